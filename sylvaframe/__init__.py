"""Optimal sparse decision trees as Spark queries.

``functions`` holds column expressions, ``operators`` DataFrame operators (profiling, encoding, compression, splits,
bitmaps, metrics), ``sources`` readers and writers, ``plans`` the tree, its search and the estimator, ``streaming`` the
scoring of streams, ``catalogue`` the registered queries.
"""
