"""Trees, their search, and the estimator."""
