"""python -m sylvaframe DATA [CONFIG.json]: fit a table (target last) and print the models as JSON. DATA - reads CSV from stdin."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import sources
from .plans.config import Config
from .plans.estimator import OptimalTree


def main(args: list[str]) -> int:
    if not args or len(args) > 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sylvaframe").getOrCreate()
    config = Config.of(sources.read_config(spark, args[1]) if len(args) == 2 else None)
    df = sources.table_from_text(spark, sys.stdin.read()) if args[0] == "-" else sources.read_table(spark, args[0])
    model = OptimalTree(config).fit(df)
    print(model.json())
    return model.summary.get("status", 1)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
