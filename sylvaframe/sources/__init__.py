"""Readers and writers: tables, cost matrices, settings, models, rule files, search logs and checkpoints.

Paths go through Spark's readers and writers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """CSV (header, all text), Parquet, ORC or JSON, by ending where the kind isn't given."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown kind of table: {kind}")


def table_from_text(spark: SparkSession, text: str) -> DataFrame:
    """A table from CSV text in memory, all columns text, empty cells null."""
    rows = [line.split(",") for line in text.replace("\r\n", "\n").split("\n") if line]
    if not rows:
        raise ValueError("the text holds no header")
    head = [h.strip() for h in rows[0]]
    return spark.createDataFrame([tuple(x or None for x in r) for r in rows[1:]], ", ".join(f"`{h}` string" for h in head))


def table_from_pandas(spark: SparkSession, features, labels, target: str = "class") -> DataFrame:
    """Features and labels as one table whose last column is the target."""
    return spark.createDataFrame(features.assign(**{target: list(labels)}))


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def read_models(spark: SparkSession, path: str):
    """The first model of a JSON file."""
    from ..plans.estimator import OptimalTreeModel

    return OptimalTreeModel.load(read_text(spark, path))


def parse_costs(spark: SparkSession, text: str, classes: list[str] | None = None) -> DataFrame:
    """(pred, truth, cost) from a matrix: the header names true classes; one row holds for every prediction, else rows
    are predictions in the header's order."""
    import csv

    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    names = [x.strip() for x in rows[0]]
    body = [[float(x) for x in r] for r in rows[1:]]
    if len(body) not in (1, len(names)):
        raise ValueError("a cost matrix has one row or one for each class")
    preds = names if classes is None or len(body) > 1 else classes
    cells = [(p, t, 0.0 if len(body) == 1 and p == t else body[0 if len(body) == 1 else i][j]) for i, p in enumerate(preds) for j, t in enumerate(names)]
    return spark.createDataFrame(cells, "pred string, truth string, cost double")


def read_costs(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    return parse_costs(spark, read_text(spark, path), classes)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(name, bits): rule files hold a name and its bits in each line."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(parts[0].alias("name"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("int")).alias("bits"))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_models(model, spark: SparkSession, path: str) -> None:
    write_text(spark, model.json(), path)


def append_timing(spark: SparkSession, seconds: float, path: str) -> None:
    spark.createDataFrame([(float(seconds),)], "seconds double").coalesce(1).write.mode("append").csv(path)


#: Columns of a search profile.
PROFILE = "iterations long, time double, lowerbound double, upperbound double, graph_size long, queue_size long, explore double, exploit double"


def write_profile(spark: SparkSession, rows: list[tuple], path: str) -> None:
    spark.createDataFrame(rows, PROFILE).coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Subproblems and links of a search. Values in the problem's integers, of any size.
NODES = "tid string, size long, leaf decimal(38,0), lower decimal(38,0), upper decimal(38,0), feature int"
LINKS = "tid string, feature int, bit int, child string"


def write_graph(tasks: DataFrame, edges: DataFrame, path: str) -> None:
    """The subproblem graph as node and link records."""
    tasks.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_graph wrote. A tree that is one leaf has no link, and no record that could tell the columns."""
    return spark.read.schema(NODES).json(f"{path}/nodes"), spark.read.schema(LINKS).json(f"{path}/links")


def save_checkpoint(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: What a search has solved: the groups of a subproblem, its cost, label and predicate (-1 where it has none).
SOLVED = "groups binary, cost string, label int, predicate int"


def save_search(spark: SparkSession, state: list[tuple[bytes, int, int, int]], path: str) -> None:
    rows = [(bytearray(k), str(cost), int(label), int(predicate)) for k, cost, label, predicate in state]
    spark.createDataFrame(rows, SOLVED).write.mode("overwrite").parquet(path)


def load_search(spark: SparkSession, path: str) -> list[tuple[bytes, int, int, int]]:
    """What save_search saved there, or nothing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(SOLVED).parquet(path).collect()
    except AnalysisException:  # no such folder yet
        return []
    return [(bytes(r["groups"]), int(r["cost"]), r["label"], r["predicate"]) for r in rows]


def rules_with_labels(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, bits, n, correct): each rule of a rule file beside the label rows' bits (name ``1`` or ``label=1``): how many
    samples it captures, and how many of those carry label 1."""
    one = labels.orderBy(F.desc("name")).limit(1).select(F.col("bits").alias("__y"))
    both = F.zip_with("bits", "__y", lambda a, b: a * b)
    count = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return rules.crossJoin(F.broadcast(one)).select("name", "bits", count(F.col("bits")).cast("long").alias("n"), count(both).cast("long").alias("correct"))


def write_log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """A special search's log, its fields apart by semicolons: state, time, objective, bound, leaves, length of the queue."""
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").csv(path, header=True, sep=";")


LOG = "state long, time double, objective double, bound double, leaves int, queue int"
