"""Trees: scoring, folding, exports, streams."""

import json

import pytest
from pyspark.sql import functions as F

from sylvaframe import sources
from sylvaframe.operators.bitmaps import Bits
from sylvaframe.plans.tree import Leaf, Split, TreeModel, nested
from sylvaframe.streaming import drift, score

TREE = TreeModel(Split("x", ">=", 5, Split("c", "==", "red", Leaf("a", 0.1, 0.05), Leaf("b", 0.0, 0.05)), Split("x", ">=", 2, Leaf("b", 0.2, 0.05), Leaf("a", 0.0, 0.05))))


def test_scores(spark):
    df = spark.createDataFrame([("9", "red"), ("9", None), ("3", "red"), (None, "red")], "x string, c string")
    got = TREE.transform(df).select("prediction", "leaf", F.round("confidence", 3)).collect()
    assert [tuple(r) for r in got] == [("a", 0, 0.9), ("b", 1, 1.0), ("b", 2, 0.8), ("a", 3, 1.0)]


def test_shape():
    assert (TREE.leaves(), TREE.nodes(), TREE.maximum_depth(), len(TREE)) == (4, 7, 3, 4)
    assert TREE.features() == {"x", "c"} and len(TREE.encoded_features()) == 3
    assert TREE.objective() == pytest.approx(0.5)


def test_exports():
    again = TreeModel.of(TREE.json())
    assert again.json() == TREE.json() and json.loads(TREE.json())["reference"] == 5
    assert "2 <= x < 5" in str(TREE) and "c != red and x >= 5" in str(TREE)
    assert TREE.latex() == "[ $x \\ge 5$ [ $c = red$ [ $a$ ] [ $b$ ] ] [ $x \\ge 2$ [ $b$ ] [ $a$ ] ] ]"
    assert [c["in"] for c in TREE.nary()["children"]] == [[None, 2], [2, 5], [5, None]]
    with pytest.raises(ValueError):
        TreeModel.of([])


def test_nested():
    root = nested([[("x >= 5", True)], [("x >= 5", False), ("y >= 1", True)], [("x >= 5", False), ("y >= 1", False)]], ["a", "b", "c"], [0, 0, 0], 0.1)
    assert root.feature == "x" and root.false.feature == "y" and root.false.true.prediction == "b"


def test_relations(spark):
    for relation, want in ((">=", "101"), ("<=", "011"), (">", "100"), ("<", "010"), ("==", "001")):
        t = TreeModel(Split("x", relation, 2, Leaf("1", 0, 0), Leaf("0", 0, 0)))
        rows = t.transform(spark.createDataFrame([(3,), (1,), (2,)], "x int")).collect()
        assert "".join(r["prediction"] for r in rows) == want


def test_files(spark, tmp_path):
    sources.write_text(spark, f"[{TREE.json()}]", f"{tmp_path}/m")
    assert sources.read_models(spark, f"{tmp_path}/m").tree.json() == TREE.json()
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n")
    assert [tuple(r) for r in sources.read_table(spark, f"{tmp_path}/t.csv").collect()] == [("1", "x"), (None, "y")]
    (tmp_path / "r.txt").write_text("one 0 1 1\ntwo 1\n\n")
    assert [(r.name, r.bits) for r in sources.read_rules(spark, f"{tmp_path}/r.txt").collect()] == [("one", [0, 1, 1]), ("two", [1])]
    sources.append_timing(spark, 1.5, f"{tmp_path}/time")
    sources.append_timing(spark, 2.5, f"{tmp_path}/time")
    assert spark.read.csv(f"{tmp_path}/time").count() == 2
    sources.write_profile(spark, [(1, 0.1, 0.0, 1.0, 3, 0, 0.0, 0.0)], f"{tmp_path}/p")
    assert spark.read.csv(f"{tmp_path}/p", header=True).columns[0] == "iterations"
    sources.save_checkpoint(spark.range(3), f"{tmp_path}/c")
    assert sources.load_checkpoint(spark, f"{tmp_path}/c").count() == 3


def test_bits():
    x = Bits.of([1, 2, 5])
    assert Bits.positions(x) == [1, 2, 5] and Bits.runs(x) == 2
    assert (Bits.following(x, 3), Bits.following(x, 6), Bits.preceding(x, 4), Bits.preceding(x, 0)) == (5, -1, 2, -1)


def test_stream(spark, sf, tmp_path):
    model = TreeModel(Split("value", ">=", 50, Leaf("high", 0, 0), Leaf("low", 0, 0)))
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")
    for name, df in (("scored", score(stream, model).select("event_id", "prediction")), ("windows", drift(stream, model, "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "scored" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("scored").count() == table.count()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == table.count()
