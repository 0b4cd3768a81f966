"""Session-level helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one in local mode (tests), else an
    error: executors of a cluster don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sylvaframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylvaframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value):
    """A broadcast whose value brings the classes and functions it needs, so that executors need not have this package:
    Spark pickles broadcasts by reference, but not closures. Call it inside a task to get the value."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under numbers, which clash with no name of an operator's own, and each name's number."""
    numbers = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*numbers.values()), numbers


def clean(spark: SparkSession) -> None:
    """Delete all that this subpackage has stored below the shared folder: token files, too. Call it once no table that was
    read from there is wanted any more; a later query stores anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sylvaframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def least_count(counts: DataFrame, n_col: str, size: int) -> int:
    """The least count that at most ``size`` rows reach. Rows are summed by levels of counts, in eighths of powers of two,
    and then by count inside the one level in which the number is passed; no task orders rows."""
    level = F.floor(F.log2(n_col) * 8)
    held = 0
    for r in sorted(counts.groupBy(level.alias("x")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["x"]):
        if held + r["c"] <= size:
            held += r["c"]
            continue
        for r in counts.filter(level == r["x"]).groupBy(F.col(n_col).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(size - held + 1).collect():
            if held + r["c"] > size:
                return r["n"] + 1
            held += r["c"]
    return 1


def frequent(counts: DataFrame, n_col: str, size: int) -> DataFrame:
    """The rows of a stored copy of counts whose count is one that at most ``size`` rows reach."""
    counts = stored(counts, "counts")
    return counts.filter(F.col(n_col) >= least_count(counts, n_col, size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: str):
    """UTF-8 bytes of a string column; null counts as none."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def crc_of(text: str):
    """Unsigned crc32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
