"""What the operators of this subpackage share: shared folder, written intermediates, text and graph helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A temporary one is made only where it is
    unset and all executors are threads of this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {master} share no folder of this machine")
        path = tempfile.mkdtemp(prefix="paceline-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when their handles are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` is the fast way where every character is ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_words(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def bits_for(rows: int, per_bucket: int, most: int = 28) -> int:
    """How many leading hash bits make buckets of about ``per_bucket`` rows."""
    return min(most, max(0, (max(rows, 1) // per_bucket).bit_length()))


#: Parts that a hub's edges are dealt to before they meet their node's minimum.
SALTS = 16


def _with_least(e: DataFrame) -> DataFrame:
    """``e(u, v)`` with ``m``, the least v of each u. Minima are taken by (u, salt), then by u, and joined back by
    (u, salt), so that a hub's edges never meet in one task."""
    salted = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = part.groupBy(F.col("u").alias("n")).agg(F.min("m").alias("least"))
    back = part.join(low, F.col("u") == F.col("n")).select("u", "s", F.col("least").alias("m"))
    return salted.join(back, ["u", "s"]).drop("s")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``, of any ordered type: ``(node, component)``, the smallest node as component.

    Alternating large-star and small-star steps, each with its minima by (node, salt) first. The number of steps grows
    with the logarithm of the longest chain; an error is raised after ``rounds`` steps that haven't come to an end.
    Nodes without an edge are not in the result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    before, settled = _signature(e), False
    for _ in range(rounds):
        if not before[0]:
            settled = True
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _with_least(large)
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        e = checkpointed(small.distinct())
        after = _signature(e)
        if after == before:
            settled = True
            break
        before = after
    if not settled:
        raise RuntimeError(f"components didn't come to an end in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
