"""Helpers shared by the corpus operators: inputs, scratch tables, sliding sums."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from any store it knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in spark.checkpoint.dir. Where that is unset, a folder
    of our own is used, which only a local master can share with itself.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillmere/{label}-{uuid.uuid4().hex}"
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the scratch table that written() returned."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillmere/" in name:
            fs, path = _fs(spark, name)
            fs.delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished jobs before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that together name a row by its contents; equal rows share them."""
    return [
        F.xxhash64(*cols).alias("r1"),
        F.xxhash64(F.lit(0x5EED), *reversed(cols), F.lit("r2")).alias("r2"),
    ]


def prefix_sums(lengths: str, block: int = 256) -> str:
    """SQL for the exclusive running sums of an int array, linear but for short blocks.

    Sums run inside blocks of a few hundred entries and over the blocks' totals,
    so that an array of n entries costs about n * block copies, not n * n.
    """

    def running(array: str) -> str:
        return (
            f"aggregate({array}, named_struct('at', 0, 'sums', array_repeat(0, 0)), "
            "(s, x) -> named_struct('at', s.at + x, 'sums', concat(s.sums, array(s.at))), s -> s.sums)"
        )

    starts = f"if(size({lengths}) = 0, array_repeat(0, 0), sequence(1, size({lengths}), {block}))"
    totals = f"transform({starts}, b -> aggregate(slice({lengths}, b, {block}), 0, (t, x) -> t + x))"
    inner = running(f"slice({lengths}, b, {block})")
    return f"flatten(zip_with({starts}, {running(totals)}, (b, o) -> transform({inner}, y -> y + o)))"
