"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator; given back as null.
NO_ID = -(2**63)

#: A word: a run of anything but ASCII white space, the same in Spark, DuckDB and numpy.
WORD = r"[^ \t\n\r\f\x0B]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one gets a
    temporary folder of its own. A size that was estimated at 2^63 bytes or more is forgotten (``_sized``).
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="termloom-"))
    return _sized(df.checkpoint(eager=True))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, with Spark's default for a table of unknown size (2^63 - 1) where its estimated size is larger.

    A checkpoint keeps the estimate of the plan that made it, which for a join is the product of both sides. In a loop that
    joins its own checkpoints the number of its digits doubles with each turn, until these numbers fill the driver's memory.
    """
    plan = df._jdf.queryExecution().logical()
    if int(plan.stats().sizeInBytes()) < 2**63:
        return df
    jvm, session = df.sparkSession._jvm, df._jdf.sparkSession()
    unknown = jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, unknown, unknown)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run``, of ``mapInPandas``; when a task is through, the allocators give free memory back to the system.

    An executor keeps its Python workers, and they would keep the most that any task needed while the JVM beside them grows.
    """

    @functools.wraps(run)
    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(frames)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return whole


def parts(df: DataFrame) -> int:
    """The session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash60(*cols: Column | str) -> Column:
    """First 60 bits of an MD5, as a non-negative BIGINT that other engines can reproduce."""
    joined = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only what an operator reads: ``_d`` (doc_id, null as NO_ID), ``text``, and further columns.

    Other columns, whatever their names, never reach an operator that returns rows of its own.
    """
    return df.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_d"), F.col("text").cast("string").alias("text"), *more)


def doc_id(c: str = "_d") -> Column:
    return F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id")


def spread_rank(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, buckets: int, key: str) -> DataFrame:
    """``out``: sum of ``weight`` over the rows of the same group that come before, in ``order``.

    ``key`` is a non-negative 60-bit column that must lead ``order``. Its top bits cut every group into
    ``buckets`` (a power of two) consecutive ranges, which are summed apart and then offset by a prefix
    sum over the small (group, range) table: a hot group is spread over all tasks.
    """
    from pyspark.sql import Window

    shift = 60 - (buckets.bit_length() - 1)
    cols = df.columns
    df = df.withColumn("_w", weight.cast("bigint")).withColumn("_b", F.shiftright(F.col(key), shift))
    sums = df.groupBy(*group, "_b").agg(F.sum("_w").alias("_s"))
    base = sums.select(*group, "_b", (F.sum("_s").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_s")).alias("_o"))
    inner = F.sum("_w").over(Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return df.withColumn("_i", inner).join(base, [*group, "_b"]).select(*cols, (F.col("_o") + F.col("_i")).alias(out))
