"""Gapless global row numbers with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

ROWS_PER_BUCKET = 100_000
RUN = 10_000


def number_rows(df: DataFrame, rows: int, out: str = "row_number") -> DataFrame:
    """All rows of ``df`` with ``out``: 0 to ``rows`` - 1, the same on each run for the same rows.

    Rows fall into buckets of about 100,000 by a hash of all columns, are ordered inside their bucket and get the
    bucket's offset, so no task sees more than its buckets. Equal rows, however many, are counted before the shuffle and
    numbered as a run; which of them gets which number makes no difference. Only the bucket sizes (one row per 100,000)
    are added up in one task. ``rows`` is the row count of ``df``.
    """
    key = F.xxhash64(*[F.col(c) for c in df.columns])
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies")).withColumn("_key", key).withColumn(
        "_bucket", F.pmod("_key", F.lit(buckets)))
    sizes = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy("_key", *df.columns).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, "_bucket")
    first = F.col("_offset") + F.col("_inside")
    runs = placed.select(*df.columns, (first + F.col("_copies")).alias("_end"), F.explode(
        F.sequence(first, first + F.col("_copies") - 1, F.lit(RUN))).alias("_begin"))
    return runs.select(*df.columns, F.explode(F.sequence(
        F.col("_begin"), F.least(F.col("_begin") + RUN, F.col("_end")) - 1)).alias(out))
