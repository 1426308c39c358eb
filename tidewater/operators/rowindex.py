"""Dense 0-based row numbers without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead: tag rows with ``monotonically_increasing_id`` (partition id in the
high bits), count rows per partition (one row per partition — bounded by the
partition count, not the data), turn the counts into start offsets on the
driver, and add them back through a broadcast of that per-partition table.
The tagged frame is written to the shared checkpoint folder first so both
passes see identical ids even if tasks are retried on other executors.

Parquet files tell a row's place themselves (:func:`with_file_index`): the place in its file plus
the rows of the files before it.  Nothing is written, and any scan gives a row the same number.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW_BITS = 33
#: files whose offsets are broadcast; beyond, the join is left to the planner
MAX_BROADCAST_FILES = 100_000


def with_row_index(df: DataFrame, name: str = "row_number", order_by: list[str] | None = None) -> DataFrame:
    """Append a dense 0-based ``name`` column (scan order, or ``order_by``)."""
    from tidewater.session import materialize
    if order_by:
        # a unique tiebreaker lets the range partitioner split a value that
        # repeats in a third of the rows; the write below fixes the ids
        src = (df.withColumn("__tie", F.monotonically_increasing_id())
                 .orderBy(*order_by, "__tie").drop("__tie"))
    else:
        src = df
    # written once to the shared checkpoint folder: both passes (and any task
    # retry) see the same ids
    tagged = materialize(src.withColumn("__mid", F.monotonically_increasing_id()), "rowindex")
    part = F.shiftright(F.col("__mid"), _LOW_BITS)
    counts = sorted((int(r["p"]), int(r["n"])) for r in
                    tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [0] + list(accumulate(n for _, n in counts))[:-1]
    spark = df.sparkSession
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "p long, start long")
    local = F.col("__mid") - F.shiftleft(part, _LOW_BITS)
    out = tagged.join(F.broadcast(offsets), part == F.col("p"), "left")
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns],
                      (F.col("start") + local).alias(name))


def with_file_index(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Append a dense 0-based ``name`` column to a plain scan of Parquet files: files in the order of their paths, rows as they stand in them.

    One count for each file first, which reads no column.
    """
    file = F.col("_metadata.file_path")
    counts = sorted((r["f"], int(r["n"])) for r in df.select(file.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each file
    starts = [0] + list(accumulate(n for _, n in counts))[:-1]
    offsets = df.sparkSession.createDataFrame([(f, s) for (f, _), s in zip(counts, starts)], "__file string, __start long")
    if len(counts) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    rows = df.select(*columns, file.alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return rows.join(offsets, "__file").select(*columns, (F.col("__start") + F.col("__at")).alias(name))
