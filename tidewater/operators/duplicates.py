"""Duplicate flags for UNIQUE (one column) and DUPLICATE_CHECK (whole row).

Every occurrence of a value (or row) that appears at least twice fails; NULLs
count as equal values.  The result is exact.

Plan, chosen for long keys (document text, whole rows) and for skew (one
value may hold a third of all rows):

(Keys of at most three fixed-width columns skip steps 1-2 and are grouped
directly: their hash would be no cheaper than the values.)

1. ``candidates`` — ``groupBy(xxhash64(keys)).count() > 1``: an aggregate on
   an 8-byte key with map-side partial aggregation, so neither long text nor
   a hot value's raw rows cross the shuffle.
2. ``duplicates`` — only rows whose hash is a candidate are grouped by the
   real key values (exact; a hash collision is resolved here), again with
   partial aggregation.  Result: one row per duplicated value.
3. the flag is a left join on ``(hash, keys)`` with null-safe equality.  The
   duplicate side has one row per value, so the only possibly hot side is the
   probe side.  The duplicate set is written once to the shared checkpoint
   folder and its size measured: at most 128 MB (setting
   ``spark.tidewater.duplicates.broadcastLimitBytes``) it is broadcast and
   the probe side is never shuffled; beyond that the sort-merge join's skewed
   partitions are split by AQE's skew-join handling.  Nothing is broadcast on
   assumption.

A window ``count() over (partition by key)`` would instead pull all rows of a
hot value into one task and sort them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_hash(cols: list[str]) -> Column:
    # xxhash64 skips NULL inputs, so different NULL patterns may collide;
    # step 2 compares the real values, which keeps the result exact.
    return F.xxhash64(*[F.col(_q(c)) for c in cols])


def candidate_hashes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Hashes occurring at least twice (8-byte keys, partial aggregation)."""
    return (df.select(key_hash(cols).alias("__h")).groupBy("__h")
              .agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__h"))


_FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DateType, T.TimestampType, T.TimestampNTZType)


def is_narrow(df: DataFrame, cols: list[str], max_cols: int = 3) -> bool:
    """Keys of at most ``max_cols`` fixed-width columns: grouping on them is
    as cheap as grouping on their hash, so the pre-filter would only add a pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return len(cols) <= max_cols and all(isinstance(types[c], _FIXED_WIDTH) for c in cols)


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact duplicated values with their hash ``__h`` and multiplicity ``__n``."""
    if is_narrow(df, cols):
        return (df.groupBy(*[F.col(_q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
                  .where(F.col("__n") > 1).select(key_hash(cols).alias("__h"), *[F.col(_q(c)) for c in cols], "__n"))
    cand = candidate_hashes(df, cols)
    rows = df.select(key_hash(cols).alias("__h"), *[F.col(_q(c)) for c in cols]).join(cand, "__h", "left_semi")
    return (rows.groupBy("__h", *[F.col(_q(c)) for c in cols])
                .agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1))


BROADCAST_LIMIT_CONF = "spark.tidewater.duplicates.broadcastLimitBytes"
DEFAULT_BROADCAST_LIMIT = 128 * 1024 * 1024


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(DEFAULT_BROADCAST_LIMIT)))


def flag_duplicates(df: DataFrame, cols: list[str], flag: str, base: DataFrame | None = None,
                    materialize_keys: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """Add boolean column ``flag``: True when the row's ``cols`` value repeats.

    ``base`` is the frame the counts come from (default ``df``); passing the
    unflagged input keeps several flag joins from re-running each other.
    ``materialize_keys`` writes the duplicate-key set (one row per duplicated
    value) to the shared checkpoint folder once, so frames read several times
    do not recompute it and the join sees its measured size.  Values of ``taken`` (column ``key``) count as
    repeated wherever they occur (one column only).
    """
    keys = [f"__dk{i}" for i in range(len(cols))]
    dup_set = duplicate_keys(base if base is not None else df, cols)
    if taken is not None:
        own = (base if base is not None else df).select(key_hash(cols).alias("__h"), F.col(_q(cols[0]))).distinct()
        again = own.join(taken, own[_q(cols[0])].eqNullSafe(taken["key"]), "left_semi")
        dup_set = dup_set.select("__h", F.col(_q(cols[0]))).unionByName(again).distinct()
    small = False
    if materialize_keys:
        from tidewater.session import materialize_measured
        dup_set, size, in_memory = materialize_measured(dup_set.select("__h", *[F.col(_q(c)) for c in cols]), "dupkeys")
        # files are compressed: what counts is the size in memory
        small = size <= broadcast_limit(df) and in_memory <= broadcast_limit(df)
    dups = dup_set.select(
        F.col("__h").alias("__dh"),
        *[F.col(_q(c)).alias(k) for c, k in zip(cols, keys)],
        F.lit(True).alias(flag),
    )
    probe = df.withColumn("__ph", key_hash(cols))
    cond = probe["__ph"] == dups["__dh"]
    for c, k in zip(cols, keys):
        cond = cond & probe[_q(c)].eqNullSafe(dups[k])
    # measured small -> broadcast (the probe side is never shuffled); otherwise
    # a shuffled join whose hot partitions AQE's skew-join splits
    joined = probe.join(F.broadcast(dups) if small else dups, cond, "left")
    return joined.select(*[probe[_q(c)] for c in df.columns],
                         F.coalesce(F.col(flag), F.lit(False)).alias(flag))
