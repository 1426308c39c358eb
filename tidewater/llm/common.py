"""Shared helpers of the text operators: splits, Arrow row maps, and numpy
views of a batch of texts (code points, words, word hashes).

Memory in a task is bounded by an Arrow batch plus one *chunk* of about
``CHUNK`` characters; a text longer than that is cut between words where the
operator's result allows it (:func:`pieces`), else it is a chunk of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: characters handled at a time inside a task
CHUNK = 1 << 20
#: characters of the texts learned from, for each label
MAX_CHARS = 16_000_000
#: characters between words: space, \t, \n, \v, \f, \r
BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SQL_BREAKS = " \t\n\x0b\x0c\r"

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True in the fold that is never learned from (a NULL id is not in it)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sample_ids(keys: DataFrame, by: str, most: int, seed: int = 7) -> DataFrame:
    """(doc_id, ``by``): at most ``most`` ids for each value of ``by``, the first in the order of a hash of the id.

    ``keys`` has the columns doc_id and ``by``; NULLs are left out.  Rows far
    behind the bound fall out by their hash before anything is shuffled, so no
    value, however hot, gathers more than about ``most`` ids in one task.  The
    choice does not depend on how the input is partitioned.
    """
    from pyspark.sql.window import Window

    keys = keys.select("doc_id", by).where(F.col("doc_id").isNotNull() & F.col(by).isNotNull()).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    n = keys.select(by, "_h").distinct().groupBy(by).agg(F.count("*").alias("_n"))  # ids, not rows: a repeated one counts once
    near = (keys.join(F.broadcast(n), by)  # one row for each class to be learned
            .where((F.col("_h") / F.lit(2.0 ** 64) + 0.5) * F.col("_n") < 1.2 * most + 100))
    order = Window.partitionBy(by).orderBy("_h", "doc_id")
    return near.select("doc_id", by, "_h").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("doc_id", by)


def sample_texts(docs: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """(``ids`` columns, text), one row for each id: the ids (a bounded set) are broadcast, so only their texts
    leave the scan.  Of several texts of an id the first in text order is taken."""
    found = docs.select(*on, "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), on)
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def within(sample: DataFrame, by: str, most: int = MAX_CHARS) -> DataFrame:
    """A sample (few rows for each value of ``by``) cut where its texts pass ``most`` characters, in the order of a hash of
    doc_id; the first text stays whatever its length."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return sample.withColumn("_used", used).where((F.col("_used") == 0) | (F.col("_used") + F.length("text") <= most)).drop("_used")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` rows and ``MAX_CHARS`` characters of each label that may be learned from: a label of
    0 or 1 and an id outside the held-out fold.  Repeated label rows of an id count once (the largest label)."""
    y = (labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0))
         .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    return within(sample_texts(docs, sample_ids(y, "y", most), ["doc_id"]), "y")


def map_texts(df: DataFrame, keep: list[str], make, fields: list[T.StructField], text: str = "text") -> DataFrame:
    """Run ``make()(texts)`` over Arrow batches of ``df``.

    The function gets the list of a batch's texts (None for NULL) and returns
    ``(rows, columns)``: for each output row the input row it belongs to (None:
    one output row for each input row, in order) and arrays by column name.
    Columns of ``keep`` are passed through unchanged, NULLs included.
    """
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        work = make()
        for batch in batches:
            rows, columns = work(batch.column(len(keep)).to_pylist())
            ids = [batch.column(i) for i in range(len(keep))]
            if rows is not None:
                pick = pa.array(np.asarray(rows, dtype=np.int64))
                ids = [c.take(pick) for c in ids]
            yield pa.RecordBatch.from_arrays(
                ids + [c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[f.name] for f in fields)],
                names=[*keep, *(f.name for f in fields)])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def collect_texts(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows of a bounded sample, in an order that does not depend on the tasks."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# -- numpy views of texts --------------------------------------------------------------------------


def chunks(texts: list, limit: int = CHUNK):
    """Yield (rows, whole texts) with at most ``limit`` characters, or one text.  NULL and empty texts are left out."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if parts and size + len(t) > limit:
            yield np.array(rows), parts
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(t)
        size += len(t)
    if parts:
        yield np.array(rows), parts


def pieces(texts: list, limit: int = CHUNK):
    """Like :func:`chunks`, but a text longer than ``limit`` is cut at a space, so its row may come several times."""
    def cut():
        for i, t in enumerate(texts):
            if not t:
                continue
            at = 0
            while len(t) - at > limit:
                to = max(t.rfind(" ", at + 1, at + limit), t.rfind("\n", at + 1, at + limit))
                if to < 0:  # one very long word
                    nxt = [p for p in (t.find(" ", at + limit), t.find("\n", at + limit)) if p >= 0]
                    to = min(nxt, default=len(t))
                yield i, t[at:to]
                at = to
            if at < len(t):
                yield i, t[at:]

    rows, parts, size = [], [], 0
    for i, t in cut():
        if parts and size + len(t) > limit:
            yield np.array(rows), parts
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(t)
        size += len(t)
    if parts:
        yield np.array(rows), parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each part followed by a line break, and where each part starts."""
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.zeros(len(parts), dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=starts[1:])
    return codes, starts


@lru_cache(maxsize=4)
def char_table(kind: str) -> np.ndarray:
    """Boolean by code point: ``alpha`` and ``alnum`` by Unicode, ``solid``: no break between words."""
    if kind == "solid":
        out = np.ones(0x110000, dtype=bool)
        out[list(BREAKS)] = False
        return out
    test = str.isalpha if kind == "alpha" else str.isalnum
    return np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, pow(_BASE, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[s:e]``, the same wherever the run stands."""
    n = 1 << max(16, int(len(values)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum((values.astype(_U) + _U(1)) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(_U))


class HashIndex:
    """Sorted 64-bit keys with a table of their leading bits: a lookup is a few gathers."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=_U)
        bits = min(20, max(1, int(len(keys)).bit_length() + 1))
        self.shift = _U(64 - bits)
        heads = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys) or not len(keys):
            return out
        at = self.first[(keys >> self.shift).astype(np.int64)]
        last = len(self.keys) - 1
        for _ in range(self.deepest):
            hit = self.keys[at := np.minimum(at, last)] == keys
            out[hit] = at[hit]
            at = at + 1
        return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values[starts[i]:starts[i+1]]`` for each i; 0 where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    bounds = np.append(starts, len(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    """(a, b) of the logistic curve of y over score, by Newton steps, slopes held positive."""
    scale = float(np.std(score)) or 1.0
    x = np.stack([score / scale, np.ones(len(score))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = logistic(x @ w)
        grad = x.T @ (p - y) / len(y) + ridge * w * [1, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3) / scale, float(w[1])
