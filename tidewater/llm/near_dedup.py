"""Near-duplicate classes by BagMinHash.

A text is the bag (multiset) of its five-word shingles; two texts are linked if
their weighted Jaccard similarity, sum of minima over sum of maxima of the
shingle counts, is ``SIMILARITY`` or more.  A class is a connected component of
links; its id is its smallest doc_id.

1. *Copies.*  Equal texts are one node, by SHA-256, counted map-side.
2. *Signatures.*  Shingle counts are discretised weights.  Each shingle owns a
   Poisson process over [0, weight): a hierarchy of dyadic ranges [0,1), [1,2),
   [2,4), ... with rates 1, 1, 2, ..., the last one thinned to the weight.  Every
   arrival falls into one of ``BANDS * ROWS`` components; a component's value is
   its earliest arrival, so two bags agree in a component with probability equal
   to their weighted Jaccard similarity.  Arrivals are generated in time order
   and only up to the time by which all components are filled, about m ln m of
   them however long the text.
3. *Bands.*  Nodes that agree in all rows of a band share a bucket: a pair at
   0.8 meets in some bucket with probability above 0.9998.
4. *Verification.*  No bucket is expanded into pairs.  Each member is first
   compared with its bucket's smallest node, by exact multiset overlap of the
   texts.  Buckets whose members are then in one component are done: of a large
   group of copies nothing is left.  The members of the others meet in blocks of
   ``BLOCK``, two blocks in a task, which compares those of different components
   whose signatures agree in ``AGREE`` of the components (five standard
   deviations below 0.8), each pair in the first bucket that it shares, and
   returns links only.  So no link between components is lost to a pivot.

All sets (signatures, buckets, pairs, components) are Spark tables in the shared
checkpoint folder; the driver sees counts only.

Defined cases: a NULL text or one without words is a class of its own, with its
doc_id as class id (all such rows of one id share it); a text of fewer than
five words has one shingle, all of its words; rows with equal texts share a
class whatever their ids; a class without any non-NULL id has a NULL class id;
an empty table gives no rows.  Only ``doc_id`` and ``text`` are read, so further
columns do no harm.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C
from tidewater.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
#: share of agreeing components from which on a later pair is verified
AGREE = 0.65
#: members of a bucket that are compared with each other in one task
BLOCK = 512
_M = BANDS * ROWS
_U = np.uint64


# -- signatures ------------------------------------------------------------------------------------


def shingles(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle occurrence, its text), in the order of the texts."""
    codes, starts = C.code_points(parts)
    begin, end = C.word_spans(C.char_table("solid")[codes])
    words = C.run_hashes(codes, begin, end)
    owner = np.searchsorted(starts, begin, side="right") - 1
    n = np.bincount(owner, minlength=len(parts))
    first = np.cumsum(n) - n
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(parts)), count)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    left = n[owner]
    h = np.minimum(left, SHINGLE).astype(_U)
    last = max(len(words) - 1, 0)
    for k in range(SHINGLE):
        word = words[np.minimum(at + k, last)] if len(words) else h
        h = np.where(k < left, C.mix(h ^ word), h)
    return h, owner


def bags(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, weight) of every distinct shingle of each text."""
    h, owner = shingles(parts)
    _, first, weight = np.unique(C.mix(h ^ (owner.astype(_U) * _U(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
    return h[first], owner[first], weight


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1], from the leading 53 bits."""
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def signatures(parts: list[str], m: int = _M) -> tuple[np.ndarray, np.ndarray]:
    """(texts, m) earliest arrivals, and the total weight of each text; infinite for a text without words."""
    shingle, owner, weight = bags(parts)
    total = np.bincount(owner, weights=weight, minlength=len(parts))
    out = np.full(len(parts) * m, np.inf)
    # a process for each shingle and dyadic range that its weight reaches into
    seed, text, rate, low, high = [shingle], [owner], [np.ones(len(shingle))], [np.zeros(len(shingle))], [np.ones(len(shingle))]
    k = 1
    while len(more := np.flatnonzero(weight > 2 ** (k - 1))):
        seed.append(C.mix(shingle[more] + _U(k)))
        text.append(owner[more])
        rate.append(np.full(len(more), 2.0 ** (k - 1)))
        low.append(rate[-1])
        high.append(weight[more].astype(float))  # heights from here on are thinned out
        k += 1
    seed, text, rate, low, high = (np.concatenate(x) for x in (seed, text, rate, low, high))
    until = m * (np.log(m) + 3) / np.maximum(total, 1)
    alive = np.arange(len(seed))
    while len(alive):
        _arrivals(out, m, seed[alive], text[alive], rate[alive], low[alive], high[alive], until)
        # texts with a component left empty (about one in twenty) go on to later arrivals
        open_ = np.zeros(len(parts), dtype=bool)
        open_[np.flatnonzero(np.isinf(out)) // m] = True
        until = until * 2
        alive = alive[open_[text[alive]]]
    return out.reshape(len(parts), m), total


def _arrivals(out, m, seed, text, rate, low, high, until):
    """Note the arrivals of all processes up to their text's time."""
    time, k = np.zeros(len(seed)), 0
    state = seed.copy()
    until = until[text]
    slot = text * m
    while len(state):
        k += 1
        state = C.mix(state ^ _U(k))
        time = time - np.log(_uniform(state)) / rate
        keep = time <= until
        state, time, until, rate, slot, low, high = (x[keep] for x in (state, time, until, rate, slot, low, high))
        draw = C.mix(state ^ _U(0xA5A5A5A5))
        inside = low + rate * _uniform(C.mix(draw)) <= high
        where = slot + ((draw >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        np.minimum.at(out, where[inside], time[inside])


def band_keys(values: np.ndarray) -> np.ndarray:
    """(texts, BANDS) one 64-bit key for each band."""
    rows = values.reshape(len(values), BANDS, ROWS).view(_U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = C.mix(key ^ rows[:, :, k])
    return key


def _sign():
    def work(texts):
        n = len(texts)
        weight = np.zeros(n)
        bands, sketch = [None] * n, [None] * n
        for rows, parts in C.chunks(texts, C.CHUNK // 2):
            values, total = signatures(parts)
            keys = band_keys(values).view(np.int64)
            short = (C.mix(values.view(_U)) & _U(0xFFFF)).astype(np.uint16)
            weight[rows] = total
            for i, r in enumerate(rows):
                if total[i]:
                    bands[r], sketch[r] = keys[i], short[i].tobytes()
        return None, {"weight": weight, "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())}
    return work


# -- verification ----------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles([text])[0], return_counts=True)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle bags; 0 if either has no words."""
    (x, m), (y, n) = _bag(a), _bag(b)
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _verify(batches):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        ok = np.array([similarity(a[i].as_py(), b[i].as_py()) >= SIMILARITY for i in range(batch.num_rows)], dtype=bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar.  ``texts``: (node, text).  A node in very many pairs is a skewed key that Spark splits."""
    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("_a")), "u")
    both = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("_b")), "v")
    return both.select("u", "v", "_a", "_b").mapInArrow(_verify, "u long, v long")


# -- components ------------------------------------------------------------------------------------


def contract(edges: DataFrame) -> DataFrame | None:
    """(node, label) for every node of ``edges`` (u, v): the label is one node of its component; None without edges.

    Each step hooks every node to one neighbour and contracts the edges: first
    to the smallest, as pairs are stars around a bucket's smallest node, then to
    the first in a random order drawn anew, so that the number of steps grows
    with the logarithm of the longest path that is left.
    """
    edges = materialize(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels, step = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(step)) if step else F.lit(0)).alias("h"), F.col(c).alias("x"))  # noqa: B023,E731
        both = edges.select("u", "v").union(edges.select("v", "u"))
        first = F.least(F.min(rank("v")), F.min(rank("u")))["x"]
        hooks = materialize(both.groupBy("u").agg(first.alias("to")), "hooks")
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            labels = materialize(_relabelled(labels, hooks.select(F.col("u").alias("node"), F.col("to").alias("label"))), "labels")
        a, b = hooks.select(F.col("u"), F.col("to").alias("a")), hooks.select(F.col("u").alias("v"), F.col("to").alias("b"))
        edges = edges.join(a, "u").join(b, "v").where("a != b")
        edges = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        step += 1
    return labels


def _relabelled(labels: DataFrame, change: DataFrame) -> DataFrame:
    """``labels`` (node, label) after its labels have been given labels by ``change``."""
    by = change.select(F.col("node").alias("_l"), F.col("label").alias("_to"))
    return labels.join(by, F.col("label") == F.col("_l"), "left").select("node", F.coalesce("_to", "label").alias("label"))


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` with further links: only components that these connect are contracted."""
    if labels is None:
        return contract(links)
    name = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    ends = links.join(name("u", "a"), "u", "left").join(name("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    change = contract(ends)
    if change is None:
        return labels
    fresh = change.join(labels, "node", "left_anti")  # nodes that had no link before; the others are labels, or have got one
    return materialize(_relabelled(labels, change).unionByName(fresh), "labels")


# -- classes ---------------------------------------------------------------------------------------


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (see the module)."""
    signed, final = _classes(docs)
    # a text held by a third of all rows is a skewed key on this side only
    out = signed.select("doc_id", "key", "weight").join(final.select("key", "class_id"), "key", "left")
    return out.select("doc_id", F.when(F.coalesce(F.col("weight"), F.lit(0.0)) > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each class (the smallest doc_id; of repeated rows of
    that id and text any one), and all without words."""
    names = docs.columns
    signed, final = _classes(docs)
    stay = materialize(final.where("first").select(F.col("key").alias("__key"), F.col("first_id").alias("__id")), "kept-keys")
    blank = F.length(F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(C.SQL_BREAKS))) == 0
    # one column to join by: a hot text is one key on one side, and no row leaves twice
    rows = docs.withColumn("__key", _key(F.col("text")))
    kept = rows.where(~blank).join(stay, (rows["__key"] == stay["__key"]) & rows["doc_id"].eqNullSafe(stay["__id"]), "left_semi")
    again = materialize(signed.where("weight > 0").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
                        .select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")), "repeated-rows")
    if not again.isEmpty():
        same = (kept["__key"] == again["__key"]) & kept["doc_id"].eqNullSafe(again["__id"])
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return kept.select(*names).unionByName(docs.where(blank))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, weight, ... of each row), (key, class_id, first_id, first) of each distinct text with words;
    ``first`` marks the text that stands for its class."""
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"), "text")
    fields = [T.StructField("weight", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    signed = materialize(C.map_texts(rows, ["doc_id", "key"], _sign, fields), "signatures")
    nodes = (signed.where("weight > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(nodes, "nodes")
    # buckets with more than one member
    spread = nodes.select("node", F.explode("bands").alias("b"))
    shared = spread.groupBy("b").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n")
    members = materialize(spread.join(shared, "b"), "members")
    used = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = materialize(docs.select(_key(F.col("text")).alias("key"), "text").join(used, "key")
                        .groupBy("node").agg(F.first("text").alias("text")), "texts")
    pairs = materialize(members.where("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    labels = joined(None, materialize(verified(pairs, texts), "links"))
    members = materialize(_undecided(members.select("b", "node"), labels), "undecided")
    if not members.isEmpty():
        labels = joined(labels, materialize(_rest(members, nodes, texts), "links"))
    named = nodes.select("key", "node", "first_id")
    if labels is None:
        named = named.withColumn("label", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")
    heads = named.groupBy("label").agg(F.min(order).alias("head"))
    final = named.join(heads, "label").select("key", F.col("head.first_id").alias("class_id"), "first_id", (F.col("node") == F.col("head.node")).alias("first"))
    return signed, final


def _undecided(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(b, node, label) of the buckets whose members are in more than one component."""
    named = members.withColumn("label", F.col("node")) if labels is None else (
        members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_ = named.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("b")
    return named.join(open_, "b").select("b", "node", "label")


def _rest(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between different components of the undecided buckets' members (b, node, label).

    A bucket is cut into blocks of about ``BLOCK`` members by a hash; every two
    blocks meet in one task, which compares their members in memory and returns
    links only, at most one for each member.
    """
    size = members.groupBy("b").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    cells = (members.join(size, "b").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("b", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "label"))
    full = cells.join(nodes.select("node", "sketch", "bands"), "node").join(texts, "node")
    return full.groupBy("b", "lo", "hi").applyInPandas(_compare, "u long, v long")


def _compare(key, rows):
    """Links of one cell: pairs of different components, in the first bucket that they share only, whose signatures
    agree in ``AGREE`` of the components and whose texts are similar; none between members linked already here."""
    import pandas as pd

    b, lo, hi = key
    rows = rows.sort_values("node", ignore_index=True)
    node, label, mine = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["mine"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint16).reshape(-1, _M)
    bands = np.stack([np.asarray(x, dtype=np.int64) for x in rows["bands"]])
    units: dict = {}

    def bag(i):
        """A bag as a set: the k-th copy of a shingle is an element of its own."""
        if i not in units:
            h, _ = shingles([rows["text"][i]])
            h = np.sort(h)
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            copy = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
            units[i] = set(C.mix(h + copy.astype(_U) * _U(0x9E3779B97F4A7C15)).tolist())
        return units[i]

    root = {x: x for x in set(label.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(node)):
        after = np.arange(i + 1, len(node))
        if lo != hi:
            after = after[mine[after] != mine[i]]
        after = after[label[after] != label[i]]
        if not len(after):
            continue
        after = after[(sketch[after] == sketch[i]).mean(axis=1) >= AGREE]
        if not len(after):
            continue
        shared = bands[after] == bands[i]
        after = after[bands[i][shared.argmax(axis=1)] == b]
        for j in after.tolist():
            x, y = find(int(label[i])), find(int(label[j]))
            if x == y:
                continue
            a, c = bag(i), bag(j)
            both = len(a & c)
            if both >= SIMILARITY * (len(a) + len(c) - both):
                root[x] = y
                out.append((int(node[i]), int(node[j])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return classes(C.table(spark, sf_dir, "documents"))
