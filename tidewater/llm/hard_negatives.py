"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

*Blocks.*  Vectors (quantised to integers) are sorted along a Hilbert curve over ``AXES`` projected axes
and written as a Parquet table with one row for each block of ``BLOCK`` neighbours: ids, labels, the packed
matrix, and its zone map, the least and largest value of every dimension.

*Bounds.*  For an anchor and a block, interval arithmetic over the zone map gives the least and
largest inner product that any of its rows can have.  Two matrix products bound many anchors and blocks at once.

*Search*, twice: first an anchor's positives (the best rows of its label), then, for each positive, the best rows of other labels
within a window of scores.  The anchor's own block is read first.  Its results raise the
lower end of the search (to the last of the best found, if there are enough; of equal scores only smaller ids still count), and only blocks whose
bounds meet what is left are read.  Blocks and the searches that need them meet in a shuffle by block: a block's
matrix is moved once, a search's vectors once for each block that it must read.  All matches that may still count leave the task, at most the
wanted number for each search and block; a window function ranks them.

The zone maps are broadcast if they take at most ``ZONE_BYTES`` (a bound on their size, not a sample); otherwise they are dealt out in shards, and every anchor meets every shard.

The axes are principal directions of at most ``SAMPLE`` rows (chosen by a hash of the id); they decide
only which vectors are neighbours, never a result.

Defined cases: a row with a NULL id, label or vector, with a NULL or non-finite component, or with a vector of another
length than most rows (the longest of several) takes no part; equal rows (id, label and quantised vector) count once;
rows that share an id but differ are rows each; an empty table gives no rows; scores must fit 64 bits (an
error otherwise).  Only the three columns named are read, so further columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import common as C
from tidewater.session import materialize

BLOCK = 1024
AXES, BITS = 8, 8
SAMPLE = 20_000
ZONE_BYTES = 64 << 20
#: blocks in a shard of the zone maps, where they are not broadcast
SHARD = 4096
_LOW = -(1 << 62)


# -- order -----------------------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (``bits`` bits on each axis, 64 in all at most)."""
    x = [c.astype(np.uint64) for c in cells.T]
    zero = np.zeros(len(cells), dtype=np.uint64)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell on
        below = np.uint64(q - 1)
        for i in range(len(x)):
            flip = (x[i] & np.uint64(q)) != 0
            swap = np.where(flip, zero, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(flip, below, zero) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = zero, 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = zero
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << np.uint64(1) | ((c ^ turn) >> np.uint64(b) & np.uint64(1))
    return key


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def fit_axes(rows: DataFrame, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cell limits on each) from a bounded sample."""
    near = F.xxhash64("vec_id") / F.lit(2.0 ** 64) + 0.5
    got = rows.where(near * n < SAMPLE).select("vec_id", "embedding").limit(2 * SAMPLE).toArrow()
    if not got.num_rows:  # few rows, none of them drawn
        got = rows.select("vec_id", "embedding").limit(SAMPLE).toArrow()
    x = _matrix(got.column("embedding").combine_chunks(), d)
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return np.eye(d, min(AXES, d)), np.zeros((min(AXES, d), (1 << BITS) - 1))
    _, v = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))
    axes = v[:, ::-1][:, :AXES]
    return axes, np.quantile(x @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T


# -- packing ---------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes, which the first byte tells."""
    top = int(np.abs(x).max()) if x.size else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + np.ascontiguousarray(x, dtype=f"<i{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in doubles where no sum can pass 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top >= 2.0 ** 62:
        raise ValueError("an inner product does not fit 64 bits")
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with anything between ``low`` and ``high`` (one zone a row)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best among ``ok``: higher scores first, ties by smaller id."""
    at = np.flatnonzero(ok)
    if len(at) > most:
        cut = np.partition(score[at], len(at) - most)[len(at) - most]
        at = at[score[at] >= cut]
    return at[np.lexsort((ids[at], -score[at]))[:most]]


# -- blocks and anchors ----------------------------------------------------------------------------

_BLOCK = "block long, n int, first long, ids binary, labels binary, vectors binary, low binary, high binary"


def write_blocks(rows: DataFrame, scale: int, axes: np.ndarray, limits: np.ndarray, size: int = BLOCK) -> DataFrame:
    """The block table of (vec_id, label, embedding) rows, quantised by ``floor(scale * x)``."""
    d = len(axes)

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column(2), d)
            ok = np.isfinite(x).all(axis=1)
            x = x[ok]
            q = np.floor(scale * x)
            if np.abs(q).max(initial=0) >= 2.0 ** 30:
                raise ValueError("a component does not fit 31 bits")
            cell = np.stack([np.searchsorted(limit, c, side="right") for limit, c in zip(limits, (x @ axes).T)], axis=1)
            key = (hilbert(cell, BITS) ^ np.uint64(1 << 63)).astype(np.int64)
            q = np.ascontiguousarray(q, dtype="<i4")
            pick = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(key), pa.array([r.tobytes() for r in q], pa.binary())],
                                             names=["vec_id", "label", "key", "q"])

    def blocks(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, done, before = [], 0, None

        def row(part):
            nonlocal done
            ids, labels = (np.array([r[k] for r in part], dtype=np.int64) for k in (0, 1))
            q = np.frombuffer(b"".join(r[2] for r in part), dtype="<i4").reshape(-1, d).astype(np.int64)
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([first + done - 1]), pa.array([len(part)], pa.int32()), pa.array([int(ids.min())]), *(
                pa.array([_pack(x)], pa.binary()) for x in (ids, labels, q, q.min(axis=0), q.max(axis=0)))], names=["block", "n", "first", "ids", "labels", "vectors", "low", "high"])
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if r != before:  # equal rows are neighbours here
                    held.append(r)
                    before = r
                if len(held) == size:
                    yield row(held)
                    held = []
        if held:
            yield row(held)

    q = rows.mapInArrow(keyed, "vec_id long, label long, key long, q binary")
    order = ["key", "vec_id", "label", "q"]
    return q.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "q").mapInArrow(blocks, _BLOCK)


#: searches of one home block: for each anchor its place there, id, label and vector; for each search the anchor it belongs to, its number, the scores it looks
#: for (``low`` itself only with ids below ``upto``), and the score of its positive
_SEARCH = "home long, place binary, anchor binary, labels binary, vectors binary, who binary, number binary, low binary, upto binary, high binary, target binary"
_FIELDS = [f.split()[0] for f in _SEARCH.split(", ")]


def _search(row: dict) -> dict:
    out = {k: _unpack(v) if k != "home" else v for k, v in row.items() if k in _FIELDS}
    out["vectors"] = out["vectors"].reshape(len(out["anchor"]), -1)
    return out


def _packed(s: dict, pick: np.ndarray) -> list:
    """The searches ``pick`` of ``s`` with the anchors that they need."""
    used, who = np.unique(s["who"][pick], return_inverse=True)
    own = {k: s[k][used] for k in ("place", "anchor", "labels", "vectors")} | {k: s[k][pick] for k in ("number", "low", "upto", "high", "target")} | {"who": who}
    return [s["home"], *(_pack(own[k]) for k in _FIELDS[1:])]


def _own_anchors(every: int, d: int):
    """Searches for the positives of each block's anchors."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, labels, q = (_unpack(r[k]) for k in ("ids", "labels", "vectors"))
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    m = len(at)
                    out.append([r["block"], *map(_pack, (at, ids[at], labels[at], q.reshape(-1, d)[at], np.arange(m), np.zeros(m, int), np.full(m, _LOW), np.full(m, -_LOW), np.full(m, -_LOW), np.zeros(m, int)))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out))], names=_FIELDS)
    return run


_HIT = "home long, place long, number long, anchor long, target long, id long, score long"


def _read(searches: DataFrame, blocks: DataFrame, same: bool, most: int, d: int) -> DataFrame:
    """Matches of searches (with the ``block`` that each is to read): at most ``most`` for each search and block."""
    left = blocks.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("home"), F.lit(None).cast("binary").alias("place"), F.col("ids").alias("anchor"), "labels", "vectors",
                         *[F.lit(None).cast("binary").alias(k) for k in _FIELDS[5:]])
    right = searches.select("block", F.lit(1).alias("kind"), *_FIELDS)
    met = left.join(right.select("block").distinct(), "block", "left_semi").unionByName(right).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches):
        ids = labels = q = None
        for batch in batches:
            out = [np.zeros((7, 0), dtype=np.int64)]
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ["block", "kind", *_FIELDS]}
                if r["kind"] == 0:
                    ids, labels, q = _unpack(r["anchor"]), _unpack(r["labels"]), _unpack(r["vectors"]).reshape(-1, d)
                    continue
                s = _search(r)
                score = products(s["vectors"], q)
                own = s["labels"][:, None] == labels
                ok = own if same else ~own
                if s["home"] == r["block"]:
                    ok[np.arange(len(s["place"])), s["place"]] = False  # the anchor itself
                for k, (a, low, upto, high) in enumerate(zip(s["who"], s["low"], s["upto"], s["high"])):
                    at = _best(score[a], ids, ok[a] & (score[a] >= low) & (score[a] <= high) & ((score[a] > low) | (ids < upto)), most)
                    if len(at):
                        one = np.ones(len(at), dtype=np.int64)
                        out.append(np.stack((one * s["home"], one * s["place"][a], one * s["number"][k], one * s["anchor"][a], one * s["target"][k], ids[at], score[a][at])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=[f.split()[0] for f in _HIT.split(", ")])
    return met.mapInArrow(run, _HIT)


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("home", "place", "number").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _raised(searches: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """Searches with their lower ends raised to the last of the ``most`` best hits, where there are so many."""
    enough = _ranked(hits, most).where(F.col("rank") == most).groupBy("home").agg(F.collect_list(F.struct("place", "number", "score", "id")).alias("enough"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = _search(r)
                least = {(e["place"], e["number"]): (e["score"], e["id"]) for e in r["enough"] or []}  # within the search, so not below its low end
                ends = [least.get((int(s["place"][a]), int(k)), (low, upto)) for a, k, low, upto in zip(s["who"], s["number"], s["low"], s["upto"])]
                s["low"], s["upto"] = np.array(ends, dtype=np.int64).reshape(-1, 2).T
                out.append(_packed(s, np.arange(len(s["who"]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out))], names=_FIELDS)
    return searches.join(enough, "home", "left").mapInArrow(run, _SEARCH)


def _choose(searches: DataFrame, blocks: DataFrame, d: int) -> DataFrame:
    """Searches, once for each block (but their own) whose bounds meet what they look for: with ``block``."""
    n = blocks.count()
    zones = blocks.select("block", "first", "low", "high")

    def wanted(batch, name, first, low, high):
        """(search rows, blocks) of the searches of a batch against zones."""
        out = []
        for r in batch.to_pylist():
            s = _search({k: r[k] for k in _FIELDS})
            least, most = bounds(s["vectors"], low, high)
            most, end = most[s["who"]], s["low"][:, None]
            need = ((most > end) | (most == end) & (first < s["upto"][:, None])) & (least[s["who"]] <= s["high"][:, None]) & (name != s["home"])
            for b in np.flatnonzero(need.any(axis=0)):
                out.append([int(name[b]), *_packed(s, np.flatnonzero(need[:, b]))])
                if len(out) >= 1000:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out))], names=["block", *_FIELDS])

    def pack(rows):
        return (*(np.array([r[k] for r in rows], dtype=np.int64) for k in ("block", "first")), *(np.array([_unpack(r[k]) for r in rows], dtype=np.int64).reshape(-1, d) for k in ("low", "high")))

    schema = f"block long, {_SEARCH}"
    if n * d * 16 <= ZONE_BYTES:
        shared = searches.sparkSession.sparkContext.broadcast(pack(sorted(zones.toArrow().to_pylist(), key=lambda r: r["block"])))

        def run(batches):
            for batch in batches:
                yield from wanted(batch, *shared.value)
        return searches.mapInArrow(run, schema)
    shards = -(-n // SHARD)
    left = zones.select(F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "block", "first", "low", "high", *[F.lit(None).cast("long" if k == "home" else "binary").alias(f"s_{k}") for k in _FIELDS])
    right = searches.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("binary").alias("low"),
                            F.lit(None).cast("binary").alias("high"), *[F.col(k).alias(f"s_{k}") for k in _FIELDS])
    met = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind")

    def run_shards(batches):
        shard, held, zone = None, [], None
        for batch in batches:
            for i, (s, kind) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist())):
                if s != shard:
                    shard, held, zone = s, [], None
                one = batch.slice(i, 1)
                if kind == 0:
                    held.append(one.select(["block", "first", "low", "high"]).to_pylist()[0])
                else:
                    zone = zone or pack(held)
                    yield from wanted(one.select([f"s_{k}" for k in _FIELDS]).rename_columns(_FIELDS), *zone)
    return met.mapInArrow(run_shards, schema)


def _find(searches: DataFrame, blocks: DataFrame, same: bool, most: int, d: int) -> DataFrame:
    """The best matches of each search: home, place, number, anchor, target, id, score, rank."""
    near = materialize(_read(searches.withColumn("block", F.col("home")), blocks, same, most, d), "own-block-matches")
    far = _read(materialize(_choose(_raised(searches, near, most), blocks, d), "chosen-blocks"), blocks, same, most, d)
    return _ranked(near.unionByName(far), most)


def _windows(positives: DataFrame, searches: DataFrame, least: int, most: int) -> DataFrame:
    """Searches for negatives, one for each positive: scores from ``least`` to ``most`` per cent of the positive's."""
    found = positives.groupBy("home").agg(F.collect_list(F.struct("place", F.col("rank").cast("long").alias("rank"), "score")).alias("found"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = _search(r)
                place = {int(p): i for i, p in enumerate(s["place"])}
                rows = sorted((place[f["place"]], f["rank"], f["score"]) for f in r["found"])
                rows = [(a, k, -(-least * x // 100), most * x // 100, x) for a, k, x in rows]
                rows = np.array([x for x in rows if x[2] <= x[3]], dtype=np.int64).reshape(-1, 5).T
                if rows.shape[1]:
                    s |= dict(zip(("who", "number", "low", "high", "target"), rows)) | {"upto": np.full(rows.shape[1], -_LOW)}
                    out.append(_packed(s, np.arange(rows.shape[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out))], names=_FIELDS)
    return searches.join(found, "home").mapInArrow(run, _SEARCH)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256,
         block: int = BLOCK) -> DataFrame:
    """Hard negatives of (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
                      & ~F.exists("embedding", lambda x: x.isNull()))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not common:
        return rows.sparkSession.createDataFrame([], _RESULT)
    d, n = common[0]
    rows = rows.where(F.size("embedding") == d)
    blocks = materialize(write_blocks(rows, scale, *fit_axes(rows, n, d), block), "vector-blocks")
    searches = materialize(blocks.mapInArrow(_own_anchors(every, d), _SEARCH), "anchor-searches")
    best = materialize(_find(searches, blocks, True, positives, d), "positives")
    windows = materialize(_windows(best, searches, least, most), "window-searches")
    found = _find(windows, blocks, False, negatives, d)
    ids = best.select("home", "place", F.col("rank").cast("long").alias("number"), F.col("id").alias("positive_id"))
    return found.join(ids, ["home", "place", "number"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("target").alias("positive_score"), F.col("score").alias("negative_score"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with the labels of every seventh moved on by one."""
    vectors = C.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 3
"""
