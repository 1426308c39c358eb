"""Mixing to target weights with soft domain membership.

1. *Posteriors.*  A linear softmax over hashed character pairs and triples,
   learned from a labelled table (doc_id, domain), gives every document a
   probability for each domain.  At most ``MAX_TRAIN`` documents of each domain
   are learned from (documented bound, chosen by a hash of the id, and of at most ``common.MAX_CHARS`` characters).
2. *Rates.*  With n_i tokens (words) and posterior p_i, a document read r_i times
   adds r_i * n_i * p_i to the domain totals.  Rates r_i >= 0 minimise the squared
   distance of the expected totals from the targets, by projected gradient:

       r  <-  max(0, r - p_i . (total(r) - target) / (tokens * share))

   ``share`` being the domains' present shares (a diagonal preconditioner in
   which a step of 1 never overshoots).  Each iteration is one Spark aggregation
   of as many sums as there are domains.  A document's rate is a function of its
   posterior and of the residuals so far, so it is recomputed in the task: no
   state is kept, and a lost executor costs only its tasks.  Iterations end when
   every domain is within ``TOLERANCE`` of its target, or after ``STEPS``; targets
   that are not reached by then are reported by a warning that names the shares.

``copies`` turns the rate into whole readings: its floor, plus one with the
probability of the fraction, drawn by a hash of doc_id and text.

Defined cases: NULL and empty texts have no tokens and the posterior of the
classifier's constant; their rate counts for nothing but is given.  A target of
a domain that was not learned is left out and the others are scaled to sum to
1; a learned domain that has no target keeps its present share of the tokens, and
the targets are scaled to the rest (a target of 0 does remove a domain); without
any learnable row or usable target there is one domain, ``all``, and every rate
is 1.  Repeated rows are documents each (equal rows get equal rates).
Columns of ``docs`` are carried through on request; others do no harm.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C
from tidewater.session import materialize

MAX_TRAIN = 800
BUCKETS = 1 << 13
TOLERANCE = 1e-5
STEPS = 200
#: shares of the tokens that each language of ``documents`` is to have
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
_U = np.uint64


def _events(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash bucket, part) of every character pair and triple, and words of each part."""
    codes, starts = C.code_points([p.lower() for p in parts])
    x = np.where(C.char_table("alpha")[codes], codes, 32).astype(_U)
    part = np.repeat(np.arange(len(parts)), np.diff(np.append(starts, len(codes))))
    begin, _ = C.word_spans(C.char_table("solid")[codes])
    words = np.bincount(part[begin], minlength=len(parts))
    pair = x[1:] | x[:-1] << _U(21)
    triple = pair[1:] | x[:-2] << _U(42)
    use2, use3 = pair != _U(32 | 32 << 21), (part[2:] == part[:-2]) & (x[1:-1] != 32)
    use2 &= part[1:] == part[:-1]
    bucket = lambda h: (C.mix(h) >> _U(64 - 13)).astype(np.int64)
    return np.concatenate((bucket(pair[use2]), bucket(triple[use3]))), np.concatenate((part[1:][use2], part[2:][use3])), words


def _triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, frequency of the bucket in the text), sorted: what is not zero of the texts' frequencies."""
    found = [np.zeros(0, dtype=np.int64)]
    counts = [np.zeros(0, dtype=np.int64)]
    for rows, parts in C.pieces(texts):
        bucket, part, _ = _events(parts)
        key, n = np.unique(rows[part].astype(np.int64) * BUCKETS + bucket, return_counts=True)
        found.append(key)
        counts.append(n)
    key, back = np.unique(np.concatenate(found), return_inverse=True)  # parts of a long text meet
    n = np.bincount(back, weights=np.concatenate(counts), minlength=len(key))
    row = (key // BUCKETS).astype(np.int32)
    total = np.bincount(row, weights=n, minlength=len(texts))
    return row, (key % BUCKETS).astype(np.int32), (n / total[row]).astype(np.float32)


def _times(start: np.ndarray, index: np.ndarray, value: np.ndarray, dense: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A sparse matrix (rows ``start[i]:start[i + 1]`` of index and value) times a dense one, ``most`` entries at a time."""
    out = np.zeros((len(start) - 1, dense.shape[1]), dtype=np.float32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + most, side="right")) - 1)
        a, b = start[lo], start[hi]
        full = np.flatnonzero(start[lo + 1:hi + 1] > start[lo:hi])
        if len(full):
            out[lo + full] = np.add.reduceat(value[a:b, None] * dense[index[a:b]], start[lo:hi][full] - a, axis=0)
        lo = hi
    return out


def train(texts: list[str], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights (BUCKETS, n) and constants over bucket frequencies: full batches, Adam.

    Frequencies are kept as triples, so memory grows with the texts' distinct buckets and not with BUCKETS x texts.
    """
    row, bucket, x = _triples(texts)
    scale = 1.0 / (np.sqrt(np.bincount(bucket, weights=x.astype(np.float64) ** 2, minlength=BUCKETS) / max(1, len(texts))) + 1e-4)
    x = x * scale[bucket].astype(np.float32)
    by_text = np.searchsorted(row, np.arange(len(texts) + 1))
    order = np.argsort(bucket, kind="stable")
    row_t, x_t = row[order], x[order]
    by_bucket = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    del row, order
    goal = np.eye(n, dtype=np.float32)[y]
    weight = ((1.0 / np.maximum(np.bincount(y, minlength=n), 1))[y][:, None] / n).astype(np.float32)
    w, b = np.zeros((BUCKETS, n)), np.zeros(n)
    mw, vw, mb, vb = 0.0, 0.0, 0.0, 0.0
    for step in range(1, 61):
        p = _softmax(_times(by_text, bucket, x, w.astype(np.float32)) / 30 + b.astype(np.float32))
        d = (p - goal) * weight
        gw, gb = _times(by_bucket, row_t, x_t, d) / 30 + 1e-5 * w, d.sum(axis=0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw ** 2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb ** 2
        w -= 0.05 * (mw / (1 - 0.9 ** step)) / (np.sqrt(vw / (1 - 0.99 ** step)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.99 ** step)) + 1e-8)
    return (w * scale[:, None] / 30).astype(np.float32), b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """The classifier of ``labelled`` (doc_id, domain)."""
    ids = C.sample_ids(labelled.select("doc_id", F.col("domain").cast("string").alias("domain")), "domain", max_train)
    got = C.collect_texts(C.within(C.sample_texts(docs, ids, ["doc_id"]), "domain"), "doc_id", "domain", "text")
    domains = sorted({r[1] for r in got})
    if not domains:
        return {"domains": ["all"], "w": np.zeros((BUCKETS, 1), dtype=np.float32), "b": np.zeros(1)}
    w, b = train([r[2] for r in got], np.array([domains.index(r[1]) for r in got]), len(domains))
    return {"domains": domains, "w": w, "b": b}


def posteriors(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens and posterior (in the order of the model's domains) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x domains numbers

    def make():
        own = shared.value
        n = len(own["domains"])

        def work(texts):
            total, events, words = np.zeros((len(texts), n)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for rows, parts in C.pieces(texts):
                bucket, part, w = _events(parts)
                weight = own["w"][bucket]
                add = np.stack([np.bincount(part, weights=weight[:, k], minlength=len(parts)) for k in range(n)], axis=1)
                np.add.at(total, rows, add)
                np.add.at(events, rows, np.bincount(part, minlength=len(parts)))
                np.add.at(words, rows, w)
            p = _softmax(total / np.maximum(events, 1)[:, None] + own["b"])
            return None, {"n_tokens": words, "posterior": pa.array(list(p), pa.list_(pa.float64()))}
        return work
    return C.map_texts(docs, keep, make, [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the given gradient steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def fit_rates(table: DataFrame, target: np.ndarray) -> list[np.ndarray]:
    """Gradient steps (one vector of the domains' size for each iteration) that bring the totals to the targets
    (weights, scaled here; NaN: the present share)."""
    n = len(target)
    names = [f"s{k}" for k in range(n)]

    def totals(steps):
        def run(batches):
            for batch in batches:
                p = _matrix(batch.column(1), n)
                mass = batch.column(0).to_numpy() * rates(p, steps)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in mass @ p], names=names)
        sums = table.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{x} double" for x in names))
        row = sums.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in names]).first()
        return np.array([row[x] for x in names])

    now = totals([])
    tokens = now.sum()
    if tokens <= 0:
        return []
    keep = np.isnan(target)
    target = np.where(keep, now / tokens, target / np.nansum(target) * (1 - (now / tokens)[keep].sum()))
    share, goal, steps = np.maximum(now / tokens, 1e-12), target * tokens, []
    reached = lambda: np.all(np.abs(now - goal) <= TOLERANCE * np.maximum(goal, TOLERANCE * tokens))
    while not reached() and len(steps) < STEPS:
        steps.append((now - goal) / (tokens * share))
        now = totals(steps)
    if not reached():
        warnings.warn(f"target shares {target.tolist()} not reached after {STEPS} steps: {(now / tokens).tolist()}", stacklevel=2)
    return steps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row (but those named like the operator's own), n_tokens, domain (the likeliest),
    posterior, rate, copies."""
    keep = [c for c in keep or ["doc_id"] if c not in ("n_tokens", "domain", "posterior", "rate", "copies")]
    model = fit(docs, labelled)
    weight = np.array([max(0.0, targets[d]) if d in targets else np.nan for d in model["domains"]])
    seed = docs.withColumn("__draw", F.xxhash64("doc_id", "text") / F.lit(2.0 ** 64) + 0.5)
    table = materialize(posteriors(seed, model, [*keep, "__draw"]), "posteriors")
    steps = fit_rates(table, weight) if np.nansum(weight) > 0 else []
    n = len(model["domains"])
    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])
    place = table.columns.index("posterior")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_matrix(batch.column(place), n), steps))], names=schema.names)

    out = table.mapInArrow(run, schema)
    best = F.element_at(F.array(*[F.lit(d) for d in model["domains"]]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    copies = (F.floor("rate") + (F.col("__draw") < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
    return out.select(*keep, "n_tokens", best.alias("domain"), "posterior", "rate", copies.alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target weights of the languages; the documents of the table ``labels`` that
    name a language are the labelled table."""
    docs = C.table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "text"), labelled_languages(docs, C.table(spark, sf_dir, "labels")), TARGETS)


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")
