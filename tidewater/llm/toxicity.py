"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (3 to 5, with marks at both ends).
Their embeddings are averaged and a linear softmax with two outputs gives the
word's log-odds of being toxic.  Embeddings and softmax are trained jointly in
numpy, from labels of whole texts only: a text is clean if all of its words are
(noisy-or), so the gradient finds the words that set toxic texts apart.
Averaging over a whole text instead would thin out one insult in thousands of
words.  An unseen misspelling shares n-grams, hence vectors, with the words
learned from.  A text's score is that of its worst word, calibrated.

Since the softmax is linear in the average, scoring needs one number for each
n-gram bucket: one pass over the texts, no shuffle, a table of 1 MB.

*Learning* takes at most ``MAX_TRAIN`` texts and ``common.MAX_CHARS`` characters of each label
(documented bounds, whole texts, chosen by a hash of the id) outside the held-out fold.

Defined cases: NULL texts, empty texts and texts without letters or digits
score as a text with no word at all (the lowest score); without labels of both
kinds every score is 0; repeated rows are scored each.  Only ``doc_id`` and
``text`` are read besides the labels, so further columns do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C

#: labelled texts learned from, for each label
MAX_TRAIN = 2500
SIZES = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
STEPS = 250
_U = np.uint64


def _grams(parts: list[str]):
    """Words' starts and ends, part of each word, and per n-gram size the bucket at each end position (-1: none).

    Runs of letters and digits, lower-cased; the code before and behind a run
    is its mark, so an n-gram may hold a mark at its ends but not inside.
    """
    codes, starts = C.code_points([p.lower() for p in parts])
    inside = C.char_table("alnum")[codes]
    inside[-1] = False
    x = np.where(inside, codes, 0).astype(_U)
    begin, end = C.word_spans(inside)
    part = np.searchsorted(starts, begin, side="right") - 1
    return x, inside, begin, end, part


def _buckets(x: np.ndarray, inside: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(last positions, buckets) of the n-grams of ``size`` whose inner characters all belong to a word."""
    n = len(x)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ok = inside[1:n - size + 2].copy()
    for k in range(2, size - 1):
        ok &= inside[k:n - size + 1 + k]
    at = np.flatnonzero(ok[:n - size + 1])
    h = np.full(len(at), size, dtype=_U)
    for k in range(size):
        h = (h ^ x[at + k]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return at, (C.mix(h) & _U(BUCKETS - 1)).astype(np.int64)


def _bags(parts: list[str]):
    """(part of each word, its n-grams' word numbers, their buckets, a hash of each word)."""
    x, inside, begin, end, part = _grams(parts)
    words, buckets = [], []
    for size in SIZES:
        at, bucket = _buckets(x, inside, size)
        words.append(np.searchsorted(begin, at + 1, side="right") - 1)  # at + 1 is an inner character
        buckets.append(bucket)
    return part, np.concatenate(words), np.concatenate(buckets), C.run_hashes(x, begin, end)


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> np.ndarray | None:
    """Joint training of embeddings and softmax (full batches, Adam); the log-odds of each n-gram bucket, the
    bias at the end.  None without texts of both labels."""
    if len(set(y.tolist())) < 2:
        return None
    known = np.zeros(0, dtype=_U)
    words, owners, gram_words, gram_buckets = [], [], [], []
    for rows, parts in C.pieces(texts):
        part, own, bucket, word = _bags(parts)
        uniq, first = np.unique(word, return_index=True)
        first = first[~np.isin(uniq, known)]
        fresh = np.zeros(len(word) + 1, dtype=bool)
        fresh[first] = True
        known = np.union1d(known, uniq)
        # a text's distinct words
        own_words, at = np.unique(word, return_inverse=True)
        pair = np.unique(part.astype(np.int64) * len(own_words) + at)
        words.append(own_words[pair % max(1, len(own_words))])
        owners.append(rows[pair // max(1, len(own_words))])
        gram_words.append(word[own[fresh[own]]])
        gram_buckets.append(bucket[fresh[own]])
    if not len(known):
        return None
    gram_word, gram_bucket = np.searchsorted(known, np.concatenate(gram_words)), np.concatenate(gram_buckets)
    pair = np.unique(np.concatenate(owners).astype(np.int64) * len(known) + np.searchsorted(known, np.concatenate(words)))
    owner, word = pair // len(known), pair % len(known)
    used, gram = np.unique(gram_bucket, return_inverse=True)
    size = np.maximum(np.bincount(gram_word, minlength=len(known)), 1)
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.1, (len(used), DIM)), "U": rng.normal(0, 0.3, (2, DIM)), "b": np.array([3.0, -3.0])}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, STEPS + 1):
        u = p["U"][1] - p["U"][0]
        z = np.bincount(gram_word, weights=(p["E"] @ u)[gram], minlength=len(known)) / size + (p["b"][1] - p["b"][0])
        soft = np.logaddexp(0, z)
        clean = np.bincount(owner, weights=soft[word], minlength=len(y))  # -log P(no word is toxic)
        # d loss / d clean: 1 for a clean text, -P(clean) / P(toxic) for a toxic one
        pull = np.where(y == 0, 1.0, -1.0 / np.expm1(np.maximum(clean, 1e-4))) * weight
        dz = np.bincount(word, weights=pull[owner], minlength=len(known)) * C.logistic(z)
        per_gram = np.bincount(gram, weights=(dz / size)[gram_word], minlength=len(used))
        du = p["E"].T @ per_gram
        grad = {"E": per_gram[:, None] * u + 1e-6 * p["E"], "U": np.stack([-du, du]) + 1e-5 * p["U"],
                "b": np.array([-1.0, 1.0]) * dz.sum()}
        for k in p:
            m[k] *= 0.9  # in place: the embeddings are what takes memory here
            m[k] += 0.1 * grad[k]
            np.square(grad[k], out=grad[k])
            grad[k] *= 0.01
            v[k] *= 0.99
            v[k] += grad[k]
            step_size = np.sqrt(v[k] / (1 - 0.99 ** step), out=grad[k])
            step_size += 1e-8
            np.divide(m[k], step_size, out=step_size)
            step_size *= 0.05 / (1 - 0.9 ** step)
            p[k] -= step_size
    out = np.zeros(BUCKETS + 1)
    out[used] = p["E"] @ (p["U"][1] - p["U"][0])
    out[-1] = p["b"][1] - p["b"][0]
    return out


def worst_word(texts: list, table: np.ndarray) -> np.ndarray:
    """Log-odds of each text's worst word; -inf for a text without words."""
    out = np.full(len(texts), -np.inf)
    for rows, parts in C.pieces(texts):
        x, inside, begin, end, part = _grams(parts)
        if not len(begin):
            continue
        total, count = np.zeros(len(x) + 1), np.zeros(len(x) + 1, dtype=np.int32)
        for size in SIZES:
            at, bucket = _buckets(x, inside, size)
            total[at + 2] += table[bucket]  # at + 1 is an inner character, so the word's span holds it
            count[at + 2] += 1
        total, count = np.cumsum(total), np.cumsum(count)
        z = (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1) + table[-1]
        np.maximum.at(out, rows[part], z)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> dict | None:
    """The bucket table and the calibration of the worst word's log-odds; None without labels of both kinds."""
    got = C.collect_texts(C.labelled(docs, labels, label, max_train), "doc_id", "y", "text")
    texts, y = [r[2] for r in got], np.array([r[1] for r in got], dtype=np.int64)
    # a fifth calibrates what the rest has trained
    late = np.arange(len(y)) % 5 == 4
    table = train([t for t, x in zip(texts, late) if not x], y[~late]) if len(y) else None
    if table is None:
        return None
    z = worst_word(texts, table)
    # the calibration weighs both kinds alike and lies between what training and calibration texts say
    z = np.clip(z, -30, 30)
    cut = _middle(z[late], y[late]) if len(set(y[late].tolist())) == 2 else _middle(z[~late], y[~late])
    slope, _ = C.fit_platt(z - cut, y.astype(float))
    return {"table": table.astype(np.float32), "cut": float(cut), "slope": slope}


def _middle(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds that tells the two labels apart with the fewest mistakes (the middle of the best places)."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    bad = y / max(1, y.sum())
    good = (1 - y) / max(1, (1 - y).sum())
    wrong = np.concatenate(([0], np.cumsum(bad))) + np.concatenate((np.cumsum(good[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    return float(edges[best[len(best) // 2]])


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of each row and its score, as column ``name`` (0 to 1; 0.5 where both labels are as likely)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        own = shared.value

        def work(texts):
            if own is None:
                return None, {name: np.zeros(len(texts))}
            z = np.clip(worst_word(texts, own["table"]), -30, 30)
            return None, {name: C.logistic(own["slope"] * (z - own["cut"]))}
        return work
    return C.map_texts(docs, keep or ["doc_id"], make, [T.StructField(name, T.DoubleType())])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
