"""Language identification by interpolated Kneser-Ney character models.

One character model of order four per language, over the runs of letters of a
text (lower-cased, each run closed by a boundary mark).  The models' tables
are sorted hash arrays shared by all languages: one lookup gives the log
probability of a character in every language.  A text gets the language of the
lowest cross-entropy per character.

*Learning* takes at most ``MAX_TRAIN`` texts for each language (documented
bound, whole texts, chosen by a hash of the id): two thirds give the counts,
which Spark aggregates by (language, n-gram), one third calibrates the score
and the rejection.  Everything else covers all rows.

Defined cases: a NULL text or one without letters gets ``und`` and score 0; a
letter or n-gram never seen falls back to shorter ones and last to a uniform
share; equal cross-entropies go to the alphabetically first language; without
any learnable row every text gets ``und``.  Repeated rows are scored each.
Only ``doc_id``, ``text`` and ``lang`` are read, so further columns of any name
do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C
from tidewater.session import materialize

ORDER = 4
#: texts learned from, for each language
MAX_TRAIN = 600
#: Kneser-Ney discount
DISCOUNT = 0.75
_U = np.uint64


def _events(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram keys of order 4, part of each, letters of each part).

    A key packs four characters of 16 bits, the predicted one lowest; characters
    before the run's start, and the mark behind its end, are 0.  Characters
    beyond 16 bits are folded by a modulus.
    """
    codes, starts = C.code_points([p.lower() for p in parts])
    alpha = C.char_table("alpha")[codes]
    x = np.where(alpha, codes % 65521, 0).astype(_U)
    key, alive = x.copy(), np.ones(len(x), dtype=bool)
    for back in range(1, ORDER):
        prev = np.zeros_like(x)
        prev[back:] = x[:-back]
        alive &= prev != 0
        key |= np.where(alive, prev, _U(0)) << _U(16 * back)
    event = alpha.copy()
    event[1:] |= alpha[:-1]  # the mark behind a run
    at = np.flatnonzero(event)
    part = np.searchsorted(starts, at, side="right") - 1
    return key[at], part, C.sums(alpha.astype(np.int64), starts)


def _masked(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of each key, tagged with the order in the hash."""
    return keys & _U((1 << (16 * order)) - 1) if order < ORDER else keys


class Model:
    """Log probabilities by language for all n-grams seen, as sorted hash arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray):
        self.langs = langs
        n = len(langs)
        raw = [None] * (ORDER + 1)
        grams = [None] * (ORDER + 1)
        # counts by order: the highest has raw counts, the lower ones the number of different characters before
        # them; an n-gram at a run's start has nothing before it and keeps its raw count
        union, place = np.unique(key, return_inverse=True)
        table = np.zeros((len(union), n))
        np.add.at(table, (place, lang), count)
        grams[ORDER], raw[ORDER] = union, table
        for k in range(ORDER - 1, 0, -1):
            parent, have = grams[k + 1], raw[k + 1]
            front = (parent >> _U(16 * k)) & _U(0xFFFF)
            own, place = np.unique(_masked(parent, k), return_inverse=True)
            table = np.zeros((len(own), n))
            np.add.at(table, place, np.where((front != 0)[:, None], have > 0, have))
            grams[k], raw[k] = own, table
        chars = len(grams[1]) + 1
        self.floor = np.log(1.0 / chars)
        self.tables = []
        below = None
        for k in range(1, ORDER + 1):
            own, have = grams[k], raw[k]
            ctx, place = np.unique(own >> _U(16), return_inverse=True)
            total, kinds = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, place, have)
            np.add.at(kinds, place, have > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
                direct = np.where(total[place] > 0, np.maximum(have - DISCOUNT, 0) / total[place], 0.0)
            lower = np.full((len(own), n), 1.0 / chars) if k == 1 else below[np.searchsorted(grams[k - 1], _masked(own, k - 1))]
            below = direct + rest[place] * lower
            self.tables.append((C.mix(own), np.log(below), C.mix(ctx), np.log(rest)))
        packed = []
        for hashes, logs, ctx, rest in self.tables:
            a, b = np.argsort(hashes), np.argsort(ctx)
            packed.append((C.HashIndex(hashes[a]), logs[a].astype(np.float32), C.HashIndex(ctx[b]), rest[b].astype(np.float32)))
        self.tables = packed

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """(events, languages) natural log probabilities."""
        out = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            index, logs, contexts, rest = self.tables[k - 1]
            own = _masked(keys[todo], k)
            at = index.find(C.mix(own))
            seen = at >= 0
            out[todo[seen]] += logs[at[seen]]
            todo, own = todo[~seen], own[~seen]
            if not len(todo):
                return out
            at = contexts.find(C.mix(own >> _U(16)))
            seen = at >= 0
            out[todo[seen]] += rest[at[seen]]
        out[todo] += np.float32(self.floor)
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: cross-entropy per character in each language, characters predicted, letters."""
        total = np.zeros((len(texts), len(self.langs)))
        events, letters = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for rows, parts in C.pieces(texts):
            keys, part, alpha = _events(parts)
            first = np.searchsorted(part, np.arange(len(parts)))
            np.add.at(total, rows, C.sums(self.log_probs(keys), first))
            np.add.at(events, rows, np.diff(np.append(first, len(keys))))
            np.add.at(letters, rows, alpha)
        return -total / np.maximum(events, 1)[:, None], events, letters


def _margin(entropy: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Evidence for the best language over the next: log-odds, damped for long texts."""
    if entropy.shape[1] < 2:
        return np.sqrt(events.astype(float))
    two = np.partition(entropy, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(events, 1)) * 4


def fit(spark: SparkSession, docs: DataFrame, max_train: int = MAX_TRAIN) -> dict | None:
    """The model, its calibration and its rejection limit, from the rows outside the held-out fold."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(C.fold(F.col("doc_id")) != 0)
    sample = C.sample_texts(rows, C.sample_ids(rows, "lang", max_train), ["doc_id", "lang"])
    sample = materialize(sample.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3))), "language-sample")

    def make():
        def work(texts):
            where, keys, counts = [], [], []
            for rows_, parts in C.pieces(texts):
                key, part, _ = _events(parts)
                for i, r in enumerate(rows_):
                    lo, hi = np.searchsorted(part, [i, i + 1])
                    k, c = np.unique(key[lo:hi], return_counts=True)
                    where.append(np.full(len(k), r))
                    keys.append(k.view(np.int64))
                    counts.append(c)
            join = lambda a: np.concatenate(a).astype(np.int64) if a else np.zeros(0, dtype=np.int64)
            return join(where), {"gram": join(keys), "n": join(counts)}
        return work

    grams = (C.map_texts(sample.where("_part > 0"), ["lang"], make, [T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    got = grams.toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    at = {x: i for i, x in enumerate(langs)}
    order = np.lexsort((got.column("gram").to_numpy(), lang := np.array([at[x] for x in names])))
    model = Model(langs, lang[order], got.column("gram").to_numpy()[order].view(_U), got.column("n").to_numpy()[order].astype(float))
    trial = C.collect_texts(sample.where("_part = 0"), "lang", "text")
    a, b, limit = 1.0, 0.0, float("inf")
    if trial:
        entropy, events, letters = model.entropies([t for _, t in trial])
        has = letters > 0
        right = np.array([langs[i] == x for i, (x, _) in zip(entropy.argmin(axis=1), trial)])[has]
        if has.any():
            margin = _margin(entropy, events)[has]
            # two pseudo-texts without evidence, one of them wrong, keep the curve finite where no text is misjudged
            a, b = C.fit_platt(np.append(margin, [0.0, 0.0]), np.append(right, [False, True]).astype(float))
            limit = float(np.quantile(entropy.min(axis=1)[has], 0.99)) + 1.0
    return {"model": model, "a": a, "b": b, "limit": limit}


def identify(docs: DataFrame, fitted: dict | None, min_score: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``keep`` columns, lang_pred, score, cross_entropy (nats per character, NULL for
    ``und``) and rejected (score below ``min_score``, or less like its language than nearly all texts
    calibrated on)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # n-grams of at most MAX_TRAIN texts per language

    def make():
        own = shared.value

        def work(texts):
            n = len(texts)
            pred, score, cross, out = ["und"] * n, np.zeros(n), [None] * n, np.ones(n, dtype=bool)
            if own:
                entropy, events, letters = own["model"].entropies(texts)
                best = entropy.argmin(axis=1)
                sure = C.logistic(own["a"] * _margin(entropy, events) + own["b"])
                for i in np.flatnonzero(letters > 0):
                    pred[i], score[i], cross[i] = own["model"].langs[best[i]], sure[i], float(entropy[i, best[i]])
                    out[i] = sure[i] < min_score or entropy[i, best[i]] > own["limit"]
            return None, {"lang_pred": pa.array(pred, pa.string()), "score": score, "cross_entropy": pa.array(cross, pa.float64()), "rejected": out}
        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return C.map_texts(docs, keep, make, fields)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(spark, docs))
    return found.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
