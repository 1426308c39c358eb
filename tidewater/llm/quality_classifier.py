"""Quality scores by Bradley-Terry pairwise ranking.

Every text is described by shares and ratios of its whole content
(:data:`FEATURES`).  From labelled rows, preference pairs (good, bad) are drawn
and a linear score ``s(x) = w . x`` is fitted so that ``P(good beats bad) =
logistic(s(good) - s(bad))``: logistic loss on feature differences.  The
threshold is a quantile of the training scores, the one that misjudges fewest
training rows; the score is mapped to 0..1 so that the threshold lies at
``CUT`` (0.3) and, on each side, by the logistic curve of the labels.

*Learning* takes at most ``MAX_TRAIN`` rows of each label (documented bound,
whole texts, chosen by a hash of the id) outside the held-out fold.  Scoring
covers all rows, one pass, no shuffle.

Defined cases: NULL and empty texts have all features 0 and are scored like any
other vector, but never above the threshold (nothing in them can be good);
without labels of both kinds every score is 0.5 for a text with words; repeated
rows are scored each; ties of the score are equal scores.  Only ``doc_id`` and
``text`` are read besides the labels, so further columns do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C

#: labelled rows learned from, for each label
MAX_TRAIN = 4000
#: preference pairs for each labelled row of the rarer label
PAIRS = 8
#: scores from here on count as good
CUT = 0.3

FEATURES = ("upper", "digit", "mark", "other", "line", "sentence", "mean_word", "word_spread", "distinct",
            "repeat_next", "marked_words", "upper_words", "lone_marks", "long_words", "length", "bang")


def features(texts: list) -> np.ndarray:
    """One row of :data:`FEATURES` for each text; zeros for a text without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for rows, parts in C.chunks(texts):
        codes, starts = C.code_points(parts)
        solid = C.char_table("solid")[codes]
        alnum = C.char_table("alnum")[codes]
        begin, end = C.word_spans(solid)
        n_words = np.searchsorted(begin, np.append(starts[1:], len(codes))) - np.searchsorted(begin, starts)
        first = np.searchsorted(begin, starts)
        some = np.maximum(n_words, 1)
        chars = np.maximum(C.sums(solid.astype(np.int64), starts), 1)
        share = lambda mask: C.sums(mask.astype(np.int64), starts) / chars
        per_word = lambda mask: C.sums(mask.astype(np.int64), first) / some
        upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
        marks = solid & ~alnum
        plain = marks & np.isin(codes, np.frombuffer(".,;:'\"()-?".encode("utf-32-le"), dtype="<u4"))
        width = end - begin
        inside = lambda mask: (t := np.concatenate(([0], np.cumsum(mask))))[end] - t[begin]
        word = C.run_hashes(codes, begin, end)
        owner = np.repeat(np.arange(len(parts)), n_words)
        distinct = np.bincount(owner[np.unique(C.mix(word ^ owner.astype(np.uint64)), return_index=True)[1]], minlength=len(parts))
        again = np.zeros(len(word), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        mean = C.sums(width, first) / some
        spread = np.sqrt(np.maximum(C.sums(width.astype(float) ** 2, first) / some - mean ** 2, 0))
        odd, caps = inside(marks & ~plain), inside(upper)
        out[rows] = np.stack([
            share(upper), share(alnum & (codes >= 48) & (codes <= 57)), share(marks & ~plain), share(plain),
            C.sums((codes == 10).astype(np.int64), starts) / some, share(np.isin(codes, [46, 63, 33])), np.log1p(mean), np.log1p(spread),
            (distinct / some) ** 0.5, per_word(again), per_word(odd > 0), per_word((caps == width - inside(marks)) & (caps > 1)),
            per_word(inside(marks) == width), per_word(width > 25), np.log1p(n_words) / 10, share(codes == 33),
        ], axis=1) * (n_words > 0)[:, None]
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Each feature with its square root, so that a linear score can bend."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, pairs: int = PAIRS, seed: int = 5) -> dict | None:
    """Weights and the map from score to 0..1; None without rows of both labels."""
    sample = C.labelled(docs, labels, label, max_train)
    rows = C.map_texts(sample, ["doc_id", "y"], _features_udf, [T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = C.collect_texts(rows, "doc_id", "y", "x")
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = expand(x)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - centre) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = pairs * max(len(good), len(bad))
    diff = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, 401):  # Adam on the pairwise logistic loss with a small ridge
        grad = -(diff * C.logistic(-(diff @ w))[:, None]).mean(axis=0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    score = x @ w
    # the score quantile with the fewest misjudged training rows; between two scores, so that ties fall on one side
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0]))
    place = np.flatnonzero(np.append(np.insert(s[1:] > s[:-1], 0, True), True))
    best = place[wrong[place] == wrong[place].min()]
    at = int(best[len(best) // 2])
    cut = s[0] - 1 if at == 0 else s[-1] + 1e-9 if at == len(s) else (s[at - 1] + s[at]) / 2
    slope, _ = C.fit_platt(score - cut, y.astype(float))
    return {"w": w, "centre": centre, "scale": scale, "cut": float(cut), "quantile": at / len(s), "slope": slope}


def judge(x: np.ndarray, model: dict | None) -> np.ndarray:
    """Scores 0..1 of feature rows; CUT at the learned threshold."""
    empty = ~x.any(axis=1)
    if model is None:
        return np.where(empty, 0.0, 0.5)
    s = np.clip((expand(x) - model["centre"]) / model["scale"], -8, 8) @ model["w"]
    out = C.logistic(model["slope"] * (s - model["cut"]) + np.log(CUT / (1 - CUT)))
    return np.where(empty, np.minimum(out, 0.1 * CUT), out)


def _features_udf():
    def work(texts):
        return None, {"x": list(features(texts))}
    return work


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of each row and its score, as column ``name``."""
    def make():
        def work(texts):
            return None, {name: judge(features(texts), model)}
        return work
    return C.map_texts(docs, keep or ["doc_id"], make, [T.StructField(name, T.DoubleType())])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))
