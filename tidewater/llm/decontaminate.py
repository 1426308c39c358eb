"""Benchmark decontamination: BM25 over test items with block-max pruning.

The test items are the indexed collection, the training passages the queries.

*Index.*  Terms are lower-cased runs of letters and digits.  Every (term, item)
posting holds its BM25 impact as a share of the item's own total, so an item
that a passage holds whole scores 1.  The inverse document frequency is
``log(1 + (N - n + 0.5) / (n + 0.5))``, above 0 also for a term of all items, so
that no term lowers a score or a bound.  Items stand in blocks of ``BLOCK``; for
each term and block the index keeps the largest impact.

*Query.*  A document is read as passages of ``2 * S`` words, ``S`` apart, with S the
longest item of the index, so that a copied item lies whole in some passage.
For each passage, the block maxima of its terms add up to a bound; only blocks
whose bound reaches what one of their items needs are opened and their items scored (block-max
WAND over all blocks at once).  An item needs ``THRESHOLD`` of its total, or less: the
lowest share that a passage with ``OVERLAP`` of its shingles can have (:func:`least_share`), so that an item whose
weight lies in few words beside a common template is found when some of them are altered.
All items that get what they need are retrieved; there is no top-k.

*Verification.*  An item is its question and, after the last line break or
sentence end, its answer.  ``question_overlap`` and ``answer_overlap`` are the
shares of their five-word shingles found in the passage (a part of fewer than
five words counts as one shingle); a part of fewer than ``SHORT`` words is judged
by the share of its words instead, and one of a single word together with the
word beside it, so that one altered word does not decide.  A document is
contaminated by an item if ``overlap``, over the shingles of both, is ``OVERLAP``
or more, and both parts reach ``PART``.

The index is broadcast in blocks of items with at most ``MAX_INDEX_CHARS``
characters of text each (measured first), and the documents are read once for
each such block, so any number of items is searched with bounded memory.
Documents are never shuffled; only hits leave the scan.

Defined cases: NULL and empty texts, on either side, match nothing; an item
without terms is never found; items with equal texts are found each; repeated
documents give their hits each; a document that holds an item several times
gives one row with its best passage (the first among equals); empty tables give
no rows.  Only ``doc_id`` and ``text``, ``item_id`` and ``text`` are read, so
further columns do no harm.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm import common as C
from tidewater.session import materialize

K1, B = 1.2, 0.75
BLOCK = 8
#: share of an item's own BM25 total from which on it is retrieved, at the latest
THRESHOLD = 0.5
OVERLAP = 0.8
PART = 0.5
SHINGLE = 5
#: words below which a part is judged by its words: from here on, one altered word leaves half of the shingles
SHORT = 3 * SHINGLE - 1
#: characters of item text in one broadcast index
MAX_INDEX_CHARS = 16_000_000
_U = np.uint64


def terms(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, part it stands in)."""
    codes, starts = C.code_points([p.lower() for p in parts])
    begin, end = C.word_spans(C.char_table("alnum")[codes])
    return C.run_hashes(codes, begin, end), np.searchsorted(starts, begin, side="right") - 1


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words)
    if n < k or not k:
        return np.zeros(0, dtype=_U)
    h = np.full(n - k + 1, k, dtype=_U)
    for i in range(k):
        h = C.mix(h ^ words[i:n - k + 1 + i])
    return h


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last line or, within one line, the last sentence; empty if there is one only."""
    body = text.rstrip()
    cut = body.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.?!]\s+", body)]
        cut = ends[-1] if ends else -1
    return (body, "") if cut <= 0 else (body[:cut], body[cut:])


def _removable(value: np.ndarray, budget: int) -> np.ndarray:
    """Largest sum of word values that gaps costing 0 .. ``budget`` shingles can take from one part of an item.

    A gap of g words inside costs g + 4 shingles, at either end g, the whole part all that it has.
    """
    n, never = len(value), -1.0
    best = np.zeros(budget + 1)
    if not n:
        return best
    k = min(SHINGLE, n)

    def paid(x, cost):
        out = np.full(budget + 1, never)
        out[cost:] = x[:max(0, budget + 1 - cost)]
        return out
    kept, inner = np.zeros(budget + 1), np.full(budget + 1, never)  # the last word is kept, or in a gap inside
    first, last = np.zeros(budget + 1), np.full(budget + 1, never)  # all words so far are the gap at the start; the gap at the end has begun
    for v in value:
        add = lambda x: np.where(x < 0, never, x + v)
        kept, inner, first, last = (
            np.maximum(np.maximum(kept, inner), first),
            add(np.maximum(paid(kept, k), paid(inner, 1))), add(paid(first, 1)), add(np.maximum(paid(np.maximum(kept, first), 1), paid(last, 1))))
    whole = paid(np.full(budget + 1, value.sum()), n - k + 1)
    return np.maximum.accumulate(np.max([best, kept, inner, last, first, whole], axis=0))


def least_share(parts: list[np.ndarray], share: dict[int, float]) -> float:
    """The lowest share of an item's BM25 total that a passage holding ``OVERLAP`` of its shingles can have (a lower bound).

    ``parts`` are the words of question and answer, ``share`` each word's part of the total; a word that occurs
    several times goes only if all of them do, so each occurrence counts its part.
    """
    size = sum(max(1, len(p) - SHINGLE + 1) for p in parts if len(p))
    budget = size - int(np.ceil(OVERLAP * size - 1e-9))
    every = np.concatenate(parts)
    words, at, times = np.unique(every, return_inverse=True, return_counts=True)
    value = (np.array([share.get(int(w), 0.0) for w in words]) / times)[at]
    cut = len(parts[0])
    a, b = _removable(value[:cut], budget), _removable(value[cut:], budget)
    return 1.0 - max(a[i] + b[budget - i] for i in range(budget + 1))


class Index:
    """Impact-ordered postings of a block of items, with block maxima."""

    def __init__(self, ids: list, texts: list[str], idf: dict, average: float, id_type: pa.DataType):
        self.ids, self.parts = ids, []
        self.id_type = id_type
        owner, term, impact, lengths, need = [], [], [], [], []
        for i, t in enumerate(texts):
            words = terms([t])[0]
            split = [terms([p])[0] if p else words[:0] for p in split_item(t)]
            if not len(split[0]):
                split = [words, words[:0]]
            at = len(split[0])
            near = [words[:max(at, 2)], words[max(0, min(at, len(words) - 2)):]]
            self.parts.append([(shingles(x, min(SHINGLE, len(x))), min(SHINGLE, len(x)), y if 0 < len(x) < SHORT else None)
                               for x, y in zip(split, near)])
            lengths.append(len(words))
            own, tf = np.unique(words, return_counts=True)
            w = np.array([idf[int(x)] for x in own.view(np.int64)]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            owner.append(np.full(len(own), i))
            term.append(own)
            impact.append(w / w.sum())
            need.append(min(THRESHOLD, least_share(split, dict(zip(own.tolist(), impact[-1].tolist())))) - 1e-9)
        owner, term, impact = (np.concatenate(x) for x in (owner, term, impact))
        self.stride = max(lengths)
        vocabulary, at = np.unique(term, return_inverse=True)
        order = np.lexsort((owner, at))
        at, self.owner, self.impact = at[order], owner[order], impact[order]
        self.index = C.HashIndex(vocabulary)
        self.first = np.searchsorted(at, np.arange(len(vocabulary) + 1))
        # (term, block) -> largest impact
        key = at * (len(ids) // BLOCK + 1) + self.owner // BLOCK
        uniq, start = np.unique(key, return_index=True)
        self.most = np.maximum.reduceat(self.impact, start)
        self.block = uniq % (len(ids) // BLOCK + 1)
        self.block_first = np.searchsorted(uniq // (len(ids) // BLOCK + 1), np.arange(len(vocabulary) + 1))
        self.n_blocks = len(ids) // BLOCK + 1
        self.need = np.full(self.n_blocks * BLOCK, np.inf)
        self.need[:len(ids)] = need
        self.block_need = self.need.reshape(-1, BLOCK).min(axis=1)

    def search(self, words: np.ndarray, owner: np.ndarray, n: int):
        """Yield (row, item, score, passage words) for every item that gets what it needs, by passage."""
        first = np.searchsorted(owner, np.arange(n + 1))
        length = np.diff(first)
        cells = np.maximum(1, -(-length // self.stride)) * (length > 0)
        cell_first = np.concatenate(([0], np.cumsum(cells)))
        found = self.index.find(words)
        hit = np.flatnonzero(found >= 0)
        if not len(hit):
            return
        vocabulary = len(self.index.keys)
        cell = cell_first[owner[hit]] + (hit - first[owner[hit]]) // self.stride
        pair = np.unique(cell * vocabulary + found[hit])
        cell, term = pair // vocabulary, pair % vocabulary
        # passage p is cells p and p + 1 of the same text; the last cell alone is a passage only where it is the only one
        row_of_cell = np.repeat(np.arange(n), cells)
        start = np.zeros(len(row_of_cell) + 1, dtype=bool)
        start[cell_first[:-1][cells > 0]] = True
        single = np.repeat(cells == 1, cells)
        last = np.zeros(len(row_of_cell), dtype=bool)
        last[cell_first[1:][cells > 0] - 1] = True
        here = ~last[cell] | single[cell]
        before = ~start[cell]
        key = np.unique(np.concatenate((cell[here] * vocabulary + term[here], (cell[before] - 1) * vocabulary + term[before])))
        passage, term = key // vocabulary, key % vocabulary
        for lo, hi in _slices(self.block_first[term + 1] - self.block_first[term], passage):
            yield from self._score(passage[lo:hi], term[lo:hi], row_of_cell, cell_first, first, words)

    def _score(self, passage, term, row_of_cell, cell_first, first, words):
        base = passage[0]
        size = self.block_first[term + 1] - self.block_first[term]
        at = _ranges(self.block_first[term], size)
        bound = np.bincount(np.repeat((passage - base) * self.n_blocks, size) + self.block[at], weights=self.most[at])
        opened = np.flatnonzero(bound >= self.block_need[np.arange(len(bound)) % self.n_blocks])
        if not len(opened):
            return
        # items of the opened blocks, term by term
        slot = np.full(len(bound), -1, dtype=np.int64)
        slot[opened] = np.arange(len(opened))
        wanted = np.zeros(int(passage[-1] - base) + 1, dtype=bool)
        wanted[opened // self.n_blocks] = True
        use = wanted[passage - base]
        passage, term = passage[use] - base, term[use]
        size = self.first[term + 1] - self.first[term]
        at = _ranges(self.first[term], size)
        item = self.owner[at]
        place = slot[np.repeat(passage * self.n_blocks, size) + item // BLOCK]
        ok = place >= 0
        score = np.bincount(place[ok] * BLOCK + item[ok] % BLOCK, weights=self.impact[at][ok], minlength=len(opened) * BLOCK)
        items = (opened % self.n_blocks)[:, None] * BLOCK + np.arange(BLOCK)
        for k in np.flatnonzero(score >= self.need[items].ravel()):
            block = opened[k // BLOCK]
            cell = base + block // self.n_blocks
            row = row_of_cell[cell]
            begin = first[row] + (cell - cell_first[row]) * self.stride
            yield int(row), int(block % self.n_blocks * BLOCK + k % BLOCK), float(score[k]), words[begin:min(first[row + 1], begin + 2 * self.stride)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``start[i] .. start[i] + size[i] - 1``, one after the other."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


def _slices(size: np.ndarray, group: np.ndarray, limit: int = 4_000_000):
    """Cut sorted ``group`` between groups so that the sizes of a slice add up to about ``limit``."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(group):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        hi = len(group) if hi >= len(group) else int(np.searchsorted(group, group[hi], side="left"))
        if hi <= lo:  # one passage with more than the limit
            hi = int(np.searchsorted(group, group[lo], side="right"))
        yield lo, hi
        lo = hi


def _blocks(items: DataFrame):
    """The items block by block, each with the inverse document frequencies of its terms in all items, and the mean
    length of an item.  A block has about half of MAX_INDEX_CHARS characters (a longer item is a block of its own)."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // (MAX_INDEX_CHARS // 2)) or 1
    items = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def make():
        def work(texts):
            rows, words, sizes = [], [], []
            for i, t in enumerate(texts):
                own, tf = np.unique(terms([t])[0], return_counts=True)
                rows.append(np.full(len(own), i))
                words.append(own.view(np.int64))
                sizes.append(tf)
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
            return join(rows), {"term": join(words), "tf": join(sizes)}
        return work

    items = items.withColumn("_item", F.xxhash64("item_id", "text"))
    found = C.map_texts(items, ["_block", "_item"], make, [T.StructField("term", T.LongType()), T.StructField("tf", T.LongType())])
    found = materialize(found, "item-terms")
    words, count = found.agg(F.sum("tf"), F.countDistinct("_item")).first()
    frequency = found.groupBy("term").agg(F.count("*").alias("n"))
    for k in range(n):
        own = found.where(F.col("_block") == k).select("term").distinct().join(frequency, "term").collect()
        idf = {r["term"]: float(np.log1p((max(0, count - r["n"]) + 0.5) / (r["n"] + 0.5))) for r in own}  # above 0: block maxima are bounds
        block = sorted((tuple(r) for r in items.where(F.col("_block") == k).select("item_id", "text").collect()), key=repr)
        block = [(i, t) for i, t in block if len(terms([t])[0])]
        if block:
            yield block, idf, words / count


def find(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each (row of ``docs``, contaminating item): keep, item_id, score, overlap, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    usable = items.select("item_id", "text").where(F.length("text") > 0)
    fields = [T.StructField("item_id", items.schema["item_id"].dataType)] + [
        T.StructField(k, T.DoubleType()) for k in ("score", "overlap", "question_overlap", "answer_overlap")]
    out = []
    for block, idf, average in _blocks(usable):
        shared = spark.sparkContext.broadcast(Index([i for i, _ in block], [t for _, t in block], idf, average, to_arrow_type(fields[0].dataType)))
        got = C.map_texts(docs, keep, lambda shared=shared: _searcher(shared.value), fields)
        out.append(got)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], T.StructType([docs.schema[c] for c in keep] + fields))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates; one pass for each block of items, no join."""
    usable = items.select("item_id", "text").where(F.length("text") > 0)
    names = docs.columns
    for block, idf, average in _blocks(usable):
        shared = docs.sparkSession.sparkContext.broadcast(
            Index([i for i, _ in block], [t for _, t in block], idf, average, to_arrow_type(items.schema["item_id"].dataType)))

        def make(shared=shared):
            search = _searcher(shared.value)

            def work(texts):
                clean = np.ones(len(texts), dtype=bool)
                clean[np.array(search(texts)[0], dtype=np.int64)] = False
                return None, {"__clean": clean}
            return work
        docs = C.map_texts(docs, names, make, [T.StructField("__clean", T.BooleanType())]).where("__clean").drop("__clean")
    return docs


def _searcher(index: Index):
    def work(texts):
        best: dict = {}
        for rows, parts in C.chunks(texts):
            words, owner = terms(parts)
            for row, item, score, passage in index.search(words, owner, len(parts)):
                overlaps, sizes, judged = [], [], []
                for hashes, width, short in index.parts[item]:
                    sizes.append(len(hashes))
                    overlaps.append(float(np.isin(hashes, shingles(passage, width)).mean()) if len(hashes) else 1.0)
                    judged.append(overlaps[-1] if short is None else float(np.isin(short, passage).mean()))
                both = float(np.dot(overlaps, sizes) / sum(sizes))
                if both >= OVERLAP and min(judged) >= PART:
                    key, value = (int(rows[row]), item), (both, score, *judged)
                    if key not in best or value[:2] > best[key][:2]:
                        best[key] = value
        keys = sorted(best)
        col = lambda k: np.array([best[x][k] for x in keys], dtype=float)
        return [r for r, _ in keys], {"item_id": pa.array([index.ids[i] for _, i in keys], index.id_type), "score": col(1), "overlap": col(0),
                                      "question_overlap": col(2), "answer_overlap": col(3)}
    return work


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with the item's question and answer in the document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, C.table(spark, sf_dir, "benchmark"))
