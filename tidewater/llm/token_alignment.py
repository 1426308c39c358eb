"""Alignment of two tokenizers by diagonal run skipping.

A text (with a space before it) is encoded by tokenizer A, a byte-level BPE, and
by tokenizer B, a sentence-piece model.  Both give byte runs that add up to the text;
places where a token of A and one of B end together cut them into *groups*.

*Groups* (:func:`align`).  The end arrays are compared at the current index shift.  While
tokens end together one by one, probes of 1, 2, 4, ... ends jump ahead, and halving probes find
where the stretch stops.  There the ends are merged until they meet again: that is an irregular group, and its sizes update the shift.

*Links.*  Every token of A is linked to the tokens of B that share bytes with it: one link in a group of one
to one, one for each stretch between neighbouring ends in an irregular group.

*Counts.*  A document's links are kept as distinct id pairs with their number.  Their
sums over the corpus are one aggregation; a pair is *best* if no other pair of
its B id counts more.  To score links, the most frequent pairs are
broadcast: at most ``MAX_SHARED``, all from a power of two of the count on; links of other pairs are joined
to the counts in a shuffle.  Both ways give the same numbers.

Long texts are encoded in parts of about ``PART`` characters, cut at a single space between two ASCII
letters: neither tokenizer joins bytes across it (checked for the pieces of B), and a part begins with that space.

Defined cases: a NULL or empty text, or one whose joined token bytes of A or B are not the space and the
text (say, one that holds U+2581), has no tokens: zeros and an empty string; repeated rows count
each; ids of special tokens never occur, as their strings are plain text.  Only ``doc_id`` and ``text`` are
read besides ``keep``, so further columns do no harm.  The vocabulary files have to be on every executor (their paths are parameters).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C
from tidewater.session import materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: the pieces of a byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters without a break between letters and others from which on a text goes to the library with the heap
RUN = 2000
_LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))
#: characters encoded at a time, and about the length of the parts of a long text
PART = 1 << 18
#: pairs in the broadcast table of counts
MAX_SHARED = 1 << 18
SPACE = "▁"


# -- tokenizers ------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves,
    the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Both tokenizers, each with the bytes, the length and the decimal texts of its ids.

    The byte-level BPE is run by the faster of two libraries (``fast``) where its file lets both give the same ids: plain
    byte-level pieces by ``PATTERN``, no normaliser, and merges in the order of their ids.  Texts with
    a run of ``RUN`` characters without a break go to the other, which sorts such a piece's merges in a heap.
    """

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = bytes_a, bytes_b
        self.size = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in self.bytes)
        self.shown = [f"{i}{after}" for t, pair in zip(self.bytes, (",|", ",;")) for after in pair for i in range(len(t))]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.fast = self._fast(a, alphabet)

    def _fast(self, path: str, alphabet: dict[str, int]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ranks = [ids.get("".join(m), -1) for m in merges]
        plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
                 and not spec.get("normalizer") and all(x < y for x, y in zip(ranks, ranks[1:])) and all(ids[c] < ranks[0] for c in alphabet))
        if not plain:
            return None
        import tiktoken
        own = {self.bytes[0][i]: i for i in ranks} | {bytes([v]): ids[c] for c, v in alphabet.items()}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or _LONG_RUN.search(t)]
        out = [None] * len(texts)
        for i, e in zip(slow, self.many([" " + texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype=np.int64)
        return [self.fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) if x is None else x for t, x in zip(texts, out)]

    def encode(self, texts: list[str]):
        """Ids of A and of B for each text, None where their bytes are not a space and the text."""
        for t, x, y in zip(texts, self._ids_a(texts), self.b.encode(texts, num_threads=1)):
            raw = b" " + t.encode()
            same = int(self.size[0][x].sum()) == len(raw) and all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in zip(self.bytes, (x.tolist(), y)))
            yield (x, np.array(y, dtype=np.int64)) if same else None


@lru_cache(maxsize=2)
def encoder(a: str, b: str) -> Encoder:
    """Loaded once in a Python worker."""
    return Encoder(a, b)


def parts(text: str, limit: int) -> list[str]:
    """The text cut at single spaces (left out: each part is encoded with one before it) between ASCII letters, about every ``limit`` characters."""
    out, at = [], 0
    letter = lambda c: c.isascii() and c.isalpha()
    while len(text) - at > limit:
        to = text.find(" ", at + limit)
        while to > 0 and not (to + 1 < len(text) and letter(text[to - 1]) and letter(text[to + 1])):
            to = text.find(" ", to + 1)
        if to < 0:
            break
        out.append(text[at:to])
        at = to + 1
    return [*out, text[at:]]


# -- alignment -------------------------------------------------------------------------------------


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Stretches of A and B tokens (from and to, of A, then of B) of rising ends with the same last one: those of
    one-to-one groups, as long as they go, and each irregular group.  A stretch with as many tokens of B as of A, whose first ends agree, is of the first kind."""
    i = j = 0
    n, out = len(a), []
    while i < n:
        from_i, from_j = i, j
        if a[i] == b[j]:  # a one-to-one stretch: look, then gallop at this shift
            near = min(i + 8, n)
            i += 1
            j += 1
            while i < near and a[i] == b[j]:
                i += 1
                j += 1
            if i == near < n:
                step = 8
                while i < n and (run := a[i:i + step]) == b[j:j + step]:
                    i += len(run)
                    j += len(run)
                    step *= 2
                while step > 1 and i < n:
                    step //= 2
                    if (run := a[i:i + step]) == b[j:j + step]:
                        i += len(run)
                        j += len(run)
        else:  # an irregular group: merge the ends until they meet
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
        out.append((from_i, i, from_j, j))
    return out


def groups(runs: list[tuple[int, int, int, int]], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups, as numbers of tokens of A and of B before them."""
    from_a, to_a, from_b, to_b = np.array(runs, dtype=np.int64).T
    count = np.where(single, to_a - from_a, 1)
    run = np.repeat(np.arange(len(count)), count)
    nth = np.arange(1, len(run) + 1) - (np.cumsum(count) - count)[run]
    one = single[run]
    return np.where(one, from_a[run] + nth, to_a[run]), np.where(one, from_b[run] + nth, to_b[run])


def links(end_a: np.ndarray, end_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) of all links of the groups that end at the given cuts; the arrays may hold several texts
    one after the other, with rising ends."""
    size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    single = (size_a == 1) & (size_b == 1)
    odd_a, odd_b = np.flatnonzero(np.repeat(~single, size_a)), np.flatnonzero(np.repeat(~single, size_b))
    stretch = np.union1d(end_a[odd_a], end_b[odd_b])  # between neighbouring ends there is one token of each side
    return (np.concatenate((cut_a[single] - 1, odd_a[np.searchsorted(end_a[odd_a], stretch)])),
            np.concatenate((cut_b[single] - 1, odd_b[np.searchsorted(end_b[odd_b], stretch)])))


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, shown: list[str], n_a: int, n_b: int) -> str:
    """``a1,a2|b1;a3|b2,b3``.

    ``shown`` has each id with what follows it: A's before a comma, A's before a bar, B's before a comma, B's before a semicolon.
    """
    size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    which = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    last_a[cut_a - 1] = n_a
    last_b[cut_b - 1] = n_b
    which[np.arange(len(ids_a)) + np.repeat(cut_b - size_b, size_a)] = ids_a + last_a
    which[np.arange(len(ids_b)) + np.repeat(cut_a, size_b)] = 2 * n_a + ids_b + last_b
    return "".join(map(shown.__getitem__, which.tolist()))[:-1]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _solve(own: Encoder, texts: list[str]):
    """Numbers, groups, and the distinct pairs with their times, of each text (a part of a document); None where it has no tokens."""
    found = list(own.encode(texts))
    out: list = [None] * len(texts)
    ends, cuts, all_ids, owner, base, count = ([], []), ([], []), ([], []), [], 0, (0, 0)
    for i, got in enumerate(found):
        if got is None:
            continue
        end = [np.cumsum(size[ids]) for size, ids in zip(own.size, got)]
        la, lb = (e.tolist() for e in end)
        runs = align(la, lb)
        cut = groups(runs, np.array([la[r[0]] == lb[r[2]] for r in runs]))
        n = (len(la), len(lb))
        out[i] = [np.array((*n, len(cut[0]), sum(n) - len(cut[0]))), groups_text(*got, *cut, own.shown, len(own.size[0]), len(own.size[1])), None, None]
        for k in range(2):
            ends[k].append(end[k] + base)
            cuts[k].append(cut[k] + count[k])
            all_ids[k].append(got[k])
        owner.append(np.full(n[0], i))
        base += la[-1]
        count = (count[0] + n[0], count[1] + n[1])
    if not owner:
        return out
    at_a, at_b = links(*(np.concatenate(e) for e in ends), *(np.concatenate(c) for c in cuts))
    id_a, id_b = (np.concatenate(x) for x in all_ids)
    bits_a, bits_b = len(own.size[0]).bit_length(), len(own.size[1]).bit_length()
    key = (np.concatenate(owner)[at_a] << (bits_a + bits_b)) | (id_a[at_a] << bits_b) | id_b[at_b]
    key, times = np.unique(key, return_counts=True)
    text = key >> (bits_a + bits_b)
    pair = (key >> bits_b & ((1 << bits_a) - 1)) << 32 | key & ((1 << bits_b) - 1)
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(text)]):
        out[text[s]][2:] = [pair[s:e], times[s:e]]
    return out


def align_texts(docs: DataFrame, keep: list[str] | None = None, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """``keep`` columns of each row, n_a, n_b, n_groups, n_links, groups (text), pairs and times: its distinct id
    pairs, each as ``a * 2**32 + b``, and how many links hold each."""
    keep = keep or ["doc_id"]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in _NUMBERS] + [
        T.StructField("groups", T.StringType()), T.StructField("pairs", longs), T.StructField("times", longs)])

    def merged(parts):
        """One document of its parts."""
        if not parts or any(p is None for p in parts):
            return np.zeros(4, dtype=np.int64), "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(parts) == 1:
            return parts[0]
        pair, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        times = np.zeros(len(pair), dtype=np.int64)
        np.add.at(times, back, np.concatenate([p[3] for p in parts]))
        return sum(p[0] for p in parts), ";".join(p[1] for p in parts), pair, times

    def run(batches):
        own = encoder(a, b)

        def rows(batch, start, texts):
            units = [(i, u) for i, t in enumerate(texts) if t for u in (parts(t, PART) if own.cuts and len(t) > PART else [t])]
            solved: list[list] = [[] for _ in texts]
            held, size = [], 0
            for k, (i, u) in enumerate(units):
                held.append((i, u))
                size += len(u)
                if size >= PART or k + 1 == len(units):
                    for (x, _), got in zip(held, _solve(own, [y for _, y in held])):
                        solved[x].append(got)
                    held, size = [], 0
            done = [merged(s) for s in solved]
            bounds = np.concatenate(([0], np.cumsum([len(d[2]) for d in done])))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([d[k] for d in done]).astype(np.int64))) for k in (2, 3)]
            return pa.RecordBatch.from_arrays(
                [batch.column(i).slice(start, len(texts)) for i in range(len(keep))] + [pa.array([int(d[0][k]) for d in done], pa.int64()) for k in range(4)]
                + [pa.array([d[1] for d in done], pa.string()), *lists], names=schema.names)

        for batch in batches:
            start, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(len(keep))[i].as_py())
                size += len(texts[-1] or "")
                if size >= PART or i + 1 == batch.num_rows:
                    yield rows(batch, start, texts)
                    start, texts, size = i + 1, [], 0

    return docs.select(*keep, "text").mapInArrow(run, schema)


# -- counts ----------------------------------------------------------------------------------------


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all rows; best if no pair of the same B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("_most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least power of two from which on at most ``most`` pairs count, and whether that leaves pairs out."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r["k"]: r["c"] for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("c")).collect()}  # 63 rows at most
    total, low = 0, 64
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            break
        total, low = total + sizes[k], k
    return (1 << low if low < 63 else (1 << 63) - 1), total < sum(sizes.values())


def score_links(aligned: DataFrame, row: str, most: int = MAX_SHARED) -> DataFrame:
    """``aligned`` without pairs and times, with n_best (links of best pairs) and count_sum (sum of the pair's count
    over links); ``row`` names a column that tells rows apart."""
    spark = aligned.sparkSession
    counts = materialize(pair_counts(aligned), "pair-scores")
    low, more = _frequent(counts, most)
    table = counts.where(F.col("n") >= low).toArrow()  # ``most`` rows at most
    key = table.column("pair").to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], table.column("n").to_numpy()[order], np.asarray(table.column("best").to_pylist(), dtype=bool)[order]))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = T.StructType([aligned.schema[c] for c in kept] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def lookup(pairs):
        key, n, best = shared.value
        at = np.minimum(np.searchsorted(key, pairs), max(0, len(key) - 1))
        hit = key[at] == pairs if len(key) else np.zeros(len(pairs), dtype=bool)
        return hit, (np.where(hit, n[at], 0), np.where(hit, best[at], False)) if len(key) else (np.zeros(len(pairs), dtype=np.int64),) * 2

    def flat(batch, names):
        pairs, times = (batch.column(names.index(c)) for c in ("pairs", "times"))
        size = np.diff(pairs.offsets.to_numpy())
        return pairs.flatten().to_numpy(), times.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)

    def run(batches):
        for batch in batches:
            pairs, times, owner = flat(batch, columns)
            _, (n, best) = lookup(pairs)
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], owner, times * best)
            np.add.at(sums[1], owner, times * n)
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in kept] + [pa.array(s) for s in sums], names=schema.names)

    def rest(batches):
        for batch in batches:
            pairs, times, owner = flat(batch, ["pairs", "times", row])
            miss = ~lookup(pairs)[0]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(owner[miss])), pa.array(pairs[miss]), pa.array(times[miss])], names=[row, "pair", "times"])

    columns = aligned.columns
    out = aligned.mapInArrow(run, schema)
    if not more:
        return out
    rare = aligned.select("pairs", "times", row).mapInArrow(rest, T.StructType([aligned.schema[row], T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    rare = rare.join(counts.where(F.col("n") < low), "pair")
    add = rare.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.join(add, row, "left").select(*kept, plus("n_best", "_best"), plus("count_sum", "_sum"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers in every document, scored by counts over all documents."""
    found = align_texts(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    found = found.withColumns({"groups_sha256": digest, "_row": F.monotonically_increasing_id()}).drop("groups")
    out = score_links(materialize(found, "aligned"), "_row")  # written once: a row keeps its number
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
