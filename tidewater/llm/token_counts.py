"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  Its tokens are byte runs that add up to the
text, so a running sum of their lengths gives every token's span.  The spans
are interval-joined to the document's sections (a merge of two sorted lists of
bounds, per document, inside the task), and each token goes to sections by an
explicit rule:

* ``first``: the section that holds the token's first byte (the default; every
  token counts once),
* ``last``: the section that holds its last byte,
* ``split``: as ``first``, and ``token_share`` gives each section the part of the
  token's bytes that lies in it.

Sections are any list of (name, start, end) spans in code points; without one
they are the text's lines (a line's break belongs to it), and :func:`fields`
joins several columns into one text with a section for each.  Nothing is shuffled: a
document's sections leave the task that read it.

Defined cases: a NULL or empty text has no section, hence no row; bytes of a
text outside every section count nowhere; overlapping or empty sections are
refused with an error; a text of any length is encoded whole (one document at a
time in memory, cut only where the tokenizer's own pattern cuts anyway);
repeated rows give their rows again.  Only ``doc_id`` and ``text`` are read, so
further columns do no harm.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C

#: a vocabulary of ranks (base64 token, rank) and the pattern that splits text before the merges
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "split")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """(encoding, bytes of each token by id); loaded once in a Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def fields(names: list[str], separator: str = "\n\n") -> tuple[Column, Column]:
    """(text, spans) of several columns joined to one document; a NULL column is an empty field and has no section."""
    value = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    start, spans = F.lit(0), []
    for n, v in zip(names, value):
        spans.append(F.struct(F.lit(n).alias("name"), start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end")))
        start = start + F.length(v) + len(separator)
    return F.concat_ws(separator, *value), F.filter(F.array(*spans), lambda s: s["end"] > s["start"])


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str):
    """Tokens ``[starts, ends)`` joined to sections ``[lows, highs)`` (both sorted): count, share and crossing tokens of each section."""
    n = len(lows)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
    if ((highs <= lows).any() or (lows[1:] < highs[:-1]).any()):
        raise ValueError("sections must not be empty or overlap")
    a = np.searchsorted(lows, starts, side="right") - 1  # section of the first byte
    b = np.searchsorted(lows, ends - 1, side="right") - 1
    in_a = (a >= 0) & (starts < highs[np.maximum(a, 0)])
    in_b = (b >= 0) & (ends - 1 < highs[np.maximum(b, 0)])
    mine, ok = (b, in_b) if rule == "last" else (a, in_a)
    count = np.bincount(mine[ok], minlength=n)
    inner = in_a & in_b & (a == b)
    share = np.bincount(a[inner], minlength=n).astype(float)
    crossing = np.zeros(n, dtype=np.int64)
    for s, e in zip(starts[~inner], ends[~inner]):  # few: tokens over a bound
        for k in range(max(0, np.searchsorted(highs, s, side="right")), np.searchsorted(lows, e, side="left")):
            part = min(e, highs[k]) - max(s, lows[k])
            if part > 0:
                share[k] += part / (e - s)
                crossing[k] += 1
    return count, share, crossing


def count_sections(docs: DataFrame, spans: Column | None = None, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN,
                   keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row for each section of each document: ``keep``, section, start, end (code points), n_tokens,
    n_crossing (tokens that touch it and lie outside in part), token_share.

    ``spans`` is an array of (name, start, end) sorted by start, in code points;
    None means the text's lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keep = keep or ["doc_id"]
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("section", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("token_share", T.DoubleType())])
    rows = docs.select(*keep, F.col(text).alias("_text"), *([spans.alias("_spans")] if spans is not None else []))
    rows = rows.where(F.length("_text") > 0)
    own_spans = spans is not None

    def run(batches):
        import pyarrow as pa

        enc, size = encoder(vocabulary, pattern)
        for batch in batches:
            ids = [batch.column(i) for i in range(len(keep))]
            given = batch.column(len(keep) + 1).to_pylist() if own_spans else None
            at, out = [], {f.name: [] for f in schema.fields[len(keep):]}

            def flush():
                pick = pa.array(np.concatenate(at) if at else np.zeros(0, dtype=np.int64))
                cols = [c.take(pick) for c in ids]
                for f in schema.fields[len(keep):]:
                    if f.name == "section":
                        cols.append(pa.array([x for part in out["section"] for x in part], pa.string()))
                    else:
                        cols.append(pa.array(np.concatenate(out[f.name]) if out[f.name] else np.zeros(0)).cast(
                            {"start": pa.int32(), "end": pa.int32(), "token_share": pa.float64()}.get(f.name, pa.int64())))
                return pa.RecordBatch.from_arrays(cols, names=schema.names)

            held = 0
            for i, t in enumerate(batch.column(len(keep))):
                t = t.as_py()
                if given is None:
                    breaks = np.flatnonzero(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 10) + 1
                    high = breaks if len(breaks) and breaks[-1] == len(t) else np.append(breaks, len(t))
                    low = np.concatenate(([0], high[:-1]))
                    names = [str(k) for k in range(len(high))]
                else:
                    names = [s["name"] for s in given[i] or []]
                    low, high = (np.array([s[k] for s in given[i] or []], dtype=np.int64) for k in ("start", "end"))
                raw = t.encode()
                end = np.cumsum(size[enc.encode_to_numpy(t, disallowed_special=())])
                start = np.concatenate(([0], end[:-1]))
                if len(raw) == len(t):
                    lows, highs = low, high
                else:  # code points to bytes
                    place = np.append(np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80), len(raw))
                    lows, highs = place[low], place[high]
                count, share, crossing = attribute(start, end, lows, highs, rule)
                at.append(np.full(len(low), i, dtype=np.int64))
                for name, value in (("section", names), ("start", low), ("end", high), ("n_tokens", count), ("n_crossing", crossing),
                                    ("token_share", share if rule == "split" else count.astype(float))):
                    out[name].append(value)
                held += len(low)
                if held >= 50_000:
                    yield flush()
                    at, out, held = [], {k: [] for k in out}, 0
            if at:
                yield flush()

    return rows.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by the rule of the first byte."""
    return count_sections(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
