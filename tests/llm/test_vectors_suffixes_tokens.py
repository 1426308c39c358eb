"""Hard negatives, repeated byte strings and token alignment: against brute force."""
import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import empty
from tidewater.llm import common as C
from tidewater.llm import hard_negatives, suffix_dedup, token_alignment
from tidewater.session import materialize

# -- repeated byte strings -------------------------------------------------------------------------


def without_repeats(texts, length):
    """(n_bytes, n_removed, n_spans, digest of the rest) of each text, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(hashlib.md5(r[i:i + length]).digest() for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[hashlib.md5(r[i:i + length]).digest()] > 1:
                gone[i:i + length] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, dtype=np.uint8)[~gone])).hexdigest()))
    return out


def kept(df):
    return {r.doc_id: (r.n_bytes, sum(s.high - s.low for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def some_texts(seed, n):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefgh \n") for _ in range(k))
    shared = [noise(k) for k in (30, 60, 90, 200, 45, 41)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            p = rng.choice(shared)
            t += noise(rng.randrange(0, 80)) if kind < 0.5 else p[rng.randrange(0, 10):len(p) - rng.randrange(0, 10)] if kind < 0.9 else rng.choice(["ab", "a", "xyzé", "\0", "\0\0a"]) * rng.randrange(1, 80)
        out.append(t)
    return [*out, None, "", out[0], out[0], "é" * 100, "\0" * 50, "\0" * 100]


@pytest.mark.parametrize("length,options", [(16, {}), (40, {}), (32, {"hot": 2}), (40, {"hot": 1}), (40, {"piece": 150})])
def test_repeated_strings_equal_brute_force(spark, length, options):
    texts = some_texts(length + len(options), 110)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert kept(suffix_dedup.remove_repeats(docs, length, **options)) == dict(enumerate(without_repeats(texts, length)))


def test_repeated_strings_query_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = C.table(spark, small, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, without_repeats([r.text for r in rows], 400))}
    got = suffix_dedup.op12_suffix_dedup(spark, small)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def test_repeated_strings_odd_rows(spark, odd_docs):
    got = suffix_dedup.remove_repeats(odd_docs, 400, keep=["doc_id", "key", "n"]).collect()
    assert len(got) == odd_docs.count() and {r.key for r in got} == {"clash"}
    texts = [r.text for r in odd_docs.select("text").collect()]
    assert sorted(w[:3] for w in without_repeats([t for t in texts if len(t or "") < 50_000], 400)) == sorted(
        (r.n_bytes, sum(s.high - s.low for s in r.spans), len(r.spans)) for r in got if r.n_bytes < 50_000)
    assert suffix_dedup.remove_repeats(empty(odd_docs)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd_docs, 8)


def test_a_long_text_of_one_character(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b" + "a" * 399), (3, "x" * 399)], "doc_id long, text string")
    got = kept(suffix_dedup.remove_repeats(docs, 400))
    assert got[1][:3] == (300_000, 300_000, 1) and got[2][:3] == (400, 0, 0) and got[3][:3] == (399, 0, 0)


def test_deep_shallow_sorts(spark):
    rng = random.Random(3)
    strings = [bytes(rng.choice((0, 1, 97)) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    strings += [b"q" * 40 + s for s in strings[:150]] + [b"q" * 40] * 3
    order, prefix = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and prefix[0] == -1
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[k] == n


# -- token alignment -------------------------------------------------------------------------------


def aligned_by_hand(texts):
    """Numbers and digest of each text, by comparing the spans of all pairs of tokens."""
    own = token_alignment.Encoder(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    rows, count = [], collections.Counter()
    for t in texts:
        got = next(iter(own.encode([t]))) if t else None
        if got is None:
            rows.append(None)
            continue
        ids, spans = [g.tolist() for g in got], []
        for k in range(2):
            ends = np.cumsum([len(own.bytes[k][i]) for i in ids[k]]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        found = [(x, y) for x, s in zip(ids[0], spans[0]) for y, u in zip(ids[1], spans[1]) if s[0] < u[1] and u[0] < s[1]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text = ";".join("|".join(",".join(str(i) for i, s in zip(ids[k], spans[k]) if a <= s[0] < b) for k in range(2)) for a, b in zip([0, *cuts[:-1]], cuts))
        rows.append((len(ids[0]), len(ids[1]), len(cuts), found, hashlib.sha256(text.encode()).hexdigest()))
        count.update(found)
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[p] == best[p[1]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


@pytest.fixture(scope="module")
def token_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80)
    rows = [(r.doc_id, (r.text or "")[:1200]) for r in docs.collect()]
    odd = [None, "", " lead", "a▁b", "x  y\n\tz é你好\U0001f600 <|endoftext|> <s> </s> <0x41>", "\x00a", "\x00a", " ", "ﬁ ½ ​ é", "▁", "w" * 5000, " \n" * 3000]
    return rows + [(-1 - k, t) for k, t in enumerate(odd)]


@pytest.mark.parametrize("most", [1 << 18, 400, 1])
def test_token_alignment_equals_brute_force(spark, token_rows, most):
    df = spark.createDataFrame(token_rows, "doc_id long, text string").repartition(6).withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.lit("clash"))
    out = token_alignment.score_links(materialize(token_alignment.align_texts(df, ["doc_id", "row", "n"]), "aligned"), "row", most)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = collections.Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest(r.groups))) for r in out.collect())
    assert got == collections.Counter(zip([i for i, _ in token_rows], aligned_by_hand([t for _, t in token_rows])))


def test_token_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    found = materialize(token_alignment.align_texts(df, ["doc_id", "row"]), "aligned-none")
    assert token_alignment.score_links(found, "row").count() == 0


def test_parts_of_a_long_text_are_encoded_as_the_whole(spark, token_rows):
    own = token_alignment.Encoder(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    whole = " ".join(t for _, t in token_rows[:60])
    want = next(iter(own.encode([whole])))
    parts = token_alignment.parts(whole, 1000)
    got = list(own.encode(parts))
    assert own.cuts and len(parts) > 20
    for k in range(2):
        assert np.concatenate([g[k] for g in got]).tolist() == want[k].tolist()


def test_both_libraries_give_the_same_ids(spark):
    own = token_alignment.Encoder(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    assert own.fast is not None
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} " for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    slow = [e.ids for e in own.many([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in own._ids_a(texts)] == slow


# -- hard negatives --------------------------------------------------------------------------------


def mined_by_hand(rows, every=50):
    """Hard negatives of (id, label, vector) rows by comparing all of them."""
    ok = [(i, y, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ok = list({(i, y, tuple(q)): (i, y, q) for i, y, q in ok}.values())
    out = []
    for i, y, q in ok:
        if i % every:
            continue
        score = [(int(q @ r[2]), r) for r in ok if r[2] is not q]
        for s, p in sorted(((s, r[0]) for s, r in score if r[1] == y), key=lambda x: (-x[0], x[1]))[:5]:
            near = sorted(((t, r[0]) for t, r in score if r[1] != y and 50 * s <= 100 * t <= 95 * s), key=lambda x: (-x[0], x[1]))[:3]
            out += [(i, p, k + 1, n, s, t) for k, (t, n) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 0.4, (6, 12))
    rows = [(i, int(rng.integers(0, 4)), (centre[i % 6] + rng.normal(0, 0.1, 12)).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(120)] + [(2000 + i, 2, rows[0][2]) for i in range(60)]  # one vector very often
    rows += [rows[3], rows[50], rows[50]]  # repeated rows
    rows += [(3000, None, rows[1][2]), (3050, 1, None), (3051, 1, [float("nan")] * 12), (3052, 1, [None, *rows[1][2][1:]]), (3053, 2, [float("inf")] * 12),
             (None, 1, rows[1][2]), (3100, 3, [0.0] * 12), (-50, 0, rows[2][2])]
    return rows


@pytest.mark.parametrize("block,zone_bytes", [(1024, 64 << 20), (16, 64 << 20), (16, 0)])
def test_hard_negatives_equal_brute_force(spark, vector_rows, monkeypatch, block, zone_bytes):
    monkeypatch.setattr(hard_negatives, "ZONE_BYTES", zone_bytes)
    monkeypatch.setattr(hard_negatives, "SHARD", 5)
    df = spark.createDataFrame(vector_rows, "vec_id long, label int, embedding array<float>").repartition(4).withColumn("score", F.lit("clash")).withColumn("block", F.lit(7))
    as_floats = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in vector_rows]
    got = sorted(tuple(r) for r in hard_negatives.mine(df, block=block).collect())
    assert got == mined_by_hand(as_floats) and len(got) > 20


def test_vectors_of_another_length_take_no_part(spark, vector_rows):
    rows = [r for r in vector_rows[:300]] + [(5000, 1, [0.5] * 7), (5050, 1, [])]
    schema = "vec_id long, label int, embedding array<float>"
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(vector_rows[:300], schema)).collect())
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(3051, 1, [float("nan")])], schema)).count() == 0


def test_hilbert_neighbours_are_cell_neighbours():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    key = hard_negatives.hilbert(cells, 4)
    assert sorted(key.tolist()) == list(range(256))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    a, rows = rng.integers(-50, 50, (20, 8)), rng.integers(-50, 50, (30, 40, 8))
    least, most = hard_negatives.bounds(a, rows.min(axis=1), rows.max(axis=1))
    product = np.einsum("ad,brd->abr", a, rows)
    assert (least[:, :, None] <= product).all() and (product <= most[:, :, None]).all()
    big = np.full((1, 4), 1 << 40)
    with pytest.raises(ValueError):
        hard_negatives.products(big, big)
