"""Near-duplicates, decontamination, token counts, mixing: against brute force."""
import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import empty
from tidewater.llm import common as C
from tidewater.llm import decontaminate, mixing, near_dedup, token_counts


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(words))
    return collections.Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute_classes(rows):
    """Class of each row (by position): components of similarity 0.8, smallest id."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = [None] * len(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = rows[i][0] if not bags[i] else min(ids, default=None)
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(1000)}"
    return words


@pytest.fixture(scope="module")
def group_rows():
    rng = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(6):  # groups of near copies around the threshold, and chains of edits
        base = list(rng.choice(vocabulary, 120))
        now = base
        for k in range(20):
            rows.append((len(rows), " ".join(edited(rng, base, int(rng.integers(0, 5))))))
            now = edited(rng, now, 2)
            rows.append((len(rows), " ".join(now)))
    common = " ".join(rng.choice(vocabulary, 60))
    for k in range(30):  # a passage that many share
        rows.append((len(rows), common + " " + " ".join(rng.choice(vocabulary, 40))))
    rows += [(len(rows) + k, "x y z " * 30 + f"end{k % 3}") for k in range(6)]  # heavy weights
    return rows


def test_classes_match_brute_force(spark, group_rows):
    df = spark.createDataFrame(group_rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == {r[0]: c for r, c in zip(group_rows, brute_classes(group_rows))}


def test_classes_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(map(repr, ((r.doc_id, r.class_id) for r in near_dedup.classes(odd_docs).collect())))
    assert got == sorted(map(repr, ((r[0], c) for r, c in zip(rows, brute_classes(rows)))))
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(9007) == 1 and 9008 not in ids and ids.count(None) == 1 and {9001, 9002, 9003, 9004} <= set(ids)
    assert near_dedup.classes(empty(odd_docs)).count() == 0 and near_dedup.keep_one(empty(odd_docs)).count() == 0


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (1, "other words than those at all")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()) == [(1, "a b c d e f"), (1, "other words than those at all")]


@pytest.mark.parametrize("a,b", [("x y z " * 7 + " ".join(f"q{i}" for i in range(9)), "x y z " * 4 + " ".join(f"q{i}" for i in range(9))),
                                 ("a b c d e f g h i j k l", "a b c d e f g h i j k m")])
def test_signature_is_unbiased(a, b):
    s, _ = near_dedup.signatures([a, b], 6000)
    want = jaccard(bag(a), bag(b))
    assert abs((s[0] == s[1]).mean() - want) < 5 * (want * (1 - want) / 6000) ** 0.5
    alone, _ = near_dedup.signatures([b], 6000)
    assert (alone[0] == s[1]).all()  # a signature does not depend on its neighbours


def test_decontamination_matches_brute_force(spark, sf):
    docs, items = C.table(spark, sf, "documents"), C.table(spark, sf, "benchmark")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    bench = {r.item_id: grams(words(r.text)) for r in items.collect()}
    want = set()
    for r in docs.where("text is not null").collect():
        have = set(grams(words(r.text)))
        want |= {(r.doc_id, i) for i, g in bench.items() if sum(x in have for x in g) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    assert got == want and len(want) > 10


def test_decontamination_odd_rows(spark, odd_docs, monkeypatch):
    q = "What did the quick brown fox jump over last night? The extremely lazy dog of the old farmer."
    items = spark.createDataFrame([(1, q), (2, q), (None, "A question of one kind about rivers.\nIts answer names seven long rivers of the north."),
                                   (4, None), (5, ""), (6, "...")], "item_id long, text string").withColumn("term", F.lit("clash"))
    pad = " ".join(f"pad{i}" for i in range(500))
    half = q.split("?")[0]
    extra = spark.createDataFrame([(1, f"{pad} {q} {pad}"), (1, f"{pad} {q} {pad}"), (2, pad + " " + half + " " + pad), (3, q.upper()),
                                   (None, pad + " a question of one kind about rivers its answer names seven long rivers of the north")], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    want = sorted([(1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2), (None, None)], key=repr)
    for limit in (decontaminate.MAX_INDEX_CHARS, 200):  # one index, and one for each few items
        monkeypatch.setattr(decontaminate, "MAX_INDEX_CHARS", limit)
        assert sorted(((r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()), key=repr) == want
        left = decontaminate.remove(docs, items)
        assert left.columns == docs.columns and left.count() == docs.count() - 4
    assert decontaminate.find(empty(docs), items).count() == 0
    assert decontaminate.find(docs, empty(items)).count() == 0 and decontaminate.remove(docs, empty(items)).count() == docs.count()


def test_terms_of_most_items(spark):
    """Templated items, untemplated ones among them, and a single item are found, whole and with the last word altered."""
    template = " ".join(f"template{k}" for k in range(30))
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    few = [(i, f"{template} {own(i, 15)}" if i % 10 else own(i, 15)) for i in range(300)]  # nine of ten share 30 words
    many = [(i, f"{template[:230]} {own(i, 15)}" if i % 33 else own(i, 15)) for i in range(300)]  # 97 of 100
    for items in (few, many, few[:1], few[1:2], few[1:3]):
        docs = [(i, f"{few[1][1]} and {t}") for i, t in items] + [(1000 + i, f"{t.rsplit(' ', 1)[0]} another") for i, t in items]
        got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        pairs = {(r.doc_id, r.item_id) for r in got.collect()}
        assert pairs >= {(k, i) for i, _ in items for k in (i, 1000 + i)}
        assert all(k % 1000 == i or i == 1 for k, i in pairs)


def test_one_altered_word_of_a_short_part(spark):
    """One word altered in a short answer or question leaves a hit; a copy without the answer is none."""
    say = lambda i, what, n: [f"{what}{i}x{k}" for k in range(n)]
    items, docs, want = [], [], set()
    for i in range(1, 17):
        for k, (q, a) in enumerate(((say(i, "q", 60), say(i, "a", i)), (say(100 + i, "q", i), say(100 + i, "a", 60)))):
            item, short = 2 * i + k, (a, q)[k]
            items.append((item, " ".join(q) + "?\n" + " ".join(a) + "."))
            for at in range(i):
                changed = [w if n != at else "altered" for n, w in enumerate(short)]
                docs.append((1000 * item + at, " ".join(q + changed if k == 0 else changed + a)))
                want.add((1000 * item + at, item))
            if i > 1:
                docs.append((1000 * item + 500, " ".join((q, a)[k])))
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want <= got and not [p for p in got if p[0] % 1000 == 500]


def test_block_max_prunes_nothing_due(spark):
    """All items that get what they need are retrieved, whatever the blocks."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 30) % 400) for _ in range(90)]
    df = collections.Counter(w for t in texts for w in set(C.run_hashes(*_spans(t)).view(np.int64).tolist()))
    idf = {k: float(np.log1p((90 - v + 0.5) / (v + 0.5))) for k, v in df.items()}
    import pyarrow as pa
    index = decontaminate.Index(list(range(90)), texts, idf, 30.0, pa.int64())
    queries = [" ".join(rng.permutation(texts[k].split())[:24]) for k in range(60)]
    words, owner = decontaminate.terms(queries)
    got = {(r, i) for r, i, _, _ in index.search(words, owner, len(queries))}
    want = set()
    impact = collections.defaultdict(dict)
    for k in range(len(index.index.keys)):
        for at in range(index.first[k], index.first[k + 1]):
            impact[int(index.owner[at])][int(index.index.keys[k])] = index.impact[at]
    for r, q in enumerate(queries):
        have = set(decontaminate.terms([q])[0].tolist())
        want |= {(r, i) for i, w in impact.items() if sum(v for t, v in w.items() if t in have) >= index.need[i]}
    assert got == want and len(want) >= 40


def test_least_share_is_a_lower_bound_over_all_gaps():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, cut = int(rng.integers(1, 40)), int(rng.integers(0, 40))
        words = rng.integers(0, 25, n).astype(np.uint64)
        parts = [words[:min(cut, n)], words[min(cut, n):]]
        parts = parts if len(parts[0]) else [words, words[:0]]
        share = dict(zip(np.unique(words).tolist(), rng.dirichlet(np.full(len(np.unique(words)), 0.3)).tolist()))
        least = decontaminate.least_share(parts, share)
        for _ in range(200):  # random altered words: any passage that still counts has at least that share
            gone = rng.random(n) < rng.choice([0.02, 0.05, 0.1])
            at = int(rng.integers(0, n))
            gone[at:at + int(rng.integers(0, 10))] = True
            total = lost = done = 0
            for p in parts:
                k = min(5, len(p))
                for i in range(max(0, len(p) - k + 1) if len(p) else 0):
                    total, lost = total + 1, lost + bool(gone[done + i:done + i + k].any())
                done += len(p)
            if (total - lost) / total >= decontaminate.OVERLAP:
                held = set(words[~gone].tolist())
                assert sum(v for w, v in share.items() if w in held) >= least - 1e-9


def test_templated_items_with_gaps_are_found(spark):
    """Items that differ in 8 of 50 words; copies with gaps of any kind against brute force over shingles."""
    rng = np.random.default_rng(8)
    template = [f"tpl{i}" for i in range(42)]
    items, docs = [], []
    for k in range(300):
        at = int(rng.integers(0, 43))
        own = [f"own{k}x{i}" for i in range(8)]
        items.append((k, " ".join(template[:at] + own + template[at:])))
        words = items[-1][1].split()
        if k % 3 == 0:  # five of the eight own words altered, next to each other
            s = at + int(rng.integers(0, 4))
            words[s:s + 5] = [f"new{i}" for i in range(5)]
        elif k % 3 == 1:
            for i in rng.integers(0, 50, int(rng.integers(1, 4))):
                words[int(i)] = "other"
        docs.append((1000 + k, " ".join([f"front{k}"] * 7 + words + [f"back{k}"] * 9)))
    docs.append((9, " ".join(template)))
    want = set()
    grams = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    for d, t in docs:
        have = set(grams(t.split()))
        want |= {(d, i) for i, x in items if np.mean([g in have for g in grams(x.split())]) >= decontaminate.OVERLAP}
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 200
    assert any(d - 1000 == i and i % 3 == 0 for d, i in want)


def _spans(text):
    codes, _ = C.code_points([text.lower()])
    return (codes, *C.word_spans(C.char_table("alnum")[codes]))


# -- token counts ----------------------------------------------------------------------------------


def test_token_counts_match_offsets_of_another_library(spark, odd_docs):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    got = collections.defaultdict(list)
    for r in token_counts.count_sections(odd_docs.dropDuplicates(["doc_id"])).collect():
        got[r.doc_id].append((int(r.section), r.start, r.end, r.n_tokens))
    for r in odd_docs.dropDuplicates(["doc_id"]).collect():
        if not r.text:
            assert r.doc_id not in got
            continue
        at, want = 0, []
        starts = [a for a, _ in other.encode(r.text, add_special_tokens=False).offsets]
        for k, line in enumerate(x for x in re.split(r"(?<=\n)", r.text) if x):
            want.append((k, at, at + len(line), sum(at <= s < at + len(line) for s in starts)))
            at += len(line)
        if r.text.isascii():  # offsets of split characters differ between the libraries
            assert sorted(got[r.doc_id]) == want
        else:
            assert [x[:3] for x in sorted(got[r.doc_id])] == [x[:3] for x in want]
        assert sum(x[3] for x in got[r.doc_id]) == len(starts)


def test_token_rules_and_fields(spark):
    df = spark.createDataFrame([(1, "Hello", None, "world again"), (2, None, None, None)], "doc_id long, title string, note string, body string")
    text, spans = token_counts.fields(["title", "note", "body"], " ")
    rows = token_counts.count_sections(df.withColumn("text", text), spans).collect()
    assert [(r.doc_id, r.section, r.start, r.end) for r in rows if r.doc_id == 1] == [(1, "title", 0, 5), (1, "body", 7, 18)]
    assert not [r for r in rows if r.doc_id == 2]
    a, b = np.array([0, 3, 6]), np.array([3, 6, 9])  # tokens
    low, high = np.array([0, 4]), np.array([4, 9])
    assert token_counts.attribute(a, b, low, high, "first")[0].tolist() == [2, 1]
    assert token_counts.attribute(a, b, low, high, "last")[0].tolist() == [1, 2]
    count, share, crossing = token_counts.attribute(a, b, low, high, "split")
    assert np.allclose(share, [1 + 1 / 3, 1 + 2 / 3]) and crossing.tolist() == [1, 1]
    with pytest.raises(ValueError):
        token_counts.attribute(a, b, np.array([0, 3]), np.array([4, 9]), "first")
    assert token_counts.count_sections(empty(df.withColumn("text", F.lit("x")))).count() == 0


# -- mixing ----------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark, sf):
    rows = mixing.op3_mixing(spark, sf).collect()
    p, n, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    share = (n * r) @ p / n.sum()
    assert np.allclose(share, [mixing.TARGETS[d] for d in ("de", "en", "es", "fr")], atol=1e-4) and (r >= 0).all()
    # brute force: the same descent in one array
    goal, want = np.array([0.2, 0.4, 0.2, 0.2]), np.ones(len(n))
    base = n @ p / n.sum()
    for _ in range(300):
        want = np.maximum(0, want - p @ (((n * want) @ p / n.sum() - goal) / base))
    assert np.allclose(r, want, atol=1e-3)
    lang = {x.doc_id: x.lang for x in C.table(spark, sf, "documents").collect()}
    assert np.mean([lang[x.doc_id] == x.domain for x in rows]) > 0.98
    assert abs(sum(x.copies * x.n_tokens for x in rows) / n.sum() - 1) < 0.1


def test_mixing_domain_without_a_target(spark, sf):
    """It keeps its share and the named domains share the rest; targets out of reach are reported."""
    docs = C.table(spark, sf, "documents")
    labelled = mixing.labelled_languages(docs, C.table(spark, sf, "labels"))
    rows = mixing.mix(docs, labelled, {"en": 0.5, "de": 0.25, "fr": 0.25}).collect()
    n, p, r = np.array([x.n_tokens for x in rows], float), np.array([x.posterior for x in rows]), np.array([x.rate for x in rows])
    es = (n @ p / n.sum())[2]
    assert np.allclose((n * r) @ p / n.sum(), [0.25 * (1 - es), 0.5 * (1 - es), es, 0.25 * (1 - es)], atol=1e-3)
    assert all(x.rate > 0.5 for x in rows if x.domain == "es")
    flat = spark.createDataFrame([(10, [0.9, 0.1])] * 3, "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="not reached"):
        mixing.fit_rates(flat, np.array([0.1, 0.9]))


def test_mixing_odd_rows(spark, odd_docs, labels):
    labelled = mixing.labelled_languages(odd_docs, labels)
    out = mixing.mix(odd_docs, labelled, mixing.TARGETS, odd_docs.columns[:5])
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (9001, 9002, 9003)} == {0}
    assert mixing.mix(empty(odd_docs), labelled, mixing.TARGETS).count() == 0
    alone = mixing.mix(odd_docs, empty(labelled), mixing.TARGETS).collect()
    assert {(r.domain, r.rate, r.copies) for r in alone} == {("all", 1.0, 1)}
    assert {r.rate for r in mixing.mix(odd_docs, labelled, {"xx": 1.0}).collect()} == {1.0}
