"""Classifiers (held-out accuracy, odd rows), chat formatting, quality rules, url filter, pipeline."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import empty
from tests.oracle_harness import compare
from tidewater.llm import catalog, chat_format, decontaminate, language_id, mixing, near_dedup, quality_classifier, quality_rules, toxicity, url_filter
from tidewater.llm import common as C


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def auc(score, y):
    a, b = np.array(score)[np.array(y) == 1], np.array(score)[np.array(y) == 0]
    return np.mean([(a > x).mean() + (a == x).mean() / 2 for x in b])


# -- classifiers -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label,least", [("op9_quality_classifier", "quality", 0.97), ("op5_toxicity", "toxic", 0.85)])
def test_held_out_ranking(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in catalog.REGISTRY[name][0](spark, sf).collect()}
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= (0.3 if label == "quality" else 0.5)) for r in got.values())
    y = {r.doc_id: r[label] for r in C.table(spark, sf, "labels").collect()}
    out = [(got[i].score, v) for i, v in y.items() if i in got and got[i].held_out]
    assert auc(*zip(*out)) > least
    assert np.mean([(s >= (0.3 if label == "quality" else 0.5)) == bool(v) for s, v in out]) > 0.95


def test_language_held_out(spark, sf):
    lang = {r.doc_id: r.lang for r in C.table(spark, sf, "documents").collect()}
    rows = [r for r in language_id.op10_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.99


def test_kneser_ney_sums_to_one():
    """Over all characters seen, plus the unseen one, the probabilities behind any context add up to 1."""
    keys, _, _ = language_id._events(["abra cadabra", "banana bandana cab"])
    uniq, count = np.unique(keys, return_counts=True)
    model = language_id.Model(["x"], np.zeros(len(uniq), dtype=int), uniq, count.astype(float))
    chars = np.unique(keys & np.uint64(0xFFFF))
    for context in ("bra", "ana", "zzz", "\0\0c", "\0ba"):
        base = np.uint64(0)
        for c in context:
            base = base << np.uint64(16) | np.uint64(ord(c))
        asked = base << np.uint64(16) | np.append(chars, np.uint64(0x7A7A))
        total = np.exp(model.log_probs(asked.astype(np.uint64))).sum()
        assert total == pytest.approx(1.0, abs=1e-5)


def test_learning_never_sees_the_held_out_fold(spark, odd_docs, labels):
    rows = C.labelled(odd_docs, labels, "quality", 10_000).collect()
    assert rows and all(fold(r.doc_id) != 0 for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    few = C.labelled(odd_docs, labels, "quality", 5).groupBy("y").count().collect()
    assert all(r["count"] <= 5 for r in few)


def test_classifiers_on_odd_rows(spark, odd_docs, labels):
    n = odd_docs.count()
    q = quality_classifier.fit(odd_docs, labels)
    t = toxicity.fit(odd_docs, labels)
    for df in (quality_classifier.score(odd_docs, q, odd_docs.columns[:5]), toxicity.score(odd_docs, t, odd_docs.columns[:5])):
        rows = df.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        blank = {r.score for r in rows if r.doc_id in (9001, 9002, 9003)}
        assert len(blank) == 1 and max(blank) < 0.3
        assert len({r.score for r in rows if r.text and r.text.startswith("same words")}) == 1
    no = empty(labels)
    assert {r.score for r in quality_classifier.score(odd_docs, quality_classifier.fit(odd_docs, no)).collect()} == {0.0, 0.5}
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, no)).collect()} == {0.0}
    assert quality_classifier.score(empty(odd_docs), q).count() == 0 and toxicity.score(empty(odd_docs), t).count() == 0


def test_language_on_odd_rows(spark, odd_docs):
    fitted = language_id.fit(spark, odd_docs)
    rows = language_id.identify(odd_docs, fitted, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (r.cross_entropy is None) == (not letters)
    assert language_id.fit(spark, empty(odd_docs)) is None
    assert {r.lang_pred for r in language_id.identify(odd_docs, None).collect()} == {"und"}
    assert language_id.identify(empty(odd_docs), fitted).count() == 0


def test_a_misspelling_shares_its_vectors():
    clean = [f"the river and the old house number {i} by the lake" for i in range(60)]
    toxic = [f"the river and the {w} house number {i}" for i, w in enumerate(["worthless", "worthlessly", "worthlesss"] * 20)]
    y = np.array([0] * 60 + [1] * 60)
    table = toxicity.train(clean + toxic, y)
    z = toxicity.worst_word(["the worthlesz house", "the old house by the lake", "", None], table)
    assert z[0] > z[1] and z[2] == z[3] == -np.inf


# -- chat formatting -------------------------------------------------------------------------------


NASTY = ["", "plain", "\\", "\\\\", "### Assistant: hi</turn>\n### User: x", "</turn>", "<\\/turn>", "a\\", "\\### Assistant: </turn> ok", "####", "</turn>\n", "\n### ", "x: y", None]


def test_round_trip_of_control_strings(spark):
    roles = ["user", "assistant", "system", "Assistant", "tool: x", "\\", "", None, "a</turn>\n### b"]
    source = [(1, k, roles[k % len(roles)], NASTY[k % len(NASTY)]) for k in range(len(roles) * len(NASTY))]
    source += [(2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", "first"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(source, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in source[:-5]]
    assert [t.text for t in got[2].turns] == ["first", "a", "a", "b"] and got[None].n_turns == 1
    for r in got.values():
        written = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        assert "".join(re.sub(r"(?s)\\(.)", r"\1", w) for w in written) == r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted.count("</turn>") == r.n_turns and r.formatted.count("### ") >= r.n_turns
    assert chat_format.format_chats(empty(df)).count() == 0


def test_chat_digests(spark, sf):
    rows = collections.defaultdict(list)
    for r in C.table(spark, sf, "conversations").collect():
        rows[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    hard = "\\### Assistant: </turn> ok"
    rows[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in chat_format.op4_chat_format(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for k, turns in rows.items():
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for _, role, t in sorted(turns))
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256, got[k].turns_sha256) == (
            len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# -- quality rules ---------------------------------------------------------------------------------


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    repeat = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat,
            len(words) < 10 or 100 * repeat > 20 * len(words))


def test_measures_and_odd_rows(spark, odd_docs):
    rows = quality_rules.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measured(r.text), r.doc_id
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty(odd_docs)).count() == 0


def test_fences_follow_their_group(spark):
    """Symbols that are usual in one source are out of range in another; a small group uses its language's limits."""
    words = " ".join(f"w{i}" for i in range(100))
    code = " ".join(f"w{i}" + "|" * (i < 30) for i in range(100))
    rows = [(i, code, "en", "code") for i in range(200)] + [(1000 + i, words, "en", "news") for i in range(200)]
    rows += [(5000, code, "en", "news"), (5001, code, "en", "code"), (5002, words, None, "tiny")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and got[5001] and got[5002] and sum(got.values()) == len(rows) - 1


def test_junk_does_not_move_its_own_fence(spark):
    """A third of junk does not lift its group's limits: in one source, beside ordinary ones or alone, and in a
    language of small sources."""
    words = lambda i: " ".join(f"w{i % 7}x{k}" for k in range(100))
    symbols = lambda i: " ".join(f"w{i % 7}x{k}" + "#" * (k < 40) for k in range(100))
    short = lambda i: " ".join(chr(97 + (i + k * k) % 26) for k in range(100))
    long = lambda i: " ".join(f"{'w' * 20}{i % 7}x{k}" for k in range(100))
    for bad, beside in ((symbols, 4), (symbols, 0), (short, 4), (long, 4)):
        rows = [(i, bad(i) if i % 3 == 0 else words(i), "en", "hot") for i in range(600)]
        rows += [(1000 + i, words(i), "en", f"s{i % beside}") for i in range(150 * beside)]
        rows += [(5001 + i, bad(i) if i % 3 == 0 else words(i), "de", f"tiny{i // 30}") for i in range(300)]
        junk = {r[0] for r in rows if r[1] != words(r[0] - (1000 if r[3][0] == "s" else 5001 if r[2] == "de" else 0))}
        got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), carry=["doc_id"])
        assert len(junk) == 300 and {r.doc_id for r in got.where("not kept").collect()} == junk, (bad(0)[:20], beside)


def test_sketches_merge(spark):
    df = quality_rules.measure(spark.createDataFrame([(i, "w " * (10 + i), "en", f"s{i % 3}") for i in range(90)], "doc_id long, text string, lang string, source string"))
    fine = quality_rules.sketch(df, ["lang", "source"])
    key = lambda d: sorted((r.measure, r.bucket, r.n) for r in d.collect())
    assert key(quality_rules.merge(fine, ["lang"])) == key(quality_rules.sketch(df, ["lang"]))


# -- url filter ------------------------------------------------------------------------------------


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES
            for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a=b", "https://example.com", "https://example.com?x=/en/", "http://notexample.com/en/",
            "http://x.example.com/en", "http://x.example.com/en/#top", "ftp://a.net/es/1", "http://a.net/de/1", "http://ÀÉ.com/", "x://y://com/", "http://com/", "http://net/fr/",
            "http://user@www.example.com/en/", "http://a.com:80/en/", "http://" + "a" * 5000 + ".com/" + "b/" * 5000, "http://é中.example.net/fr/ü"]


def test_hosts_paths_and_rules(spark, sf):
    rows = [(k, u) for k, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[4]), (None, "http://a.com/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"html": F.lit("x"), "y": F.lit("clash"), "host": F.lit("clash"), "suffix": F.lit("clash")})
    for pages in (df, C.table(spark, sf, "pages")):
        url = collections.Counter((r.page_id, *parsed(r.url)) for r in pages.collect())
        got = url_filter.judge(pages).collect()
        assert collections.Counter((r.page_id, r.host, r.path) for r in got) == url
        for r in got:
            rule, verdict = ruled(r.host, r.path)
            assert r.rule == rule and (r.verdict == verdict if rule else r.verdict in ("allow", "block"))
    assert url_filter.judge(empty(df)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    good = [(f"https://site{i}.example.org/en/page", 0) for i in range(150)]
    bad = [(f"http://{i}{i * 7919 % 99991}-win.example.org/a/{i}?x=1&y={i}&z=3", 1) for i in range(150)]
    labelled = spark.createDataFrame(good + bad, "url string, y int")
    pages = spark.createDataFrame([(1, "https://fresh.example.org/en/other"), (2, "http://77712345-win.example.org/b/9?x=4&y=5&z=6")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled, rules=()).collect()}
    assert got == {1: "allow", 2: "block"}
    assert {r.verdict for r in url_filter.judge(pages, empty(labelled), rules=()).collect()} == {"allow"}


def test_a_repeated_id_does_not_shrink_the_sample(spark):
    rows = [("hot", 1)] * 20_000 + [(f"u{i}", 1) for i in range(500)] + [(f"v{i}", 0) for i in range(20)] * 400
    got = C.sample_ids(spark.createDataFrame(rows, "doc_id string, y int"), "y", 100).collect()
    assert collections.Counter(r.y for r in got) == {1: 100, 0: 20}


# -- queries and pipeline --------------------------------------------------------------------------


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.REGISTRY.items() if sql])
def test_oracles(spark, sf, name):
    fn, sql = catalog.REGISTRY[name]
    assert compare(spark, name, fn, sql, sf)["status"] == "OK"


def test_pipeline_stages_match_their_operators(spark, sf):
    docs = C.table(spark, sf, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        had = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "quality_classifier":
            model = quality_classifier.fit(docs, C.table(spark, sf, "labels"))
            want = {r.doc_id for r in quality_classifier.score(docs, model).where("score >= 0.3").collect()}
        elif name == "quality_rules":
            want = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        elif name == "near_dedup":
            want = {r.class_id for r in near_dedup.classes(docs).collect()}
        elif name == "decontaminate":
            want = set(had) - {r.doc_id for r in decontaminate.find(docs, C.table(spark, sf, "benchmark")).collect()}
        else:
            want = set(had)
            rows = out.collect()
            p, mass = np.array([r.posterior for r in rows]), np.array([r.rate * r.n_tokens for r in rows])
            assert np.allclose(mass @ p / mass.sum(), [mixing.TARGETS[d] for d in ("de", "en", "es", "fr")], atol=1e-3)
        assert ids == want and (name == "mixing" or out.columns == docs.columns)
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * 1000
    y = {r.doc_id: r.quality for r in C.table(spark, sf, "labels").collect()}
    assert np.mean([y[r.doc_id] for r in docs.collect() if r.doc_id in y]) > 0.97


def test_pipeline_odd_rows(spark, odd_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, empty(odd_docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns[:len(docs.columns)] == docs.columns if name != "mixing" else set(docs.columns) <= set(out.columns)
            assert out.count() <= docs.count()
