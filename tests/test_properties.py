"""Transforms against plain-Python models of their semantics (hypothesis)."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.fixed import UNICODE_WHITESPACE
from tidewater.functions.transforms import apply_transform

ALPHABET = "abcXYZşğİ12" + UNICODE_WHITESPACE
texts = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=20)


def spark_values(spark, values, ttype, params):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    c, _ = apply_transform(F.col("c"), T.StringType(), ttype, params)
    return [r.o for r in df.select("i", c.alias("o")).orderBy("i").collect()]


def py_substring(s: str, start: int, length: int | None) -> str:
    n = len(s)
    first = start if start >= 0 else max(n + start, 0)
    first = min(first, n)
    return s[first:first + length] if length else s[first:]


@settings(max_examples=20, deadline=None)
@given(texts, st.integers(-15, 15), st.one_of(st.none(), st.integers(0, 15)))
def test_substring_matches_model(spark, values, start, length):
    got = spark_values(spark, values, "SUBSTRING", {"start": start, "length": length})
    assert got == [py_substring(v, start, length) for v in values]


@settings(max_examples=20, deadline=None)
@given(texts)
def test_trim_matches_model(spark, values):
    got = spark_values(spark, values, "TRIM", {})
    assert got == [v.strip(UNICODE_WHITESPACE) for v in values]


@settings(max_examples=15, deadline=None)
@given(texts, st.sampled_from(["prefix", "suffix"]), st.text(alphabet="-_#ş", max_size=3))
def test_concat_matches_model(spark, values, position, glue):
    got = spark_values(spark, values, "CONCAT", {"value": glue, "position": position})
    assert got == [glue + v if position == "prefix" else v + glue for v in values]


def py_int(s: str):
    import re
    t = s.strip(" ")
    if not re.fullmatch(r"[+-]?[0-9]+", t):
        return None
    v = int(t)
    return v if -2**31 <= v < 2**31 else None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-. x", max_size=12), min_size=1, max_size=20))
def test_cast_int_matches_model(spark, values):
    got = spark_values(spark, values, "CAST", {"to_type": "int"})
    assert got == [py_int(v) for v in values]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.datetimes(min_value=__import__("datetime").datetime(1900, 1, 1),
                             max_value=__import__("datetime").datetime(2099, 12, 31)), min_size=1, max_size=10),
       st.sampled_from(["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%Y%m%d%H%M%S", "%m/%d/%Y %I:%M:%S %p",
                        "%Y-%m-%dT%H:%M:%S.%f", "%d.%m.%Y", "%Y/%j"]))
def test_strftime_translation_roundtrip(spark, values, fmt):
    """Python formats the value; Spark parses it back with the translated pattern."""
    import datetime as dt
    from tidewater.functions.formats import strftime_to_spark
    texts = [v.strftime(fmt) for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in df.select("i", F.try_to_timestamp("t", F.lit(strftime_to_spark(fmt))).cast("timestamp_ntz")
                                  .alias("p")).orderBy("i").collect()]
    want = [dt.datetime.strptime(t, fmt) for t in texts]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abŞşğİı 12٣\t-", max_size=12), min_size=1, max_size=15),
       st.sampled_from([r"\w+", r"\d", r"[a-z]+", r"\s+", r"(\w)(\w)"]))
def test_replace_matches_unicode_regex_model(spark, values, pattern):
    import re
    repl = "<$2$1>" if "(" in pattern else "#"
    got = spark_values(spark, values, "REPLACE", {"from": pattern, "to": repl})
    py_repl = r"<\2\1>" if "(" in pattern else "#"
    assert got == [re.sub(pattern, py_repl, v) for v in values]


def py_upsert(target, source):
    """target: [(k, v, t)] unique k; source: [(k|None, v, ord)] unique ord."""
    out = {k: (k, v, t) for k, v, t in target}
    best = {}
    for k, v, o in source:
        if k is not None and (k not in best or o > best[k][1]):
            best[k] = (v, o)
    for k, (v, _) in best.items():
        out[k] = (k, v, out[k][2]) if k in out else (k, v, None)
    rows = list(out.values()) + [(None, v, None) for k, v, o in source if k is None]
    return sorted(rows, key=repr)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 8), unique=True, max_size=8),
       st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.text("xyz", max_size=2))),
                max_size=15))
def test_upsert_matches_model(spark, tkeys, src):
    from tidewater.operators.merge import upsert
    target = [(k, f"t{k}", f"keep{k}") for k in tkeys]
    source = [(k, v, i) for i, (k, v) in enumerate(src)]
    tdf = spark.createDataFrame(target, "k int, v string, t string")
    sdf = spark.createDataFrame(source, "k int, v string, o int")
    want = py_upsert(target, source)
    for limit in (1 << 40, 0):  # broadcast plan, shuffled plan
        got = sorted(map(tuple, upsert(tdf, sdf, ["k"], "o", plan="auto", broadcast_limit=limit).collect()), key=repr)
        assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.sampled_from(["x1", "y", "xx"]))),
                min_size=1, max_size=25))
def test_validation_matches_model(spark, rows):
    import re
    from collections import Counter

    from tidewater.operators.validate import validate
    from tidewater.spec import ValidationRule as V
    data = [(i, k, s) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, k int, s string")
    rules = [V("NOT_NULL", "s"), V("RANGE", "k", {"max": 3}), V("UNIQUE", "k", {}, "WARN"),
             V("REGEX", "s", {"pattern": "^x"}, "WARN")]
    counts = Counter(k for _, k, _ in data)
    fails = {
        "NOT_NULL": {i for i, _, s in data if s is None},
        "RANGE": {i for i, k, _ in data if k is not None and k > 3},
        "UNIQUE": {i for i, k, _ in data if counts[k] > 1},
        "REGEX": {i for i, _, s in data if s is not None and not re.search("^x", s)},
    }
    vo = validate(df, rules)
    assert sorted(r.id for r in vo.valid().collect()) == \
        sorted(i for i, _, _ in data if i not in fails["NOT_NULL"] | fails["RANGE"])
    got = sorted((r.id, r.error_rule) for r in vo.violations(row_key=["id"], include_source=False).collect())
    assert got == sorted((i, rule) for rule, ids in fails.items() for i in ids)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"])), min_size=1, max_size=20),
       st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(["X", "Y", "Z"])), max_size=4),
       st.one_of(st.none(), st.just("E")))
def test_case_when_matches_model(spark, values, conds, other):
    params = {"conditions": [{"when": w, "then": t} for w, t in conds], "else": other}

    def model(v):
        for w, t in conds:
            if v is not None and v == w:
                return t
        return other
    assert spark_values(spark, values, "CASE_WHEN", params) == [model(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=20),
       st.sampled_from(["0", "7", "n/a", ""]))
def test_coalesce_type_directed_model(spark, values, default):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c bigint")
    c, t = apply_transform(F.col("c"), T.LongType(), "COALESCE", {"default": default})
    got = [r.o for r in df.select("i", c.alias("o")).orderBy("i").collect()]
    if default.lstrip("-").isdigit():
        assert isinstance(t, T.LongType) and got == [int(default) if v is None else v for v in values]
    else:
        assert isinstance(t, T.StringType) and got == [default if v is None else str(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1990, 2030), st.integers(0, 13), st.integers(0, 32), st.booleans(),
                          st.sampled_from(["", "x", " "])), min_size=1, max_size=20))
def test_date_format_rule_matches_model(spark, parts):
    import datetime as dt

    from tidewater.operators.validate import validate
    from tidewater.spec import ValidationRule as V
    texts = [(f"{y}-{m:02d}-{d:02d}" if pad else f"{y}-{m}-{d}") + tail for y, m, d, pad, tail in parts]

    def bad(t):
        try:
            dt.datetime.strptime(t, "%Y-%m-%d")
            return False
        except ValueError:
            return True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    vo = validate(df, [V("DATE_FORMAT", "s", {"format": "%Y-%m-%d"})])
    got = sorted(r.i for r in vo.violations(row_key=["i"], include_source=False).collect())
    assert got == [i for i, t in enumerate(texts) if bad(t)]
