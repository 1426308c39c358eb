import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.functions.transforms import FoldContext, apply_transform, translate_replacement


def run(spark, values, schema, ttype, params=None):
    df = spark.createDataFrame([(v,) for v in values], f"c {schema}")
    t = df.schema["c"].dataType
    ctx = FoldContext()
    c, rt = apply_transform(F.col("c"), t, ttype, params or {}, ctx)
    rows = [r[0] for r in df.select(c.alias("o")).collect()]
    return rows, rt, ctx


def test_trim_unicode_whitespace(spark):
    vals = ["\t a b \n", " x　", "  ", None, " y "]
    rows, rt, _ = run(spark, vals, "string", "trim")
    assert rows == ["a b", "x", "", None, "y"]
    assert isinstance(rt, T.StringType)


def test_upper_lower(spark):
    rows, _, _ = run(spark, ["şehir", "İstanbul", None], "string", "UPPER")
    assert rows == ["ŞEHIR", "İSTANBUL", None]
    rows, _, _ = run(spark, ["ABC", None], "string", "lower")
    assert rows == ["abc", None]


def test_upper_on_number_casts_to_text(spark):
    rows, rt, _ = run(spark, [12], "int", "UPPER")
    assert rows == ["12"] and isinstance(rt, T.StringType)


def test_replace_regex_and_groups(spark):
    rows, _, _ = run(spark, ["ab12cd345", None], "string", "REPLACE", {"from": "([0-9]+)", "to": "<$1>"})
    assert rows == ["ab<12>cd<345>", None]
    rows, _, _ = run(spark, ["a.b"], "string", "REPLACE", {"from": ".", "to": "$$"})
    assert rows == ["$$$"]
    rows, _, _ = run(spark, ["a.b"], "string", "REPLACE", {"from": ".", "to": "-", "literal": True})
    assert rows == ["a-b"]


def test_replace_requires_params():
    with pytest.raises(JobError):
        apply_transform(F.col("c"), T.StringType(), "REPLACE", {"from": "x"})


def test_translate_replacement():
    assert translate_replacement("${1}x") == "$1x"
    assert translate_replacement("${name}") == "${name}"
    assert translate_replacement("a\\b") == "a\\\\b"
    assert translate_replacement("cost $") == "cost \\$"


def test_cast_failures_become_null(spark):
    rows, rt, _ = run(spark, ["12", "1.5", "x", None, "99999999999"], "string", "CAST", {"to_type": "integer"})
    assert rows == [12, None, None, None, None] and isinstance(rt, T.IntegerType)
    rows, _, _ = run(spark, [-1.9, 2.7, 1e20], "double", "CAST", {"to_type": "int"})
    assert rows == [-1, 2, None]
    rows, rt, _ = run(spark, ["1.25"], "string", "CAST", {"to_type": "decimal"})
    assert rows == [1.25] and isinstance(rt, T.DoubleType)
    rows, rt, _ = run(spark, [5], "int", "CAST", {"to_type": "nonsense"})
    assert rows == ["5"] and isinstance(rt, T.StringType)
    rows, _, _ = run(spark, ["true", "false", "maybe"], "string", "CAST", {"to_type": "BOOLEAN"})
    assert rows == [True, False, None]
    rows, rt, _ = run(spark, ["2024-01-02 03:04:05"], "string", "CAST", {"to_type": "timestamp"})
    assert rows == [dt.datetime(2024, 1, 2, 3, 4, 5)] and isinstance(rt, T.TimestampNTZType)


def test_to_date_and_timestamp(spark):
    rows, rt, _ = run(spark, ["2024-02-29", "2024-13-01", "2024-01-01x", None], "string", "TO_DATE")
    assert rows == [dt.date(2024, 2, 29), None, None, None] and isinstance(rt, T.DateType)
    rows, _, _ = run(spark, ["05/01/2024"], "string", "TO_DATE", {"format": "%d/%m/%Y"})
    assert rows == [dt.date(2024, 1, 5)]
    rows, rt, _ = run(spark, ["2024-01-05 10:11:12", "2024-01-05 25:00:00"], "string", "TO_TIMESTAMP")
    assert rows == [dt.datetime(2024, 1, 5, 10, 11, 12), None] and isinstance(rt, T.TimestampNTZType)


@pytest.mark.parametrize("params,expected", [
    ({"start": 0, "length": 2}, ["ab", "he", None]),
    ({"start": 1}, ["bcdef", "ello", None]),
    ({"start": -2}, ["ef", "lo", None]),
    ({"start": -3, "length": 2}, ["de", "ll", None]),
    ({"start": 1, "length": 0}, ["bcdef", "ello", None]),
    ({"start": 10, "length": 2}, ["", "", None]),
])
def test_substring(spark, params, expected):
    rows, _, _ = run(spark, ["abcdef", "hello", None], "string", "SUBSTRING", params)
    assert rows == expected


def test_substring_negative_past_start(spark):
    rows, _, _ = run(spark, ["ab", "", "abcdef"], "string", "SUBSTRING", {"start": -5, "length": 3})
    assert rows == ["ab", "", "bcd"]


def test_concat(spark):
    rows, _, _ = run(spark, ["x", None], "string", "CONCAT", {"value": "p_", "position": "prefix"})
    assert rows == ["p_x", None]
    rows, _, _ = run(spark, [7], "int", "CONCAT", {"value": "_s"})
    assert rows == ["7_s"]


def test_fill_family(spark):
    rows, rt, _ = run(spark, [1, None], "bigint", "COALESCE", {"default": "0"})
    assert rows == [1, 0] and isinstance(rt, T.LongType)
    rows, rt, _ = run(spark, [1, None], "bigint", "COALESCE", {})
    assert rows == ["1", ""] and isinstance(rt, T.StringType)
    rows, _, _ = run(spark, ["a", None], "string", "DEFAULT_VALUE", {"value": "zz"})
    assert rows == ["a", "zz"]
    rows, _, _ = run(spark, [None, 2.5], "double", "NULL_HANDLING", {"fill_value": "1.5"})
    assert rows == [1.5, 2.5]


def test_null_handling_drop_collects_predicate(spark):
    rows, _, ctx = run(spark, ["a", None], "string", "NULL_HANDLING", {"strategy": "drop"})
    assert rows == ["a", None] and len(ctx.keep_predicates) == 1


def test_case_when(spark):
    p = {"conditions": [{"when": "A", "then": "alpha"}, {"when": "B", "then": "beta"}], "else": "other"}
    rows, _, _ = run(spark, ["A", "B", "C", None], "string", "CASE_WHEN", p)
    assert rows == ["alpha", "beta", "other", "other"]
    rows, rt, _ = run(spark, [1, 2, 3], "int", "CASE_WHEN", {"conditions": [{"when": "1", "then": 10}]})
    assert rows == [10, None, None] and isinstance(rt, T.LongType)


def test_unknown_passes_through(spark):
    rows, _, ctx = run(spark, ["x"], "string", "SHOUT")
    assert rows == ["x"] and ctx.warnings


def test_replace_missing_group_is_empty(spark):
    rows, _, _ = run(spark, ["ab12"], "string", "REPLACE", {"from": "([0-9])", "to": "<$2>"})
    assert rows == ["ab<><>"]
    rows, _, _ = run(spark, ["ab12"], "string", "REPLACE", {"from": "(?<d>[0-9])", "to": "[$d]"})
    assert rows == ["ab[1][2]"]
    rows, _, _ = run(spark, ["a1"], "string", "REPLACE", {"from": "([0-9])", "to": "${1}0"})
    assert rows == ["a10"]


def test_impossible_cast_is_cast_error(spark):
    from tidewater.operators.mapping import apply_mappings
    from tidewater.spec import ColumnMapping as M
    from tidewater.spec import TransformRule as R
    df = spark.createDataFrame([((1, "a"),)], "s struct<x:int,y:string>")
    with pytest.raises(JobError) as e:
        apply_mappings(df, [M("s", "s", 0, transform_rules=(R("CAST", {"to_type": "int"}),))])
    assert e.value.code == "CAST_ERROR"


def test_bad_params_are_spec_errors():
    for tt, params in (("SUBSTRING", {"start": "x"}), ("CASE_WHEN", {"conditions": "nope"})):
        with pytest.raises(JobError) as e:
            apply_transform(F.col("c"), T.StringType(), tt, params)
        assert e.value.code == "SPEC_INVALID"


def test_regex_dialect_unicode_classes(spark):
    rows, _, _ = run(spark, ["Şişe 12", "çay"], "string", "REPLACE", {"from": r"\w+", "to": "X"})
    assert rows == ["X X", "X"]
    rows, _, _ = run(spark, ["ab12"], "string", "REPLACE", {"from": "(?P<d>[0-9])", "to": "<$d>"})
    assert rows == ["ab<1><2>"]


def test_regex_rule_unicode_word(spark):
    from tidewater.operators.validate import validate
    from tidewater.spec import ValidationRule as V
    df = spark.createDataFrame([("Şişe",), ("a b",)], "s string")
    vo = validate(df, [V("REGEX", "s", {"pattern": r"^\w+$"})])
    assert vo.counts()["__fail0"] == 1
