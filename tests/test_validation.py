import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.errors import ValidationStop
from tidewater.operators.validate import validate
from tidewater.spec import ValidationRule as V


@pytest.fixture()
def df(spark):
    rows = [(1, "a", 5.0, "2024-01-01"), (2, "a", 50.0, "2024-13-01"), (3, None, None, None),
            (4, "b", -1.0, "x"), (4, "b", -1.0, "x")]
    return spark.createDataFrame(rows, "id int, s string, v double, d string")


def flags(vo, flag):
    return sorted((r.id, r[flag]) for r in vo.flagged.collect())


def test_not_null(df):
    vo = validate(df, [V("NOT_NULL", "s")])
    assert vo.counts()["__fail0"] == 1


def test_unique_nulls_equal(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "y"), (5, "y")], "id int, s string")
    vo = validate(d, [V("UNIQUE", "s")])
    assert [i for i, f in flags(vo, "__fail0") if f] == [1, 2, 4, 5]


def test_regex_unanchored_null_passes(df):
    vo = validate(df, [V("REGEX", "s", {"pattern": "b"})])
    assert [i for i, f in flags(vo, "__fail0") if f] == [1, 2]


def test_range_bounds_inclusive_and_null(df):
    vo = validate(df, [V("RANGE", "v", {"min": 0, "max": 50})])
    assert [i for i, f in flags(vo, "__fail0") if f] == [4, 4]
    vo = validate(df, [V("RANGE", "v", {"max": 10})])
    assert vo.counts()["__fail0"] == 1


def test_date_format(df):
    vo = validate(df, [V("DATE_FORMAT", "d")])
    assert [i for i, f in flags(vo, "__fail0") if f] == [2, 4, 4]


def test_duplicate_check(df):
    vo = validate(df, [V("DUPLICATE_CHECK")])
    assert vo.counts()["__fail0"] == 2


def test_skipped_rules(df):
    vo = validate(df, [V("NOT_NULL", "missing"), V("REGEX", "s", {"pattern": ""}), V("WHATEVER", "s")])
    assert vo.rules == [] and vo.skipped == [0, 1, 2]


def test_actions_and_counts(df):
    vo = validate(df, [V("NOT_NULL", "s"), V("RANGE", "v", {"min": 0}, "WARN")])
    c = vo.counts()
    assert vo.valid().count() == 4
    assert vo.violation_record_count(c) == 3
    assert vo.warnings(c) == ["'v' kolonu geçerli aralık dışında [0, None]: 2 kayıt etkilendi"]
    v = vo.violations(row_key=["id"]).collect()
    assert sorted((r.id, r.error_rule, r.action) for r in v) == [(3, "NOT_NULL", "REJECT"), (4, "RANGE", "WARN"),
                                                                 (4, "RANGE", "WARN")]
    assert v[0].source_data is not None


def test_stop(df):
    vo = validate(df, [V("NOT_NULL", "s", {}, "WARN"), V("RANGE", "v", {"max": 10}, "STOP")])
    with pytest.raises(ValidationStop) as e:
        vo.check_stop(vo.counts())
    assert e.value.rule_index == 1 and e.value.failures == 1
    assert "Validation STOP kuralı tetiklendi" in e.value.message


def test_messages():
    from tidewater.functions.rules import rule_message
    assert rule_message("NOT_NULL", "x", {}) == "'x' kolonu boş (null) olamaz"
    assert rule_message("DUPLICATE_CHECK", None, {}) == "Tekrar eden kayıt tespit edildi"
    assert rule_message("REGEX", "x", {"pattern": "^a"}) == "'x' kolonu regex doğrulaması başarısız: ^a"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))),
                min_size=1, max_size=30))
def test_property_valid_plus_rejected_is_input(spark, rows):
    d = spark.createDataFrame(rows, "k int, s string")
    vo = validate(d, [V("NOT_NULL", "s"), V("UNIQUE", "k", {}, "WARN"), V("RANGE", "k", {"max": 3})])
    valid = [tuple(r) for r in vo.valid().collect()]
    rejected = [tuple(r) for r in vo.rejected_rows().collect()]
    assert sorted(valid + rejected, key=repr) == sorted(rows, key=repr)
    c = vo.counts()
    assert vo.violations().count() == sum(c[r.flag] for r in vo.rules)
    expected_unique = sum(1 for k, _ in rows if sum(1 for k2, _ in rows if k2 == k) > 1)
    assert c["__fail1"] == expected_unique


def test_duplicate_check_with_column_names_it(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, s string")
    v = validate(d, [V("DUPLICATE_CHECK", "s")]).violations(include_source=False).collect()
    assert {(r.error_column, r.error_rule, r.error_message) for r in v} == \
        {("s", "DUPLICATE_CHECK", "Tekrar eden kayıt tespit edildi")} and len(v) == 2
