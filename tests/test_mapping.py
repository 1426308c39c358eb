import pytest
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.operators.mapping import apply_mappings, auto_map
from tidewater.spec import ColumnMapping as M
from tidewater.spec import TransformRule as R


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, a string, b string")


def test_rename_appends_at_end(df):
    out = apply_mappings(df, [M("aa", "a", 0)]).frame
    assert out.columns == ["id", "b", "aa"]
    assert [r.aa for r in out.orderBy("id").collect()] == ["a", "b"]


def test_rename_onto_existing_replaces_in_place(df):
    out = apply_mappings(df, [M("b", "a", 0)]).frame
    assert out.columns == ["id", "b"]
    assert [r.b for r in out.orderBy("id").collect()] == ["a", "b"]


def test_in_place_chain_sorted_by_order(df):
    rules = (R("CONCAT", {"value": "!"}, 2), R("UPPER", {}, 1))
    out = apply_mappings(df, [M("a", "a", 0, transform_rules=rules)]).frame
    assert [r.a for r in out.orderBy("id").collect()] == ["A!", "B!"]


def test_constant_and_exclude(df):
    out = apply_mappings(df, [M("src", None, 0, is_constant=True, constant_value="erp"),
                              M("b", "b", 1, is_excluded=True)]).frame
    assert out.columns == ["id", "a", "src"]
    assert {r.src for r in out.collect()} == {"erp"}


def test_missing_source(df):
    out = apply_mappings(df, [M("z", "nope", 0, default_value="d"), M("y", "nope2", 1)]).frame
    assert [(r.z, r.y) for r in out.collect()] == [("d", None), ("d", None)]
    with pytest.raises(JobError) as e:
        apply_mappings(df, [M("z", "nope", 0, is_nullable=False)])
    assert e.value.code == "COLUMN_NOT_FOUND"


def test_swap_loses_original(df):
    out = apply_mappings(df, [M("b", "a", 0), M("a", "b", 1)]).frame
    assert out.columns == ["id", "a"]
    assert [r.a for r in out.orderBy("id").collect()] == ["a", "b"]


def test_same_source_twice(df):
    out = apply_mappings(df, [M("x1", "a", 0), M("x2", "a", 1)]).frame
    assert "x2" in out.columns and {r.x2 for r in out.collect()} == {None}


def test_keep_unmapped_false_prunes(df):
    out = apply_mappings(df, [M("aa", "a", 0)], keep_unmapped=False).frame
    assert out.columns == ["aa"]


def test_null_drop_filters_rows(df):
    out = apply_mappings(df, [M("b", "b", 0, transform_rules=(R("NULL_HANDLING", {"strategy": "drop"}),))]).frame
    assert out.count() == 1


def test_source_names_follow_renames(df):
    res = apply_mappings(df, [M("aa", "a", 0)])
    assert res.source_names["aa"] == "a" and res.source_names["id"] == "id"


def test_auto_map():
    src = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("n", T.StringType())])
    tgt = T.StructType([T.StructField("n", T.StringType())])
    maps = auto_map(src, tgt)
    assert [(m.source_column, m.target_column, m.is_nullable) for m in maps] == [("id", "id", False), ("n", "n", True)]


# --- property: the one-select fold equals the naive step-by-step frame rebuild
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

NAMES = ["a", "b", "c", "x", "y"]
mapping_st = st.lists(st.tuples(
    st.sampled_from(["rename", "constant", "exclude", "missing", "upper"]),
    st.sampled_from(NAMES), st.sampled_from(NAMES)), min_size=1, max_size=6)


def naive(df, ops):
    """Rebuild the frame after every mapping, as an eager engine would."""
    for kind, src, tgt in ops:
        if kind == "exclude":
            if src in df.columns:
                df = df.drop(src)
        elif kind == "constant":
            df = df.withColumn(tgt, F.lit("k"))
        elif kind == "missing" or src not in df.columns:
            df = df.withColumn(tgt, F.lit(None).cast("string"))
        else:
            col = F.upper(F.col(src).cast("string")) if kind == "upper" else F.col(src)
            if src != tgt:
                df = df.withColumn("__tmp", col).drop(src).withColumn(tgt, F.col("__tmp")).drop("__tmp")
            else:
                df = df.withColumn(tgt, col)
    return df


def to_mappings(ops):
    out = []
    for i, (kind, src, tgt) in enumerate(ops):
        if kind == "exclude":
            out.append(M(src, src, i, is_excluded=True))
        elif kind == "constant":
            out.append(M(tgt, None, i, is_constant=True, constant_value="k"))
        elif kind == "missing":
            out.append(M(tgt, "zz_missing", i))
        else:
            rules = (R("UPPER"),) if kind == "upper" else ()
            out.append(M(tgt, src, i, transform_rules=rules))
    return out


@settings(max_examples=25, deadline=None)
@given(mapping_st)
def test_property_fold_equals_step_by_step(spark, ops):
    df = spark.createDataFrame([("p", "q", "r"), ("s", None, "u")], "a string, b string, c string")
    got = apply_mappings(df, to_mappings(ops)).frame
    want = naive(df, ops)
    assert set(got.columns) == set(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == \
        sorted(map(tuple, want.select(*cols).collect()), key=repr)
