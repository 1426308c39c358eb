"""Driver queries for transforms (T), mapping (P), validation rules (V) and
actions (A): each has a Spark callable built from the library's operators and
an equivalent DuckDB SQL text over the same tables.

The test tables hold no NULLs, padding or malformed text, so such values are
derived inside the query with the same expression in both engines (e.g.
``case when event_id % 7 = 0 then null else event_type end``).  Every query
reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.fixed import UNICODE_WHITESPACE, WARN_TEMPLATE
from tidewater.functions.rules import rule_message
from tidewater.operators.mapping import apply_mappings, auto_map
from tidewater.operators.validate import validate
from tidewater.spec import ColumnMapping as M
from tidewater.spec import TransformRule as R
from tidewater.spec import ValidationRule as V


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapped(df: DataFrame, mappings, keep_unmapped: bool = True) -> DataFrame:
    return apply_mappings(df, mappings, keep_unmapped=keep_unmapped).frame


WS_SQL = "||".join(f"chr({ord(c)})" for c in UNICODE_WHITESPACE)
WARN_HEAD, WARN_TAIL = WARN_TEMPLATE.split("{n}")

# ----------------------------------------------------------------- inputs
# Derived inputs are written once as SQL expressions that Spark SQL and
# DuckDB both accept, so the two sides start from identical values.
PADDED_CUSTOMER = ("c_custkey",
                   "case when c_custkey % 3 = 0 then concat(chr(9), ' ', c_name, ' ', chr(10)) "
                   "when c_custkey % 3 = 1 then concat(chr(160), c_name, chr(12288)) else c_name end AS c_name")
# Spark's chr() wraps above 255, so the ideographic space is a \u literal there
PADDED_CUSTOMER_SPARK = ("c_custkey",
                         "case when c_custkey % 3 = 0 then concat(chr(9), ' ', c_name, ' ', chr(10)) "
                         "when c_custkey % 3 = 1 then concat(chr(160), c_name, '\\u3000') else c_name end AS c_name")
NULLY_EVENTS = ("event_id", "ts",
                "case when event_id % 11 = 0 then null else user_id end AS user_id",
                "case when event_id % 7 = 0 then null else event_type end AS event_type",
                "case when event_id % 5 = 0 then null else value end AS value",
                "case when event_id % 13 = 0 then null else props end AS props")
TEXT_ORDERS = ("o_orderkey",
               "case when o_orderkey % 9 = 0 then 'n/a' else cast(o_totalprice as varchar) end AS price_txt",
               "case when o_orderkey % 6 = 0 then '1999-13-01' when o_orderkey % 6 = 1 then 'someday' "
               "else strftime(o_orderdate, '%Y-%m-%d') end AS date_txt",
               "case when o_orderkey % 4 = 0 then 'maybe' when o_orderkey % 4 = 1 then 'true' else 'false' end AS flag_txt")
TEXT_ORDERS_SPARK = ("o_orderkey",
                     "case when o_orderkey % 9 = 0 then 'n/a' else cast(o_totalprice as string) end AS price_txt",
                     "case when o_orderkey % 6 = 0 then '1999-13-01' when o_orderkey % 6 = 1 then 'someday' "
                     "else date_format(o_orderdate, 'yyyy-MM-dd') end AS date_txt",
                     "case when o_orderkey % 4 = 0 then 'maybe' when o_orderkey % 4 = 1 then 'true' else 'false' end AS flag_txt")


def _sel(cols) -> str:
    return ", ".join(cols)


# ======================================================================= T
def t_trim(spark, d):
    df = table(spark, d, "customer").selectExpr(*PADDED_CUSTOMER_SPARK)
    return mapped(df, [M("c_name", "c_name", 0, transform_rules=(R("TRIM"),))])


T_TRIM_SQL = f"""
with p as (select {_sel(PADDED_CUSTOMER)} from customer)
select c_custkey, trim(c_name, {WS_SQL}) as c_name from p
"""


def t_upper_lower(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return mapped(df, [M("p_name", "p_name", 0, transform_rules=(R("UPPER"),)),
                       M("p_type", "p_type", 1, transform_rules=(R("lower"),))])


T_UPPER_LOWER_SQL = "select p_partkey, upper(p_name) as p_name, lower(p_type) as p_type from part"


def t_documents(spark, d):
    """Whole document texts (up to 20,000 words, four languages) through a
    chain: TRIM, LOWER, then a length-preserving CAST of the char count."""
    df = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return mapped(df, [M("text", "text", 0, transform_rules=(R("TRIM"), R("LOWER", apply_order=1))),
                       M("n_chars_text", "n_chars", 1, transform_rules=(R("CAST", {"to_type": "varchar"}),)),
                       M("lang", "lang", 2, transform_rules=(R("UPPER"),))])


T_DOCUMENTS_SQL = f"""
select doc_id, lower(trim(text, {WS_SQL})) as text, upper(lang) as lang, cast(n_chars as varchar) as n_chars_text
from documents
"""


def t_replace(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return mapped(df, [M("c_name", "c_name", 0, transform_rules=(R("REPLACE", {"from": "([1-9][0-9]*)$", "to": "<$1>"}),))])


T_REPLACE_SQL = r"select c_custkey, regexp_replace(c_name, '([1-9][0-9]*)$', '<\1>', 'g') as c_name from customer"


def t_replace_groups(spark, d):
    """A reference to a group the pattern lacks expands to empty text."""
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return mapped(df, [M("c_name", "c_name", 0, transform_rules=(R("REPLACE", {"from": "#([0-9])", "to": "[$1$2]"}),))])


T_REPLACE_GROUPS_SQL = r"select c_custkey, regexp_replace(c_name, '#([0-9])', '[\1]', 'g') as c_name from customer"


def t_cast(spark, d):
    df = table(spark, d, "orders").selectExpr(*TEXT_ORDERS_SPARK)
    out = mapped(df, [
        M("price", "price_txt", 0, transform_rules=(R("CAST", {"to_type": "decimal"}),)),
        M("price_int", "price", 1, transform_rules=(R("CAST", {"to_type": "INT"}),)),
        M("order_date", "date_txt", 2, transform_rules=(R("CAST", {"to_type": "date"}),)),
        M("flag", "flag_txt", 3, transform_rules=(R("CAST", {"to_type": "boolean"}),)),
        M("key_text", "o_orderkey", 4, transform_rules=(R("CAST", {"to_type": "varchar"}),)),
    ], keep_unmapped=False)
    # "price" was renamed into "price_int" by the second mapping (sequential fold)
    return out.select("key_text", "price_int", F.col("order_date").cast("string").alias("order_date"), "flag")


def t_cast_double(spark, d):
    df = table(spark, d, "orders").selectExpr(*TEXT_ORDERS_SPARK)
    return mapped(df, [M("price", "price_txt", 0, transform_rules=(R("CAST", {"to_type": "double"}),))],
                  keep_unmapped=False)


T_CAST_SQL = f"""
with p as (select {_sel(TEXT_ORDERS)} from orders)
select cast(o_orderkey as varchar) as key_text,
       cast(trunc(try_cast(price_txt as double)) as integer) as price_int,
       cast(try_cast(date_txt as date) as varchar) as order_date,
       try_cast(flag_txt as boolean) as flag
from p
"""


def t_cast_timestamp(spark, d):
    """Text -> timestamp (microseconds kept); malformed text becomes NULL."""
    df = table(spark, d, "events").selectExpr(
        "event_id",
        "case when event_id % 8 = 0 then date_format(ts, 'yyyy-MM-dd 25:mm:ss') "
        "when event_id % 8 = 1 then 'yesterday' else date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') end AS ts_txt")
    return mapped(df, [M("ts", "ts_txt", 0, transform_rules=(R("CAST", {"to_type": "timestamp"}),))])


T_CAST_TIMESTAMP_SQL = """
with p as (select event_id,
  case when event_id % 8 = 0 then strftime(ts, '%Y-%m-%d 25:%M:%S') when event_id % 8 = 1 then 'yesterday'
       else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as ts_txt from events)
select event_id, try_cast(ts_txt as timestamp) as ts from p
"""


def t_cast_int_text(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey",
        "case when p_partkey % 5 = 0 then concat('x', cast(p_size as string)) "
        "when p_partkey % 5 = 1 then concat(cast(p_size as string), '.5') else cast(p_size as string) end AS size_txt")
    return mapped(df, [M("size", "size_txt", 0, transform_rules=(R("CAST", {"to_type": "bigint"}),))])


T_CAST_DOUBLE_SQL = f"with p as (select {_sel(TEXT_ORDERS)} from orders) select try_cast(price_txt as double) as price from p"


T_CAST_INT_TEXT_SQL = """
with p as (select p_partkey,
  case when p_partkey % 5 = 0 then concat('x', cast(p_size as varchar))
       when p_partkey % 5 = 1 then concat(cast(p_size as varchar), '.5') else cast(p_size as varchar) end as size_txt
  from part)
select p_partkey, case when regexp_full_match(size_txt, '[+-]?[0-9]+') then cast(size_txt as bigint) end as size from p
"""


def t_to_date(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 5 = 0 then concat('32/', date_format(o_orderdate, 'MM/yyyy')) "
        "when o_orderkey % 5 = 1 then concat(date_format(o_orderdate, 'dd/MM/yyyy'), 'x') "
        "else date_format(o_orderdate, 'dd/MM/yyyy') end AS d_txt")
    out = mapped(df, [M("order_date", "d_txt", 0, transform_rules=(R("TO_DATE", {"format": "%d/%m/%Y"}),))])
    return out.select("o_orderkey", F.col("order_date").cast("string").alias("order_date"))


T_TO_DATE_SQL = """
with p as (select o_orderkey,
  case when o_orderkey % 5 = 0 then concat('32/', strftime(o_orderdate, '%m/%Y'))
       when o_orderkey % 5 = 1 then concat(strftime(o_orderdate, '%d/%m/%Y'), 'x')
       else strftime(o_orderdate, '%d/%m/%Y') end as d_txt from orders)
select o_orderkey, cast(cast(try_strptime(d_txt, '%d/%m/%Y') as date) as varchar) as order_date from p
"""


def t_to_timestamp(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id",
        "case when event_id % 6 = 0 then date_format(ts, 'yyyy-MM-dd 25:mm:ss') "
        "else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end AS ts_txt")
    return mapped(df, [M("ts", "ts_txt", 0, transform_rules=(R("TO_TIMESTAMP"),))])


T_TO_TIMESTAMP_SQL = """
with p as (select event_id,
  case when event_id % 6 = 0 then strftime(ts, '%Y-%m-%d 25:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S') end as ts_txt
  from events)
select event_id, try_strptime(ts_txt, '%Y-%m-%d %H:%M:%S') as ts from p
"""


def t_substring(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_type", "p_name")
    return mapped(df, [
        M("t_head", "p_type", 0, transform_rules=(R("SUBSTRING", {"start": 1, "length": 3}),)),
        M("t_tail", "p_name", 1, transform_rules=(R("SUBSTRING", {"start": -4, "length": 2}),)),
        M("t_rest", "p_partkey", 2, transform_rules=(R("SUBSTRING", {"start": 1}),)),
        M("t_far", "p_brand", 3, is_nullable=True),
    ], keep_unmapped=True).selectExpr("t_head", "t_tail", "t_rest", "t_far")


T_SUBSTRING_SQL = """
select substring(p_type, 2, 3) as t_head,
       substring(p_name, greatest(length(p_name) - 4, 0) + 1, 2) as t_tail,
       substring(cast(p_partkey as varchar), 2) as t_rest,
       cast(null as varchar) as t_far
from part
"""


def t_concat(spark, d):
    df = table(spark, d, "nation").selectExpr(
        "n_nationkey", "case when n_nationkey % 4 = 0 then null else n_name end AS n_name")
    return mapped(df, [
        M("pre", "n_name", 0, transform_rules=(R("CONCAT", {"value": "N:", "position": "prefix"}),)),
        M("suf", "n_nationkey", 1, transform_rules=(R("CONCAT", {"value": "_x"}),)),
    ])


T_CONCAT_SQL = """
select 'N:' || case when n_nationkey % 4 = 0 then null else n_name end as pre,
       cast(n_nationkey as varchar) || '_x' as suf
from nation
"""


def t_fill(spark, d):
    df = table(spark, d, "events").selectExpr(*NULLY_EVENTS)
    return mapped(df, [
        M("event_type", "event_type", 0, transform_rules=(R("COALESCE", {"default": "unknown"}),)),
        M("value", "value", 1, transform_rules=(R("DEFAULT_VALUE", {"value": "0"}),)),
        M("user_id", "user_id", 2, transform_rules=(R("NULL_HANDLING", {"strategy": "fill", "fill_value": "-1"}),)),
        M("props", "props", 3, transform_rules=(R("COALESCE"),)),
    ]).select("event_id", "event_type", "value", "user_id", "props")


T_FILL_SQL = f"""
with p as (select {_sel(NULLY_EVENTS)} from events)
select event_id, coalesce(event_type, 'unknown') as event_type, coalesce(value, 0.0) as value,
       coalesce(user_id, -1) as user_id, coalesce(props, '') as props
from p
"""


def t_fill_text(spark, d):
    """A default that does not fit the column type turns the column into text."""
    df = table(spark, d, "events").selectExpr(*NULLY_EVENTS)
    return mapped(df, [M("user_id", "user_id", 0, transform_rules=(R("COALESCE", {"default": "none"}),))]
                  ).select("event_id", "user_id")


T_FILL_TEXT_SQL = f"""
with p as (select {_sel(NULLY_EVENTS)} from events)
select event_id, coalesce(cast(user_id as varchar), 'none') as user_id from p
"""


def t_null_drop(spark, d):
    df = table(spark, d, "events").selectExpr(*NULLY_EVENTS)
    return mapped(df, [M("props", "props", 0, transform_rules=(R("NULL_HANDLING", {"strategy": "drop"}),)),
                       M("kind", "event_type", 1, transform_rules=(R("UPPER"),))]
                  ).select("event_id", "props", "kind")


T_NULL_DROP_SQL = f"""
with p as (select {_sel(NULLY_EVENTS)} from events)
select event_id, props, upper(event_type) as kind from p where props is not null
"""


def t_case_when(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return mapped(df, [
        M("status", "o_orderstatus", 0, transform_rules=(R("CASE_WHEN", {
            "conditions": [{"when": "F", "then": "FILLED"}, {"when": "O", "then": "OPEN"}], "else": "OTHER"}),)),
        M("urgent", "o_orderpriority", 1, transform_rules=(R("CASE_WHEN", {
            "conditions": [{"when": "1-URGENT", "then": 1}, {"when": "2-HIGH", "then": 2}]}),)),
    ])


T_CASE_WHEN_SQL = """
select o_orderkey,
       case when o_orderstatus = 'F' then 'FILLED' when o_orderstatus = 'O' then 'OPEN' else 'OTHER' end as status,
       case when o_orderpriority = '1-URGENT' then 1 when o_orderpriority = '2-HIGH' then 2 end::bigint as urgent
from orders
"""


def t_unknown(spark, d):
    df = table(spark, d, "region")
    return mapped(df, [M("r_name", "r_name", 0, transform_rules=(R("REVERSE"), R("UPPER", apply_order=1)))])


T_UNKNOWN_SQL = "select r_regionkey, upper(r_name) as r_name from region"


# ======================================================================= P
def p_rename(spark, d):
    df = table(spark, d, "supplier")
    return mapped(df, [M("supplier_name", "s_name", 0), M("balance", "s_acctbal", 1),
                       M("s_nationkey", "s_nationkey", 2)])


P_RENAME_SQL = "select s_suppkey, s_nationkey, s_name as supplier_name, s_acctbal as balance from supplier"


def p_constant(spark, d):
    df = table(spark, d, "nation")
    return mapped(df, [M("source_system", None, 0, is_constant=True, constant_value="erp"),
                       M("n_regionkey", None, 1, is_constant=True, constant_value="7")])


P_CONSTANT_SQL = "select n_nationkey, n_name, '7' as n_regionkey, 'erp' as source_system from nation"


def p_exclude(spark, d):
    df = table(spark, d, "customer")
    return mapped(df, [M("c_mktsegment", "c_mktsegment", 0, is_excluded=True),
                       M("c_acctbal", "c_acctbal", 1, is_excluded=True)])


P_EXCLUDE_SQL = "select c_custkey, c_name, c_nationkey from customer"


def p_missing_default(spark, d):
    df = table(spark, d, "supplier")
    return mapped(df, [M("phone", "s_phone", 0, default_value="n/a", is_nullable=False),
                       M("comment", "s_comment", 1, is_nullable=True)])


P_MISSING_DEFAULT_SQL = ("select s_suppkey, s_name, s_nationkey, s_acctbal, 'n/a' as phone, "
                         "cast(null as varchar) as comment from supplier")


def p_swap(spark, d):
    df = table(spark, d, "nation")
    return mapped(df, [M("n_regionkey", "n_name", 0), M("n_name", "n_regionkey", 1)])


P_SWAP_SQL = "select n_nationkey, n_name from nation"


def p_chain(spark, d):
    df = table(spark, d, "customer").selectExpr(*PADDED_CUSTOMER_SPARK)
    rules = (R("SUBSTRING", {"start": 0, "length": 6}, 3), R("TRIM", {}, 0),
             R("REPLACE", {"from": "#0+", "to": "-"}, 2), R("UPPER", {}, 1))
    return mapped(df, [M("code", "c_name", 0, transform_rules=rules)])


P_CHAIN_SQL = f"""
with p as (select {_sel(PADDED_CUSTOMER)} from customer)
select c_custkey, substring(regexp_replace(upper(trim(c_name, {WS_SQL})), '#0+', '-', 'g'), 1, 6) as code from p
"""


def p_automap(spark, d):
    df = table(spark, d, "part")
    target = df.select("p_partkey", "p_name", "p_size").schema
    maps = auto_map(df.schema, target)
    maps = [m if m.source_column != "p_name" else M(m.target_column, m.source_column, m.ordinal_position,
                                                   transform_rules=(R("UPPER"),)) for m in maps]
    return mapped(df, maps)


def p_keep_mapped(spark, d):
    """keep_unmapped=False: only mapped columns survive (the scan reads only them)."""
    df = table(spark, d, "lineitem")
    return mapped(df, [M("order_id", "l_orderkey", 0), M("qty", "l_quantity", 1, transform_rules=(R("CAST", {"to_type": "int"}),)),
                       M("flag", "l_returnflag", 2, transform_rules=(R("LOWER"),))], keep_unmapped=False)


P_KEEP_MAPPED_SQL = ("select l_orderkey as order_id, cast(trunc(l_quantity) as integer) as qty, lower(l_returnflag) as flag "
                     "from lineitem")


P_AUTOMAP_SQL = ("select p_partkey, upper(p_name) as p_name, p_brand, p_type, p_size, p_retailprice from part")


# ======================================================================= V
def _violations(df: DataFrame, rules, key) -> DataFrame:
    vo = validate(df, rules, persist=False)
    return vo.violations(row_key=key, include_source=False).drop("rule_index", "action")


def _viol_sql(src: str, key: str, pred: str, col: str | None, rule: str, params: dict) -> str:
    msg = sql_str(rule_message(rule, col, params))
    return (f"select {key}, {sql_str(col or '')} as error_column, {sql_str(rule)} as error_rule, "
            f"{msg} as error_message from {src} where {pred}")


def v_not_null(spark, d):
    df = table(spark, d, "events").selectExpr(*NULLY_EVENTS)
    return _violations(df, [V("NOT_NULL", "event_type")], ["event_id"])


V_NOT_NULL_SQL = f"with p as (select {_sel(NULLY_EVENTS)} from events) " + \
    _viol_sql("p", "event_id", "event_type is null", "event_type", "NOT_NULL", {})


def v_unique(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    return _violations(df, [V("UNIQUE", "text")], ["doc_id"])


V_UNIQUE_SQL = ("with p as (select doc_id, text, count(*) over (partition by text) as n from documents) " +
                _viol_sql("p", "doc_id", "n > 1", "text", "UNIQUE", {}))


def v_regex(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return _violations(df, [V("REGEX", "c_name", {"pattern": "[13579]$"})], ["c_custkey"])


V_REGEX_SQL = _viol_sql("customer", "c_custkey", "not regexp_matches(c_name, '[13579]$')", "c_name", "REGEX",
                        {"pattern": "[13579]$"})


def v_range(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _violations(df, [V("RANGE", "o_totalprice", {"min": 5000, "max": 400000})], ["o_orderkey"])


V_RANGE_SQL = _viol_sql("orders", "o_orderkey", "o_totalprice < 5000 or o_totalprice > 400000", "o_totalprice",
                        "RANGE", {"min": 5000, "max": 400000})


def v_range_open(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _violations(df, [V("RANGE", "l_quantity", {"max": 45})], ["l_orderkey", "l_linenumber"])


V_RANGE_OPEN_SQL = _viol_sql("lineitem", "l_orderkey, l_linenumber", "l_quantity > 45", "l_quantity", "RANGE",
                             {"max": 45})


def v_date_format(spark, d):
    df = table(spark, d, "orders").selectExpr(*TEXT_ORDERS_SPARK)
    return _violations(df, [V("DATE_FORMAT", "date_txt", {"format": "%Y-%m-%d"})], ["o_orderkey"])


V_DATE_FORMAT_SQL = f"with p as (select {_sel(TEXT_ORDERS)} from orders) " + \
    _viol_sql("p", "o_orderkey", "date_txt is not null and try_strptime(date_txt, '%Y-%m-%d') is null",
              "date_txt", "DATE_FORMAT", {"format": "%Y-%m-%d"})


def v_duplicate_check(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return _violations(df, [V("DUPLICATE_CHECK")], ["l_orderkey", "l_linenumber"])


V_DUPLICATE_CHECK_SQL = ("with p as (select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey, l_linenumber) as n "
                         "from lineitem) " + _viol_sql("p", "l_orderkey, l_linenumber", "n > 1", None,
                                                       "DUPLICATE_CHECK", {}))


# ======================================================================= A
ORDERS_RULE_INPUT = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                     "case when o_orderkey % 17 = 0 then null else o_orderstatus end AS o_orderstatus")
ORDERS_RULES = (
    V("RANGE", "o_totalprice", {"min": 5000, "max": 450000}),
    V("REGEX", "o_orderpriority", {"pattern": "^[12]-"}, "WARN"),
    V("NOT_NULL", "o_orderstatus"),
    V("UNIQUE", "o_custkey", {}, "WARN"),
)
_A_PRED = (
    "o_totalprice < 5000 or o_totalprice > 450000",
    "not regexp_matches(o_orderpriority, '^[12]-')",
    "o_orderstatus is null",
    "n_cust > 1",
)
_A_BASE = (f"with p as (select {_sel(ORDERS_RULE_INPUT)}, count(*) over (partition by o_custkey) as n_cust "
           f"from orders) ")


def _orders_outcome(spark, d):
    df = table(spark, d, "orders").selectExpr(*ORDERS_RULE_INPUT)
    return validate(df, ORDERS_RULES, persist=False)


def a_valid(spark, d):
    return _orders_outcome(spark, d).valid()


A_VALID_SQL = _A_BASE + ("select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus from p "
                         f"where not ({_A_PRED[0]}) and not coalesce({_A_PRED[2]}, false)")


def a_violations(spark, d):
    return _orders_outcome(spark, d).violations(row_key=["o_orderkey"], include_source=False)


def _a_viol_sql() -> str:
    parts = []
    for i, (r, pred) in enumerate(zip(ORDERS_RULES, _A_PRED)):
        msg = sql_str(rule_message(r.rule_type, r.column, r.params))
        parts.append(f"select o_orderkey, {i} as rule_index, {sql_str(r.column)} as error_column, "
                     f"{sql_str(r.rule_type)} as error_rule, {msg} as error_message, "
                     f"{sql_str(r.action_on_fail)} as action from p where {pred}")
    return _A_BASE + " union all ".join(parts)


A_VIOLATIONS_SQL = _a_viol_sql()


def a_rejected_rows(spark, d):
    return _orders_outcome(spark, d).rejected_rows()


A_REJECTED_ROWS_SQL = _A_BASE + ("select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus from p "
                                 f"where ({_A_PRED[0]}) or ({_A_PRED[2]})")


def a_rule_counts(spark, d):
    """Per-rule failures and the WARN texts, as a DataFrame (one aggregate)."""
    vo = _orders_outcome(spark, d)
    agg = vo.flagged.agg(*[F.count_if(F.col(r.flag)).alias(r.flag) for r in vo.rules])
    rows = [F.struct(F.lit(r.index).alias("rule_index"), F.lit(r.rule_type).alias("error_rule"),
                     F.lit(r.action).alias("action"), F.col(r.flag).alias("failures"),
                     F.when((F.lit(r.action) == "WARN") & (F.col(r.flag) > 0),
                            F.concat(F.lit(WARN_HEAD.format(msg=r.message)), F.col(r.flag).cast("string"),
                                     F.lit(WARN_TAIL)))
                     .alias("warning")) for r in vo.rules]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _a_counts_sql() -> str:
    parts = []
    for i, (r, pred) in enumerate(zip(ORDERS_RULES, _A_PRED)):
        msg = rule_message(r.rule_type, r.column, r.params)
        warn = (f"case when count_if({pred}) > 0 then concat({sql_str(WARN_HEAD.format(msg=msg))}, "
                f"cast(count_if({pred}) as varchar), {sql_str(WARN_TAIL)}) end") if r.action_on_fail == "WARN" \
            else "cast(null as varchar)"
        parts.append(f"select {i} as rule_index, {sql_str(r.rule_type)} as error_rule, {sql_str(r.action_on_fail)} as action, "
                     f"cast(count_if({pred}) as bigint) as failures, {warn} as warning from p")
    return _A_BASE + " union all ".join(parts)


A_RULE_COUNTS_SQL = _a_counts_sql()


def a_stop(spark, d):
    """STOP: the run is refused; the result is the raised code and counts."""
    from tidewater.errors import ValidationStop
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    vo = validate(df, [V("RANGE", "l_quantity", {"max": 49}, "WARN"),
                       V("RANGE", "l_discount", {"max": 0.09}, "STOP")], persist=False)
    counts = vo.counts()
    try:
        vo.check_stop(counts)
        code, idx, n = "OK", -1, 0
    except ValidationStop as e:
        code, idx, n = e.code, e.rule_index, e.failures
    return spark.createDataFrame([(code, idx, n)], "code string, rule_index int, failures bigint")


A_STOP_SQL = ("select 'VALIDATION_STOP' as code, 1 as rule_index, count(*) as failures "
              "from lineitem where l_discount > 0.09")


def a_row_index(spark, d):
    """Violation records carry a dense 0-based row number (ordered by key)."""
    from tidewater.operators.rowindex import with_row_index
    df = with_row_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "rn", order_by=["o_orderkey"])
    vo = validate(df, [V("RANGE", "o_totalprice", {"max": 300000})], extra_columns=["rn"], persist=False)
    return vo.violations(row_key=["o_orderkey"], include_source=False, row_number_col="rn").select(
        "o_orderkey", "row_number", "error_rule")


A_ROW_INDEX_SQL = ("with p as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as rn "
                   "from orders) select o_orderkey, rn as row_number, 'RANGE' as error_rule from p "
                   "where o_totalprice > 300000")


QUERIES = {
    "t_trim": (t_trim, T_TRIM_SQL),
    "t_upper_lower": (t_upper_lower, T_UPPER_LOWER_SQL),
    "t_documents": (t_documents, T_DOCUMENTS_SQL),
    "t_replace": (t_replace, T_REPLACE_SQL),
    "t_replace_groups": (t_replace_groups, T_REPLACE_GROUPS_SQL),
    "t_cast": (t_cast, T_CAST_SQL),
    "t_cast_double": (t_cast_double, T_CAST_DOUBLE_SQL),
    "t_cast_timestamp": (t_cast_timestamp, T_CAST_TIMESTAMP_SQL),
    "t_cast_int_text": (t_cast_int_text, T_CAST_INT_TEXT_SQL),
    "t_to_date": (t_to_date, T_TO_DATE_SQL),
    "t_to_timestamp": (t_to_timestamp, T_TO_TIMESTAMP_SQL),
    "t_substring": (t_substring, T_SUBSTRING_SQL),
    "t_concat": (t_concat, T_CONCAT_SQL),
    "t_fill": (t_fill, T_FILL_SQL),
    "t_fill_text": (t_fill_text, T_FILL_TEXT_SQL),
    "t_null_drop": (t_null_drop, T_NULL_DROP_SQL),
    "t_case_when": (t_case_when, T_CASE_WHEN_SQL),
    "t_unknown": (t_unknown, T_UNKNOWN_SQL),
    "p_rename": (p_rename, P_RENAME_SQL),
    "p_constant": (p_constant, P_CONSTANT_SQL),
    "p_exclude": (p_exclude, P_EXCLUDE_SQL),
    "p_missing_default": (p_missing_default, P_MISSING_DEFAULT_SQL),
    "p_swap": (p_swap, P_SWAP_SQL),
    "p_chain": (p_chain, P_CHAIN_SQL),
    "p_automap": (p_automap, P_AUTOMAP_SQL),
    "p_keep_mapped": (p_keep_mapped, P_KEEP_MAPPED_SQL),
    "v_not_null": (v_not_null, V_NOT_NULL_SQL),
    "v_unique": (v_unique, V_UNIQUE_SQL),
    "v_regex": (v_regex, V_REGEX_SQL),
    "v_range": (v_range, V_RANGE_SQL),
    "v_range_open": (v_range_open, V_RANGE_OPEN_SQL),
    "v_date_format": (v_date_format, V_DATE_FORMAT_SQL),
    "v_duplicate_check": (v_duplicate_check, V_DUPLICATE_CHECK_SQL),
    "a_valid": (a_valid, A_VALID_SQL),
    "a_violations": (a_violations, A_VIOLATIONS_SQL),
    "a_rejected_rows": (a_rejected_rows, A_REJECTED_ROWS_SQL),
    "a_rule_counts": (a_rule_counts, A_RULE_COUNTS_SQL),
    "a_stop": (a_stop, A_STOP_SQL),
    "a_row_index": (a_row_index, A_ROW_INDEX_SQL),
}
