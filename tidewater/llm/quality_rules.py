"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Built-in expressions only.  Each text is measured in its own row (words, lines,
repeated five-word windows); texts are never shuffled.  The thresholds of the
method are not fixed cutoffs: for each language and source, and for each
measure, a quantile sketch over all documents gives the usual range.

*Sketch.*  A measure (a non-negative integer) falls into a bucket that keeps its
leading seven bits, so a bucket's lower bound is within 1/64 of the value.  The
sketch of a group is its count per bucket.  Counts add up, so sketches merge
exactly and in any order: tasks count before the shuffle, groups of a language
merge into the language, languages into the whole, and a hot source costs no
more than any other.  A group of fewer than ``MIN_DOCS`` documents uses its
language's thresholds, and that of a small language the overall ones.

*Verdict.*  A text passing the base rules is dropped when a measure lies above
the limit of its group, or (mean word length) below it.  The upper limit is
``q90 + SPREAD * (q90 - q50) + slack``, but no more than its *cap*: q90 is junk's
own value once more than a tenth of the group is junk.  The cap is the larger of
two values that such junk does not move: the lower half of the group mirrored,
``q50 + (SPREAD + 1) * (q50 - q10) + slack``, and the plain limit of the ordinary
groups of the language (of all, if those have fewer than ``MIN_DOCS`` documents).
A group is ordinary in a measure if its q90 lies within its mirrored lower half;
groups of fewer than ``MIN_DOCS`` documents count as one group of their language.
The lower limit has the same form, with the quantiles turned around.  Junk that
makes up half of a group or more is its usual range and is not found.

Defined cases: NULL and empty texts have no words, fail the base rules and are
not kept; a NULL language or source is a group of its own; repeated rows are
judged each, ties change nothing (thresholds are compared with ``>`` / ``<``).
Sketches cover the rows that pass the base rules.  Only the columns named are
read, so further columns do no harm; the operator's own columns are prefixed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.session import materialize, memory_bytes

MIN_DOCS = 100
SPREAD = 4
#: measures (per mille) and their slack: what every group may vary by
MEASURES = {"symbols": 60, "dup_lines": 300, "repeats": 150, "word_up": 1500, "word_down": 1500}
#: added to the number of lines and words in a share, so that one line that recurs does not condemn a short text
FEW_LINES, FEW_WORDS = 5, 100
#: size of the table of limits up to which it is broadcast
LIMIT_BYTES = 16 << 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: what measure() adds
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(t, F.lit(C.SQL_BREAKS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(C.SQL_BREAKS))) > 0)
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    w = lambda i: F.get("_words", i)
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[w(i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    # only texts in which a window recurs sort their windows; places of recurring ones, ascending
    sorted_ = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_))
    h = lambda i: F.get("_sorted", i)["h"]
    places = F.sort_array(F.transform(
        F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == h(k + 1), F.lit(False)) | F.coalesce(x["h"] == h(k - 1), F.lit(False))),
        lambda x: x["i"]))
    out = out.withColumn("_places", F.coalesce(places, F.array().cast("array<int>")))
    # each recurring window covers five words, less those that the one before has covered
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]
    out = out.withColumns({
        "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines", "_windows", "_sorted", "_places")


def _per_mille() -> dict[str, Column]:
    word = F.expr("(word_chars * 1000) div greatest(n_words, 1)")
    return {"symbols": F.expr("(n_symbols * 1000) div greatest(n_words, 1)"),
            "dup_lines": F.expr(f"(n_dup_lines * 1000) div (n_lines + {FEW_LINES})"),
            "repeats": F.expr(f"(n_repeat_words * 1000) div (n_words + {FEW_WORDS})"),
            "word_up": word, "word_down": word}


def bucket(value: Column) -> Column:
    """The lower bound of the value's bucket: its leading seven bits."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 7, F.lit(0))).cast("long")
    return value - value % unit


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by ``keys``, measure and bucket: one mergeable quantile sketch for each group and measure, of the
    rows that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket"))
                                for k, v in _per_mille().items() if k != "word_down"]))
    return (measured.select(*keys, pairs.alias("_m")).select(*keys, "_m.*")
            .groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """n and the 10, 50 and 90 per cent points of each group and measure (the bucket that holds the row of that rank)."""
    group = sketches.groupBy(*keys, "measure").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("_b"))  # few hundred buckets at most

    def point(per_cent: int) -> Column:
        rank = F.expr(f"(n * {per_cent} + 99) div 100")
        return F.aggregate("_b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
                           lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"),
                                                 F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= rank, x["bucket"])).alias("at")))["at"]
    return group.select(*keys, "measure", "n", point(10).alias("q10"), point(50).alias("q50"), point(90).alias("q90"))


def _limits(k: str) -> tuple[Column, Column, Column]:
    """(plain limit, mirrored limit, whether the group is ordinary) of the measure ``k``."""
    if k == "word_down":
        mirrored = F.col("q50") - (SPREAD + 1) * (F.col("q90") - F.col("q50")) - MEASURES[k]
        return F.col("q10") - SPREAD * (F.col("q50") - F.col("q10")) - MEASURES[k], mirrored, F.col("q10") >= mirrored
    mirrored = F.col("q50") + (SPREAD + 1) * (F.col("q50") - F.col("q10")) + MEASURES[k]
    return F.col("q90") + SPREAD * (F.col("q90") - F.col("q50")) + MEASURES[k], mirrored, F.col("q90") <= mirrored


def _of(k: str, value: Column) -> Column:
    return F.max(F.when(F.col("measure") == ("word_up" if k == "word_down" else k), value))


def fences(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: its size and, for each measure, the plain limit and (``mirrored_``) the mirrored one."""
    return points.groupBy(*keys).agg(F.max("n").alias("n"), *[_of(k, _limits(k)[0]).alias(k) for k in MEASURES],
                                     *[_of(k, _limits(k)[1]).alias(f"mirrored_{k}") for k in MEASURES])


def ordinary(fine: DataFrame) -> DataFrame:
    """Sketches by _lang, ``side`` (a key of MEASURES), measure and bucket of the groups that are ordinary in that measure."""
    size = fine.groupBy("_lang", "_source", "measure").agg(F.sum("n").alias("_size"))
    same = lambda a, b, keys: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    # the sources too small to be judged alone share the group NULL
    pooled = (fine.alias("a").join(size.alias("b"), same("a", "b", ["_lang", "_source", "measure"]))
              .select("a._lang", F.when(F.col("_size") >= MIN_DOCS, F.struct("a._source")).alias("_group"), "a.measure", "bucket", "n"))
    sides = F.filter(F.array(*[F.when((F.col("measure") == ("word_up" if k == "word_down" else k)) & _limits(k)[2], F.lit(k)) for k in MEASURES]),
                     lambda x: x.isNotNull())
    good = quantiles(pooled, ["_lang", "_group"]).select("_lang", "_group", "measure", F.explode(sides).alias("side"))
    return (pooled.alias("a").join(good.alias("b"), same("a", "b", ["_lang", "_group", "measure"]))
            .select("a._lang", "side", "a.measure", "bucket", "n"))


def bounds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``keys``: the plain limits (``bound_``) of :func:`ordinary` sketches, and their sizes (``size_``)."""
    points = quantiles(merge(sketches, [*keys, "side"]), [*keys, "side"])
    of = lambda k, value: F.max(F.when(F.col("side") == k, value))
    return points.groupBy(*keys).agg(*[of(k, _limits(k)[0]).alias(f"bound_{k}") for k in MEASURES], *[of(k, F.col("n")).alias(f"size_{k}") for k in MEASURES])


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each (language, source): the limits in force, from the finest group that is large enough, capped."""
    rows = measured.where(~F.col("base_failed")).select(
        F.col(lang).alias("_lang"), F.col(source).alias("_source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    fine = materialize(sketch(rows, ["_lang", "_source"]), "quality-sketches")
    middle = merge(fine, ["_lang"])
    whole = merge(middle, [])
    usual = ordinary(fine)
    f = fences(quantiles(fine, ["_lang", "_source"]), ["_lang", "_source"]).alias("f")
    m = fences(quantiles(middle, ["_lang"]), ["_lang"]).alias("m")
    w = fences(quantiles(whole, []), []).alias("w")
    b = bounds(usual, ["_lang"]).alias("b")
    a = bounds(usual, []).alias("a")
    joined = (f.join(m, F.col("f._lang").eqNullSafe(F.col("m._lang")), "left").join(w)  # w and a are one row each
              .join(b, F.col("f._lang").eqNullSafe(F.col("b._lang")), "left").join(a))
    pick = lambda k: F.when(F.col("f.n") >= MIN_DOCS, F.col(f"f.{k}")).when(F.col("m.n") >= MIN_DOCS, F.col(f"m.{k}")).otherwise(F.col(f"w.{k}"))

    def capped(k):
        bound = F.when(F.col(f"b.size_{k}") >= MIN_DOCS, F.col(f"b.bound_{k}")).otherwise(F.col(f"a.bound_{k}"))  # NULL if no group is ordinary
        inner, outer = (F.greatest, F.least) if k == "word_down" else (F.least, F.greatest)
        return inner(pick(k), outer(pick(f"mirrored_{k}"), bound))
    return joined.select(F.col("f._lang").alias("_lang"), F.col("f._source").alias("_source"), *[capped(k).alias(f"limit_{k}") for k in MEASURES])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) plus the measures, base_failed, the group's limits and ``kept``.

    Columns of ``docs`` with one of these names are replaced.  Texts are
    measured once: the measured rows go to the shared checkpoint folder, from
    which the sketches and the verdicts are read.
    """
    out = measure(docs, text)
    if carry is not None:
        out = out.select(*dict.fromkeys([*carry, lang, source]), *COLUMNS)
    measured = materialize(out, "quality-measures")
    limits = materialize(thresholds(measured, lang, source), "quality-limits")
    if memory_bytes(limits) <= LIMIT_BYTES:  # one row for each language and source: rows with their texts then stay where they are
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured[lang].eqNullSafe(limits["_lang"]) & measured[source].eqNullSafe(limits["_source"]), "left")
    value = _per_mille()
    out = [value[k] < F.col(f"limit_{k}") if k == "word_down" else value[k] > F.col(f"limit_{k}") for k in MEASURES]
    bad = F.lit(False)
    for x in out:
        bad = bad | F.coalesce(x, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_lang", "_source")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every whole text of ``documents``."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_points(source: str, keys: str) -> str:
    """n, q10, q50 and q90 by ``keys`` of a table of sketches (``keys``, bucket, n)."""
    point = lambda q: f"min(case when seen >= (total * {q} + 99) // 100 then bucket end) as q{q}"
    return f"""(select {keys}, max(total) as n, {point(10)}, {point(50)}, {point(90)}
      from (select *, sum(n) over (partition by {keys} order by bucket) as seen, sum(n) over (partition by {keys}) as total
            from (select {keys}, bucket, sum(n) as n from {source} group by {keys}, bucket)) group by {keys})"""


_SIDES = ", ".join(f"('{k}', '{'word_up' if k == 'word_down' else k}', {slack}, {str(k == 'word_down').lower()})" for k, slack in MEASURES.items())
_PLAIN = f"case when down then q10 - {SPREAD} * (q50 - q10) - slack else q90 + {SPREAD} * (q90 - q50) + slack end"
_MIRRORED = f"case when down then q50 - {SPREAD + 1} * (q90 - q50) - slack else q50 + {SPREAD + 1} * (q50 - q10) + slack end"
_PIVOT = ", ".join(f"max(case when side = '{k}' then edge end) as {k}" for k in MEASURES)


OP7_SQL = rf"""
with base as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select rid, i, ws[i:i+4] as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from base where len(ws) >= 5)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cover as (select rid, count(distinct p) as n from (select rid, unnest([i, i+1, i+2, i+3, i+4]) as p from dup) group by rid),
meas as (
  select b.rid, doc_id, lang, source, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from base b left join cover c on b.rid = c.rid),
m2 as (
  select *, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from meas),
v as (
  select *, (n_symbols * 1000) // greatest(n_words, 1) as symbols, (n_dup_lines * 1000) // (n_lines + {FEW_LINES}) as dup_lines,
         (n_repeat_words * 1000) // (n_words + {FEW_WORDS}) as repeats, (word_chars * 1000) // greatest(n_words, 1) as word from m2),
pairs as (
  select lang, source, measure, val - val % (cast(pow(2, greatest(length(bin(val)) - 7, 0)) as bigint)) as bucket from (
    select lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_up']) as measure,
           unnest([symbols, dup_lines, repeats, word]) as val from v where not base_failed)),
sk as (select lang, source, measure, bucket, count(*) as n from pairs group by all),
sides as (select * from (values {_SIDES}) x(side, measure, slack, down)),
fine as (select lang, source, side, down, n, {_PLAIN} as plain, {_MIRRORED} as mirrored from {_sql_points('sk', 'lang, source, measure')} join sides using (measure)),
middle as (select lang, side, n, {_PLAIN} as plain, {_MIRRORED} as mirrored from {_sql_points('sk', 'lang, measure')} join sides using (measure)),
whole as (select side, n, {_PLAIN} as plain, {_MIRRORED} as mirrored from {_sql_points('sk', 'measure')} join sides using (measure)),
pooled as (  -- the sources too small to be judged alone are one group of their language
  select lang, case when sum(n) over (partition by lang, source, measure) >= {MIN_DOCS} then coalesce('s' || source, 'null') end as grp, measure, bucket, n from sk),
good as (
  select lang, grp, measure, side, slack, down from {_sql_points('pooled', 'lang, grp, measure')} join sides using (measure)
  where case when down then q10 >= {_MIRRORED} else q90 <= {_MIRRORED} end),
usual as (
  select p.lang, g.side, g.slack, g.down, p.bucket, p.n from pooled p join good g
  on p.lang is not distinct from g.lang and p.grp is not distinct from g.grp and p.measure = g.measure),
by_lang as (select lang, side, n, {_PLAIN} as plain from {_sql_points('usual', 'lang, side, slack, down')}),
overall as (select side, n, {_PLAIN} as plain from {_sql_points('usual', 'side, slack, down')}),
edges as (
  select f.lang, f.source, f.side, f.down,
         case when f.n >= {MIN_DOCS} then f.plain when m.n >= {MIN_DOCS} then m.plain else w.plain end as plain,
         case when f.n >= {MIN_DOCS} then f.mirrored when m.n >= {MIN_DOCS} then m.mirrored else w.mirrored end as mirrored,
         case when b.n >= {MIN_DOCS} then b.plain else a.plain end as bound
  from fine f join middle m on f.lang is not distinct from m.lang and f.side = m.side join whole w on f.side = w.side
  left join by_lang b on f.lang is not distinct from b.lang and f.side = b.side left join overall a on f.side = a.side),
lim as (
  select lang, source, {_PIVOT} from (
    select *, case when down then greatest(plain, least(mirrored, bound)) else least(plain, greatest(mirrored, bound)) end as edge from edges)
  group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(v.symbols > lim.symbols, false) and not coalesce(v.dup_lines > lim.dup_lines, false)
       and not coalesce(v.repeats > lim.repeats, false) and not coalesce(v.word > lim.word_up, false)
       and not coalesce(v.word < lim.word_down, false) as kept
from v left join lim on v.lang is not distinct from lim.lang and v.source is not distinct from lim.source
"""
