"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

Built-in expressions and ``pyspark.ml`` only.  A rule names a host and a path
prefix; it fits its host and all subdomains where the url's path starts with
the rule's path, and the longest rule decides.  Rules are a short policy list
(one CASE expression), not data.

Urls without a rule are judged by gradient-boosted trees.  Features: lengths,
depth, digit and punctuation shares, character entropy of the host, parameter
counts, and statistics of the host's suffix (how often it occurs, and the
smoothed share of labelled urls under it that are blocked, out of fold).  They are trained from labelled urls: by
default those that a rule decides.  At most ``MAX_TRAIN`` labelled urls train
the trees (documented bound, chosen by a hash of the url); suffix statistics
cover all rows and are counted before any shuffle.

Defined cases: a NULL url, or one without ``://``, has an empty host and path;
no rule fits it and the trees judge it as any other; without labelled urls of
both kinds every url without a rule is allowed; a url exactly between both
verdicts is allowed; repeated rows are judged each, and count as often as they
occur in the suffix statistics.  Only ``page_id`` and ``url`` are read, so
further columns do no harm.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.session import materialize

#: (verdict, rule); a rule is a host, then a path that begins with a slash
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: labelled urls that the trees learn from, for each label
MAX_TRAIN = 20_000
TREES, DEPTH = 10, 4
#: host folds of the suffix statistics
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host behind the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path up to ``?``, ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.array_distinct(F.split(text, ""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


FEATURES = ("url_length", "host_length", "path_length", "depth", "dots", "dashes", "digits", "marks", "entropy", "params",
            "query_length", "fragment", "secure", "longest_label", "suffix_log", "suffix_blocked")


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, host, path) plus the lexical :data:`FEATURES`, all but the suffix statistics."""
    u = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).cast("double")
    share = lambda c, p: F.regexp_count(c, F.lit(p)) / F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return pages.withColumns({
        "url_length": F.length(u).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "dots": count(F.col("host"), "."), "dashes": count(F.col("host"), "-"),
        "digits": share(u, "[0-9]"), "marks": share(u, "[^A-Za-z0-9]"), "entropy": _entropy(F.col("host")),
        "params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0), "query_length": F.length(query).cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"), "secure": F.startswith(u, F.lit("https://")).cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split("host", r"\."), F.length)), F.lit(0)).cast("double"),
        "suffix": suffix(F.col("host")),
    })


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` (with suffix and ``y``: 1 block, 0 allow, NULL unknown) plus the suffix statistics.

    A labelled url's share comes from the labelled urls of the other host folds
    only, so that its own label is not among its features.
    """
    rows = rows.withColumn("_fold", F.when(F.col("y").isNotNull(), F.pmod(F.xxhash64("host"), F.lit(FOLDS))).otherwise(FOLDS).cast("int"))
    by_fold = rows.groupBy("suffix", "_fold").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("b"))
    known = lambda c, k: F.sum(F.when(F.col("_fold").between(0, FOLDS - 1) & (F.col("_fold") != k), F.col(c)).otherwise(0))
    stats = by_fold.groupBy(F.col("suffix").alias("_suffix")).agg(
        F.sum("n").alias("_n"), F.array(*[(known("b", k) + 0.5) / (known("n", k) + 1.0) for k in range(FOLDS + 1)]).alias("_share"))
    # suffixes may be many: a shuffle join, whose hot suffix Spark splits
    joined = rows.join(stats, F.col("suffix") == F.col("_suffix"))
    return joined.withColumns({"suffix_log": F.log1p(F.col("_n").cast("double")),
                               "suffix_blocked": F.element_at("_share", F.col("_fold") + 1)}).drop("_suffix", "_n", "_share", "_fold")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of block, by the trees; NULL where no trees could be learned).

    ``labelled`` holds (url, y) with y 1 for block and 0 for allow; None takes the verdicts of the rules.
    """
    def prepare(df):
        host, path = parts(F.col("url"))
        df = df.withColumns({"host": host, "path": path})
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, "_ruled": verdict})

    rows = prepare(pages.select("page_id", "url"))
    if labelled is None:
        rows = rows.withColumn("y", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0))
        rows = with_suffix_statistics(lexical(rows))
        learn = rows.where(F.col("y").isNotNull())
    else:
        extra = prepare(labelled.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "url", F.col("y").cast("int").alias("y")))
        both = rows.withColumns({"y": F.lit(None).cast("int"), "_page": F.lit(True)}).unionByName(extra.withColumn("_page", F.lit(False)))
        both = with_suffix_statistics(lexical(both))
        rows, learn = both.where("_page").drop("_page"), both.where(~F.col("_page") & F.col("y").isNotNull())
    sample = C.sample_ids(learn.select(F.col("url").alias("doc_id"), "y"), "y", MAX_TRAIN).select(F.col("doc_id").alias("url"), "y")
    train = materialize(learn.join(F.broadcast(sample), ["url", "y"], "left_semi").select("y", *FEATURES), "url-training")  # read once by each tree
    kinds = {r["y"] for r in train.select("y").distinct().collect()}
    final = F.coalesce(F.col("_ruled"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict")
    if kinds != {0, 1}:
        return rows.withColumn("score", F.lit(None).cast("double")).select("page_id", "host", "path", "rule", final, "score")
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64).fit(pack.transform(train).select("_x", "y"))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(pack.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", final, "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every url of ``pages``."""
    return judge(C.table(spark, sf_dir, "pages"))
