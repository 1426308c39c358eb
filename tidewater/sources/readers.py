"""Sources: JDBC, custom SQL, CSV/TSV with null tokens, Parquet/ORC/JSON,
catalog tables; dispatch by kind; list tables, describe columns, preview.

Every reader returns a lazy DataFrame.  The incremental predicate and test
limits are applied as DataFrame operators so Catalyst pushes them into the
scan (``PushedFilters`` on Parquet and JDBC).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import (
    CSV_NULL_TOKENS,
    ERROR_MESSAGES,
    LOGICAL_TYPE_NAMES,
    PREVIEW_DEFAULT_ROWS,
    PREVIEW_MAX_ROWS,
)
from tidewater.sources import publish
from tidewater.spec import SourceSpec


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------------------
# JDBC (PostgreSQL, MySQL, SQL Server ... any driver on the classpath)
# ---------------------------------------------------------------------------

def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 user: str | None = None, password: str | None = None, driver: str | None = None,
                 schema: str | None = None, fetchsize: int = 10000,
                 partition_column: str | None = None, lower_bound: Any = None, upper_bound: Any = None,
                 num_partitions: int | None = None, extra: dict | None = None) -> dict[str, str]:
    """Reader options for one JDBC scan.

    ``query`` replaces the table.  A partitioned read (``partition_column`` +
    bounds + ``num_partitions``) gives one connection per partition instead of
    one task pulling the whole table.
    """
    if not table and not query:
        raise JobError("SPEC_INVALID", "JDBC source needs a table or a query")
    opts: dict[str, str] = {"url": url, "fetchsize": str(fetchsize)}
    if query:
        opts["query"] = query
    else:
        opts["dbtable"] = f"{schema}.{table}" if schema else table
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    if partition_column:
        if query:
            raise JobError("SPEC_INVALID", "partitioned JDBC reads need a table, not a query")
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise JobError("SPEC_INVALID", "partition_column needs lower/upper bound and num_partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    for k, v in (extra or {}).items():
        opts[k] = str(v)
    return opts


def bounds_query(table: str, column: str) -> str:
    return f"select min({column}) as lo, max({column}) as hi from {table}"


# --- fixed values: driver messages that mean "could not connect" ---------
_CONNECTION_HINTS = ("communications link failure", "connection refused", "connection attempt failed",
                     "could not connect", "unknownhostexception", "connect timed out", "no suitable driver",
                     "password authentication failed", "access denied for user", "login failed")


def is_connection_error(e: Exception) -> bool:
    text = str(e).lower()
    return any(h in text for h in _CONNECTION_HINTS)


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    """JDBC scan.  With only ``partition_column`` given, its bounds come from
    one ``min``/``max`` query (a single row) and ``num_partitions`` defaults to
    the cluster's parallelism, so the table is read by many tasks, not one."""
    if kw.get("partition_column") and (kw.get("lower_bound") is None or kw.get("upper_bound") is None):
        base = {k: kw[k] for k in ("url", "user", "password", "driver") if kw.get(k) is not None}
        table = kw["table"] if not kw.get("schema") else f"{kw['schema']}.{kw['table']}"
        row = (spark.read.format("jdbc").options(**jdbc_options(query=bounds_query(table, kw["partition_column"]),
                                                                **base)).load().collect()[0])
        if row["lo"] is None:  # empty table: one partition is enough
            kw = {k: v for k, v in kw.items() if k not in ("partition_column", "lower_bound", "upper_bound",
                                                          "num_partitions")}
        else:
            kw = dict(kw, lower_bound=row["lo"], upper_bound=row["hi"],
                      num_partitions=kw.get("num_partitions") or spark.sparkContext.defaultParallelism)
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()


# ---------------------------------------------------------------------------
# CSV with several null tokens and exact type inference
# ---------------------------------------------------------------------------

# --- fixed values: charsets Spark accepts without the legacy switch -------
_SPARK_CHARSETS = {"UTF-8", "UTF8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE",
                   "UTF-32", "UTF-32BE", "UTF-32LE"}

# --- fixed values: inference patterns (whole-value match) ------------------
_INT_RE = r"^[+-]?[0-9]+$"
_FLOAT_RE = r"^[+-]?(([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|inf|NaN)$"
_BOOL_RE = r"^(?i)(true|false)$"


def enable_charset(spark: SparkSession, encoding: str | None) -> None:
    """Allow a Java charset outside Spark's short list (e.g. ISO-8859-9 for
    Turkish files) for CSV reads and writes."""
    if encoding and encoding.upper().replace("_", "-") not in _SPARK_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def normalise_null_tokens(df: DataFrame, tokens=CSV_NULL_TOKENS, but: tuple = ()) -> DataFrame:
    """Map every token in ``tokens`` to NULL in all string columns (``but`` some)."""
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(_q(f.name)).isin(toks), F.lit(None).cast("string")).otherwise(F.col(_q(f.name))).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in but else F.col(_q(f.name))
        for f in df.schema.fields
    ])


def infer_types(df: DataFrame) -> T.StructType:
    """Pick bigint -> double -> boolean -> string per text column.

    One aggregate over the whole input counts the values that do NOT fit each
    candidate type (a full pass makes the choice stable, unlike a first-N-rows
    window where a late value could silently turn into NULL).
    """
    exprs = []
    names = [f.name for f in df.schema.fields]
    for n in names:
        c = F.col(_q(n))
        exprs += [
            F.count_if(c.isNotNull() & ~c.rlike(_INT_RE)).alias(f"{n}__int"),
            F.count_if(c.rlike(_INT_RE) & c.try_cast("bigint").isNull()).alias(f"{n}__big"),
            F.count_if(c.isNotNull() & ~(c.rlike(_INT_RE) | c.rlike(_FLOAT_RE))).alias(f"{n}__dbl"),
            F.count_if(c.isNotNull() & ~c.rlike(_BOOL_RE)).alias(f"{n}__bool"),
            F.count(c).alias(f"{n}__nn"),
        ]
    row = df.agg(*exprs).collect()[0]
    fields = []
    for n in names:
        if row[f"{n}__nn"] == 0:
            t: T.DataType = T.StringType()
        elif row[f"{n}__big"]:
            t = T.StringType()  # integers beyond 64 bits stay as they are written
        elif row[f"{n}__int"] == 0:
            t = T.LongType()
        elif row[f"{n}__dbl"] == 0:
            t = T.DoubleType()
        elif row[f"{n}__bool"] == 0:
            t = T.BooleanType()
        else:
            t = T.StringType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


#: struct (line, column, rule, message) of a row that does not parse, NULL for the others
BAD_ROW = "__bad_row"
_CORRUPT = "__corrupt"
BAD_ROW_MODES = ("fail", "quarantine")
#: what an error of the strict reader begins with
CSV_VALUE = "CSV value"


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", header: bool = True,
             null_tokens=CSV_NULL_TOKENS, schema: T.StructType | str | None = None,
             infer: bool = True, multi_line: bool | None = None, bad_rows: str = "fail") -> DataFrame:
    """CSV/TSV/TXT reader.

    Quoted fields may hold separators, doubled quotes and line breaks.  ``multi_line`` says whether
    quoted line breaks occur; files that have them cannot be split between
    tasks.  None finds out by one pass over the lines (an odd number of quotes).

    All fields are read as text, the null tokens become NULL, then either the
    given ``schema`` is applied (by the header's names) or types are inferred (see :func:`infer_types`).
    Dates stay text unless a schema says otherwise.

    No value becomes NULL because it does not fit.  ``bad_rows`` says what happens to rows with
    too few or too many fields, and to values outside the given type:

    * ``fail``: the read fails (as it does, in either mode, where files differ in their headers),
    * ``quarantine``: the frame has a further column ``BAD_ROW``, NULL for rows that parse, else why the row does not; a run
      keeps those rows as violations and loads the others.
    """
    if bad_rows not in BAD_ROW_MODES:
        raise JobError("SPEC_INVALID", f"bad_rows must be one of {list(BAD_ROW_MODES)}")
    enable_charset(spark, encoding)
    if multi_line is None:
        odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
        multi_line = not spark.read.text(path).where(odd).isEmpty()
    reader = (spark.read.option("header", str(header).lower()).option("sep", sep)
              .option("encoding", encoding).option("inferSchema", "false").option("escape", '"')
              .option("multiLine", str(multi_line).lower()).option("columnPruning", "false").option("enforceSchema", "false"))
    quarantine = bad_rows == "quarantine"
    if quarantine:
        names = reader.csv(path).schema  # the header only
        raw = (reader.schema(T.StructType([*names.fields, T.StructField(_CORRUPT, T.StringType())])).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _CORRUPT).option("enforceSchema", "true").csv(path))
    else:
        raw = reader.option("mode", "FAILFAST").csv(path)
    fields = [f.name for f in raw.schema.fields if f.name != _CORRUPT]
    clean = normalise_null_tokens(raw.select(*[F.col(_q(c)) for c in fields], *([F.col(_CORRUPT).alias(BAD_ROW)] if quarantine else [])),
                                  null_tokens, but=(BAD_ROW,))
    if schema is not None:
        st = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    elif infer:
        whole = clean.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW) if quarantine else clean
        st = infer_types(whole)
    else:
        st = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    return _typed_rows(clean, st, fields, sep, quarantine)


def _typed_rows(rows: DataFrame, st: T.StructType, fields: list[str], sep: str, quarantine: bool) -> DataFrame:
    """Text columns in the types of ``st``; a value that does not fit fails the read or marks its row."""
    out, misfits = [], []
    line = F.to_csv(F.struct(*[F.col(_q(c)) for c in fields]), {"sep": sep})
    for f in st.fields:
        c = F.col(_q(f.name))
        if isinstance(f.dataType, T.StringType):
            out.append(c)
            continue
        value = c.try_cast(f.dataType)
        lost = c.isNotNull() & value.isNull()
        message = F.concat(F.lit(f"{CSV_VALUE} does not fit {f.name} {f.dataType.simpleString()}: "), F.substring(c, 1, 200))
        if quarantine:
            out.append(value.alias(f.name))
            misfits.append(F.when(lost, F.struct(line.alias("line"), F.lit(f.name).alias("column"), F.lit("CSV_TYPE").alias("rule"), message.alias("message"))))
        else:
            out.append(F.when(lost, F.raise_error(message).cast(f.dataType)).otherwise(value).alias(f.name))
    if not quarantine:
        return rows.select(*out)
    width = F.when(F.col(BAD_ROW).isNotNull(), F.struct(
        F.col(BAD_ROW).alias("line"), F.lit("").alias("column"), F.lit("CSV_FORMAT").alias("rule"),
        F.lit(f"the row does not have {len(fields)} fields").alias("message")))
    return rows.select(*out, F.coalesce(width, *misfits).alias(BAD_ROW))


# ---------------------------------------------------------------------------
# dispatch
# ---------------------------------------------------------------------------

SOURCE_KINDS = ("parquet", "orc", "json", "csv", "tsv", "txt", "jdbc", "table", "sql")


def _load(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    kind = spec.kind.lower()
    o = dict(spec.options)
    if kind in ("parquet", "orc", "json"):
        if not spec.path:
            raise JobError("SPEC_INVALID", f"{kind} source needs a path")
        reader = spark.read.options(**{k: str(v) for k, v in o.items() if k != "schema"})
        if o.get("schema"):
            reader = reader.schema(o["schema"])

        def load(paths: list[str], base: str) -> DataFrame:
            own = reader.option("basePath", base) if paths != [base] else reader
            return own.format(kind).load(paths)
        if any(c in spec.path for c in "*?[{"):
            return load([spec.path], spec.path)
        return publish.load_live(spark, spec.path, load)  # also what a lost writer has committed but not moved in
    if kind in ("csv", "tsv", "txt"):
        sep = o.get("delimiter") or o.get("sep") or ("\t" if kind == "tsv" else ",")
        return read_csv(spark, spec.path, sep=sep, encoding=o.get("encoding", "UTF-8"),
                        header=bool(o.get("header", True)), schema=o.get("schema"), multi_line=o.get("multiLine"),
                        bad_rows=str(o.get("bad_rows", "fail")).lower())
    if kind == "jdbc":
        kw = {k: v for k, v in o.items() if k in (
            "url", "user", "password", "driver", "schema", "fetchsize", "partition_column",
            "lower_bound", "upper_bound", "num_partitions")}
        extra = {k: v for k, v in o.items() if k not in kw}
        return read_jdbc(spark, table=spec.table, query=spec.query, extra=extra, **kw)
    if kind == "table":
        if spec.query:
            return spark.sql(spec.query)
        return spark.read.table(spec.table)
    if kind == "sql":
        if not spec.query:
            raise JobError("SPEC_INVALID", "sql source needs a query")
        return spark.sql(spec.query)
    raise JobError("SPEC_INVALID", ERROR_MESSAGES["UNSUPPORTED_SOURCE"].format(kind=spec.kind, known=list(SOURCE_KINDS)))


def typed_mark(value: str, t: T.DataType):
    """The stored (text) high-water mark as a literal of the column type."""
    if isinstance(t, T.StringType):
        return F.lit(value)
    return F.lit(value).cast(t)


def read_source(spark: SparkSession, spec: SourceSpec, checkpoint_value: str | None = None,
                limit: int | None = None) -> DataFrame:
    """Read one source; apply the incremental predicate and an optional limit.

    The predicate ``checkpoint_col > mark`` is strict, typed by the column and
    applied to every source kind (also custom SQL); rows with a NULL mark
    column are never read by an incremental run.
    """
    try:
        df = _load(spark, spec)
    except JobError:
        raise
    except Exception as e:  # noqa: BLE001 - surfaced as a run error with a code
        code = "SOURCE_CONNECTION_FAILED" if spec.kind.lower() == "jdbc" and is_connection_error(e) else "READ_FAILED"
        raise JobError(code, ERROR_MESSAGES["READ_FAILED"].format(what=spec.table or spec.path or "custom query"), str(e))
    if spec.checkpoint_col and checkpoint_value is not None:
        types = {f.name: f.dataType for f in df.schema.fields}
        if spec.checkpoint_col not in types:
            raise JobError("COLUMN_NOT_FOUND", ERROR_MESSAGES["COLUMN_NOT_FOUND"].format(col=spec.checkpoint_col))
        mark = typed_mark(checkpoint_value, types[spec.checkpoint_col])
        lookback = spec.options.get("lookback")
        if lookback is not None:
            # re-read a window before the mark to pick up late rows (pair with
            # UPSERT so the re-read rows are idempotent)
            if isinstance(types[spec.checkpoint_col], (T.TimestampType, T.TimestampNTZType, T.DateType)):
                mark = mark - F.expr(f"INTERVAL {lookback}")
            else:
                mark = mark - F.lit(lookback)
        df = df.where(F.col(_q(spec.checkpoint_col)) > mark)
        part = spec.options.get("mark_partition_column")
        if part:
            # the source is partitioned by the date of the mark column: rows
            # newer than the mark live in partitions on or after its date, so
            # this predicate prunes whole partition directories
            df = df.where(F.col(_q(part)) >= F.to_date(mark))
    if limit:
        df = df.limit(int(limit))
    return df


# ---------------------------------------------------------------------------
# discovery: list tables, describe, preview
# ---------------------------------------------------------------------------

def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of one database, sorted by name."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables(database)]
    schema = "name string, table_type string, is_temporary boolean"
    return spark.createDataFrame(rows, schema).orderBy("name")


def logical_type(t: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """(logical name, precision, scale, max_length) of a Spark type."""
    if isinstance(t, T.DecimalType):
        return "DECIMAL", t.precision, t.scale, None
    if isinstance(t, (T.VarcharType, T.CharType)):
        return "VARCHAR", None, None, t.length
    name = t.simpleString().split("(")[0]
    return LOGICAL_TYPE_NAMES.get(name, name.upper()), None, None, None


def describe_schema(schema: T.StructType) -> list[tuple]:
    out = []
    for i, f in enumerate(schema.fields):
        # tables give VARCHAR(n) as string and keep the declared type beside it
        declared = (f.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
        name, p, s, ml = logical_type(T.DataType.fromDDL(declared) if declared else f.dataType)
        out.append((f.name, name, bool(f.nullable), p, s, ml, i))
    return out


DESCRIBE_SCHEMA = ("name string, data_type string, is_nullable boolean, precision int, scale int, "
                   "max_length int, ordinal_position int")


def describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Ordered column descriptors of a frame (no data is read)."""
    return spark.createDataFrame(describe_schema(df.schema), DESCRIBE_SCHEMA)


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Column descriptors of a catalog table; missing -> ``TABLE_NOT_FOUND``."""
    if not spark.catalog.tableExists(name):
        raise JobError("TABLE_NOT_FOUND", ERROR_MESSAGES["TABLE_NOT_FOUND"].format(what=name))
    return describe(spark, spark.read.table(name))


def preview(df: DataFrame, n: int = PREVIEW_DEFAULT_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (capped at 100); ``order_by`` makes "first" deterministic.

    With an order this is a top-k (each partition keeps its best ``n``), never
    a full sort.
    """
    n = max(0, min(int(n), PREVIEW_MAX_ROWS))
    if order_by:
        return df.orderBy(*[F.col(_q(c)) for c in order_by]).limit(n)
    return df.limit(n)


def preview_payload(df: DataFrame, n: int = PREVIEW_DEFAULT_ROWS, order_by: list[str] | None = None) -> dict:
    """Column names, the preview rows (at most 100, so bounded on the driver)
    and their count — the shape a UI preview shows."""
    rows = [r.asDict() for r in preview(df, n, order_by).collect()]
    return {"columns": df.columns, "rows": rows, "count": len(rows)}
