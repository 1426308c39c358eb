"""Connection descriptions -> source / target specs.

A stored connection has a type (POSTGRESQL, MYSQL, MSSQL, CSV), host, port,
database, user, password and ``extra_config`` (schema, sslmode, charset,
file_path, delimiter, encoding).  Database types become one JDBC reader /
writer (only the URL and the identifier quoting differ); CSV becomes the CSV
reader / sink.  Types are matched case-insensitively; an unknown type lists
the supported ones.
"""

from __future__ import annotations

from typing import Any

from tidewater.errors import JobError
from tidewater.fixed import ERROR_MESSAGES, MYSQL_TYPE_NAMES, PG_TYPE_NAMES
from tidewater.spec import SourceSpec, TargetSpec

# --- fixed values: supported connection types, default ports, JDBC drivers ---
CONNECTION_TYPES = ("POSTGRESQL", "MYSQL", "MSSQL", "CSV")
DEFAULT_PORTS = {"POSTGRESQL": 5432, "MYSQL": 3306, "MSSQL": 1433}
JDBC_DRIVERS = {
    "POSTGRESQL": "org.postgresql.Driver",
    "MYSQL": "com.mysql.cj.jdbc.Driver",
    "MSSQL": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
DEFAULT_SCHEMAS = {"POSTGRESQL": "public", "MSSQL": "dbo"}


def list_supported_types() -> list[str]:
    return list(CONNECTION_TYPES)


def _type_of(conn: dict) -> str:
    t = str(conn.get("type") or "").upper()
    if t not in CONNECTION_TYPES:
        raise JobError("SPEC_INVALID",
                       ERROR_MESSAGES["UNSUPPORTED_SOURCE"].format(kind=conn.get("type"), known=list(CONNECTION_TYPES)))
    return t


def _java_charset(name: str | None) -> str:
    """The driver wants Java's names; the database's own ``utf8mb4`` is UTF-8."""
    return "UTF-8" if not name or name.lower() in ("utf8", "utf8mb3", "utf8mb4") else name


def jdbc_url(conn: dict) -> str:
    t = _type_of(conn)
    host = conn.get("host") or "localhost"
    port = conn.get("port") or DEFAULT_PORTS[t]
    db = conn.get("database_name") or ""
    extra = dict(conn.get("extra_config") or {})
    if t == "POSTGRESQL":
        return f"jdbc:postgresql://{host}:{port}/{db}?sslmode={extra.get('sslmode', 'prefer')}"
    if t == "MYSQL":
        return f"jdbc:mysql://{host}:{port}/{db}?characterEncoding={_java_charset(extra.get('charset'))}"
    return f"jdbc:sqlserver://{host}:{port};databaseName={db}"


def qualified_table(conn: dict, table: str) -> str:
    """Table name quoted the way the database expects."""
    t = _type_of(conn)
    schema = (conn.get("extra_config") or {}).get("schema", DEFAULT_SCHEMAS.get(t))
    if t == "POSTGRESQL":
        return f'"{schema}"."{table}"'
    if t == "MYSQL":
        return f"`{table}`"
    return f"[{schema}].[{table}]"


def _jdbc_options(conn: dict, extra: dict | None = None) -> dict[str, Any]:
    t = _type_of(conn)
    o: dict[str, Any] = {"url": jdbc_url(conn), "driver": JDBC_DRIVERS[t]}
    if conn.get("username") is not None:
        o["user"] = conn["username"]
    if conn.get("password") is not None:
        o["password"] = conn["password"]
    o.update(extra or {})
    return o


def source_from_connection(conn: dict, source_config: dict | None = None) -> SourceSpec:
    """``source_config``: ``table`` or ``query``, ``checkpoint_col``, and for
    partitioned JDBC reads ``partition_column`` / bounds / ``num_partitions``."""
    cfg = dict(source_config or {})
    t = _type_of(conn)
    extra = dict(conn.get("extra_config") or {})
    if t == "CSV":
        path = extra.get("file_path") or conn.get("host")
        opts = {"delimiter": extra.get("delimiter", ","), "encoding": extra.get("encoding", "UTF-8")}
        # what saves passes over the files or says what happens to rows that do not parse
        opts |= {k: extra[k] for k in ("multiLine", "schema", "bad_rows") if k in extra}
        return SourceSpec(kind="csv", path=path, checkpoint_col=cfg.get("checkpoint_col"), options=opts)
    table = cfg.get("table")
    part = {k: cfg[k] for k in ("partition_column", "lower_bound", "upper_bound", "num_partitions", "fetchsize")
            if k in cfg}
    return SourceSpec(kind="jdbc", table=qualified_table(conn, table) if table else None, query=cfg.get("query"),
                      checkpoint_col=cfg.get("checkpoint_col"), options=_jdbc_options(conn, part))


def target_from_connection(conn: dict, target_config: dict | None = None) -> TargetSpec:
    cfg = dict(target_config or {})
    t = _type_of(conn)
    extra = dict(conn.get("extra_config") or {})
    create = bool(cfg.get("create_if_not_exists", True))
    if t == "CSV":
        path = cfg.get("output_path") or extra.get("output_path") or extra.get("file_path") or conn.get("host")
        opts = {"delimiter": extra.get("delimiter", ","), "encoding": extra.get("encoding", "UTF-8")}
        return TargetSpec(kind="csv", path=path, create_if_not_exists=create, options=opts)
    return TargetSpec(kind="jdbc", table=qualified_table(conn, cfg["table"]), create_if_not_exists=create,
                      defaults=dict(cfg.get("defaults") or {}), options=_jdbc_options(conn))


# ---------------------------------------------------------------------------
# discovery on databases: list tables, describe columns (information_schema)
# ---------------------------------------------------------------------------

def _schema_predicate(conn: dict) -> str:
    t = _type_of(conn)
    if t == "MYSQL":
        return "table_schema = database()"
    schema = str((conn.get("extra_config") or {}).get("schema", DEFAULT_SCHEMAS.get(t))).replace("'", "''")
    return f"table_schema = '{schema}'"


def list_tables_query(conn: dict) -> str:
    """Base tables of the connection's schema, sorted by name."""
    return (f"select table_name as name from information_schema.tables where {_schema_predicate(conn)} "
            "and table_type = 'BASE TABLE' order by table_name")


def describe_query(conn: dict, table: str) -> str:
    tbl = table.replace("'", "''")
    return ("select column_name as name, data_type, is_nullable, numeric_precision as precision, "
            "numeric_scale as scale, character_maximum_length as max_length, ordinal_position "
            f"from information_schema.columns where {_schema_predicate(conn)} and table_name = '{tbl}' "
            "order by ordinal_position")


def logical_db_type(conn: dict, data_type: str) -> str:
    """Catalog type name -> logical name; unknown names pass upper-cased."""
    names = PG_TYPE_NAMES if _type_of(conn) == "POSTGRESQL" else MYSQL_TYPE_NAMES
    return names.get(str(data_type).lower(), str(data_type).upper())


def list_tables(spark, conn: dict):
    from tidewater.sources.readers import read_jdbc
    o = _jdbc_options(conn)
    return read_jdbc(spark, url=o["url"], query=list_tables_query(conn), user=o.get("user"),
                     password=o.get("password"), driver=o.get("driver"))


def describe_table(spark, conn: dict, table: str):
    """Ordered column descriptors; a missing table -> ``TABLE_NOT_FOUND``."""
    from pyspark.sql import functions as F
    from tidewater.sources.readers import read_jdbc
    o = _jdbc_options(conn)
    df = read_jdbc(spark, url=o["url"], query=describe_query(conn, table), user=o.get("user"),
                   password=o.get("password"), driver=o.get("driver"))
    if df.limit(1).count() == 0:
        raise JobError("TABLE_NOT_FOUND", ERROR_MESSAGES["TABLE_NOT_FOUND"].format(what=table))
    names = PG_TYPE_NAMES if _type_of(conn) == "POSTGRESQL" else MYSQL_TYPE_NAMES
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    dt = F.lower(F.col("data_type"))
    return df.select("name", F.coalesce(mapping[dt], F.upper(F.col("data_type"))).alias("data_type"),
                     (F.upper(F.col("is_nullable")) == "YES").alias("is_nullable"),
                     "precision", "scale", "max_length", "ordinal_position")
