"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a constant that results depend on: names of
strategies / transforms / rules, cast aliases, CSV null tokens, message
templates and the whitespace set.  They are listed plainly and in natural
order; no logic lives here.
"""

# --- fixed values: load strategy names ------------------------------------
LOAD_STRATEGIES = ("APPEND", "FULL_LOAD", "TRUNCATE_INSERT", "UPSERT", "INCREMENTAL", "OVERWRITE")

# --- fixed values: validation rule names and actions ----------------------
VALIDATION_RULES = ("NOT_NULL", "UNIQUE", "REGEX", "RANGE", "DATE_FORMAT", "DUPLICATE_CHECK")
ACTIONS = ("REJECT", "WARN", "STOP")

# --- fixed values: CAST target aliases (name -> Spark SQL type) -----------
# "decimal" deliberately maps to double (a 64-bit float), as in the original.
CAST_ALIASES = {
    "integer": "int", "int": "int",
    "bigint": "bigint", "long": "bigint",
    "smallint": "smallint",
    "float": "float",
    "double": "double", "decimal": "double",
    "string": "string", "varchar": "string", "text": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
}

# --- fixed values: default date / timestamp formats (strftime) ------------
DEFAULT_DATE_FORMAT = "%Y-%m-%d"
DEFAULT_TIMESTAMP_FORMAT = "%Y-%m-%d %H:%M:%S"

# --- fixed values: CSV tokens read as null --------------------------------
CSV_NULL_TOKENS = ("", "NULL", "null", "NA", "N/A")

# --- fixed values: Unicode White_Space code points (TRIM strips these) ----
UNICODE_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: validation messages (Turkish, as shown to users) -------
# {label} is "'<col>' kolonu" for a column rule and "Satır" without a column.
COLUMN_LABEL = "'{col}' kolonu"
ROW_LABEL = "Satır"
RULE_MESSAGES = {
    "NOT_NULL": "{label} boş (null) olamaz",
    "UNIQUE": "{label} benzersiz olmalı, tekrar eden değer var",
    "REGEX": "{label} regex doğrulaması başarısız: {pattern}",
    "RANGE": "{label} geçerli aralık dışında [{min}, {max}]",
    "DATE_FORMAT": "{label} tarih formatı geçersiz: {format}",
    "DUPLICATE_CHECK": "Tekrar eden kayıt tespit edildi",
}
UNKNOWN_RULE_MESSAGE = "Validation başarısız: {rule}"
WARN_TEMPLATE = "{msg}: {n} kayıt etkilendi"
STOP_TEMPLATE = "Validation STOP kuralı tetiklendi: {msg} — {n} hatalı kayıt"

# --- fixed values: step-log messages (Turkish, as shown to users) ----------
STEP_MESSAGES = {
    "METADATA": "Pipeline metadata yükleniyor",
    "SOURCE_CONNECT": "Kaynak bağlantısı başlatılıyor: {name}",
    "SOURCE_CONNECTED": "Kaynak bağlandı ({ms}ms)",
    "TARGET_CONNECT": "Hedef bağlantısı başlatılıyor: {name}",
    "TARGET_CONNECTED": "Hedef bağlandı ({ms}ms)",
    "CHECKPOINT": "Son checkpoint: {value} [{column}]",
    "CHECKPOINT_FIRST": "İlk incremental çalışma — checkpoint yok",
    "SOURCE_READ_START": "Kaynak veri okunuyor",
    "SOURCE_READ_DONE": "{n:,} satır okundu",
    "NO_DATA": "Kaynak veri boş — iş tamamlandı",
    "MAPPING": "{n} kolon eşleştirmesi uygulanıyor",
    "TRANSFORM_DONE": "Dönüşümler tamamlandı",
    "VALIDATION_START": "{n} validation kuralı çalıştırılıyor",
    "VALIDATION_REJECTED": "{n} kayıt reddedildi",
    "VALIDATION_DONE": "Validation tamamlandı: {n:,} geçerli kayıt",
    "TARGET_WRITE_START": "Hedefe yazılıyor: {strategy}",
    "TARGET_WRITE_DONE": "{n:,} satır yazıldı",
    "CHECKPOINT_UPDATED": "Checkpoint güncellendi: {value}",
    "JOB_SUCCESS": "İş başarıyla tamamlandı 🎉",
    "JOB_UNEXPECTED": "Beklenmeyen hata: {error}",
}

# --- fixed values: error messages (Turkish, as shown to users) -------------
ERROR_MESSAGES = {
    "COLUMN_NOT_FOUND": "Kaynak kolon bulunamadı: '{col}'",
    "READ_FAILED": "Veri okunamadı: {what}",
    "WRITE_FAILED": "Hedefe yazma başarısız: {what}",
    "TABLE_NOT_FOUND": "Tablo bulunamadı: {what}",
    "UNSUPPORTED_SOURCE": "Desteklenmeyen connector tipi: '{kind}'. Mevcut: {known}",
    "TRANSFORM_FAILED": "Dönüşüm uygulanamadı",
}

# --- fixed values: preview limits ------------------------------------------
PREVIEW_DEFAULT_ROWS = 20
PREVIEW_MAX_ROWS = 100
TEST_RUN_DEFAULT_ROWS = 100
RECENT_RUNS_DEFAULT = 10
REJECTED_PAGE_DEFAULT = 100
RUN_PAGE_DEFAULT = 50
MISSING_PIPELINE_NAME = "—"

# --- fixed values: logical type names reported by describe -----------------
LOGICAL_TYPE_NAMES = {
    "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT",
    "float": "FLOAT", "double": "DOUBLE", "decimal": "DECIMAL",
    "string": "VARCHAR", "varchar": "VARCHAR", "char": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ",
}

# --- fixed values: database catalog type names -> logical names ------------
PG_TYPE_NAMES = {
    "integer": "INTEGER", "int4": "INTEGER", "int8": "BIGINT", "bigint": "BIGINT",
    "smallint": "SMALLINT", "int2": "SMALLINT",
    "numeric": "DECIMAL", "decimal": "DECIMAL", "float4": "FLOAT", "float8": "DOUBLE",
    "real": "FLOAT", "double precision": "DOUBLE",
    "varchar": "VARCHAR", "character varying": "VARCHAR", "text": "TEXT",
    "char": "CHAR", "bpchar": "CHAR",
    "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMPTZ",
    "time": "TIME", "json": "JSON", "jsonb": "JSONB", "uuid": "UUID",
}
MYSQL_TYPE_NAMES = {
    "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT",
    "float": "FLOAT", "double": "DOUBLE", "decimal": "DECIMAL", "numeric": "DECIMAL",
    "varchar": "VARCHAR", "text": "TEXT", "mediumtext": "TEXT", "longtext": "TEXT",
    "char": "CHAR", "enum": "VARCHAR",
    "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "date": "DATE", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "time": "TIME",
    "json": "JSON",
}
