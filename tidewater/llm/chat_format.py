"""Chat formatting with a grammar round trip.

Built-in expressions only.  The template writes a turn as

    ``### <role>: <text></turn>\\n``

with ``user``, ``assistant``, ``system`` capitalised as ``User``, ... and any
other role as it is.  The grammar is deterministic and read from left to right: a
backslash makes the character behind it ordinary; a role goes to the first
ordinary colon, which a space follows; a text goes to the first ``</turn>``
whose ``<`` no backslash precedes, and a line break follows that; the next turn begins there.

Every turn is first rendered as it is and reparsed.  Where the parser does not
give back exactly the source (a backslash anywhere, also at the end; control strings), the turn
is rendered again with its conflicting content escaped (``\\`` before every
backslash, ``#`` of ``###``, ``/`` of ``</turn>``, ``:`` in a role, and a role that is a written name).  The joined
conversation is reparsed once more; a difference from the source stops the job.
What a consumer reads (turns, loss spans, loss text) is read back from the
rendered text by that parser, whose patterns never backtrack: roles and texts may have any length.

A conversation is one output row, so its turns meet in one task: that is the
output's own size.  Turns are shuffled once, as they are; offsets come from a
running sum over the sorted turns, which spills.

Defined cases: rows are ordered by turn, then role, then text (NULLs first);
repeated rows are turns each; a NULL or empty text is an empty turn; a NULL
role is an empty role; rows with a NULL conv_id form one conversation; an empty
table gives no row.  Only the four columns named are read, so further columns
do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import common as C

END = "</turn>"
HEAD = "### "
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(out, F.lit(END), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """The character behind each backslash."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    """The role as the template writes it; a role that looks like a written one stays apart through its escape."""
    out = role
    for name, written in NAMES.items():
        out = F.when(role == name, F.lit(written)).otherwise(out)
    return out


def _role_in(written: Column) -> Column:
    """The role of a header: a written name, unless a backslash marks it as ordinary text."""
    out = unescape(written)
    for name, shown in NAMES.items():
        out = F.when(written == shown, F.lit(name)).otherwise(out)
    return out


def _escape_role(role: Column) -> Column:
    plain = F.replace(_escape(role), F.lit(":"), F.lit("\\:"))
    shown = role.isin(*NAMES.values())
    return F.when(role.isin(*NAMES), _role_out(role)).when(shown, F.concat(F.lit("\\"), plain)).otherwise(plain)


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), text)


#: a turn, read from left to right; possessive, so that its length costs no stack
TURN = r"(?s)\G### ([^:\\]*+(?:\\.[^:\\]*+)*+): ([^\\<]*+(?:(?:\\.|<(?!/turn>))[^\\<]*+)*+)</turn>\n"


def parse_turns(formatted: Column) -> Column:
    """(role, text) of every turn, in order; what does not parse ends the list."""
    part = lambda k: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("role"), part(2).alias("text")),
                       lambda t: F.struct(_role_in(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def render_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) plus ``body``, the turn's rendering, and ``escaped``."""
    plain = _turn(_role_out(F.col("role")), F.col("text"))
    out = turns.withColumn("_plain", plain)
    whole = F.concat("_plain", F.lit(END + "\n"))
    role, text = (F.regexp_extract(whole, TURN + r"\z", k) for k in (1, 2))
    control = lambda c: F.contains(c, F.lit(END)) | F.contains(c, F.lit("###"))
    same = (_role_in(role) == F.col("role")) & (unescape(text) == F.col("text")) & ~control(F.col("role")) & ~control(F.col("text"))
    out = out.withColumn("escaped", ~same)
    return out.withColumn("body", F.when(F.col("escaped"), _turn(_escape_role(F.col("role")), _escape(F.col("text")))).otherwise(F.col("_plain"))).drop("_plain")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, n_turns, turns (role and text, read back), loss_spans
    (start and length, in code points of ``formatted``, of each assistant text as written), loss_text (read
    back), n_escaped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text")).repartition("conv_id")
    rows = render_turns(source)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("body") + len(END) + 1
    rows = rows.withColumns({"_n": F.row_number().over(order), "_at": F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))})
    chats = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_n", "_at", "role", "text", "body"))).alias("_turns"),
        F.count("*").alias("n_turns"), F.sum(F.col("escaped").cast("long")).alias("n_escaped"))
    chats = chats.withColumn("formatted", F.concat(F.array_join(F.transform("_turns", lambda t: t["body"]), END + "\n"), F.lit(END + "\n")))
    # from here on everything is read back from the rendered text
    chats = chats.withColumn("turns", parse_turns(F.col("formatted")))
    same = F.col("turns") == F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    failed = F.raise_error(F.concat(F.lit("round trip failed in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL"))))
    chats = chats.withColumn("turns", F.when(same, F.col("turns")).otherwise(failed))
    head = len(HEAD) + len(NAMES["assistant"]) + 2
    spans = F.transform(F.filter("_turns", lambda t: t["role"] == "assistant"),
                        lambda t: F.struct((t["_at"] + head).alias("start"), (F.length(t["body"]) - head).cast("long").alias("length")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select("conv_id", "formatted", "n_turns", "turns", spans.alias("loss_spans"), loss.alias("loss_text"), "n_escaped")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of conversation -7."""
    hard = "\\### Assistant: </turn> ok"
    chats = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text"))
        for k, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    out = format_chats(chats.unionByName(extra))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped")


OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, k, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
w as (
  select *, contains(text, '\') or contains(text, '###') or contains(text, '</turn>')
            or contains(role, '\') or contains(role, '###') or contains(role, '</turn>') or contains(role, ':')
            or role in ('User', 'Assistant', 'System') as esc,
         replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>') as et,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), ':', '\:') as er from t),
e as (
  select *, case when role in ('User', 'Assistant', 'System') then length(er) + 1 else length(er) end as nr from w)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(nr + length(et) + 14)::bigint as formatted_chars,
       sum(esc::bigint)::bigint as n_escaped
from e group by conv_id
"""
