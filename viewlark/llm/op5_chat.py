"""Chat formatting by event-sourced reconstruction (native).

A log holds one row per event: ``conv_id, turn, part, seq, kind, role, text``.
``(conv_id, turn, part)`` names a message and ``seq`` orders its events:

* ``start`` opens the message: sets its role, and its text to the given text;
* ``delta`` appends streamed text;
* ``edit`` replaces the text; ``regenerate`` clears it, and voids every later
  turn of the conversation whose last event came before it;
* ``delete`` removes the message.

``reconstruct`` folds the log into final messages, ``render`` writes each
conversation with the template below, its messages by turn and part.  Inside texts
and roles every backslash, ``#`` and ``<`` (in roles also ``:``) becomes a backslash
and a letter, so that no control string can appear there, and ``unescape`` gives
back the exact text.  The loss mask is a list of spans of the output, one for each
turn: ``length`` code points of it from ``start`` on, 0 of a turn that bears no loss;
``under_loss`` reads it.  (Places are within the turn, so that slicing a long
conversation takes time in proportion to it.)

All of it takes one exchange, by conversation: numbering, sorting by sequence,
folding and rendering find the rows where they are.

Nulls: a null text is empty, a null role is the empty role, a null conv_id is a
conversation of its own and a null turn comes first.  Rows that repeat an event
are separate events; in ``query`` each row of the table is a turn of its own.
Events of one message with equal ``seq`` follow by text and kind.  Empty tables give no rows.  Columns other than those named are ignored.  A
conversation is one output row, so the whole of it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, SEP, END = "### ", ": ", "</turn>\n"
#: What sets the text anew; only events from the last of these on count.
RESETS = ("start", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, part, role, text`` of an event log."""
    kind, seq = F.col("kind"), F.col("seq")
    # of each event, the last regeneration of an earlier turn (a null turn is before all others)
    earlier = Window.partitionBy("conv_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    log = events.select("conv_id", "turn", "part", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"), at.alias("at"))
    log = log.withColumn("redone", F.max(F.when(kind == "regenerate", seq)).over(earlier))
    # in order of sequence: how often the message was set anew, and by whom it was opened
    so_far = Window.partitionBy("conv_id", "turn", "part").orderBy("seq", "text", "kind").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumns({
        "version": F.count_if(kind.isin(*RESETS)).over(so_far),
        "opened": F.last(F.when(kind == "start", F.coalesce("role", F.lit(""))), ignorenulls=True).over(so_far),
    })
    messages = log.groupBy("conv_id", "turn", "part").agg(
        F.max("version").alias("final"), F.max("seq").alias("last_seq"), F.max("redone").alias("redone"),
        F.max_by("opened", F.struct("version", "seq")).alias("role"), F.collect_list(F.struct("version", "seq", "text", "kind")).alias("log"),
    )
    live = F.array_sort(F.filter("log", lambda e: e["version"] == F.col("final")))
    texts = F.transform(F.filter(live, lambda e: e["kind"].isin("start", "delta", "edit")), lambda e: e["text"])
    # a regeneration voids what came later in the conversation and was written before it
    return (
        messages.filter(~F.coalesce(F.col("redone") > F.col("last_seq"), F.lit(False)))
        .filter(~F.exists(live, lambda e: e["kind"] == "delete"))
        .select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss``: the output string, and of each of its turns the span (``start, length``) that is text of ``loss_role``."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(SEP))
    rows = messages.select("conv_id", "turn", "part", (F.col("role") == loss_role).alias("own"), head.alias("head"), escape(F.col("text")).alias("body"))
    one = F.struct(
        "turn", "part", "own", F.length("head").alias("start"), F.length("body").alias("length"),
        F.concat("head", "body", F.lit(END)).alias("written"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("ms"))
    loss = F.transform("ms", lambda m: F.struct(m["start"].alias("start"), F.when(m["own"], m["length"]).otherwise(0).alias("length")))
    return ordered.select("conv_id", F.array_join(F.transform("ms", lambda m: m["written"]), "").alias("formatted"), loss.alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns of a rendered string, as they are written, without their end."""
    return F.filter(F.split(formatted, END, -1), lambda t: t != "")


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, sliced out of the rendered string and unescaped, in order."""
    return F.zip_with(turns_of(formatted), loss, lambda t, m: unescape(t.substr(m["start"] + 1, m["length"])))


def parse(formatted: Column) -> Column:
    """The turns ``role, text`` in a rendered string, unescaped."""
    def turn(t: Column) -> Column:
        body = F.substring(t, len(OPEN) + 1, 2**31 - 1)
        at = F.instr(body, SEP)
        role = F.replace(body.substr(F.lit(1), at - 1), F.lit("\\c"), F.lit(":"))
        text = body.substr(at + len(SEP), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns_of(formatted), turn)


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns, as a chat would have left it.

    What the assistant said arrives in two deltas, after a first answer that broke
    off and was made anew; what others said was sent half written, and then edited.
    """
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length("text") / 2).cast("int")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("part", F.row_number().over(order).cast("long"))
    begun, rest = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    none = F.lit(None).cast("string")

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct((F.col("part") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), t.alias("text")) for k, (kind, t) in enumerate(events)))

    streamed = log(("start", none), ("delta", begun), ("regenerate", none), ("delta", begun), ("delta", rest))
    edited = log(("start", begun), ("edit", F.col("text")))
    return rows.select("conv_id", "turn", "part", "role", F.inline(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = render(reconstruct(events_of(rows))).select("*", parse(F.col("formatted")).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(under_loss(F.col("formatted"), F.col("loss")), "")
    return out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), joined.alias("joined"), loss.alias("loss")).select(
        "conv_id", "n_turns", F.sha2("joined", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(text)
    + length(role) - length(translate(role, '\#<:', '')) + length(text) - length(translate(text, '\#<', '')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
