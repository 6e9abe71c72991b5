"""Chat formatting from event logs, with DataFrame functions alone.

A log holds events ``(conv_id, turn, copy, seq, kind, role, text)``. ``message``
opens a turn with its text, ``delta`` appends to it, ``edit`` replaces it, and
``regenerate`` starts it anew, to be filled by later deltas, and drops the
turns after it that were opened before. Folding goes by ``seq`` within a turn,
then turns are rendered in order. ``copy`` tells apart messages that share a
turn. A table of finished turns becomes such a log, each text streamed as
deltas, by ``log_of``.

The events of a turn meet in one task, then one row for each turn of a
conversation, and its messages where its output, one value, is put together.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In a text, ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``; in a role, a line feed also becomes
``<|nl|>``. So control strings in texts are never control strings of the
output, and reading back restores each character.

Defined cases: a null text or role is empty. Null turns come first. In a table,
rows of one turn are messages of their own, in order of role and text, repeated
rows included. An event without a kind is a ``message``; one of any other kind
changes nothing but is counted in ``ignored``, and a turn of only such events is
none. A null conversation id is a conversation. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import read

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def log_of(turns: DataFrame) -> DataFrame:
    """The events that lead to finished turns ``(conv_id, turn, role, text)``: a message is opened, then its text streams in."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, text = F.lit(None).cast("string"), F.col("text")
    events = F.array(event(0, "message", F.col("role"), none), event(1, "delta", none, text.substr(F.lit(1), half)), event(2, "delta", none, text.substr(half + 1, F.length(text))))
    return t.select("conv_id", "turn", "copy", F.explode(events).alias("e")).select("conv_id", "turn", "copy", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """The messages ``(conv_id, turn, copy, role, text, ignored)`` that a log of events ends with."""
    e = events.select("conv_id", "turn", "copy", "seq", F.coalesce(F.lower("kind"), F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # an unknown kind ranks before all others, so that it is no event of the turn's numbering
    known = F.col("kind").isin(*KINDS)
    rank = F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END")
    turn = Window.partitionBy("conv_id", "turn", "copy")
    parts = e.withColumn("known", known).withColumn("no", F.row_number().over(turn.orderBy("known", F.col("seq").asc_nulls_first(), rank, "text")))
    parts = parts.withColumn("reset", F.coalesce(F.max(F.when(known & (F.col("kind") != "delta"), F.col("no"))).over(turn), F.lit(0)))
    role = F.min_by(F.when(known, F.col("role")), F.when(known, F.struct(F.col("role") == "", F.col("no"))))
    kept = F.when(known & (F.col("no") >= F.col("reset")) & (F.col("kind") != "regenerate"), F.struct("no", "text"))
    texts = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"])
    when = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    turns = parts.groupBy("conv_id", "turn", "copy").agg(
        role.alias("role"), F.array_join(texts, "").alias("text"), F.coalesce(when("message"), F.min(F.when(known, F.col("seq")))).alias("opened"),
        when("regenerate").alias("redone"), F.count_if(~known).alias("ignored"), F.count_if(known).alias("events"),
    )
    # a turn goes if an earlier one of its conversation was regenerated after it was opened
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "copy").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("redone").over(earlier)).where("events > 0 AND (cut IS NULL OR opened > cut)")
    return turns.select("conv_id", "turn", "copy", "role", "text", "ignored")


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask``.

    ``loss_mask`` has ``(segment, start, stop)`` for each turn to learn from,
    in code points within that turn's part of the output, which begins right
    after its start mark; offsets by part keep reading back linear in long
    conversations. A conversation's output is one value and so one row; only
    its messages meet, in order, when it is put together.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    body = escape(F.coalesce("text", F.lit("")))
    m = messages.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), role.alias("role"), body.alias("body")).alias("m"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    formatted = F.array_join(F.transform("ms", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["body"], F.lit(END + "\n"))), "")
    spans = F.transform("ms", lambda x, i: F.when(x["r"] == learn_role, F.struct(i.alias("segment"), (F.length(x["role"]) + 1).alias("start"), (F.length(x["role"]) + 1 + F.length(x["body"])).alias("stop"))))
    return g.select("conv_id", formatted.alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_mask"))


def parse(rendered: DataFrame) -> DataFrame:
    """Read rendered conversations back: adds ``turns`` of (role, text) and ``learned`` texts under the loss mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2147483647)
    r = rendered.withColumn("__parts", parts)
    cut = F.length(F.lit(END + "\n"))
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
    text = lambda p: unescape(p.substr(F.instr(p, "\n") + 1, F.length(p) - cut - F.instr(p, "\n")))
    turns = F.transform("__parts", lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    learned = F.transform("loss_mask", lambda s: unescape(F.get("__parts", s["segment"]).substr(s["start"] + 1, s["stop"] - s["start"])))
    return r.withColumn("turns", turns).withColumn("learned", learned).drop("__parts")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their rendered form."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    log = log_of(turns)
    marks = END + START + "assistant ok"
    # said, edited and regenerated until both turns say the marks
    events = [(0, 0, "message", "user", "?"), (0, 1, "edit", None, marks), (1, 2, "message", "assistant", "no"), (1, 3, "regenerate", None, None), (1, 4, "delta", None, marks[:9]), (1, 5, "delta", None, marks[9:])]
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(*map(F.lit, e)) for e in events])).alias("e")).select("e.*").toDF("turn", "seq", "kind", "role", "text")
    extra = extra.select(F.lit(-1).alias("conv_id"), "turn", F.lit(1).alias("copy"), "seq", "kind", "role", "text").to(log.schema)
    r = parse(render(fold(log.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests without rendering: the round trip must change nothing.
OP7_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), esc AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS nt,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) AS nr FROM log
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + nr + 1 + nt + 11)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
