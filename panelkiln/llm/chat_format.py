"""Chat formatting by replaying an event log, in SQL functions only.

The log has one row an event: conversation, message, seq, op, role, text. Events of a message fold, in the order of seq:
`start` sets the role, `delta` appends to the draft, `edit` replaces the draft, `regenerate` throws it away. A message is
thus what follows its last edit or regeneration, so the fold needs no loop: it is the concatenation from that event on.
Messages fold first (one group a message); a conversation then gathers its finished messages.

The template is  <|role|>text<|end|>  for each message. In roles and texts a backslash becomes \\s, `<` becomes \\l and
`|` becomes \\p: control strings can't occur in them, and the mapping is undone without ambiguity.

NULL texts and roles count as empty; messages with equal numbers are ordered by role and text, those without a number come last; repeated rows are
messages of their own; extra columns, whatever their names, are ignored; an empty log gives no rows. Texts of any length are formatted whole: the
messages of a conversation make one row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ASSISTANT = "assistant"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 200) -> DataFrame:
    """Finished rows as the log of a session that led to them. Each message starts with a draft that is thrown away (`regenerate`), then its first
    part is streamed with a slip and put right (`edit`), and the rest follows as deltas of `chunk` characters. Rows with the same turn stay apart."""
    t, r = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    n = F.ceil(F.length(t) / F.lit(chunk)).cast("int")
    event = lambda seq, op, said: F.struct(seq.cast("int").alias("seq"), F.lit(op).alias("op"), said.alias("text"))
    part = lambda i: F.substring(t, (i - 1) * chunk + 1, F.lit(chunk))
    first = [event(F.lit(0), "start", F.lit("")), event(F.lit(1), "delta", F.concat(F.lit("draft: "), F.reverse(part(F.lit(1))))), event(F.lit(2), "regenerate", F.lit(None).cast("string"))]
    put_right = F.array(event(F.lit(3), "delta", F.concat(part(F.lit(1)), F.lit(" slip"))), event(F.lit(4), "edit", part(F.lit(1))))
    rest = F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: event(i + 3, "delta", part(i))))
    none = F.slice(F.array(*first), 1, 0)
    log = rows.select(
        F.col(conv).alias("conversation"), F.struct(F.col(turn).alias("turn"), F.monotonically_increasing_id().alias("row")).alias("message"), r.alias("role"),
        F.concat(F.array(*first), F.when(n > 0, put_right).otherwise(none), F.coalesce(rest, none)).alias("e"),
    )
    return log.select("conversation", "message", "role", F.inline("e"))


def fold(log: DataFrame) -> DataFrame:
    """One row a message: conversation, message, role, text."""
    e = F.array_sort(F.collect_list(F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"))))
    got = log.groupBy("conversation", "message").agg(F.max("role").alias("role"), e.alias("e"))
    last = F.aggregate("e", F.lit(0), lambda a, x: F.when(x["op"].isin("edit", "regenerate"), x["seq"]).otherwise(a))
    kept = let(last, lambda k: F.filter("e", lambda x: (x["seq"] >= k) & x["op"].isin("delta", "edit")))
    return got.select("conversation", "message", "role", F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: formatted (the text) and mask (for each message where, counted from its start, the loss applies: offset and length, 0 for none)."""
    escaped = messages.select("conversation", F.struct(F.col("message.turn").isNull().alias("last"), "message.turn", F.col("role").alias("role"), F.col("text").alias("text")).alias("m"))
    m = escaped.groupBy("conversation").agg(F.array_sort(F.collect_list("m")).alias("m"))
    piece = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE), escape(x["text"]), F.lit(END))
    span = lambda x: F.struct((F.length(escape(x["role"])) + len(OPEN) + len(CLOSE)).alias("offset"), F.when(x["role"] == ASSISTANT, F.length(escape(x["text"]))).otherwise(0).alias("length"))
    return m.select("conversation", F.array_join(F.transform("m", piece), "").alias("formatted"), F.transform("m", span).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the rendered text alone (and the mask for the loss): turns as (role, text), and the text under the mask."""
    parts = F.split(F.col("formatted"), "<\\|end\\|>")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        head = F.instr(x, CLOSE)
        return F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), head - 1 - len(OPEN))).alias("role"), unescape(F.substring(x, head + len(CLOSE), F.length(x))).alias("text"))

    loss = F.zip_with("__parts", "mask", lambda x, s: unescape(F.substring(x, s["offset"] + 1, s["length"])))
    df = formatted.withColumn("__parts", parts)
    return df.select("*", F.transform("__parts", turn).alias("turns"), F.array_join(loss, "").alias("loss_text")).drop("__parts")


def format_chat(log: DataFrame) -> DataFrame:
    return read_back(render(fold(log)))
