"""Chat formatting from event logs, with DataFrame functions only.

A log row is one event of a conversation.  Events are folded into final messages: ``message`` opens
one, ``delta`` appends to the last one at its position, ``edit`` replaces that one's text and
``regenerate`` starts that one over.  Messages are rendered with marked turns; control strings inside
texts are escaped reversibly, and the loss mask covers the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings after their first character: this template's marks and those of other common ones.
REST = r"(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string, escaped ones included."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def _line(role: Column) -> Column:
    """A role on one line: backslashes doubled, line feeds as ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unline(role: Column) -> Column:
    # a doubled backslash is set aside as \1 while \n turns into a line feed; a role's own \1 is doubled first
    held = F.replace(F.replace(unescape(role), F.lit("\x01"), F.lit("\x01\x01")), F.lit("\\\\"), F.lit("\x01 "))
    plain = F.replace(held, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(plain, F.lit("\x01 "), F.lit("\\")), F.lit("\x01\x01"), F.lit("\x01"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text): final messages of ``events(conv_id, turn, seq, kind, role, text)``.

    Events of one position (conv_id, turn) are ordered by seq, ties by role and text.  Each position is
    folded by itself, so even one very long conversation is spread over tasks.  An event of unknown
    kind counts as ``message``; a delta, edit or regeneration without a message opens one.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    later = kind.isin("delta", "edit", "regenerate")
    event = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.when(later, kind).otherwise("message").alias("kind"))
    sorted_ = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("e"))
    # messages start at ``message`` events (the first event starts one in any case) ...
    starts = F.filter(F.transform("e", lambda x, i: F.when((x["kind"] == "message") | (i == 0), i)), lambda i: i.isNotNull())
    cut = sorted_.withColumn("s", starts).select("conv_id", "turn", "e", "s", F.posexplode("s").alias("place", "first"))
    own = F.slice("e", F.col("first") + 1, F.coalesce(F.get("s", F.col("place") + 1), F.size("e")) - F.col("first"))
    cut = cut.select("conv_id", "turn", "place", own.alias("e"))
    # ... and a message's text is its last replacement and the deltas after it
    reset = F.array_max(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    kept = F.slice("e", reset + 1, F.size("e") - reset)
    return cut.select("conv_id", "turn", "place", F.col("e")[0]["role"].alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def as_log(messages: DataFrame) -> DataFrame:
    """An event log ``(conv_id, turn, seq, kind, role, text)`` whose folding gives ``messages(conv_id, turn, role, text)`` back.

    It is what a chat server would have written: assistants' texts are regenerated once and then stream in three
    deltas, the others' are drafts that an edit replaces.  Messages at one position follow each other by role and
    text.  Null roles and texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("first", F.row_number().over(order).cast("long") * 8)
    third = F.floor(F.length("text") / 3).cast("int")
    piece = lambda start, n: F.substr(F.col("text"), start, n)
    event = lambda k, kind, text: F.struct((F.col("first") + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(
        event(0, "message", F.lit("")), event(1, "delta", F.lit("a first attempt")), event(2, "regenerate", F.lit("")),
        event(3, "delta", piece(F.lit(1), third)), event(4, "delta", piece(third + 1, third)), event(5, "delta", piece(2 * third + 1, F.length("text"))),
    )
    edited = F.array(event(0, "message", F.lit("a draft")), event(1, "edit", F.col("text")))
    return rows.select("conv_id", "turn", "role", F.inline(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(edited)))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the rendered conversation and its loss mask, spans (start, length) in code points."""
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), _line(F.col("role")), F.lit("\n"))
    turns = messages.select("conv_id", "turn", "place", "role", head.alias("head"), body.alias("body")).withColumn("line", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    all_ = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "line", span.alias("span")))).alias("t"))
    return all_.select("conv_id", F.array_join(F.col("t.line"), "").alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold and render an event log ``(conv_id, turn, seq, kind, role, text, ...)``: conv_id, formatted, loss.

    Null roles and texts count as empty; rows without conv_id form one conversation of their own, and
    null turns come first.  A log must be whole: what was lost from it can't be told.  Equal rows are separate events and are all kept.  An empty log gives an
    empty table.  Texts are used whole.  Other columns are not read.
    """
    return render(fold(events))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): parse ``formatted`` into (role, text) turns, and read what its loss mask covers."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2**30))
    turn = lambda p: F.struct(_unline(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"))
    covered = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), F.array_join(covered, "").alias("loss_text"))
