"""Chat formatting by relational means (DataFrame functions only).

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role become one block; blocks are written between control strings:
``<|im_start|>role<|im_sep|>text<|im_end|>``, with ``<|im_next|>`` between the
texts of a block, so that merged turns can be told apart again.  Every control
string begins with ``<|``, and ``escape`` leaves no ``<|`` inside a text, so a
text can say what it likes and is read back as it was.

The result is an array of segments (text, loss) whose texts, joined, are the
formatted conversation; ``loss`` marks what a model learns to say, which is the
texts of the assistant and nothing between them.

Blocks are found by the places where the role changes and cut out as slices:
folding turns one by one into a growing array would copy it at every turn.

A conversation becomes one row, so it must fit into one.  Turns from number
``PIECE`` on are collected and merged in pieces of ``PIECE`` turn numbers first,
in tasks of their own; only finished blocks meet in the task of their
conversation, where blocks of one role that two pieces share become one.

Edge cases: a null text or role counts as empty; turns of equal number (ties)
are ordered by role, then text; repeated rows are turns of their own; a null
turn comes first; a null conversation id is a conversation; texts are taken
whole; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
LEARNT = "assistant"
#: Turn numbers of a piece.
PIECE = 256


def escape(c: Column) -> Column:
    """Text without ``<|`` from which ``unescape`` makes the same text again."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _blocks(runs: Column) -> Column:
    """Neighbours of one role of an array of (role, texts) as one element, their texts in order."""
    n = F.size(runs)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(runs, i)["role"] != F.get(runs, i - 1)["role"]))

    def block(at: Column, k: Column) -> Column:
        own = F.slice(runs, at + 1, F.coalesce(F.get(first, k + 1), n) - at)
        return F.struct(F.get(own, F.lit(0))["role"].alias("role"), F.flatten(F.transform(own, lambda r: r["texts"])).alias("texts"))

    return F.transform(first, block)


def blocks(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(key, blocks): per conversation its blocks (role, texts), all strings escaped."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    rows = turns.select(F.col(key).alias(key), F.greatest(F.coalesce(F.floor(F.col(turn) / piece), F.lit(0)), F.lit(0)).cast("long").alias("_p"), row.alias("_row"))
    # escaped only when sorted, as ties follow the strings as they are
    ordered = lambda: F.transform(F.sort_array(F.collect_list("_row")), lambda x: F.struct(escape(x["role"]).alias("role"), F.array(escape(x["text"])).alias("texts")))

    # the first piece of every conversation is merged where the conversation meets; later pieces come as blocks
    late = rows.where("_p > 0").groupBy(key, "_p").agg(ordered().alias("_runs")).select(key, F.struct("_p", _blocks(F.col("_runs")).alias("_b")).alias("_late"))
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    early = rows.where("_p = 0").select(key, "_row", nothing(late, "_late").alias("_late"))
    met = early.union(late.select(key, nothing(rows, "_row").alias("_row"), "_late")).groupBy(key).agg(
        F.concat(ordered(), F.flatten(F.transform(F.sort_array(F.collect_list("_late")), lambda x: x["_b"]))).alias("_runs"))
    return met.select(key, _blocks(F.col("_runs")).alias("blocks"))


def format_conversations(turns: DataFrame, key: str = "conv_id", learnt: str = LEARNT, **columns) -> DataFrame:
    """(key, segments): one row per conversation; segments are (text, loss), see above."""
    def segments(b: Column, at: Column) -> Column:
        loss = b["role"] == F.lit(learnt)
        begin = F.concat(F.when(at == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), b["role"], F.lit(SEP))
        part = lambda t, k: F.array(
            F.struct(F.when(k == 0, begin).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")), F.struct(t.alias("text"), loss.alias("loss")))
        return F.flatten(F.transform(b["texts"], part))

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    return blocks(turns, key, **columns).select(key, F.concat(F.flatten(F.transform("blocks", segments)), last).alias("segments"))


def formatted_text(segments: Column | str = "segments") -> Column:
    """The formatted conversation as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again, unescaped."""
    def turns(part: Column) -> Column:
        halves = F.split(part, r"\Q" + SEP + r"\E", 2)
        body = F.get(halves, F.lit(1))
        texts = F.split(F.substr(body, F.lit(1), F.length(body) - len(END)), r"\Q" + NEXT + r"\E")
        return F.transform(texts, lambda t: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")))

    parts = F.split(formatted, r"\Q" + START + r"\E")
    return F.flatten(F.transform(F.slice(parts, 2, F.size(parts)), turns))


def read_loss(segments: Column | str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
