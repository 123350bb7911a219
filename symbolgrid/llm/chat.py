"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation (one string)::

    conversation := turn*
    turn         := OPEN header NEWLINE body CLOSE NEWLINE
    OPEN         := "<|im_start|>"        CLOSE := "<|im_end|>"

The parser needs no lookahead: cut at every OPEN, end the header at the first NEWLINE and the
body at the first CLOSE. A text that the parser would read back differently is escaped: ``<``, any number of backslashes, ``|`` gains one backslash, and the parser takes one
away. Headers are role names whose backslashes and newlines are spelled ``\\s`` and ``\\n``.

The renderer starts from the plain texts, parses every turn it rendered, and escapes those that did
not come back. Then the whole output is parsed; a conversation that does not equal its source has
all its turns escaped, and if it still differed, the job would fail rather than return it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgrid.llm.native import let, running_sum

OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(header: Column) -> Column:
    return F.replace(F.replace(unescape(header), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(NEWLINE), body, F.lit(CLOSE + NEWLINE))


def render(turns: Column) -> Column:
    """``turns``: array of struct(role, body), bodies as they are to stand in the output."""
    return F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["body"])), "")


def parse(formatted: Column) -> Column:
    """The deterministic parser: array of struct(role, text), texts unescaped."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, NEWLINE)
        body = F.substr(piece, at + 1)
        return F.struct(
            unescape_role(F.substr(piece, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(body, F.lit(1), F.instr(body, CLOSE) - 1)).alias("text"),
        )

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def loss_spans(turns: Column, learned_role: str = LEARNED_ROLE) -> Column:
    """array of struct(start, length): code points of the output that the loss covers, in order."""

    def spans(all_: Column) -> Column:
        ends = running_sum(F.transform(all_, lambda t: F.length(_turn(t["role"], t["body"]))))
        tail = len(CLOSE + NEWLINE)
        each = F.zip_with(all_, ends, lambda t, end: F.struct((end - tail - F.length(t["body"])).alias("start"), F.length(t["body"]).alias("length"), t["role"].alias("role")))
        learned = F.filter(each, lambda s: s["role"] == learned_role)
        return F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    return let(turns, spans)


def format_chats(turns: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, source array, formatted string, loss spans, recovered turns.

    Input columns used: conv_id, turn, role, text; others are ignored, whatever their names.
    Null role or text counts as empty; null turns come first; rows with the same turn are all
    kept, ordered by role, then text; null conv_id is a conversation of its own. No rows give no
    rows. One conversation becomes one string, so it must fit one row of a task.
    Texts of any length are taken whole. ``escaped`` counts the turns that were escaped;
    ``recovered``, parsed back from ``formatted``, equals the source.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("entry"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("source"))

    # Round 0 renders one turn at a time, so that a conflict stays within its own turn.
    def settle(t: Column) -> Column:
        back = parse(_turn(t["role"], t["text"]))
        same = (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == t["role"]) & (F.get(back, F.lit(0))["text"] == t["text"])
        return F.struct(
            t["role"].alias("role"), F.when(same, t["text"]).otherwise(escape(t["text"])).alias("body"), (~same).alias("escaped")
        )

    def rendered(turns: Column) -> Column:
        return let(render(turns), lambda x: F.struct(turns.alias("turns"), x.alias("formatted"), parse(x).alias("recovered")))

    def checked(done: Column, otherwise: Column) -> Column:
        return F.when(done["recovered"] == F.col("wanted"), done).otherwise(otherwise)

    wanted = F.expr("transform(source, t -> struct(t.role as role, t.text as text))")
    everything = F.transform("source", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("body"), F.lit(True).alias("escaped")))
    settled = convs.withColumns({"turns": F.transform("source", settle), "wanted": wanted})
    failed = F.raise_error(F.lit("a conversation does not come back from its formatted text"))
    done = let(rendered(F.col("turns")), lambda first: checked(first, let(rendered(everything), lambda again: checked(again, failed))))
    out = settled.select("conv_id", "source", done.alias("done"))
    return out.select(
        "conv_id",
        "source",
        F.size(F.filter("done.turns", lambda t: t["escaped"])).alias("escaped"),
        "done.formatted",
        loss_spans(F.col("done.turns"), learned_role).alias("loss_spans"),
        "done.recovered",
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
