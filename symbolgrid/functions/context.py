"""What the text around the cursor says about the wanted symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolgrid.functions.names import ascii_lower

HINTS = ("type", "construct", "call", "module", "annotation")


def ends_with_word(text: Column, *words: str) -> Column:
    return text.rlike(r"(?s)(?<![A-Za-z0-9_$])(?:" + "|".join(words) + r")\z")


def ends_with(text: Column, *ends: str) -> Column:
    return reduce(lambda a, b: a | b, [text.endswith(e) for e in ends])


def last_at(text: Column, char: str) -> Column:
    """Position of the last ``char`` from 1, 0 if there is none."""
    at = F.instr(F.reverse(text), char)
    return F.when(at == 0, 0).otherwise(F.length(text) - at + 1)


def _head(before: Column) -> Column:
    return F.rtrim(F.substr(before, F.lit(1), F.length(before) - 1))


def script_annotation(before: Column) -> Column:
    """A colon that looks like a TypeScript type position rather than an object key."""
    head = _head(before)
    lower = ascii_lower(head)
    says = lambda *words: reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
    key = (last_at(head, "{") > last_at(head, "=")) & ~says("type ", "interface ")
    typed = head.endswith(")") | says("const ", "let ", "var ", "function ", "interface ", "type ")
    return before.endswith(":") & ~key & (typed | (last_at(head, "(") > last_at(head, "{")))


def python_annotation(before: Column) -> Column:
    head = _head(before)
    inside = (last_at(head, "{") > last_at(head, "=")) | (last_at(head, "[") > last_at(head, "="))
    return before.endswith(":") & ~inside


def hints(language: Column, line_prefix: Column, line_suffix: Column) -> Column:
    """Struct of the five booleans in HINTS."""
    blank = r"[\s\x{0b}]+"
    before = F.regexp_replace(F.coalesce(line_prefix, F.lit("")), blank + r"\z", "")
    after = F.regexp_replace(F.coalesce(line_suffix, F.lit("")), r"\A" + blank, "")
    script, python, java = language.isin("typescript", "javascript"), language == "python", language == "java"
    found = {
        "type": (script & (script_annotation(before) | ends_with(before, "<", "|", "&") | ends_with_word(before, "as", "satisfies", "extends", "implements", "type", "interface")))
        | (python & (python_annotation(before) | ends_with(before, "->", "[", "|") | ends_with_word(before, "class", "except")))
        | (java & (ends_with(before, "<", ",") | ends_with_word(before, "extends", "implements", "throws", "catch", "instanceof"))),
        "construct": (script & ends_with_word(before, "new", "instanceof")) | (java & ends_with_word(before, "new")),
        "call": after.startswith("("),
        "module": after.startswith(".") | (script & ends_with_word(before, "import", "from")),
        "annotation": before.endswith("@"),
    }
    return F.struct(*[F.coalesce(found[h], F.lit(False)).alias(h) for h in HINTS])


def line_around(source: Column, start: Column, stop: Column) -> Column:
    """Struct(line_prefix, line_suffix) of the word at [start, stop) (0-based) of a document."""
    before = F.substr(source, F.lit(1), start)
    after = F.substr(source, stop + 1)
    return F.struct(F.regexp_extract(before, r"([^\n]*)\z", 1).alias("line_prefix"), F.regexp_extract(after, r"\A([^\n\r]*)", 1).alias("line_suffix"))
