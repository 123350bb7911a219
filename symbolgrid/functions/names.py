"""Name matching: ASCII case folding, prefixes and initials, as codegen-friendly expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A boundary character: the first, one after a separator, upper case after lower case or a digit,
#: a digit after anything else.
BOUNDARY = r"(?s)^.|(?<=[_\-.$]).|(?<=[a-z0-9])[A-Z]|(?<![0-9])[0-9]"


def ascii_lower(text: Column) -> Column:
    """Folds A-Z only; other letters keep their case, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def initials(name: Column) -> Column:
    return ascii_lower(F.array_join(F.regexp_extract_all(name, F.lit(BOUNDARY), F.lit(0)), ""))


def bucket(name_lc: Column) -> Column:
    return F.substring(name_lc, 1, 1)


def is_subsequence(wanted: Column, letters: Column) -> Column:
    """Whether ``letters`` holds the characters of ``wanted`` in order."""
    rest = F.aggregate(
        F.split(letters, ""), wanted, lambda left, c: F.when((F.length(left) > 0) & (F.substring(left, 1, 1) == c), F.substr(left, F.lit(2))).otherwise(left)
    )
    return F.length(rest) == 0


def unquote(text: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(text, r"(?s)^(['\"`])(.*)\1$", "$2")
