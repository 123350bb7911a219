"""The score of a symbol for a query: match, length, context, closeness, flags and depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolgrid.functions.names import ascii_lower, initials, is_subsequence
from symbolgrid.model import CLASS, DEFAULT_EXPORT, ENUM, FUNCTION, INTERFACE, METHOD, MODULE, MODULE_IMPORT, NAMESPACE, RE_EXPORT, STANDARD_LIBRARY, TYPE_ALIAS, TYPE_ONLY, VARIABLE

#: Exact match, prefix, prefix in another case, initials.
MATCH = (1000, 500, 300, 240)
#: Per hint the score of each kind, and of all other kinds.
BY_KIND = {
    "construct": ({FUNCTION: -40, CLASS: 160, INTERFACE: -90, TYPE_ALIAS: -90}, 0),
    "type": ({VARIABLE: -50, FUNCTION: -70, CLASS: 120, INTERFACE: 120, TYPE_ALIAS: 120, ENUM: 120, NAMESPACE: 120}, 0),
    "call": ({FUNCTION: 90, CLASS: 35, INTERFACE: -80, TYPE_ALIAS: -80, METHOD: 90}, 0),
    "module": ({NAMESPACE: 120, MODULE: 120}, -25),
    "annotation": ({VARIABLE: -20, FUNCTION: 70, CLASS: 60, INTERFACE: 60}, 0),
}
#: Per hint a flag that adds to the score.
BY_HINT_FLAG = {"type": (TYPE_ONLY, 45), "module": (MODULE_IMPORT, 80)}
#: What flags add in any context.
BY_FLAG = {RE_EXPORT: -10, DEFAULT_EXPORT: 5, STANDARD_LIBRARY: -25, MODULE_IMPORT: -3}
TYPE_ONLY_AS_VALUE, PER_LEVEL = -100, -2


def has(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def context_score(kind: Column, flags: Column, hint: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, (kinds, other) in BY_KIND.items():
        of = F.lit(other)
        for k, score in kinds.items():
            of = F.when(kind == k, score).otherwise(of)
        if name in BY_HINT_FLAG:
            flag, more = BY_HINT_FLAG[name]
            of = of + F.when(has(flags, flag), more).otherwise(0)
        total = total + F.when(hint[name], of).otherwise(0)
    misused = has(flags, TYPE_ONLY) & ~hint["type"] & (hint["call"] | hint["construct"])
    return total + F.when(misused, TYPE_ONLY_AS_VALUE).otherwise(0)


def match_score(prefix: Column, name: Column, letters: Column | None = None) -> Column:
    exact, cased, folded, by_initials = MATCH
    lc = ascii_lower(prefix)
    return (
        F.when(name == prefix, exact)
        .when(name.startswith(prefix), cased)
        .when(ascii_lower(name).startswith(lc), folded)
        .when(is_subsequence(lc, initials(name) if letters is None else letters), by_initials)
        .otherwise(0)
    )


def score(prefix: Column, name: Column, kind: Column, flags: Column, depth: Column, proximity: Column, hint: dict[str, Column], letters: Column | None = None) -> Column:
    longer = F.greatest(F.octet_length(name) - 2 * F.octet_length(prefix), F.lit(0))
    total = match_score(prefix, name, letters) - longer + context_score(kind, flags, hint) + proximity + PER_LEVEL * depth
    for flag, more in BY_FLAG.items():
        total = total + F.when(has(flags, flag), more).otherwise(0)
    return total.cast("int")
