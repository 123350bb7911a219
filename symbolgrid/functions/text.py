"""Small text functions over symbols and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the kinds, in order of their codes.
KIND_LABELS = ("variable", "function", "class", "interface", "type", "enum", "namespace", "module", "method", "property")
_JAVA_IMPORT = r"(?m)^[\t ]*import\s+(?:static\s+)?([^;]+);"


def content_hash(content: Column) -> Column:
    """Sixteen bytes of SHA-256 in hex; only ever compared for equality."""
    return F.substring(F.sha2(content, 256), 1, 32)


def kind_label(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in KIND_LABELS]), kind + 1)


def java_name(package: Column, parent: Column, name: Column) -> Column:
    filled = [F.nullif(c, F.lit("")) for c in (package, parent, name)]
    return F.concat_ws(".", *filled)


def java_imported_names(source: Column) -> Column:
    """Simple names that a Java source imports; wildcards bring none."""
    names = F.transform(F.regexp_extract_all(source, F.lit(_JAVA_IMPORT), F.lit(1)), lambda x: F.substring_index(F.trim(x), ".", -1))
    return F.filter(names, lambda x: x != "*")


def strip_comment(line: Column) -> Column:
    """A Python line up to its first ``#`` outside quotes; a backslash guards the next character."""
    return F.regexp_extract(line, r"""(?s)^((?:[^#'"\\]|\\.|\\$|'(?:[^'\\]|\\.)*(?:'|\\?$)|"(?:[^"\\]|\\.)*(?:"|\\?$))*)""", 1)
