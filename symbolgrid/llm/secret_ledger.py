r"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A *path* is a row of the corpus, a *blob* its content, addressed by SHA-256. The ledger holds one
row for each (blob, rule, rule version) that was ever scanned, with the spans found. A run scans
only blobs that lack a row for a rule at its present version, appends what it found, and joins the
ledger back to every path, historical versions and exact copies included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgrid.llm.native import let, running_max, running_sum


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and non-overlapping. Where ``head`` is given, a match
    counts only if at least ``min_value`` characters remain of it behind ``head``."""

    kind: str
    version: int
    pattern: str
    head: str | None = None
    min_value: int = 0


ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Fixed by the contract of the scan: kinds in their listed order. A run of ``access`` or ``hex``
#: characters is one match of the greedy pattern, so its minimum length can stand in the pattern;
#: a short value of ``assign`` still consumes its text, so its length is tested afterwards.
BASE_RULES = (
    Rule("assign", 1, ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Kinds that the ledger scans besides.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghtoken", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + EXTRA_RULES
SPAN = "struct<start:int,stop:int,kind:string>"
FINDINGS = f"array<{SPAN}>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """array of struct(start, stop, kind): code-point offsets, stop exclusive."""

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(found, gaps, lambda hit, gap: F.length(hit) + F.length(gap))
        ends = running_sum(steps)

        def span(hit: Column, end: Column) -> Column:
            value = F.length(F.regexp_replace(hit, "^" + rule.head, "")) if rule.head else F.length(hit)
            return F.struct((end - F.length(hit)).alias("start"), end.alias("stop"), F.lit(rule.kind).alias("kind"), (value >= rule.min_value).alias("counts"))

        kept = F.filter(F.zip_with(found, ends, span), lambda s: s["counts"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))

    none = F.expr(f"cast(array() as {FINDINGS})")
    return F.when(text.rlike(rule.pattern), let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), located)).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule, version, spans) of blobs(blob, text, todo: the kinds to scan)."""
    spans = [
        F.struct(
            F.lit(r.kind).alias("rule"),
            F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", r.kind), rule_spans(F.col("text"), r)).alias("spans"),
        )
        for r in rules
    ]
    rows = blobs.select("blob", F.explode(F.array(*spans)).alias("row")).select("blob", "row.*")
    return rows.filter(F.col("spans").isNotNull())


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the unseen (blob, rule version) pairs of docs(doc_id, text).

    Each unseen blob is scanned at one path only, the smallest doc_id that holds it. A null text
    is the empty blob; rows with a null doc_id are paths like any other. An empty table gives no
    rows. Extra columns of ``docs`` are ignored.
    """
    paths = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("path"))
    paths = paths.select("text", "path", blob_id(F.col("text")).alias("blob"))
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    kinds = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    if ledger is None:
        todo = first.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = first.select("blob", "path", F.explode(F.array(*kinds)).alias("k")).select("blob", "path", "k.*")
        unseen = pairs.join(ledger.select("blob", "rule", "version").distinct(), ["blob", "rule", "version"], "left_anti")
        todo = unseen.groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("rule").alias("todo"))
    todo = todo.withColumnsRenamed({"blob": "todo_blob", "path": "todo_path"})
    same = (F.col("blob") == F.col("todo_blob")) & F.col("path").eqNullSafe(F.col("todo_path"))
    blobs = paths.join(todo, same).select("blob", "text", "todo")
    return scan_blobs(blobs, rules).dropDuplicates(["blob", "rule"])


def findings_of_blobs(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of blobs with findings at the present rule versions, sorted by start, then by
    the order of the rules."""
    now = F.lit(False)
    rank = F.lit(len(rules))
    for i, r in reversed(list(enumerate(rules))):
        now = now | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
        rank = F.when(F.col("rule") == r.kind, F.lit(i)).otherwise(rank)
    present = ledger.filter(now & (F.size("spans") > 0))
    ranked = present.select("blob", F.expr("inline(spans)"), rank.alias("rank"))
    by_blob = ranked.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("found"))
    return by_blob.select("blob", F.expr("transform(found, s -> struct(s.start as start, s.stop as stop, s.kind as kind))").alias("spans"))


def findings_of_paths(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans): every path with the spans of its blob, empty where nothing was found."""
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    found = paths.join(findings_of_blobs(ledger, rules), "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {FINDINGS})")).alias("spans"))


def redact_paths(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the found spans masked in ``text`` and ``n_chars``, where there is one, brought
    up to date; all other columns and texts without findings stay as they are."""
    found = findings_of_blobs(ledger, rules).withColumnsRenamed({"blob": "found_blob", "spans": "found_spans"})
    joined = docs.join(found, blob_id(docs["text"]) == F.col("found_blob"), "left")
    hit = F.col("found_spans").isNotNull()
    text = F.when(hit, redact(docs["text"], F.col("found_spans"))).otherwise(docs["text"])
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(text)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(*[new.get(c, docs[c]) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with the union of its spans replaced by ``mask``."""

    def masked(found: Column) -> Column:
        # The end of what the spans before cover, then each span's part of the output.
        reach = running_max(F.transform(found, lambda s: s["stop"]))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(found) - 1))

        def part(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(F.substr(text, at + 1, s["start"] - at), F.lit(mask))).otherwise("")

        rest = F.substr(text, F.element_at(reach, -1) + 1)
        return F.concat(F.array_join(F.zip_with(found, before, part), ""), rest)

    return F.when(F.size(spans) > 0, let(spans, masked)).otherwise(text)
