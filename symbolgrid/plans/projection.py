"""Symbols, edges, edits and queries derived from the driver's tables, which hold no source code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per part: a camel-case name, a path in four languages, kind and flags."""
    words = F.split("p_name", " ")
    name = F.concat(F.initcap(words[0]), F.initcap(words[1]), F.initcap(F.lower("p_type")))
    flag = lambda n, f: F.when(F.col("p_partkey") % n == 0, f).otherwise(0)
    ext = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".js", ".py", ".java")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(
        F.lit("/repo/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")),
        F.lit("/p"), (F.col("p_partkey") % 97).cast("string"), ext,
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sym_id"), name.alias("name"), path.alias("path"), (F.col("p_size") % 7).alias("kind"),
        (flag(11, 1) + flag(5, 2) + flag(7, 4)).alias("flags"),
        F.lit(None).cast("string").alias("file_qualifier"), F.lit(None).cast("string").alias("parent_qualifier"),
    )


EXPORTS_SQL = """
exports AS (
  SELECT p_partkey AS sym_id,
    upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:])
      || upper(p_type[1]) || lower(p_type[2:]) AS name,
    '/repo/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '/p' || CAST(p_partkey % 97 AS VARCHAR)
      || ['.ts', '.js', '.py', '.java'][CAST(p_partkey % 4 AS INT) + 1] AS path,
    p_size % 7 AS kind,
    CAST((CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END) + (CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 0 END) AS INT) AS flags
  FROM part
), words AS (SELECT DISTINCT name, lower(name) AS name_lc FROM exports)"""


#: Symbols of script files, by the extension of their path.
SCRIPT_SQL = "(path LIKE '%.ts' OR path LIKE '%.js')"


def in_group(group: str) -> Column:
    """Whether a path is of a language of the group."""
    return paths.group_of(paths.language_of(F.col("path"))) == group


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, href): the anchors of every page, in order."""
    found = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "href"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as file edits: one file per user, an error deletes it."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/repo/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("source")
    )


EDITS_SQL = """
edits AS (
  SELECT '/repo/u' || CAST(user_id AS VARCHAR) || '.ts' AS path, ts, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, props AS source FROM events
)"""

#: Queries of a batch: prefix, file, text before and after the cursor.
BATCH = [
    ("Small", "/repo/economy/brand_2/p1.ts", "", ""), ("sm", "/repo/small/brand_4/p2.py", "def f(a: ", "):"), ("SRE", "/repo/promo/brand_1/p3.js", "x = new ", "("),
    ("h", "/repo/large/brand_9/p4.java", "class A extends ", " {"), ("HotG", "/repo/medium/brand_3/p5.ts", "import ", ""), ("bb", "/repo/standard/brand_7/p6.ts", "const a: ", " = 1"),
    ("red", "/repo/economy/brand_17/p7.py", "@", ""), ("RWE", "/repo/economy/brand_17/p7.py", "", ".x"), ("blueboltsmall", "/repo/small/brand_4/p2.py", "", "("), ("z", "/repo/a.ts", "", ""),
    ("GreenG", "/other/lib/p9.js", "a as ", ""), ("C", "/repo/promo/brand_2/p8.java", "throws ", ";"), ("r", "/repo/economy/brand_5/p9.ts", "let v: ", ""), ("ws", "/repo/x/y/p1.js", "", ""),
    ("Wi", "/repo/economy/brand_2/p1.py", "except ", ":"), ("b", "/repo/economy/brand_2/p1.py", "x[", "]"), ("SmallRingEconomy", "/repo/economy/brand_2/p0.ts", "", ""),
    ("o", "/repo/economy/brand_2/p1.java", "new ", "("), ("HGL", "/repo/large/brand_2/p1.ts", "foo<", ">"), ("gr", "/repo/medium/brand_2/p1.js", "", "(a)"),
]


def queries(spark: SparkSession, limit: int = 20) -> DataFrame:
    rows = [(i, p, path, limit, before, after) for i, (p, path, before, after) in enumerate(BATCH)]
    asked = spark.createDataFrame(rows, "query_id long, prefix string, current_path string, `limit` int, line_prefix string, line_suffix string")
    lang = paths.language_of(F.col("current_path"))
    return asked.withColumns({"language": lang, "already_imported": F.array().cast("array<string>")}).select(*[c.split(" ")[0].strip("`") for c in model.QUERIES.split(", ")])


def queries_sql(limit: int = 20) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {lit(p)}, {lit(path)}, {lit(b)}, {lit(a)})" for i, (p, path, b, a) in enumerate(BATCH))
    return f"""
queries AS (
  SELECT CAST(query_id AS BIGINT) AS query_id, prefix, lower(prefix) AS prefix_lc, current_path, line_prefix, line_suffix, {limit} AS lim,
    CASE regexp_extract(current_path, '\\.([^./]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' END AS lang
  FROM (VALUES {rows}) AS v(query_id, prefix, current_path, line_prefix, line_suffix)
)"""
