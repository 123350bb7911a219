"""The registered queries over the reference operators, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import context, names, paths, scoring, text
from symbolgrid.operators import incremental, lookup, reexport, stats
from symbolgrid.plans import projection as p
from symbolgrid.plans import samples
from symbolgrid.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(samples.QUERIES)
SQL: dict[str, str] = dict(samples.SQL)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- SQL building blocks ------------------------------------------------------------------------

#: Initials of a name, for DuckDB (no look-behind there).
INITIALS_SQL = r"""
array_to_string(list_transform(list_filter(range(1, length(name) + 1), lambda i: i = 1
  OR regexp_matches(name[i-1], '^[_\-.$]$')
  OR (regexp_matches(name[i], '^[A-Z]$') AND regexp_matches(name[i-1], '^[a-z0-9]$'))
  OR (regexp_matches(name[i], '^[0-9]$') AND NOT regexp_matches(name[i-1], '^[0-9]$'))), lambda i: lower(name[i])), '')"""


def subsequence_sql(wanted: str, letters: str) -> str:
    """DuckDB: wanted is a subsequence of letters, as a LIKE pattern with free gaps."""
    return f"({letters} LIKE '%' || array_to_string(string_split({wanted}, ''), '%') || '%')"


def context_sql(hint: dict[str, str]) -> str:
    """The table of context scores, written out: kinds 0 to 9 in order."""
    return f"""(
      CASE WHEN {hint["construct"]} THEN [0, -40, 160, -90, -90, 0, 0, 0, 0, 0][kind + 1] ELSE 0 END
      + CASE WHEN {hint["type"]} THEN [-50, -70, 120, 120, 120, 120, 120, 0, 0, 0][kind + 1] + CASE WHEN flags & 2 != 0 THEN 45 ELSE 0 END ELSE 0 END
      + CASE WHEN {hint["call"]} THEN [0, 90, 35, -80, -80, 0, 0, 0, 90, 0][kind + 1] ELSE 0 END
      + CASE WHEN {hint["module"]} THEN [-25, -25, -25, -25, -25, -25, 120, 120, -25, -25][kind + 1] + CASE WHEN flags & 32 != 0 THEN 80 ELSE 0 END ELSE 0 END
      + CASE WHEN {hint["annotation"]} THEN [-20, 70, 60, 60, 0, 0, 0, 0, 0, 0][kind + 1] ELSE 0 END
      + CASE WHEN flags & 2 != 0 AND NOT {hint["type"]} AND ({hint["call"]} OR {hint["construct"]}) THEN -100 ELSE 0 END)"""


FLAGS_SQL = """CASE WHEN flags & 4 != 0 THEN -10 ELSE 0 END + CASE WHEN flags & 1 != 0 THEN 5 ELSE 0 END
  + CASE WHEN flags & 64 != 0 THEN -25 ELSE 0 END + CASE WHEN flags & 32 != 0 THEN -3 ELSE 0 END"""


def parents_sql(path: str) -> str:
    return f"list_filter(string_split(regexp_replace({path}, '[^/]*$', ''), '/'), lambda x: x NOT IN ('', '.', '..'))"


def proximity_sql(a: str, b: str, target: str) -> str:
    same = f"coalesce(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: coalesce({a}[i] = {b}[i], false)), false) - 1, len({a}))"
    steps = f"(len({a}) + len({b}) - 2 * {same})"
    table = f"coalesce([80, 55, 35, 20, 8, 8][{steps} + 1], 0)"
    outside = " OR ".join(f"contains({target}, '/{f}/')" for f in ("node_modules", "site-packages"))
    return f"CAST(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {table} END + CASE WHEN {outside} THEN -25 ELSE 0 END AS INT)"


def score_sql(prefix: str, hint: str, near: str) -> str:
    lc = f"lower({prefix})"
    match = f"""CASE WHEN name = {prefix} THEN 1000 WHEN starts_with(name, {prefix}) THEN 500 WHEN starts_with(lower(name), {lc}) THEN 300
      WHEN {subsequence_sql(lc, INITIALS_SQL)} THEN 240 ELSE 0 END"""
    depth = "(length(path) - length(replace(path, '/', '')))"
    return f"CAST({match} - greatest(strlen(name) - 2 * strlen({prefix}), 0) + {hint} + {near} + {FLAGS_SQL} - 2 * {depth} AS INT)"


GROUP_SQL = "CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'ts' THEN 'web' WHEN 'js' THEN 'web' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' END"
NO_HINTS = dict.fromkeys(context.HINTS, "false")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dictionary(p.exports(spark, sf_dir))


def _one(spark: SparkSession, prefix: str, path: str = "/repo/economy/brand_2/p1.ts", limit: int = 20, imported: tuple[str, ...] = ()) -> DataFrame:
    lang = next((k for k, v in model.EXTENSIONS.items() if path.rpartition(".")[2] in v), None)
    return spark.createDataFrame([(0, prefix, path, lang, limit, list(imported), "", "")], model.QUERIES)


# -- lookup ---------------------------------------------------------------------------------------


@query(f"""WITH {p.EXPORTS_SQL}, s AS (
  SELECT *, dense_rank() OVER (ORDER BY lower(name), name) AS place,
    {score_sql("'Small'", context_sql(NO_HINTS), proximity_sql("['repo','economy','brand_2']", parents_sql("path"), "path"))} AS score
  FROM exports WHERE starts_with(lower(name), 'small') AND {GROUP_SQL} = 'web' AND path != '/repo/economy/brand_2/p1.ts'
), best AS (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY score DESC, kind, flags) AS b FROM s)
SELECT name, kind, flags, path AS target_path, score, position FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, name_lc, name, path, kind, flags) AS INT) AS position FROM (SELECT *, lower(name) AS name_lc FROM best WHERE b = 1)
) WHERE position <= 20""")
def flagship_prefix_topn(spark, sf_dir):
    found = lookup.suggestions(p.exports(spark, sf_dir), _one(spark, "Small"), _words(spark, sf_dir))
    return found.select("name", "kind", "flags", "target_path", "score", "position")


@query(f"WITH {p.EXPORTS_SQL} SELECT name, name_lc FROM words WHERE starts_with(name_lc, 'hot')")
def prefix_range_scan(spark, sf_dir):
    return lookup.prefix_range(_words(spark, sf_dir), "Hot").select("name", "name_lc")


@query(f"""WITH {p.EXPORTS_SQL}, i AS (SELECT name, {INITIALS_SQL} AS initials FROM words)
SELECT name, initials FROM i WHERE {subsequence_sql("'se'", "initials")}""")
def initials_match(spark, sf_dir):
    return _words(spark, sf_dir).filter(names.is_subsequence(F.lit("se"), F.col("initials"))).select("name", "initials")


CANDIDATES_SQL = f"""{p.EXPORTS_SQL}, {p.queries_sql()}, staged AS (
  SELECT q.query_id, w.name, w.name_lc, greatest(10 * q.lim, 200) AS budget, CASE WHEN starts_with(w.name_lc, q.prefix_lc) THEN 0 ELSE 1 END AS stage
  FROM queries q JOIN (SELECT *, {INITIALS_SQL} AS initials FROM words) w ON w.name_lc[1] = q.prefix_lc[1]
    AND (starts_with(w.name_lc, q.prefix_lc) OR (strlen(q.prefix) >= 2 AND {subsequence_sql("q.prefix_lc", "w.initials")}))
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, name_lc, name) AS INT) AS place FROM staged),
cand AS (SELECT query_id, name, stage, place FROM placed WHERE place <= budget)"""


@query(f"WITH {CANDIDATES_SQL} SELECT query_id, name, stage, place FROM cand")
def candidate_budget(spark, sf_dir):
    return lookup.candidates(_words(spark, sf_dir), lookup.prepared(p.queries(spark))).drop("initials")


@query(f"""WITH {CANDIDATES_SQL}
SELECT c.query_id, c.name, c.place FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM supplier s JOIN exports e ON e.sym_id = s.s_suppkey WHERE s.s_suppkey % 20 = c.query_id AND e.name = c.name)""")
def already_imported_anti(spark, sf_dir):
    # What a file has imported: the symbols whose ids are the suppliers of its number.
    ids = p.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym_id"), (F.col("s_suppkey") % 20).alias("query_id"))
    imported = p.exports(spark, sf_dir).join(ids, "sym_id").groupBy("query_id").agg(F.collect_set("name").alias("already_imported"))
    asked = p.queries(spark).drop("already_imported").join(imported, "query_id", "left")
    asked = asked.withColumn("already_imported", F.coalesce("already_imported", F.array().cast("array<string>")))
    asked = lookup.prepared(asked)
    found = lookup.candidates(_words(spark, sf_dir), asked)
    return lookup.without_imported(found, asked).select("query_id", "name", "place")


_HINTS_SQL = r"""
hinted AS (
  SELECT *, regexp_replace(line_prefix, '\s+$', '') AS before, regexp_replace(line_suffix, '^\s+', '') AS after FROM queries
), heads AS (
  SELECT *, lang IN ('typescript', 'javascript') AS script, rtrim(before[:-2]) AS head, lower(rtrim(before[:-2])) AS low FROM hinted
), lasts AS (
  SELECT *, length(head) - strpos(reverse(head), '{') AS b0, length(head) - strpos(reverse(head), '=') AS e0, length(head) - strpos(reverse(head), '[') AS k0, length(head) - strpos(reverse(head), '(') AS p0 FROM heads
), ends AS (
  SELECT *, CASE WHEN contains(head, '{') THEN b0 ELSE -1 END AS b, CASE WHEN contains(head, '=') THEN e0 ELSE -1 END AS e, CASE WHEN contains(head, '[') THEN k0 ELSE -1 END AS k, CASE WHEN contains(head, '(') THEN p0 ELSE -1 END AS p FROM lasts
), hints AS (
  SELECT query_id, prefix, prefix_lc, current_path, lim, lang,
    coalesce((script AND (
        (ends_with(before, ':') AND NOT (b > e AND NOT contains(low, 'type ') AND NOT contains(low, 'interface '))
          AND (ends_with(head, ')') OR contains(low, 'const ') OR contains(low, 'let ') OR contains(low, 'var ') OR contains(low, 'function ') OR contains(low, 'interface ') OR contains(low, 'type ') OR p > b))
        OR regexp_matches(before, '[<|&]$') OR regexp_matches(before, '(^|[^A-Za-z0-9_$])(as|satisfies|extends|implements|type|interface)$')))
      OR (lang = 'python' AND ((ends_with(before, ':') AND NOT (b > e OR k > e)) OR regexp_matches(before, '(->|\[|\|)$') OR regexp_matches(before, '(^|[^A-Za-z0-9_$])(class|except)$')))
      OR (lang = 'java' AND (regexp_matches(before, '[<,]$') OR regexp_matches(before, '(^|[^A-Za-z0-9_$])(extends|implements|throws|catch|instanceof)$'))), false) AS h_type,
    coalesce((script AND regexp_matches(before, '(^|[^A-Za-z0-9_$])(new|instanceof)$')) OR (lang = 'java' AND regexp_matches(before, '(^|[^A-Za-z0-9_$])new$')), false) AS h_construct,
    starts_with(after, '(') AS h_call,
    coalesce(starts_with(after, '.') OR (script AND regexp_matches(before, '(^|[^A-Za-z0-9_$])(import|from)$')), false) AS h_module,
    ends_with(before, '@') AS h_annotation
  FROM ends
)"""
HINTS_SQL = f"{p.queries_sql()}, {_HINTS_SQL}"


@query(f"WITH {HINTS_SQL} SELECT query_id, h_type, h_construct, h_call, h_module, h_annotation FROM hints")
def context_hints(spark, sf_dir):
    hint = context.hints(F.col("language"), F.col("line_prefix"), F.col("line_suffix"))
    return p.queries(spark).select("query_id", hint.alias("h")).select("query_id", *[F.col("h")[h].alias(f"h_{h}") for h in context.HINTS])


_MASKS = ", ".join(f"m & {1 << i} != 0 AS h_{h}" for i, h in enumerate(context.HINTS))


@query(f"""WITH {p.EXPORTS_SQL}, m AS (SELECT m, {_MASKS} FROM (SELECT unnest(range(32)) AS m))
SELECT sym_id, CAST(m AS INT) AS mask, CAST({context_sql({h: f"h_{h}" for h in context.HINTS})} AS INT) AS score FROM exports, m""")
def context_score(spark, sf_dir):
    masks = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask")
    rows = p.exports(spark, sf_dir).select("sym_id", "kind", "flags", masks)
    hint = {h: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i, h in enumerate(context.HINTS)}
    return rows.select("sym_id", "mask", scoring.context_score(F.col("kind"), F.col("flags"), hint).cast("int").alias("score"))


BATCH_SQL = f"""{CANDIDATES_SQL.replace(p.queries_sql(), HINTS_SQL)}, rows_ AS (
  SELECT c.query_id, c.place, h.prefix, h.lim, h.current_path, h_type, h_construct, h_call, h_module, h_annotation, e.*
  FROM cand c JOIN hints h USING (query_id) JOIN exports e ON e.name = c.name
  WHERE e.path != h.current_path AND {GROUP_SQL.replace("path", "e.path")} = CASE WHEN h.lang IN ('typescript', 'javascript') THEN 'web' ELSE h.lang END
), scored AS (SELECT *, {score_sql("prefix", context_sql({h: f"h_{h}" for h in context.HINTS}), proximity_sql("pa", "pb", "path"))} AS score
  FROM (SELECT *, {parents_sql("current_path")} AS pa, {parents_sql("path")} AS pb FROM rows_)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, name, path ORDER BY score DESC, place, kind, flags) AS b FROM scored),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, path, kind, flags) AS INT) AS position FROM best WHERE b = 1)"""


@query(f"WITH {BATCH_SQL} SELECT query_id, position, name, kind, flags, path AS target_path, score FROM ranked WHERE position <= lim")
def batch_prefix_topk(spark, sf_dir):
    found = lookup.suggestions(p.exports(spark, sf_dir), p.queries(spark), _words(spark, sf_dir))
    return found.select("query_id", "position", "name", "kind", "flags", "target_path", "score")


@query(f"WITH {BATCH_SQL} SELECT query_id, name, path, kind, flags, score FROM best WHERE b = 1")
def dedup_keep_best(spark, sf_dir):
    asked, words = lookup.prepared(p.queries(spark)), _words(spark, sf_dir)
    rows = lookup.scored(lookup.candidates(words, asked), asked, p.exports(spark, sf_dir))
    return lookup.best_per_key(rows).select("query_id", "name", "path", "kind", "flags", "score")


@query(f"""WITH {BATCH_SQL} SELECT query_id, lpad(CAST(position - 1 AS VARCHAR), 4, '0') AS sort_key, name,
  ['variable','function','class','interface','type','enum','namespace'][kind + 1] AS detail FROM ranked WHERE position <= lim""")
def presentation_rank(spark, sf_dir):
    found = lookup.suggestions(p.exports(spark, sf_dir), p.queries(spark), _words(spark, sf_dir))
    return found.select("query_id", F.lpad((F.col("position") - 1).cast("string"), 4, "0").alias("sort_key"), "name", text.kind_label(F.col("kind")).alias("detail"))


@query(f"""WITH {BATCH_SQL} SELECT '{{"queryId":' || query_id || ',"position":' || position || ',"name":"' || name || '","kind":' || kind || ',"flags":' || flags
  || ',"targetPath":"' || path || '","score":' || score || '}}' AS value FROM ranked WHERE position <= lim""")
def result_lines(spark, sf_dir):
    return lookup.as_lines(lookup.suggestions(p.exports(spark, sf_dir), p.queries(spark), _words(spark, sf_dir)))


@query(f"""WITH {p.EXPORTS_SQL} SELECT path, {GROUP_SQL} AS lang_group FROM exports WHERE {GROUP_SQL} IN ('web', 'java') GROUP BY ALL""")
def lang_group_filter(spark, sf_dir):
    group = paths.group_of(paths.language_of(F.col("path")))
    return p.exports(spark, sf_dir).select("path", group.alias("lang_group")).filter(F.col("lang_group").isin("web", "java")).distinct()


@query(f"""WITH {p.EXPORTS_SQL}, t AS (SELECT sym_id, CASE sym_id % 3 WHEN 0 THEN '/repo/node_modules' WHEN 1 THEN '/repo/.venv/site-packages' ELSE '' END || path AS path FROM exports)
SELECT sym_id, path FROM t WHERE contains(path, '/node_modules/') OR contains(path, '/site-packages/')""")
def external_path_filter(spark, sf_dir):
    head = F.when(F.col("sym_id") % 3 == 0, "/repo/node_modules").when(F.col("sym_id") % 3 == 1, "/repo/.venv/site-packages").otherwise("")
    rows = p.exports(spark, sf_dir).select("sym_id", F.concat(head, "path").alias("path"))
    return rows.filter(paths.is_external(F.col("path")))


_PAIRS_SQL = f"""{p.EXPORTS_SQL}, pairs AS (
  SELECT a.sym_id AS a, b.sym_id AS b, {parents_sql("a.path")} AS pa, {parents_sql("b.path")} AS pb, b.path AS path
  FROM exports a JOIN exports b ON b.sym_id = a.sym_id + 7)"""


@query(f"WITH {_PAIRS_SQL} SELECT a, b, {proximity_sql('pa', 'pb', 'path')} AS proximity FROM pairs")
def path_proximity(spark, sf_dir):
    e = p.exports(spark, sf_dir)
    left = e.select(F.col("sym_id").alias("a"), F.col("path").alias("path_a"), (F.col("sym_id") + 7).alias("b"))
    right = e.select(F.col("sym_id").alias("b"), F.col("path").alias("path_b"))
    return left.join(right, "b").select("a", "b", paths.proximity(F.col("path_a"), F.col("path_b")).alias("proximity"))


@query(f"WITH {p.EXPORTS_SQL} SELECT sym_id, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth FROM exports")
def path_depth(spark, sf_dir):
    return p.exports(spark, sf_dir).select("sym_id", paths.depth(F.col("path")).cast("int").alias("depth"))


@query(f"WITH {p.EXPORTS_SQL} SELECT w.name, e.path, e.kind, e.flags FROM words w JOIN exports e ON e.name = w.name WHERE starts_with(name_lc, 'r')")
def postings_join(spark, sf_dir):
    words = lookup.prefix_range(_words(spark, sf_dir), "r").select("name")
    return words.join(p.exports(spark, sf_dir), "name").select("name", "path", "kind", "flags")


# -- counts ---------------------------------------------------------------------------------------


@query(f"WITH {p.EXPORTS_SQL} SELECT count(DISTINCT path) AS files, count(DISTINCT path) AS paths, count(*) AS hot_entries, count(DISTINCT name) AS names FROM exports")
def index_stats(spark, sf_dir):
    return stats.index_stats(p.exports(spark, sf_dir))


@query("""SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) AS parsed, CAST(0 AS BIGINT) AS skipped_large,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS parse_failures, count(*) FILTER (o_orderstatus = 'O') AS python_regex_fallbacks FROM orders""")
def indexer_counters(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "fallback").otherwise("failed")
    return stats.indexer_counters(p.table(spark, sf_dir, "orders").select(status.alias("status")))


@query(f"""WITH {p.EXPORTS_SQL} SELECT name, count(*) AS n, array_to_string(list(path || ':' || kind || ':' || flags ORDER BY path, kind, flags), ',') AS postings FROM exports GROUP BY name""")
def posting_groups(spark, sf_dir):
    rows = stats.posting_groups(p.exports(spark, sf_dir))
    flat = F.array_join(F.transform("postings", lambda e: F.concat_ws(":", e["path"], e["kind"], e["flags"])), ",")
    return rows.select("name", F.size("postings").cast("long").alias("n"), flat.alias("postings"))


@query(f"WITH {p.EXPORTS_SQL} SELECT path, count(DISTINCT name) AS names FROM exports GROUP BY path")
def names_by_file(spark, sf_dir):
    return p.exports(spark, sf_dir).groupBy("path").agg(F.countDistinct("name").alias("names"))


# -- re-exports -------------------------------------------------------------------------------------

LINKS_SQL = r"""
hrefs AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS h FROM pages),
links AS (SELECT page_id, unnest(range(len(h))) AS ord, unnest(h) AS href FROM hrefs)"""


@query(f"WITH {LINKS_SQL} SELECT '/repo/pages/' || page_id || '.ts' AS barrel_path, CAST(ord AS INT) AS ord, href AS from_path FROM links")
def reexport_edges(spark, sf_dir):
    barrel = F.concat(F.lit("/repo/pages/"), F.col("page_id").cast("string"), F.lit(".ts"))
    return p.links(spark, sf_dir).select(barrel.alias("barrel_path"), "ord", F.col("href").alias("from_path"))


# A barrel per nation and per region: customers export, nations re-export by star, regions by name.
_OWN_SQL = """own AS (
  SELECT '/c/' || c_nationkey || '.ts' AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS ord,
    'C' || (c_custkey % 40) AS name, CAST(c_custkey % 7 AS INT) AS kind, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS flags FROM customer)"""
_EDGES_SQL = """stars AS (
  SELECT '/n/' || n_nationkey || '.ts' AS barrel, 0 AS ord, '/c/' || n_nationkey || '.ts' AS target FROM nation
  UNION ALL SELECT '/n/' || n_nationkey || '.ts', 1, '/c/' || ((n_nationkey + 1) % 25) || '.ts' FROM nation
  UNION ALL SELECT '/r/' || r_regionkey || '.ts', n_nationkey, '/n/' || n_nationkey || '.ts' FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT '/r/' || r_regionkey || '.ts', 100, '/r/' || ((r_regionkey + 1) % 5) || '.ts' FROM region)"""


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    none = F.lit(None).cast("string")
    return p.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/c/"), F.col("c_nationkey"), F.lit(".ts")).alias("path"), place.alias("ord"), F.concat(F.lit("C"), F.col("c_custkey") % 40).alias("name"),
        (F.col("c_custkey") % 7).cast("int").alias("kind"), F.when(F.col("c_custkey") % 9 == 0, 1).otherwise(0).alias("flags"),
        none.alias("parent_qualifier"), none.alias("source_path"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda folder, c: F.concat(F.lit(f"/{folder}/"), c, F.lit(".ts"))
    nation, region = p.table(spark, sf_dir, "nation"), p.table(spark, sf_dir, "region")
    n = F.col("n_nationkey")
    rows = nation.select(at("n", n).alias("barrel"), F.lit(0).alias("ord"), at("c", n).alias("target"))
    rows = rows.unionByName(nation.select(at("n", n).alias("barrel"), F.lit(1).alias("ord"), at("c", (n + 1) % 25).alias("target")))
    rows = rows.unionByName(region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(at("r", F.col("r_regionkey")).alias("barrel"), n.alias("ord"), at("n", n).alias("target")))
    rows = rows.unionByName(region.select(at("r", F.col("r_regionkey")).alias("barrel"), F.lit(100).alias("ord"), at("r", (F.col("r_regionkey") + 1) % 5).alias("target")))
    return rows.withColumn("names", F.lit(None).cast(model.RE_EXPORT_NAMES))


@query(f"""WITH {_OWN_SQL}, {_EDGES_SQL} SELECT s.barrel AS path, s.ord AS edge, o.ord AS item, o.name, o.kind, o.flags | 4 AS flags, s.target AS source_path
FROM stars s JOIN own o ON o.path = s.target WHERE o.flags & 1 = 0""")
def flatten_all(spark, sf_dir):
    rows = reexport.flatten_all(_edges(spark, sf_dir), _own(spark, sf_dir))
    return rows.select("path", "edge", "item", "name", "kind", "flags", "source_path")


@query(f"""WITH {_OWN_SQL}, named AS (
  SELECT '/n/' || n_nationkey || '.ts' AS barrel, '/c/' || n_nationkey || '.ts' AS target, unnest(['C1', 'C2', 'C39', 'Nope']) AS name, unnest([0, 1, 2, 3]) AS item FROM nation),
last AS (SELECT path, name, arg_max(kind, ord) AS kind, arg_max(flags, ord) AS flags FROM own GROUP BY ALL)
SELECT n.barrel AS path, n.item, CASE WHEN n.item = 1 THEN 'Two' ELSE n.name END AS name, l.kind, l.flags | 4 AS flags FROM named n JOIN last l ON l.path = n.target AND l.name = n.name""")
def flatten_named(spark, sf_dir):
    wanted = F.expr(f"cast(array(struct('C1', null), struct('Two', 'C2'), struct('C39', null), struct('Nope', null)) as {model.RE_EXPORT_NAMES})")
    edges = _edges(spark, sf_dir).filter(F.col("barrel").startswith("/n/") & (F.col("ord") == 0)).withColumn("names", wanted)
    return reexport.flatten_named(edges, _own(spark, sf_dir)).select("path", "item", "name", "kind", "flags")


@query(f"""WITH {_OWN_SQL}, {_EDGES_SQL}, flat AS (
  SELECT s.barrel AS path, s.ord AS edge, o.ord AS item, o.name, o.kind, o.flags | 4 AS flags FROM stars s JOIN own o ON o.path = s.target WHERE o.flags & 1 = 0),
first_ AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY edge, item) AS f FROM flat)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY edge, item) - 1 AS INT) AS ord, name, kind, flags FROM first_ WHERE f = 1
UNION ALL SELECT path, ord, name, kind, flags FROM own""")
def merge_exports_priority(spark, sf_dir):
    own = _own(spark, sf_dir)
    return reexport.merge_priority(own, reexport.flatten_all(_edges(spark, sf_dir), own)).select("path", "ord", "name", "kind", "flags")


@query(f"""WITH RECURSIVE {_OWN_SQL}, {_EDGES_SQL}, reach AS (
  SELECT barrel, target FROM stars UNION SELECT r.barrel, s.target FROM reach r JOIN stars s ON s.barrel = r.target)
SELECT path, name FROM own GROUP BY ALL UNION SELECT r.barrel, o.name FROM reach r JOIN own o ON o.path = r.target WHERE o.flags & 1 = 0""")
def flatten_fixpoint(spark, sf_dir):
    return reexport.flatten_fixpoint(spark, _own(spark, sf_dir), _edges(spark, sf_dir)).select("path", "name").distinct()


@query(f"""WITH RECURSIVE {_EDGES_SQL}, reach AS (SELECT barrel, target FROM stars UNION SELECT r.barrel, s.target FROM reach r JOIN stars s ON s.barrel = r.target)
SELECT barrel, target FROM reach""")
def barrel_closure(spark, sf_dir):
    return reexport.reachable(spark, _edges(spark, sf_dir))


_RESOLVE_SQL = f"""{p.EXPORTS_SQL}, files AS (SELECT DISTINCT path FROM exports),
asked AS (SELECT sym_id, path AS importer, '../' || split_part(path, '/', 4) || '/p' || ((sym_id + 1) % 97) AS spec FROM exports WHERE {p.SCRIPT_SQL}),
tried AS (SELECT sym_id, '/repo/' || split_part(importer, '/', 3) || '/' || split_part(importer, '/', 4) || '/p' || ((sym_id + 1) % 97) AS base FROM asked),
each AS (SELECT sym_id, unnest(range(16)) AS pos, base || unnest(['.ts','.tsx','.d.ts','.mts','.cts','.js','.jsx','.mjs','.cjs','/index.ts','/index.tsx','/index.d.ts','/index.js','/index.jsx','/index.mjs','/index.cjs']) AS path FROM tried)"""


@query(f"WITH {_RESOLVE_SQL} SELECT sym_id, arg_min(path, pos) AS target FROM each JOIN files USING (path) GROUP BY sym_id")
def first_resolving_candidate(spark, sf_dir):
    e = p.exports(spark, sf_dir).filter(p.in_group("web"))
    brand = F.split("path", "/")[3]
    spec = F.concat(F.lit("../"), brand, F.lit("/p"), ((F.col("sym_id") + 1) % 97).cast("string"))
    rows = e.select(F.col("sym_id").alias("row_id"), reexport.script_candidates(spec, F.col("path")).alias("tried"))
    found = reexport.first_existing(rows, "tried", p.exports(spark, sf_dir))
    return found.select(F.col("row_id").alias("sym_id"), "target")


@query(f"""WITH {_EDGES_SQL}, changed AS (SELECT '/c/' || c_nationkey || '.ts' AS path FROM customer WHERE c_custkey % 100 = 0)
SELECT DISTINCT barrel AS path FROM stars WHERE target IN (SELECT path FROM changed)""")
def cascade_one_hop(spark, sf_dir):
    changed = p.table(spark, sf_dir, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("/c/"), F.col("c_nationkey"), F.lit(".ts")).alias("path"))
    return reexport.dependents(changed, _edges(spark, sf_dir))


# -- specifiers -------------------------------------------------------------------------------------


@query(f"WITH {p.EXPORTS_SQL} SELECT sym_id, regexp_replace(path, '\\.(ts|tsx|mts|cts|jsx|mjs|cjs|js)$', '') AS stripped FROM exports")
def strip_ext(spark, sf_dir):
    return p.exports(spark, sf_dir).select("sym_id", paths.strip_extension(F.col("path")).alias("stripped"))


@query(f"""WITH {p.EXPORTS_SQL}, t AS (SELECT a.sym_id, split_part(a.path, '/', 3) AS t1, split_part(a.path, '/', 4) AS b1, split_part(b.path, '/', 3) AS t2, split_part(b.path, '/', 4) AS b2,
  regexp_replace(split_part(b.path, '/', 5), '\\.(ts|js)$', '') AS f FROM exports a JOIN exports b ON b.sym_id = a.sym_id + 4 WHERE a.path LIKE '%.ts' OR a.path LIKE '%.js')
SELECT sym_id, CASE WHEN t1 = t2 AND b1 = b2 THEN './' || f WHEN t1 = t2 THEN '../' || b2 || '/' || f ELSE '../../' || t2 || '/' || b2 || '/' || f END AS specifier FROM t""")
def relative_specifier(spark, sf_dir):
    e = p.exports(spark, sf_dir)
    a = e.filter(p.in_group("web")).select("sym_id", F.col("path").alias("a"))
    b = e.select((F.col("sym_id") - 4).alias("sym_id"), F.col("path").alias("b"))
    return a.join(b, "sym_id").select("sym_id", paths.relative_specifier(F.col("a"), F.col("b")).alias("specifier"))


@query(f"""WITH {p.EXPORTS_SQL} SELECT sym_id, concat_ws('.', nullif(CASE WHEN sym_id % 3 = 0 THEN '' ELSE 'com.' || split_part(path, '/', 3) END, ''),
  CASE WHEN sym_id % 2 = 0 THEN 'Outer' END, name) AS fqcn FROM exports""")
def java_fqcn(spark, sf_dir):
    package = F.when(F.col("sym_id") % 3 == 0, "").otherwise(F.concat(F.lit("com."), F.split("path", "/")[2]))
    parent = F.when(F.col("sym_id") % 2 == 0, "Outer")
    return p.exports(spark, sf_dir).select("sym_id", text.java_name(package, parent, F.col("name")).alias("fqcn"))


@query("""SELECT p_partkey, '$stdlib/python/' || regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') || '.py' AS path FROM part""")
def synthetic_path(spark, sf_dir):
    return p.table(spark, sf_dir, "part").select("p_partkey", paths.synthetic_path(F.lit("python"), F.col("p_name"), F.lit("py")).alias("path"))


@query(f"""WITH {p.EXPORTS_SQL}, f AS (SELECT sym_id, CASE WHEN sym_id % 8 = 2 THEN '/v/lib/site-packages' || path ELSE path END AS path FROM exports WHERE path LIKE '%.py')
SELECT sym_id, replace(regexp_replace(CASE WHEN sym_id % 8 = 2 THEN path[length('/v/lib/site-packages/') + 1:] ELSE path[length('/repo/') + 1:] END, '\\.py$', ''), '/', '.') AS module FROM f""")
def module_of_path(spark, sf_dir):
    path = F.when(F.col("sym_id") % 8 == 2, F.concat(F.lit("/v/lib/site-packages"), F.col("path"))).otherwise(F.col("path"))
    rows = p.exports(spark, sf_dir).filter(p.in_group("python"))
    return rows.select("sym_id", paths.python_module(path, F.lit("/repo")).alias("module"))


_ALIASES = [("@/*", "/repo/"), ("@eco/*", "/repo/economy/"), ("@one/*", "/repo/economy/brand_1/"), ("@p/*", "/repo/promo/")]


@query(f"""WITH {p.EXPORTS_SQL}, alias(pattern, folder) AS (VALUES {", ".join(map(str, _ALIASES))})
SELECT sym_id, arg_max(replace(pattern, '*', regexp_replace(path[length(folder) + 1:], '\\.(ts|js)$', '')), length(pattern)) AS specifier
FROM exports JOIN alias ON starts_with(path, folder) WHERE {p.SCRIPT_SQL} GROUP BY sym_id""")
def alias_best_match(spark, sf_dir):
    from symbolgrid.operators import specifiers

    rules = spark.createDataFrame([(i, a, f"{f}*") for i, (a, f) in enumerate(_ALIASES)], "ord int, pattern string, target string")
    rows = p.exports(spark, sf_dir).filter(p.in_group("web")).select(F.col("sym_id").alias("row_id"), F.col("path").alias("target_path"))
    return specifiers.best_alias(rows, rules).select(F.col("row_id").alias("sym_id"), F.col("alias").alias("specifier"))


@query(f"""WITH {p.EXPORTS_SQL}, cfg(config) AS (VALUES ('/repo/tsconfig.json'), ('/repo/economy/tsconfig.json'), ('/repo/economy/brand_1/tsconfig.json'), ('/else/tsconfig.json'))
SELECT sym_id, arg_max(config, length(config)) AS config FROM exports JOIN cfg ON starts_with(path, config[:length(config) - length('tsconfig.json')]) GROUP BY sym_id""")
def nearest_ancestor(spark, sf_dir):
    from symbolgrid.operators import specifiers

    folders = ["/repo", "/repo/economy", "/repo/economy/brand_1", "/else"]
    configs = spark.createDataFrame([(f"{f}/tsconfig.json",) for f in folders], "config string")
    rows = p.exports(spark, sf_dir).select(F.col("sym_id").alias("row_id"), "path")
    return specifiers.nearest_config(rows, configs).select(F.col("row_id").alias("sym_id"), "config")


# -- catalogue and increments -----------------------------------------------------------------------


@query(f"""WITH line AS (SELECT trim(unnest(string_split(trim('{catalog.NODE}', chr(10)), chr(10)))) AS line),
part AS (SELECT split_part(line, ' ', 1) AS qualifier, split_part(line, ' ', 2) AS whole, string_split(line, '|') AS part FROM line)
SELECT qualifier, name, kind, 64 AS flags FROM (
  SELECT qualifier, 2 AS kind, unnest(string_split(trim(part[2]), ' ')) AS name FROM part UNION ALL
  SELECT qualifier, 1, unnest(string_split(trim(part[3]), ' ')) FROM part UNION ALL
  SELECT qualifier, 0, unnest(string_split(trim(part[4]), ' ')) FROM part) WHERE name != ''
UNION ALL SELECT DISTINCT qualifier, whole, 7, 96 FROM part WHERE whole != '-'""")
def stdlib_catalog(spark, sf_dir):
    rows = catalog.symbols(spark, catalog.node_modules())
    return rows.select(F.col("file_qualifier").alias("qualifier"), "name", "kind", "flags")


@query("SELECT * FROM (VALUES ('java', 30, 0), ('node', 35, 27), ('python', 48, 39)) AS t(language_key, modules, imports)")
def stdlib_counts(spark, sf_dir):
    """Modules of every language's catalogue, and those of them that are imported as a whole."""
    rows = catalog.symbols(spark, catalog.rows(spark)).withColumn("language_key", F.split("path", "/")[1])
    whole = F.when(F.col("flags").bitwiseAND(F.lit(model.MODULE_IMPORT)) != 0, F.col("file_qualifier"))
    return rows.groupBy("language_key").agg(F.count_distinct("file_qualifier").alias("modules"), F.count_distinct(whole).alias("imports"))


@query("""WITH v AS (SELECT user_id, event_id, sha256(props) AS hash, lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, event_id FROM v WHERE was IS NULL OR was != hash""")
def noop_suppression(spark, sf_dir):
    events = p.table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    versions = events.select("user_id", "event_id", text.content_hash(F.col("props")).alias("content_hash"), F.row_number().over(order).alias("version"))
    stored = versions.select("user_id", (F.col("version") + 1).alias("version"), "content_hash")
    return incremental.changed(versions, stored, "user_id", "version", "content_hash").select("user_id", "event_id")


@query(f"""WITH {p.EDITS_SQL}, nx AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, seq) AS nx FROM edits)
SELECT path, seq, op, source FROM nx WHERE nx IS NULL OR nx > ts + INTERVAL 1 HOUR""")
def debounce_last(spark, sf_dir):
    return incremental.debounced(p.edits(spark, sf_dir), "1 hour").select("path", "seq", "op", "source")


@query(f"""WITH {p.EDITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS r FROM edits)
SELECT path, seq, source FROM r WHERE r = 1 AND op != 'delete'""")
def upsert_delete_latest(spark, sf_dir):
    """The first half of the time as one batch into an empty store, the rest as another upon it."""
    edits = p.edits(spark, sf_dir)
    middle = edits.agg(F.expr("timestamp_micros(cast((unix_micros(min(cast(ts as timestamp))) + unix_micros(max(cast(ts as timestamp)))) / 2 as bigint))").alias("middle"))
    edits = edits.join(F.broadcast(middle))  # one row
    store = edits.limit(0).select("path", "seq", "source")
    for batch in (edits.filter("ts <= middle"), edits.filter("ts > middle")):
        last = incremental.latest(batch, "path", "ts", "seq")
        store = incremental.upsert(store, last.filter("op = 'upsert'").select("path", "seq", "source"), last.filter("op = 'delete'").select("path"))
    return store


@query(f"""WITH {p.EXPORTS_SQL}, f AS (SELECT path, max(sym_id) AS mtime FROM exports GROUP BY path)
SELECT path, mtime FROM f WHERE mtime % 5 = 0""")
def mtime_skip(spark, sf_dir):
    """Files whose time of change is another than the store's are all that a warm start opens."""
    listing = p.exports(spark, sf_dir).groupBy("path").agg(F.max("sym_id").alias("mtime"))
    stored = listing.select("path", F.when(F.col("mtime") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return incremental.unread(listing, stored)


# Every nation's barrel re-exports the next one's and its own customers: a chain of 25.
_CHAIN_SQL = """chain AS (
  SELECT '/n/' || n_nationkey || '.ts' AS barrel, 0 AS ord, '/c/' || n_nationkey || '.ts' AS target FROM nation
  UNION ALL SELECT '/n/' || n_nationkey || '.ts', 1, '/n/' || (n_nationkey + 1) || '.ts' FROM nation WHERE n_nationkey < 24),
reach AS (SELECT barrel, target FROM chain UNION SELECT r.barrel, s.target FROM reach r JOIN chain s ON s.barrel = r.target)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda folder, c: F.concat(F.lit(f"/{folder}/"), c, F.lit(".ts"))
    nation, n = p.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    rows = nation.select(at("n", n).alias("barrel"), F.lit(0).alias("ord"), at("c", n).alias("target"))
    rows = rows.unionByName(nation.filter("n_nationkey < 24").select(at("n", n).alias("barrel"), F.lit(1).alias("ord"), at("n", n + 1).alias("target")))
    return rows.withColumn("names", F.lit(None).cast(model.RE_EXPORT_NAMES))


@query(f"""WITH RECURSIVE {_OWN_SQL}, {_CHAIN_SQL}
SELECT path, name FROM own GROUP BY ALL UNION SELECT r.barrel, o.name FROM reach r JOIN own o ON o.path = r.target WHERE o.flags & 1 = 0""")
def flatten_deep_chain(spark, sf_dir):
    return reexport.flatten_fixpoint(spark, _own(spark, sf_dir), _chain(spark, sf_dir)).select("path", "name").distinct()


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT barrel, target FROM reach")
def deep_chain_closure(spark, sf_dir):
    return reexport.reachable(spark, _chain(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, changed AS (SELECT '/c/' || c_nationkey || '.ts' AS path FROM customer WHERE c_custkey % 50 = 0)
SELECT path FROM changed UNION SELECT barrel FROM reach WHERE target IN (SELECT path FROM changed)""")
def cascade_closure(spark, sf_dir):
    changed = p.table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(F.concat(F.lit("/c/"), F.col("c_nationkey"), F.lit(".ts")).alias("path"))
    return reexport.dependents_of(spark, changed, _chain(spark, sf_dir))


@query(f"""WITH {p.EXPORTS_SQL}, cfg(config, pattern, folder) AS (VALUES ('/repo/tsconfig.json', '@/*', '/repo/'), ('/repo/tsconfig.json', '@eco/*', '/repo/economy/'), ('/repo/promo/tsconfig.json', '~/*', '/repo/promo/')),
near AS (SELECT sym_id, path, CASE WHEN starts_with(path, '/repo/promo/') THEN '/repo/promo/tsconfig.json' ELSE '/repo/tsconfig.json' END AS config, '/repo/' || ['economy', 'promo', 'small'][CAST(sym_id % 3 AS INT) + 1] || '/x/y.ts' AS target FROM exports)
SELECT sym_id, arg_max(replace(pattern, '*', replace(target[length(folder) + 1:], '.ts', '')), length(pattern)) AS specifier
FROM near JOIN cfg ON cfg.config = near.config AND starts_with(target, folder) GROUP BY sym_id""")
def specifier_preference(spark, sf_dir):
    """Aliases of the project file nearest above the file that asks."""
    from symbolgrid.operators import specifiers

    rules = [("/repo/tsconfig.json", 0, "@/*", "/repo/*"), ("/repo/tsconfig.json", 1, "@eco/*", "/repo/economy/*"), ("/repo/promo/tsconfig.json", 0, "~/*", "/repo/promo/*")]
    e = p.exports(spark, sf_dir)
    asked = e.select(F.col("sym_id").alias("query_id"), F.col("path").alias("current_path"))
    folder = F.element_at(F.array(F.lit("economy"), F.lit("promo"), F.lit("small")), (F.col("sym_id") % 3 + 1).cast("int"))
    found = e.select(F.col("sym_id").alias("query_id"), F.lit(1).alias("position"), F.concat(F.lit("/repo/"), folder, F.lit("/x/y.ts")).alias("target_path"))
    aliases = specifiers.aliases_of(found, asked, spark.createDataFrame(rules, model.ALIASES))
    return aliases.select(F.col("row_id.query_id").alias("sym_id"), F.col("alias").alias("specifier"))
