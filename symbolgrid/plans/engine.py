"""The engine: build a store from source trees, keep it current, ask it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import paths
from symbolgrid.model import STANDARD_LIBRARY, Settings
from symbolgrid.operators import edits, extract, incremental, lookup, reexport, specifiers, stats
from symbolgrid.sources import catalog, npm, tree
from symbolgrid.sources.scratch import Scratch
from symbolgrid.sources.store import Store, VersionMismatch


class Engine:
    """``open`` loads the last snapshot or starts empty; ``build`` scans everything, ``refresh`` only
    workspace files whose time of change is another; ``apply`` (``upsert``, ``remove``) takes
    changed files and resolves anew what depends on them; ``query`` answers any number of queries
    in one job; ``close`` drops old versions. State is one set of immutable tables; those that a
    change does not touch are shared by both versions."""

    def __init__(self, spark: SparkSession, settings: Settings, folder: str):
        self.spark, self.settings, self.store = spark, settings, Store(spark, folder)
        self.tables: dict[str, DataFrame] | None = None

    @classmethod
    def open(cls, spark: SparkSession, settings: Settings, folder: str) -> Engine:
        engine = cls(spark, settings, folder)
        try:
            engine.tables = engine.store.load(settings)
        except VersionMismatch:
            engine.tables = None
        return engine

    # -- building -----------------------------------------------------------------------------------

    def workspace_files(self) -> DataFrame:
        return tree.decoded(tree.read_tree(self.spark, self.settings.root, self.settings))

    def _manifests(self) -> tuple[DataFrame, DataFrame]:
        """Listing of node_modules, and its manifests as (path, source)."""
        root = self.settings.root.rstrip("/")
        listing = tree.list_tree(self.spark, f"{root}/node_modules", names=("package.json",))
        found = tree.with_content(listing.filter(F.col("path").endswith("/package.json")), root)
        return listing, found.select("path", F.col("content").cast("string").alias("source"))

    def script_package_files(self) -> DataFrame:
        """Entry files of script packages, under the name of the dependency."""
        root = self.settings.root.rstrip("/")
        own = tree.with_content(tree.list_tree(self.spark, root, ("*/**",), ("package.json",)), root)
        listing, manifests = self._manifests()
        own = own.filter(F.col("path").endswith("/package.json")).select("path", F.col("content").cast("string").alias("source"))
        entries = npm.package_entries(manifests, npm.dependency_names(own), listing, root)
        files = listing.join(entries, "path").dropDuplicates(["path"]).withColumn("lang", paths.language_of(F.col("path")))
        rows = tree.decoded(tree.with_content(files.drop("dep"), root)).drop("file_qualifier").join(entries.withColumnRenamed("dep", "file_qualifier"), "path")
        return rows.select("path", "lang", "content_hash", "mtime", "source", "file_qualifier").dropDuplicates(["path"])

    def library_files(self) -> DataFrame | None:
        """Entry files of script packages and files of installed Python packages."""
        s, found = self.settings, []
        if s.script_packages:
            found.append(self.script_package_files())
        for base in tree.package_roots(s.root.rstrip("/"), s.extra_paths) if s.python_packages else []:
            files = tree.decoded(tree.read_tree(self.spark, base, Settings(base, exclude=())))
            found.append(tree.package_files(files, base, s.package_depth))
        return reduce(DataFrame.unionByName, found) if found else None

    def package_names(self) -> DataFrame:
        if not self.settings.script_packages:
            return self.spark.createDataFrame([], model.PACKAGES)
        return npm.package_names(self._manifests()[1])

    def path_aliases(self) -> DataFrame:
        """Rules of the workspace's project files, with the files that they extend."""
        root = self.settings.root.rstrip("/")
        listed = tree.list_tree(self.spark, root, self.settings.exclude, npm.PROJECT_FILES)
        found = listed.filter(F.element_at(F.split("path", "/"), -1).isin(*npm.PROJECT_FILES))
        read = lambda df: [(r.path, bytes(r.content).decode(errors="replace")) for r in tree.with_content(df, root).filter("content is not null").collect()]
        configs, tried = read(found), set()
        while wanted := npm.parents(configs) - tried:  # project files are few
            tried |= wanted
            configs += read(self.spark.createDataFrame([(w, 0, 0) for w in sorted(wanted)], "path string, mtime long, length long"))
        own = {path for path, _ in configs if path.rpartition("/")[2] in npm.PROJECT_FILES}
        return self.spark.createDataFrame([r for r in npm.path_aliases(configs) if r[0] in own], model.ALIASES)

    @cached_property
    def _catalogue(self) -> list[tuple]:
        return catalog.rows(self.spark)

    def standard_symbols(self) -> DataFrame | None:
        found = []
        if self.settings.standard_library:
            found.append(catalog.symbols(self.spark, self._catalogue))
        if self.settings.runtime_library:
            for base in tree.library_roots():
                files = tree.library_files(tree.decoded(tree.read_tree(self.spark, base, Settings(base, languages=("python",), exclude=()))), base)
                own = extract.exports_of(extract.extract_files(files, self.settings))
                found.append(own.select("path", "name", "kind", F.col("flags").bitwiseOR(F.lit(STANDARD_LIBRARY)).alias("flags"), "file_qualifier", "parent_qualifier"))
                found.append(tree.library_modules(files))
        return reduce(DataFrame.unionByName, found) if found else None

    def build(self, progress: Callable[[str, int], None] | None = None) -> dict:
        """Scan the workspace and its libraries from scratch, save, and return the counts.
        ``progress`` hears of every step that is done, with the rows of its table."""
        tell = progress or (lambda step, rows: None)
        files = self.workspace_files()
        files = tree.with_python_modules(files, files, self.settings.root)
        libraries = self.library_files()
        if libraries is not None:
            files = files.unionByName(libraries.join(files.select("path"), "path", "left_anti").dropDuplicates(["path"]))
        scratch = Scratch(self.spark, "build")
        extracted = scratch.put("extracted", extract.extract_files(files, self.settings))
        tell("files", extracted.count())
        found, own, re_exports = extract.files_of(extracted), extract.exports_of(extracted), extract.re_exports_of(extracted)
        edges = scratch.put("edges", reexport.barrel_edges(re_exports, found))
        tell("edges", edges.count())
        symbols = scratch.put("symbols", self._qualified(reexport.flatten_fixpoint(self.spark, own, edges), found))
        tell("symbols", symbols.count())
        standard = self.standard_symbols()
        columns = ["path", "name", "kind", "flags", "file_qualifier", "parent_qualifier"]
        standard = scratch.put("standard", self._as_exports(standard.select(*columns) if standard is not None else symbols.limit(0).select(*columns)))
        tell("standard", standard.count())
        tables = {"files": found, "own": own, "re_exports": re_exports, "edges": edges, "symbols": symbols, "standard": standard}
        self._replace(tables | {"packages": self.package_names(), "aliases": self.path_aliases()})
        scratch.drop("")
        return self.stats()

    @staticmethod
    def _qualified(symbols: DataFrame, files: DataFrame) -> DataFrame:
        return symbols.drop("file_qualifier").join(files.select("path", "file_qualifier"), "path", "left")

    @staticmethod
    def _as_exports(rows: DataFrame) -> DataFrame:
        none = F.lit(None)
        return rows.withColumns({"ord": F.lit(0), "source_path": none.cast("string"), "line": F.lit(0), "col": F.lit(0)})

    def _replace(self, tables: dict[str, DataFrame]) -> None:
        have = (self.tables or {}) | tables
        words = lookup.dictionary(have["symbols"].unionByName(have["standard"].select(*have["symbols"].columns)))
        self.store.save(tables | {"words": words}, self.settings)
        self.tables = self.store.load(self.settings)

    # -- changes ------------------------------------------------------------------------------------

    def refresh(self) -> int:
        """Bring the workspace up to date after a restart: files whose time of change the store knows
        are not opened, files that are gone leave. Returns how many had other content."""
        s, have = self.settings, self._require()
        listing = tree.list_tree(self.spark, s.root, s.exclude).withColumn("lang", paths.language_of(F.col("path")))
        listing = listing.filter(F.col("lang").isin(*s.languages) & (F.col("length") <= model.MAX_FILE_BYTES))
        fresh = tree.decoded(tree.with_content(incremental.unread(listing, have["files"]), s.root).filter("content is not null"))
        mine = have["files"].filter(F.col("path").startswith(s.root.rstrip("/") + "/") & ~paths.is_external(F.col("path"))).select("path")
        return self.apply(tree.with_python_modules(fresh, listing, s.root), mine.join(listing.select("path"), "path", "left_anti"))

    def upsert(self, files: DataFrame) -> int:
        """Take changed files(path, lang, content_hash, mtime, source, file_qualifier); those whose
        content the store has already are no work. Returns how many were."""
        return self.apply(files, files.select("path").limit(0))

    def remove(self, gone: DataFrame) -> None:
        """Take the files gone(path) out of the store."""
        self.apply(self.spark.createDataFrame([], tree.SOURCE), gone)

    def apply(self, files: DataFrame, gone: DataFrame) -> int:
        """Upserts and deletes as one new version; a path in both is upserted. Only the changed
        files, re-exports that may mean one of them, and the barrels above are resolved anew."""
        have, scratch = self._require(), Scratch(self.spark, "apply")
        fresh = incremental.changed(files, have["files"], "path", "content_hash")
        extracted = scratch.put("extracted", extract.extract_files(fresh, self.settings))
        gone = gone.select("path").join(files.select("path"), "path", "left_anti").join(have["files"].select("path"), "path", "left_semi")
        touched = scratch.put("touched", extracted.select("path", F.lit(True).alias("here")).unionByName(gone.distinct().withColumn("here", F.lit(False))))
        count = touched.filter("here").count()
        if touched.isEmpty():
            return 0
        out = {n: incremental.upsert(have[n], rows, touched) for n, rows in (("files", extract.files_of(extracted)), ("own", extract.exports_of(extracted)), ("re_exports", extract.re_exports_of(extracted)))}
        out = {n: scratch.put(n, df) for n, df in out.items()}
        # Re-exports that are new or may mean a file that came or went.
        moved = scratch.put("moved", reexport.meaning_any(out["re_exports"], touched))
        kept = have["edges"].join(touched, have["edges"]["barrel"] == touched["path"], "left_anti").join(moved.select(F.col("path").alias("barrel"), "ord"), ["barrel", "ord"], "left_anti")
        edges = scratch.put("edges", kept.unionByName(reexport.barrel_edges(moved, out["files"]).select(*kept.columns)))
        seeds = touched.select("path").unionByName(moved.select("path"))
        above = reexport.dependents_of(self.spark, seeds, have["edges"].unionByName(edges))
        still = have["symbols"].join(above, "path", "left_anti")
        part = reexport.flatten_part(self.spark, out["own"], still, edges, above)
        symbols = still.unionByName(self._qualified(part, out["files"]).select(*still.columns))
        self._replace(out | {"edges": edges, "symbols": scratch.put("symbols", symbols)})
        scratch.drop("")
        return count

    # -- questions ----------------------------------------------------------------------------------

    def _require(self) -> dict[str, DataFrame]:
        if self.tables is None:
            raise RuntimeError("nothing is indexed yet: build the store first")
        return self.tables

    def symbols(self) -> DataFrame:
        columns = ["path", "name", "kind", "flags", "file_qualifier", "parent_qualifier"]
        have = self._require()
        return have["symbols"].select(*columns).unionByName(have["standard"].select(*columns))

    def query(self, queries: DataFrame) -> DataFrame:
        """Suggestions for queries of model.QUERIES; gates on what an editor would not ask."""
        asked = queries.filter(F.col("prefix").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & (F.length("prefix") >= self.settings.min_prefix))
        asked = asked.filter(F.col("language").isin(*self.settings.languages))
        return lookup.suggestions(self.symbols(), asked, self._require()["words"])

    def query_edits(self, queries: DataFrame, sources: DataFrame) -> DataFrame:
        """Suggestions with the edits that import them; names the files import are left out."""
        known = edits.with_imported_names(sources).select(F.col("path").alias("current_path"), F.col("already_imported").alias("in_file"))
        asked = queries.join(known, "current_path", "left")
        asked = asked.withColumn("already_imported", F.array_union(F.coalesce("already_imported", F.array().cast("array<string>")), F.coalesce("in_file", F.array().cast("array<string>"))))
        asked = asked.drop("in_file").select(*queries.columns)
        have, found = self._require(), self.query(asked)
        aliases = specifiers.aliases_of(found, asked, have["aliases"])
        return edits.render(found, asked, sources, have["packages"], aliases, self.settings.type_imports)

    def stats(self) -> dict:
        have = self._require()
        index = stats.index_stats(have["symbols"]).first().asDict()
        index["files"] = have["files"].count()
        standard = {r.language_key: r["count"] for r in catalog.counts(catalog.keyed(have["standard"])).collect()}
        return {"index": index, "indexer": stats.indexer_counters(have["files"]).first().asDict(), "standard": standard}

    def close(self) -> None:
        self.store.drop_old()
        self.tables = None


def query_row(query_id: int, prefix: str, path: str, limit: int = 20, imported: tuple[str, ...] = (), before: str = "", after: str = "") -> tuple:
    """One row of model.QUERIES; the language follows from the path."""
    lang = next((k for k, v in model.EXTENSIONS.items() if path.rpartition(".")[2].lower() in v), None)
    return (query_id, prefix, path, lang, limit, list(imported), before, after)
