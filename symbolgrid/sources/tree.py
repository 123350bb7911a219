"""Source trees as DataFrames: workspace files, installed Python packages, the running library."""

from __future__ import annotations

import re
import sysconfig
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.functions import paths, text
from symbolgrid.model import EXTENSIONS, MAX_FILE_BYTES, MODULE, MODULE_IMPORT, STANDARD_LIBRARY, Settings

SOURCE = "path string, lang string, content_hash string, mtime long, source string, file_qualifier string"
#: Virtual environments below a root, and where they keep packages.
ENVIRONMENTS, PACKAGE_FOLDERS = (".venv", "venv", "env", ".env"), ("lib/python*/site-packages", "Lib/site-packages")


def glob_pattern(glob: str) -> str | None:
    """A regular expression for a glob over a relative path; a star stops at a slash. None if the
    glob is malformed, which is then ignored."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] in "[{":
            end = glob.find("]" if glob[i] == "[" else "}", i)
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            out += "[" + inner.replace("!", "^", 1) + "]" if glob[i] == "[" else "(?:" + "|".join(map(re.escape, inner.split(","))) + ")"
            i = end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def excluded(relative: Column, globs: tuple[str, ...]) -> Column:
    """One alternation over all globs; a glob that matches a folder takes all below it."""
    patterns = [p for p in map(glob_pattern, globs) if p]
    return relative.rlike("^(?:" + "|".join(patterns) + ")(?:/.*)?$") if patterns else F.lit(False)


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", root):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), str(Path(root).absolute())


def list_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """path, mtime (milliseconds), length of the files below ``root``: those of a known language and
    those called one of ``names``.

    Spark's own file sources pass over names that start with ``_`` or ``.``, which are just the
    package files of Python, so folders are listed by tasks, one for each folder below the root.
    Excluded folders are not entered, links are not followed. Nothing is read yet.
    """
    suffixes = tuple(f".{e}" for group in EXTENSIONS.values() for e in group)
    patterns = [p for p in map(glob_pattern, exclude) if p]
    barred = re.compile("^(?:" + "|".join(patterns) + ")(?:/.*)?$") if patterns else None

    def entries(fs: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, pafs.FileInfo]]:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            relative = info.path[len(base) :].lstrip("/")
            below = relative + "/x" if info.type == pafs.FileType.Directory else relative
            linked = isinstance(fs, pafs.LocalFileSystem) and Path(info.path).is_symlink()
            if not linked and not (barred and barred.match(below)):
                yield relative, info

    def row(info: pafs.FileInfo) -> tuple[str, int, int] | None:
        if info.type == pafs.FileType.File and (info.base_name.lower().endswith(suffixes) or info.base_name in names):
            return info.path, int(info.mtime.timestamp() * 1000) if info.mtime else 0, info.size
        return None

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(root)
        for batch in batches:
            todo, found = batch["folder"].tolist(), []
            while todo:
                for _, info in entries(fs, base, todo.pop()):
                    if info.type == pafs.FileType.Directory:
                        todo.append(info.path)
                    elif r := row(info):
                        found.append(r)
            yield pd.DataFrame(found, columns=["path", "mtime", "length"])

    fs, base = _file_system(root)
    schema = "path string, mtime long, length long"
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return spark.createDataFrame([], schema)
    top = [info for _, info in entries(fs, base, base)]
    here = spark.createDataFrame([r for info in top if (r := row(info))], schema)
    folders = [(info.path,) for info in top if info.type == pafs.FileType.Directory]
    if not folders:
        return here
    below = spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInPandas(walk, schema)
    return here.unionByName(below)


def with_content(listing: DataFrame, root: str) -> DataFrame:
    """The listing with the ``content`` of each file, null for one that cannot be read."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in listing.schema]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _file_system(root)
        for batch in batches:
            for k in range(0, len(batch), 64):  # a few files at a time in memory
                part = batch.iloc[k : k + 64]
                content = []
                for path in part["path"]:
                    try:
                        with fs.open_input_stream(path) as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield part.assign(content=content)

    return listing.mapInPandas(read, ", ".join([*columns, "content binary"]))


def read_tree(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """path, lang, mtime, length and content of the files below ``root`` that a scan wants.

    Language, size and globs are decided on the listing, so no other file is opened.
    """
    settings = settings or Settings(root)
    listing = list_tree(spark, root, settings.exclude)
    wanted = listing.withColumn("lang", paths.language_of(F.col("path"))).filter(F.col("lang").isin(*settings.languages) & (F.col("length") <= MAX_FILE_BYTES))
    return with_content(wanted, root).filter("content is not null")


def decoded(files: DataFrame) -> DataFrame:
    """Files as SOURCE: of at most MAX_FILE_BYTES and valid UTF-8, others are skipped."""
    fits = files.filter(F.col("length") <= MAX_FILE_BYTES).filter(F.is_valid_utf8(F.col("content").cast("string")))
    source = F.col("content").cast("string")
    return fits.select("path", "lang", text.content_hash(F.col("content")).alias("content_hash"), "mtime", source.alias("source"), F.lit(None).cast("string").alias("file_qualifier"))


def from_memory(spark: SparkSession, rows: list[tuple[str, str]], mtime: int = 0) -> DataFrame:
    """(path, source) pairs, for instance of unsaved files, as SOURCE."""
    df = spark.createDataFrame([(p, s) for p, s in rows], "path string, source string")
    lang = paths.language_of(F.col("path"))
    return df.select("path", lang.alias("lang"), text.content_hash(F.col("source")).alias("content_hash"), F.lit(mtime).cast("long").alias("mtime"), "source", F.lit(None).cast("string").alias("file_qualifier"))


def with_python_modules(files: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """file_qualifier of Python files: the dotted module, below the highest package folder.

    Which folders are packages is a join with ``listing``(path), not a probe of the disk. The
    package folders above a file that count are those without a gap, from its own folder up.
    """
    folder = paths.parent(F.col("path"))
    packages = listing.filter(F.col("path").rlike(r"/__init__\.pyi?$")).select(folder.alias("package")).distinct()
    python = files.filter("lang = 'python'").select("path").distinct()
    parts = F.split(F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 1)), "/")
    levels = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    above = F.transform(levels, lambda k: F.concat(F.lit(root.rstrip("/")), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    steps = python.filter(F.col("path").startswith(root.rstrip("/") + "/")).select("path", F.posexplode(above).alias("level", "folder"))
    hits = steps.join(packages, F.col("folder") == F.col("package"), "left")
    marks = hits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("level", "folder", F.col("package").isNotNull().alias("is"))), asc=False).alias("m"))
    # From the deepest folder up: skip to the first package, then go on while there are packages.
    run = F.aggregate(
        "m", F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("top")),
        lambda s, x: F.struct((s["done"] | (s["top"].isNotNull() & ~x["is"])).alias("done"), F.when(~s["done"] & x["is"], x["folder"]).otherwise(s["top"]).alias("top")),
        lambda s: s["top"],
    )
    tops = marks.select("path", paths.parent(run).alias("package_parent"))
    joined = files.join(tops, "path", "left")
    module = paths.python_module(F.col("path"), F.lit(root.rstrip("/")), F.col("package_parent"))
    qualifier = F.coalesce("file_qualifier", F.when(F.col("lang") == "python", module))
    return joined.withColumn("file_qualifier", qualifier).drop("package_parent")


# -- installed Python packages ----------------------------------------------------------------------


def package_roots(root: str, extra: tuple[str, ...] = ()) -> list[str]:
    """Folders of installed packages: the given ones, then those of virtual environments; each once."""
    found = [Path(p) for p in extra]
    for env in ENVIRONMENTS:
        for pattern in PACKAGE_FOLDERS:
            found += sorted((Path(root) / env).glob(pattern))
    return list(dict.fromkeys(str(p.resolve()) for p in found if p.is_dir()))


def package_files(files: DataFrame, base: str, depth: int = 3) -> DataFrame:
    """Python files of a package folder worth indexing, with their module as qualifier.

    Top level without private, hidden and metadata entries; packages to ``depth`` folders without
    tests, caches and vendored code; private files only where they are the package itself.
    """
    relative = F.substr(F.col("path"), F.lit(len(base.rstrip("/")) + 2))
    parts = F.split(relative, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    package_file = F.regexp_replace(name, r"\.pyi?$", "") == "__init__"
    first = parts[0]
    top = ~first.startswith("_") & ~first.startswith(".") & ~first.rlike(r"\.(dist-info|egg-info|egg-link)$")
    skipped = F.exists(folders, lambda x: x.startswith(".") | x.isin("__pycache__", "tests", "test", "_vendor"))
    deep = F.size(folders) <= depth
    rows = files.filter((F.col("lang") == "python") & top & ~skipped & deep & (package_file | ~name.startswith("_")))
    return rows.withColumn("file_qualifier", paths.dotted(relative)).filter("file_qualifier is not null")


def library_roots() -> list[str]:
    """Standard-library folders of the running interpreter."""
    found = [sysconfig.get_path(k) for k in ("stdlib", "platstdlib")]
    return list(dict.fromkeys(str(Path(p).resolve()) for p in found if p))


def library_files(files: DataFrame, base: str, depth: int = 8) -> DataFrame:
    """Python files of the standard library, with their module; caches, tests and sites left out."""
    relative = F.substr(F.col("path"), F.lit(len(base.rstrip("/")) + 2))
    parts = F.split(relative, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    skipped = F.exists(folders, lambda x: x.startswith(".") | x.isin("__pycache__", "site-packages", "dist-packages", "test", "tests"))
    rows = files.filter((F.col("lang") == "python") & ~skipped & (F.size(folders) <= depth) & ~name.rlike(r"^__main__\.pyi?$"))
    return rows.withColumn("file_qualifier", paths.dotted(relative)).filter("file_qualifier is not null")


def library_modules(files: DataFrame) -> DataFrame:
    """One module symbol per top-level module of files(file_qualifier)."""
    top = F.substring_index("file_qualifier", ".", 1)
    rows = files.select(top.alias("name")).distinct()
    path = paths.synthetic_path(F.lit("python-runtime"), F.col("name"), F.lit("py"))
    flags = F.lit(MODULE_IMPORT | STANDARD_LIBRARY)
    return rows.select(path.alias("path"), "name", F.lit(MODULE).alias("kind"), flags.alias("flags"), F.col("name").alias("file_qualifier"), F.lit(None).cast("string").alias("parent_qualifier"))
