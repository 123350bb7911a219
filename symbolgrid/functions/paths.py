"""Paths as data: languages, components, proximity, module names and import specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolgrid.model import EXTENSIONS, GROUPS

#: Score of the number of steps between two directories; farther is 0.
PROXIMITY = {0: 80, 1: 55, 2: 35, 3: 20, 4: 8, 5: 8}
EXTERNAL = -25
#: Root of the files that stand for library modules; their paths are keys, not places.
LIBRARY_ROOT = "$stdlib"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Null for files of no known language."""
    ext, found = extension(path), None
    for lang, names in EXTENSIONS.items():
        found = F.when(ext.isin(*names), lang) if found is None else found.when(ext.isin(*names), lang)
    return found


def group_of(lang: Column) -> Column:
    found = None
    for name, group in GROUPS.items():
        found = F.when(lang == name, group) if found is None else found.when(lang == name, group)
    return found


def is_external(path: Column) -> Column:
    found = F.lit(False)
    for folder in ("node_modules", "site-packages"):
        found = found | path.contains(f"/{folder}/") | path.contains(f"\\{folder}\\")
    return found


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def parent_components(path: Column) -> Column:
    """Folders above the file, without root, ``.`` and ``..``."""
    parts = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    return F.filter(parts, lambda x: ~x.isin("", ".", ".."))


def common_prefix_size(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def proximity(current: Column, target: Column) -> Column:
    """Closeness of two files by their folders; a malus for files of installed packages."""
    a, b = parent_components(current), parent_components(target)
    steps = F.size(a) + F.size(b) - 2 * common_prefix_size(a, b)
    near = F.lit(0)
    for distance, score in PROXIMITY.items():
        near = F.when(steps == distance, score).otherwise(near)
    near = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(near)
    return (near + F.when(is_external(target), EXTERNAL).otherwise(0)).cast("int")


def normalise(path: Column) -> Column:
    """Without ``.``, ``..`` (where there is a folder to leave) and doubled slashes."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        up = (part == "..") & (last != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def strip_extension(path: Column) -> Column:
    """Without a script extension; of a declaration file without both parts of it."""
    return F.regexp_replace(F.regexp_replace(path, r"\.d\.(ts|mts|cts)$", ""), r"\.(ts|tsx|mts|cts|jsx|mjs|cjs|js)$", "")


def relative_specifier(current: Column, target: Column) -> Column:
    """How a script imports another by relative path; an index file is its folder."""
    here, there = parent_components(current), parent_components(target)
    common = common_prefix_size(here, there).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(here) - common)
    down = F.slice(there, common + 1, F.size(there))
    name = F.array(strip_extension(F.regexp_extract(target, "([^/]*)$", 1)))
    joined = F.array_join(F.concat(up, down, name), "/")
    joined = F.regexp_replace(joined, "/index$", "")
    return F.when(joined.startswith("."), joined).otherwise(F.concat(F.lit("./"), joined))


def node_package(target: Column) -> Column:
    """Package of a path below node_modules, scope included; null elsewhere."""
    rest = F.substring_index(target, "/node_modules/", -1)
    name = F.regexp_extract(rest, "^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(target.contains("/node_modules/"), name)


def node_specifier(target: Column, manifest_name: Column | None = None) -> Column:
    """Import specifier of a file in node_modules: the package, and the sub-path unless it is an index."""
    package = node_package(target)
    rest = strip_extension(F.substr(F.substring_index(target, "/node_modules/", -1), F.length(package) + 2))
    name = package if manifest_name is None else F.coalesce(manifest_name, package)
    return F.when(rest.isin("", "index") | rest.endswith("/index"), name).otherwise(F.concat(name, F.lit("/"), rest))


def synthetic_path(lang: Column, qualifier: Column, ext: Column) -> Column:
    safe = F.regexp_replace(qualifier, "[^A-Za-z0-9]", "_")
    return F.concat(F.lit(f"{LIBRARY_ROOT}/"), lang, F.lit("/"), safe, F.lit("."), ext)


def dotted(relative: Column) -> Column:
    """Dotted module of a relative path; a package's own file is the package; null if nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(relative, r"\.[^./]*$", ""), "/"), lambda x: ~x.isin("", "."))
    parts = F.when(F.try_element_at(parts, F.lit(-1)) == "__init__", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.nullif(F.array_join(parts, "."), F.lit(""))


def python_module(path: Column, root: Column, package_parent: Column | None = None) -> Column:
    """Module of a Python file: behind site-packages; else below the parent of its highest package
    folder (``package_parent``, null if it is in none); else below the root; else null."""
    installed = F.regexp_extract(path, r"/site-packages/(.+)$", 1)
    # The first site-packages folder counts, so cut at it from the left.
    first = F.substr(path, F.instr(path, "/site-packages/") + len("/site-packages/"))
    below = lambda base: F.substr(path, F.length(base) + 2)
    base = root if package_parent is None else F.coalesce(package_parent, root)
    own = F.when(path.startswith(F.concat(root, F.lit("/"))), dotted(below(base)))
    return F.when(installed != "", dotted(first)).otherwise(own)
