"""Script packages and project files: manifests, entry points, type companions, path aliases."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgrid.functions import paths
from symbolgrid.operators.reexport import first_existing

#: Sections of a manifest that name packages.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: Conditions of an exports map in the order of trial.
CONDITIONS = ("types", "typescript", "default", "import", "require")
#: Files that state the path aliases of a project.
PROJECT_FILES = ("tsconfig.json", "jsconfig.json")
#: What stands in for a script path, in the order of trial.
DECLARATIONS = (".d.ts", ".d.mts", ".d.cts", ".ts", ".tsx")


def dependency_names(manifests: DataFrame) -> DataFrame:
    """(dep) of manifests(source), each once, in order."""
    section = lambda s: F.coalesce(F.map_keys(F.from_json(F.get_json_object("source", f"$.{s}"), "map<string,string>")), F.array().cast("array<string>"))
    names = F.explode(F.flatten(F.array(*[section(s) for s in SECTIONS])))
    return manifests.select(names.alias("dep")).filter("dep != ''").distinct().orderBy("dep")


def companion(dep):
    """The package that holds another's types."""
    scoped = F.concat(F.lit("@types/"), F.replace(F.substr(dep, F.lit(2)), F.lit("/"), F.lit("__")))
    return F.when(dep.startswith("@types/"), None).when(dep.startswith("@"), scoped).otherwise(F.concat(F.lit("@types/"), dep))


def entry_points(manifest: str) -> list[str]:
    """Candidates for a package's entry file, in order of trial."""
    try:
        data = json.loads(manifest)
    except ValueError:
        data = {}
    data = data if isinstance(data, dict) else {}

    def listed(value: object) -> list[str]:
        if isinstance(value, str):
            return [value]
        return [p for c in CONDITIONS if isinstance(value, dict) and c in value for p in listed(value[c])]

    exports = data.get("exports")
    root = exports.get(".", exports) if isinstance(exports, dict) else exports
    named = [data.get(k) for k in ("types", "typings")]
    found = [x for x in named if isinstance(x, str)] + listed(root) + ([data["main"]] if isinstance(data.get("main"), str) else [])
    return list(dict.fromkeys([*found, "index.d.ts", "index.ts"]))


def probes(path: str) -> list[str]:
    """Files that an entry can mean: itself if typed, else what stands beside the script."""
    if re.search(r"\.(ts|tsx|mts|cts)$", path):
        return [path]
    stem = re.sub(r"\.(js|mjs|cjs)$", "", path)
    return [stem + d for d in DECLARATIONS]


def package_entries(manifests: DataFrame, deps: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(dep, path): the files that stand for each dependency: its entry and, if that is found and
    another, the entry of its type companion, both under the name of the dependency itself."""

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [[posixpath.normpath(posixpath.join(posixpath.dirname(p), x)) for e in entry_points(s) for x in probes(e)] for p, s in zip(batch["path"], batch["source"], strict=True)]
            yield pd.DataFrame({"manifest": batch["path"], "tried": out})

    base = f"{root.rstrip('/')}/node_modules/"
    at = lambda dep: F.concat(F.lit(base), dep, F.lit("/package.json"))
    wanted = deps.select("dep", F.lit(0).alias("rank"), at(F.col("dep")).alias("manifest"))
    types = deps.select("dep", F.lit(1).alias("rank"), at(companion(F.col("dep"))).alias("manifest")).filter("manifest is not null")
    candidates = manifests.filter(F.col("path").startswith(base)).mapInPandas(tried, "manifest string, tried array<string>")
    rows = wanted.unionByName(types).join(candidates, "manifest").select(F.struct("dep", "rank").alias("row_id"), "tried")
    found = first_existing(rows, "tried", files, "path").select("row_id.dep", "row_id.rank", "path")
    primary = found.filter("rank = 0").select("dep", "path")
    extra = found.filter("rank = 1").select("dep", "path").join(primary.select("dep", F.col("path").alias("own")), "dep").filter("path != own").drop("own")
    return primary.unionByName(extra)


def package_names(manifests: DataFrame) -> DataFrame:
    """(folder, name) of manifests(path, source) that have a name."""
    name = F.get_json_object("source", "$.name")
    return manifests.select(paths.parent(F.col("path")).alias("folder"), name.alias("name")).filter("name is not null")


def without_comments(source: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", source, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare, flags=re.S)


def _extended(path: str, data: object) -> str | None:
    """The project file that one extends by a path, as a path."""
    parent = data.get("extends") if isinstance(data, dict) else None
    if not isinstance(parent, str) or not parent.startswith((".", "/")):
        return None
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), parent if parent.endswith(".json") else parent + ".json"))


def _parsed(configs: list[tuple[str, str]]) -> dict[str, object]:
    out = {}
    for path, source in configs:
        try:
            out[path] = json.loads(without_comments(source))
        except ValueError:
            continue
    return out


def parents(configs: list[tuple[str, str]]) -> set[str]:
    """Project files that (path, source) ones extend and that are not among them."""
    found = {_extended(path, data) for path, data in _parsed(configs).items()}
    return found - {None, *(path for path, _ in configs)}


def path_aliases(configs: list[tuple[str, str]]) -> list[tuple[str, int, str, str]]:
    """(config, ord, pattern, absolute target) of project files (path, source), ``extends`` followed.

    A child's paths replace its parent's as a whole if there are any; a cycle ends the chain. The
    project files of one root are few and are read on the driver.
    """
    parsed = _parsed(configs)

    def of(path: str, seen: frozenset[str]) -> tuple[str, dict]:
        data = parsed.get(path)
        if not isinstance(data, dict) or path in seen:
            return posixpath.dirname(path), {}
        options = data.get("compilerOptions") or {}
        folder = posixpath.normpath(posixpath.join(posixpath.dirname(path), options.get("baseUrl") or "."))
        if options.get("paths"):
            return folder, options["paths"]
        if parent := _extended(path, data):
            return of(parent, seen | {path})
        return folder, {}

    out = []
    for path in parsed:
        folder, rules = of(path, frozenset())
        pairs = [(pattern, target) for pattern, targets in rules.items() for target in targets]
        out += [(path, i, pattern, posixpath.normpath(posixpath.join(folder, target))) for i, (pattern, target) in enumerate(pairs)]
    return out
