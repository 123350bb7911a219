"""The symbol store on disk: versioned Parquet snapshots behind a pointer that moves atomically."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import names
from symbolgrid.model import Settings

TABLES = {
    "files": model.FILES,
    "own": model.EXPORTS,
    "re_exports": model.RE_EXPORTS,
    "edges": f"barrel string, ord int, target string, names {model.RE_EXPORT_NAMES}",
    "symbols": model.EXPORTS,
    "standard": model.EXPORTS,
    "words": model.WORDS,
    "packages": model.PACKAGES,
    "aliases": model.ALIASES,
}
#: Tables sorted so that a prefix of a folded name reads few row groups.
SORTED = {"symbols": ("name_lc", "name", "path"), "words": ("name_lc", "name")}
POINTER = "CURRENT-"


class VersionMismatch(Exception):
    """The snapshot was written by another schema or from other settings: build anew."""


class Store:
    """Snapshots below one folder, on any file system that Spark can reach.

    ``save`` writes a new version beside the old ones and then a pointer file of the next number,
    which exists as a whole or not at all. The highest number counts, so a reader sees one version
    or the next, never half of one and never none, and nothing is ever replaced in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)

    def _names(self) -> list[str]:
        folder = self._path(self.folder)
        return [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _numbers(self) -> list[int]:
        return sorted(int(x.removeprefix(POINTER)) for x in self._names() if x.startswith(POINTER))

    def _point(self, content: str) -> None:
        hidden = self._path(f"{self.folder}/.pointer-{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(content.encode()))
        out.close()
        number = max(self._numbers(), default=0) + 1
        while not self._fs.rename(hidden, self._path(f"{self.folder}/{POINTER}{number}")):
            if number + 1000 < max(self._numbers(), default=0) + 1:
                raise OSError("the pointer cannot be written")
            number += 1

    def current(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/{POINTER}{numbers[-1]}", wholetext=True).collect()))

    def save(self, tables: dict[str, DataFrame], settings: Settings) -> str:
        """Tables that are not given are those of the present version, whose files are shared."""
        version = f"v-{uuid.uuid4().hex[:12]}"
        now = self.current()
        where = dict(now["tables"]) if now else {}
        for name, df in tables.items():
            columns = self.spark.createDataFrame([], TABLES[name]).schema
            rows = df.select(*[df[f.name].cast(f.dataType) for f in columns])
            if name in SORTED:
                folded = names.ascii_lower(F.col("name"))
                rows = rows.withColumn("name_lc", folded).sortWithinPartitions(*SORTED[name]).select(*[f.name for f in columns])
            rows.write.parquet(f"{self.folder}/{version}/{name}")
            where[name] = f"{version}/{name}"
        self._point(json.dumps({"tables": where, "schema": model.SCHEMA_VERSION, "settings": settings.fingerprint()}))
        return version

    def load(self, settings: Settings) -> dict[str, DataFrame] | None:
        """Tables of the present version; None if there is none yet."""
        now = self.current()
        if now is None:
            return None
        if now.get("schema") != model.SCHEMA_VERSION or now["settings"] != settings.fingerprint():
            raise VersionMismatch(str(now))
        return {name: self.spark.read.schema(schema).parquet(f"{self.folder}/{now['tables'][name]}") for name, schema in TABLES.items()}

    def drop_old(self) -> None:
        """Delete all versions that the present one shares nothing with, and all older pointers."""
        now = self.current()
        used = {x.partition("/")[0] for x in now["tables"].values()} if now else set()
        for name in self._names():
            old = name.startswith("v-") and name not in used
            if old or (name.startswith(POINTER) and name != f"{POINTER}{self._numbers()[-1]}"):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
