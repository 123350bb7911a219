"""Approximate nearest neighbours with an inverted multi-index.

Two codebooks quantise the halves of a vector separately; a cell is a pair of centroids. A query
walks the cells with a heap over the two sorted centroid lists, by the sum of the squared distances
that a half's vectors have from it in the mean. It walks twice: until the cells it has passed hold
``PROBE`` vectors, whose distances bound that of its k-th neighbour, and then on through all cells
that may hold anything as near. A cell's squared distances spread around their mean; it is visited
if the mean less ``REACH`` deviations is within the bound. Visited entries are reranked by exact
Euclidean distance in double precision. The cost of a query so follows the data: on clusters the
bound is tight and few cells qualify, on vectors without any, about half do.

Equal vectors are one entry with their smallest ids, so a vector that a third of all rows share
costs one distance. Cells are dealt in chunks of bounded size by cell (a larger cell is split by
hash). A task holds one chunk and streams the queries that visit it past; a chunk that more than
``VISITS`` queries visit is dealt to several tasks, so a copied vector serves that many distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid.llm.durable import Store

#: Vectors that the codebooks are fitted on, those of smallest hash: a bounded sample.
SAMPLE, ROUNDS = 20_000, 10
#: Centroids of a half: of the order of the fourth root of the number of vectors, within bounds.
FEWEST, MOST = 8, 256
#: Vectors that the first walk looks at, and deviations by which the second one reaches beyond the
#: mean. Of 51,282 random directions they visit about half and find 0.97 of the ten nearest.
PROBE, REACH = 512, 3.0
CHUNK, VISITS = 4096, 2048


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(F.exists(embedding, bad), F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from a spread of distinct rows; an emptied centroid stays where it was."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=rows[:, j], minlength=len(centres)) for j in range(rows.shape[1])], axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


class Codebooks:
    """Centroids of both halves and the mean squared distance of a centroid's vectors from it."""

    def __init__(self, first: np.ndarray, second: np.ndarray, sample: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.loose = [self._loose(c, sample[:, part]) for c, part in ((first, slice(None, self.half)), (second, slice(self.half, None)))]

    @staticmethod
    def _loose(centres: np.ndarray, rows: np.ndarray) -> np.ndarray:
        near = nearest(rows, centres)
        size = np.bincount(near, minlength=len(centres))
        return np.bincount(near, weights=((rows - centres[near]) ** 2).sum(axis=1), minlength=len(centres)) / np.maximum(size, 1)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return nearest(rows[:, : self.half], self.first) * len(self.second) + nearest(rows[:, self.half :], self.second)

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """All cells by rising mean of the squared distances of their vectors (the multi-sequence
        algorithm), with that mean and the square of REACH deviations from it."""
        a = ((self.first - query[: self.half]) ** 2).sum(axis=1)
        b = ((self.second - query[self.half :]) ** 2).sum(axis=1)
        spread = [REACH**2 * 4 * x * loose / c.shape[1] for x, loose, c in zip((a, b), self.loose, (self.first, self.second), strict=True)]
        a, b = a + self.loose[0], b + self.loose[1]
        order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b, va, vb = a[order_a].tolist(), b[order_b].tolist(), spread[0][order_a].tolist(), spread[1][order_b].tolist()
        order_a, order_b = order_a.tolist(), order_b.tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            mean, i, j = heapq.heappop(heap)
            yield order_a[i] * len(b) + order_b[j], mean, va[i] + vb[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def widest(self, query: np.ndarray) -> float:
        """The largest REACH deviations of any cell."""
        parts = ((self.first, query[: self.half], self.loose[0]), (self.second, query[self.half :], self.loose[1]))
        return REACH * float(np.sqrt(sum((4 * ((c - q) ** 2).sum(axis=1) * loose / c.shape[1]).max() for c, q, loose in parts)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def fit(entries: DataFrame, count: int, sample: int = SAMPLE) -> Codebooks:
    picked = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("vector").toPandas()
    rows = _matrix(picked["vector"])
    k = int(np.clip(2 ** np.ceil(np.log2(4 * max(count, 1) ** 0.25)), FEWEST, MOST))
    half = max(1, rows.shape[1] // 2)
    second = rows[:, half:] if rows.shape[1] > half else np.zeros((len(rows), 1))
    return Codebooks(kmeans(rows[:, :half], k), kmeans(second, k), np.hstack([rows[:, :half], second]))


class Index:
    """entries(entry, vector, ids, cell, chunk) in the shared folder, codebooks and cell sizes."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, k: int = 10, probe: int = PROBE):
        self.spark, self.store, self.k, self.probe = spark, Store(spark, "imi"), k, probe
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
        sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dimension = sizes[0]["d"] if sizes else 0
        self.rows = rows.filter(F.size("vector") == self.dimension)
        # Of equal vectors, k rows of each of the k + 1 smallest distinct ids are all that can be
        # among anyone's k nearest, and the first 2k of these rows: k at most are the asker's own.
        counts = self.rows.groupBy("vector", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
        rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
        few = counts.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        repeated = F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("n"))))
        entries = few.groupBy("vector").agg(F.min("vec_id").alias("entry"), F.slice(F.sort_array(repeated), 1, 2 * k).alias("ids"))
        entries = self.store.put("entries", entries)
        self.count = entries.count()
        if not self.count:
            self.entries = entries.limit(0)
            return
        books = self.books = fit(entries, self.count)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows = _matrix(batch["vector"])
                    yield batch.assign(cell=books.cells(rows if rows.shape[1] > 1 else np.hstack([rows, rows * 0])))

        celled = entries.mapInPandas(assign, "vector array<double>, entry long, ids array<long>, cell long")
        self.entries = self.store.put("celled", celled)
        self.cell_sizes = np.zeros(len(books.first) * len(books.second), dtype=np.int64)
        for row in self.entries.groupBy("cell").count().collect():  # at most MOST * MOST rows
            self.cell_sizes[row["cell"]] = row["count"]
        # Cells in order fill chunks; a cell larger than a chunk has chunks of its own.
        self.first_chunk, self.parts = np.zeros(len(self.cell_sizes), np.int64), np.ones(len(self.cell_sizes), np.int64)
        chunk = filled = 0
        for cell, size in enumerate(self.cell_sizes.tolist()):
            if filled and filled + size > CHUNK:
                chunk, filled = chunk + 1, 0
            self.first_chunk[cell], self.parts[cell] = chunk, -(-size // CHUNK) or 1
            if size > CHUNK:
                chunk, filled = chunk + int(self.parts[cell]), 0
            else:
                filled += size

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) for queries(vec_id): rows of the index by id."""
        empty = "query_id long, rank int, vec_id long, score double"
        if not self.count:
            return self.spark.createDataFrame([], empty)
        wanted = self.rows.join(queries.select(F.col("vec_id").cast("long").alias("wanted")).distinct(), F.col("vec_id") == F.col("wanted"), "left_semi")
        entry = self.entries.select("entry", F.col("vector").alias("own"))
        asked = self.store.put("asked", wanted.join(entry, F.col("vector") == F.col("own")).select(F.col("vec_id").alias("query_id"), "entry", "vector").dropDuplicates(["query_id", "entry"]))
        distinct = asked.select("entry", "vector").dropDuplicates(["entry"])
        # The asker's own entry is among the places, so the last one bounds its k-th neighbour.
        near = self._visited(distinct.withColumn("bound", F.lit(None).cast("double")), "probe")
        bound = near.groupBy("asker").agg(F.when(F.count(F.lit(1)) == self.k + 1, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
        rest = self._visited(distinct.join(bound.withColumnRenamed("asker", "entry"), "entry"), "rest")
        found = self._best(near.unionByName(rest), "found")
        hits = asked.select("query_id", F.col("entry").alias("asker")).join(found, "asker")
        hits = hits.join(self.entries.select("entry", F.explode("ids").alias("vec_id")), "entry").filter("vec_id != query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        self.store.keep("celled", "asked", "found")
        return hits.withColumn("rank", rank).filter(F.col("rank") <= self.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    def _best(self, found: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("asker").orderBy("score", "entry")
        return self.store.put(name, found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.k + 1).drop("place"))

    def _visited(self, askers: DataFrame, name: str) -> DataFrame:
        """(asker, entry, score): the k + 1 best of the cells that askers(entry, vector, bound) visit:
        without a bound those of the first walk, with one all others within it."""
        books, sizes, first, parts, probe = self.books, self.cell_sizes, self.first_chunk, self.parts, self.probe
        most, dimension = self.k + 1, self.dimension

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for entry, vector, bound in zip(batch["entry"].tolist(), batch["vector"], batch["bound"].tolist(), strict=True):
                    query = np.asarray(vector, dtype=np.float64)
                    whole = query if dimension > 1 else np.append(query, 0.0)
                    again, widest = bound is not None and not np.isnan(bound), books.widest(whole)
                    passed, by_chunk = 0, {}
                    for cell, mean, spread in books.walk(whole):
                        if again and mean - widest > bound**2:
                            break
                        if not sizes[cell]:
                            continue
                        if passed < probe:
                            passed += int(sizes[cell])
                            wanted = not again
                        elif not again:
                            break
                        else:
                            wanted = mean - np.sqrt(spread) <= bound**2
                        if wanted:
                            for part in range(int(parts[cell])):
                                by_chunk.setdefault(int(first[cell]) + part, []).append(cell)
                    if by_chunk:
                        yield pd.DataFrame({"asker": entry, "query": [query] * len(by_chunk), "cells": list(by_chunk.values()), "chunk": list(by_chunk)})

        visits = self.store.put(f"visits-{name}", askers.mapInPandas(visit, "asker long, query array<double>, cells array<long>, chunk long"))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell = batch["cell"].to_numpy()
                yield batch.assign(chunk=first[cell] + batch["salt"].to_numpy() % parts[cell])[["entry", "vector", "cell", "chunk"]]

        placed = self.entries.select("entry", "vector", "cell", F.pmod(F.xxhash64("entry"), F.lit(1 << 30)).alias("salt"))
        placed = placed.mapInPandas(place, "entry long, vector array<double>, cell long, chunk long")
        tasks = visits.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("tasks"))
        points = placed.join(tasks, "chunk").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        points = points.select("chunk", "task", F.lit(0).alias("visit"), F.col("entry").alias("id"), "vector", F.array("cell").alias("cells"))
        dealt = visits.join(tasks, "chunk").withColumn("task", F.pmod(F.xxhash64("asker"), F.col("tasks")).cast("int"))
        dealt = dealt.select("chunk", "task", F.lit(1).alias("visit"), F.col("asker").alias("id"), F.col("query").alias("vector"), "cells")
        rows = points.unionByName(dealt).repartition("chunk", "task").sortWithinPartitions("chunk", "task", "visit")

        def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A chunk's points come first, then the queries that visit it."""
            key, held, points = None, [], None
            for batch in batches:
                out = {"asker": [], "entry": [], "score": []}
                for chunk, task, is_visit, i, vector, cells in batch.itertuples(index=False):
                    if (chunk, task) != key:
                        key, held, points = (chunk, task), [], None
                    if not is_visit:
                        held.append((cells[0], i, vector))
                        continue
                    if points is None:
                        points = np.array([c for c, _, _ in held]), np.array([e for _, e, _ in held]), np.array([v for _, _, v in held], dtype=np.float64)
                        held = []
                    pick = np.flatnonzero(np.isin(points[0], cells))
                    score = np.sqrt(((points[2][pick] - np.asarray(vector, dtype=np.float64)) ** 2).sum(axis=1))
                    best = np.lexsort((points[1][pick], score))[:most]
                    out["asker"] += [i] * len(best)
                    out["entry"] += points[1][pick][best].tolist()
                    out["score"] += score[best].tolist()
                yield pd.DataFrame(out).astype({"asker": "int64", "entry": "int64", "score": "float64"})

        return self._best(rows.mapInPandas(rerank, "asker long, entry long, score double"), name)


def search_table(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, probe: int = PROBE) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all other rows.

    Columns used: vec_id, embedding; others are ignored. Vectors that are null, empty, zero, hold
    a null or non-finite component, have a null vec_id or another dimension than most rows take no
    part. Ties go to the smaller vec_id. Repeated rows are candidates each; a row is never a
    neighbour of its own vec_id. No usable vectors give no rows. A ``probe`` of all vectors makes the
    search exact.
    """
    index = Index(spark, vectors, k, probe)
    return index.search(index.rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id"))
