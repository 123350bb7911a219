"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles; texts with equal sets form a class.
   Classes are the nodes of the link graph, so copies cost nothing and rows that share a doc_id
   (or have none) but not a text stay apart.
2. Signatures of ``HASHES`` values are cut into ``BANDS`` bands. Classes that agree on a band meet
   in a bucket. A pair at the threshold misses every band with probability (1 - t**ROWS)**BANDS,
   5e-6 here.
3. A bucket first proposes its members against two of them, those of smallest and of largest id
   (stars: twice as many pairs as members). Pairs are verified and components contracted.
4. Buckets that still hold several components are settled exactly. A small bucket is one packed
   row. A large one is dealt by set size (sets that reach the threshold differ by at most a third)
   and by whether a member is of the bucket's commonest component, and packed into rows of bounded
   size; packed rows meet unless both are of that component. A member is one row, once, and a
   bucket that one component fills but for a few members costs those few against the rest.
5. Verification compares signatures batch by batch. After each batch a pair is dropped when the
   posterior probability (uniform prior) that its similarity reaches the threshold is below
   ``MISS``; survivors are verified on their full sets, inside their packed rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.llm.durable import Store
from symbolgrid.llm.words import Words, filled, mix, pieces, tidy

WIDTH, THRESHOLD = 5, (75, 100)
ROWS, BANDS, BATCH, MISS = 4, 32, 32, 1e-7
HASHES = ROWS * BANDS
#: Pairs of one centre that a task gets at a time; a centre with more is dealt to several tasks.
PAIRS_PER_TASK = 500
#: Members and shingles of a packed row; two packed rows at most meet in a task.
BLOCK, WEIGHT = 512, 1 << 19
#: Pairs compared at a time.
SLICE = 1 << 15

_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one text after the other, each sorted; and offsets.

    Texts of fewer words have their whole sequence as one shingle, texts without words none.
    """
    words = Words(texts, lower=True)
    at, hashes = words.windows(width)
    text = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    text = np.concatenate([text, short])
    hashes = np.concatenate([hashes, words.whole()[short]])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 array (texts, HASHES): upper halves of the minima of multiply-shift permutations."""
    out = np.zeros((len(offsets) - 1, HASHES), dtype=np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        starts = offsets[:-1][some]
        for j in range(HASHES):
            low = np.minimum.reduceat((hashes ^ _XOR[j]) * _MUL[j], starts)
            out[some, j] = (low >> np.uint64(32)).astype(np.uint32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _sets_binary(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(hashes))]
    ).cast(pa.binary())


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, offsets = shingle_sets(filled(part.column("text")))
            size = np.diff(offsets)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
                sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("content"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), _binary(signatures(hashes, offsets))],
                names=["doc_id", "content", "n_shingles", "print1", "print2", "signature"],
            )


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, offsets = shingle_sets(filled(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), _sets_binary(hashes, offsets)], names=["id", "shingles"])


@cache
def keep_counts() -> np.ndarray:
    """Per batch of hashes: the fewest matches with which a pair may still reach the threshold."""
    t = THRESHOLD[0] / THRESHOLD[1]

    def reaches(m: int, n: int) -> float:
        """P(similarity >= t | m of n equal) under a uniform prior: a binomial tail of n + 1."""
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return np.array([next(m for m in range(n + 1) if reaches(m, n) >= MISS) for n in range(BATCH, HASHES + 1, BATCH)])


def bayes_survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of the pairs (rows i of a, rows j of b, two signature arrays) that no bound prunes."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for k, least in enumerate(keep_counts()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[i[alive], part] == b[j[alive], part]).sum(axis=1)
        passed = matches >= least
        alive, matches = alive[passed], matches[passed]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


@tidy
def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            row = np.arange(part.num_rows)
            alive = bayes_survivors(_matrix(part.column("sign_a")), _matrix(part.column("sign_b")), row, row)
            yield part.select(["a", "b"]).take(pa.array(alive))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(x), len(y)) * THRESHOLD[1] < max(len(x), len(y)) * THRESHOLD[0]:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common)


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (centre, salt, other), the centre's own set first with other null."""
    centre, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for i, j, shingles in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
            own = np.frombuffer(shingles, dtype=np.uint64)
            if j is None:
                centre, held = i, own
            elif i == centre and linked(held, own):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Packed:
    """Members of a packed row: ids, labels, signatures and, where they are there, sets."""

    def __init__(self, members: list[dict]):
        self.id = [m["id"] for m in members]
        self.label = np.array([m["label"] for m in members], dtype=np.int64)
        self.sign = np.frombuffer(b"".join(m["signature"] for m in members), dtype=np.uint32).reshape(-1, HASHES)
        self.sets = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in members if "shingles" in m]


def open_pairs(band: int, a: Packed, b: Packed | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b, or j > i of a where b is None) still to be verified: of different
    components, sharing no earlier band, and not pruned by the posterior bounds."""
    other = a if b is None else b
    step = max(1, SLICE // max(1, len(other.id)))
    for start in range(0, len(a.id), step):
        near = a.label[start : start + step, None] != other.label[None, :]
        if b is None:
            near &= np.arange(start, start + len(near))[:, None] < np.arange(len(other.id))[None, :]
        i, j = np.nonzero(near)
        i += start
        alive = bayes_survivors(a.sign, other.sign, i, j)
        i, j = i[alive], j[alive]
        if band and len(i):
            same = (a.sign[i, : ROWS * band] == other.sign[j, : ROWS * band]).reshape(len(i), band, ROWS)
            first = ~same.all(axis=2).any(axis=1)
            i, j = i[first], j[first]
        if len(i):
            yield i, j


def _packed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Packed, Packed | None]]:
    for batch in batches:
        for k in range(batch.num_rows):
            pair, band, a, b = (batch.column(c)[k].as_py() for c in ("pair", "band", "members_a", "members_b"))
            yield pair, band, Packed(a), None if b is None else Packed(b)


@tidy
def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (id, label) of either side of a pair of packed rows that have any pair to verify."""
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64())]))
    for pair, band, a, b in _packed_pairs(batches):
        found = np.zeros(len(a.id), dtype=bool), np.zeros(0 if b is None else len(b.id), dtype=bool)
        for i, j in open_pairs(band, a, b):
            found[0][i] = True
            found[b is not None][j] = True
        some = [[{"id": x.id[k], "label": int(x.label[k])} for k in np.flatnonzero(f).tolist()] for x, f in zip((a, b), found, strict=True) if x is not None]
        if any(some):
            yield pa.RecordBatch.from_arrays([pa.array([pair], pa.int64()), pa.array([some[0]], kind), pa.array([some[1] if b is not None else None], kind)], names=["pair", "flagged_a", "flagged_b"])


@tidy
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a pair of packed rows that join components which its earlier links have not joined."""
    for _, band, a, b in _packed_pairs(batches):
        other = a if b is None else b
        root = {x: x for x in {*a.label.tolist(), *other.label.tolist()}}

        def find(x: int, root: dict = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        ends: list[tuple[int, int]] = []
        for i, j in open_pairs(band, a, b):
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(int(a.label[p])), find(int(other.label[q]))
                if x != y and linked(a.sets[p], other.sets[q]):
                    root[max(x, y)] = min(x, y)
                    ends.append((a.id[p], other.id[q]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([y for _, y in ends], pa.int64())], names=["a", "b"])


PRINTS = ["n_shingles", "print1", "print2"]
#: What tells the packed rows of a bucket apart.
PART = ["bucket", "grade", "minor", "chunk"]


class _Run:
    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.store = spark, Store(spark, "neardup")
        content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content, "text")
        schema = "doc_id long, content long, n_shingles long, print1 long, print2 long, signature binary"
        self.signed = self.store.put("signed", self.docs.mapInArrow(_sign, schema))
        # Equal sets have equal signatures: any member's will do.
        classes = self.signed.filter("n_shingles > 0").groupBy(*PRINTS)
        classes = classes.agg(F.min("doc_id").alias("least_doc"), F.min(F.struct("content", "doc_id")).alias("place"), F.any_value("signature").alias("signature"))
        # The ids stand in the written table, so nothing computes them anew.
        self.classes = self.store.put("classes", classes.select(F.monotonically_increasing_id().alias("id"), *PRINTS, "least_doc", "place", "signature"))
        self.signs = self.classes.select("id", "signature")
        bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
        rows = self.classes.select("id", "n_shingles", F.posexplode(bands).alias("band", "bucket"))
        shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).filter("n > 1").drop("n")
        self.members = self.store.put("members", rows.join(shared, "bucket"))

    def shingles(self, ids: DataFrame, name: str) -> DataFrame:
        """Full sets of the classes ``ids``(id), read at one document of each."""

        none = F.lit(-(1 << 63))
        wanted = ids.join(self.classes, "id").select("id", F.coalesce("place.doc_id", none).alias("at_doc"), F.col("place.content").alias("at_content"))
        docs = self.docs.select(F.coalesce("doc_id", none).alias("at_doc"), F.col("content").alias("at_content"), "text")
        # Repeated rows are in one partition already: dropping them moves no text.
        texts = docs.join(wanted, ["at_doc", "at_content"]).dropDuplicates(["at_doc", "at_content", "id"])
        return self.store.put(name, texts.select("id", "text").mapInArrow(_sets, "id long, shingles binary"))

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs(a, b)."""
        a = self.signs.select(F.col("id").alias("a"), F.col("signature").alias("sign_a"))
        b = self.signs.select(F.col("id").alias("b"), F.col("signature").alias("sign_b"))
        near = self.store.put(f"near-{name}", pairs.join(a, "a").join(b, "b").mapInArrow(_prune, "a long, b long"))
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.shingles(ids, f"sets-{name}")
        # Few centres have more pairs than a task is to get; as a table its size is known to the planner.
        salts = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TASK).cast("int").alias("salts")).filter("salts > 1")
        salts = self.store.put(f"salts-{name}", salts)
        many = F.coalesce("salts", F.lit(1))
        others = near.join(salts, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), many).cast("int"))
        others = others.join(sets.withColumnsRenamed({"id": "b"}), "b").select("a", "salt", "b", "shingles")
        centres = near.select("a").distinct().join(salts, "a", "left").select("a", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"))
        centres = centres.join(sets.withColumnsRenamed({"id": "a"}), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
        dealt = others.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
        return self.store.put(f"links-{name}", dealt.mapInArrow(_verify, "a long, b long"))

    def placed(self, labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, once each, with their labels and
        the packed row that each goes to."""
        known = labels.withColumnsRenamed({"label": "known"})
        rows = self.members.join(known, "id", "left").select("bucket", "band", "id", "n_shingles", F.coalesce("known", "id").alias("label"))
        size = [F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")]
        buckets = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), *size).filter("low < high")
        small = (F.col("size") <= BLOCK) & (F.col("weight") <= WEIGHT)
        mixed = self.store.put("mixed", rows.join(buckets.select("bucket", small.alias("small")), "bucket"))
        large = mixed.filter("not small")
        counts = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        major = counts.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("major"))
        # Sets at the threshold are at most one grade apart; the base is a little above 4 / 3.
        grade = F.floor(F.log("n_shingles") / math.log(1.001 * THRESHOLD[1] / THRESHOLD[0])).cast("int")
        large = large.join(major, "bucket").withColumns({"grade": grade, "minor": F.col("label") != F.col("major")}).drop("small", "major")
        parts = large.groupBy("bucket", "grade", "minor").agg(*size)
        chunks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / WEIGHT)).cast("int")
        large = large.join(parts.select("bucket", "grade", "minor", chunks.alias("chunks")), ["bucket", "grade", "minor"])
        large = large.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        small = mixed.filter("small").withColumns({"grade": F.lit(-1), "minor": F.lit(True), "chunk": F.lit(0)})
        columns = [*PART, "band", "id", "label"]
        return self.store.put("placed", small.select(*columns).unionByName(large.select(*columns)))

    def settle(self, labels: DataFrame) -> DataFrame:
        """The links that remain between components, found in pairs of packed rows."""

        def pack(rows: DataFrame, *fields: str) -> DataFrame:
            return rows.groupBy(*PART).agg(F.any_value("band").alias("band"), F.collect_list(F.struct(*fields)).alias("members"))

        def meet(pairs: DataFrame, packed: DataFrame) -> DataFrame:
            """pair, band and both sides' members; a row within itself has no other side."""
            side = lambda s: packed.select(*[F.col(c).alias(f"{c}_{s}") for c in PART], F.col("members").alias(f"members_{s}"))
            both = pairs.join(side("a"), [f"{c}_a" for c in PART])
            both = both.join(side("b"), [f"{c}_b" for c in PART], "left")
            return both.select("pair", "band", "members_a", "members_b")

        packed = self.store.put("packed", pack(self.placed(labels).join(self.signs, "id"), "id", "label", "signature"))
        keys = packed.select("band", *PART)
        a = keys.select("band", *[F.col(c).alias(f"{c}_a") for c in PART])
        b = keys.select(*[F.col(c).alias(f"{c}_b") for c in PART])
        within = a.filter("minor_a").select("*", *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in b.columns])
        later = F.struct("grade_a", "minor_a", "chunk_a") < F.struct("grade_b", "minor_b", "chunk_b")
        near = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("grade_b") - F.col("grade_a") <= 1) & (F.col("minor_a") | F.col("minor_b"))
        pairs = within.unionByName(a.join(b, near & later)).withColumn("pair", F.monotonically_increasing_id())
        pairs = self.store.put("meetings", pairs)
        flagged = "array<struct<id:long,label:long>>"
        flags = meet(pairs, packed).mapInArrow(_flag, f"pair long, flagged_a {flagged}, flagged_b {flagged}")
        flags = self.store.put("flags", flags)
        found = pairs.join(flags, "pair")
        sides = [found.select(*[F.col(f"{c}_{s}").alias(c) for c in PART], "band", F.explode(f"flagged_{s}").alias("m")) for s in "ab"]
        rows = sides[0].unionByName(sides[1]).select(*PART, "band", "m.*").distinct()
        sets = self.shingles(rows.select("id").distinct(), "sets-meetings")
        rows = rows.join(self.signs, "id").join(sets, "id")
        again = pairs.join(flags.select("pair"), "pair")
        full = self.store.put("packed-sets", pack(rows, "id", "label", "signature", "shingles"))
        return self.store.put("links-meetings", meet(again, full).mapInArrow(_settle, "a long, b long"))


def components(store: Store, links: DataFrame, name: str) -> DataFrame:
    """(id, label): the smallest id of the component of every id in links(a, b).

    Labels fall along links and along themselves (pointer jumping) until nothing changes; each
    round is one aggregation on tables in the shared folder, so rounds grow with the logarithm of
    a component's width and nothing reaches the driver but one count.
    """
    edges = store.put(f"edges-{name}", links.select("a", "b").union(links.select("b", "a")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    start = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels, k = store.put(f"labels-{name}-0", start), 0
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        best = edges.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        # A label is itself an id: take over what it has been told.
        down = labels.join(best, "id").select("id", "label", F.least("label", "near").alias("low"))
        told = down.groupBy(F.col("label").alias("old")).agg(F.min("low").alias("hooked"))
        hooked = down.join(told, F.col("label") == F.col("old")).select("id", "label", F.least("low", "hooked").alias("next"))
        k += 1
        after = store.put(f"labels-{name}-{k}", hooked.select("id", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("fell")))
        store.drop(f"labels-{name}-{k - 1}")
        labels = after.select("id", "label")
        if after.filter("fell").isEmpty():
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, content (hash of the text)
    and component (a key of the link graph's component, null for texts without words).

    Columns used: doc_id, text; others are ignored. ``component_id`` is the smallest doc_id of the
    component. Null and empty texts have no shingles, are linked with nothing and are their own
    component. Repeated rows are exact copies; each gets its row. Rows that share a doc_id but not
    a text are nodes of their own. A null doc_id takes part in linking, but never is a
    component_id unless the component has no other; then the row of smallest content is kept.
    Texts of any length are taken whole. An empty table gives no rows.
    """
    run = _Run(spark, docs)
    ends = run.members.select(F.col("first").alias("a"), F.col("id").alias("b")).unionByName(run.members.select(F.col("id").alias("a"), F.col("last").alias("b")))
    pairs = run.store.put("pairs", ends.filter("a < b").distinct())
    labels = components(run.store, run.verify(pairs, "stars"), "stars")
    # Links between components join labels, so only the contracted graph is walked again.
    more = run.settle(labels)
    inner = labels.withColumnRenamed("label", "inner")
    for end in ("a", "b"):
        more = more.join(inner.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("inner", end)).drop("inner")
    outer = components(run.store, run.store.put("contracted", more.filter("a != b")), "meetings").withColumnsRenamed({"id": "inner", "label": "outer"})
    classes = run.classes.drop("signature").join(inner, "id", "left").withColumn("inner", F.coalesce("inner", "id"))
    classes = classes.join(outer, "inner", "left").withColumn("component", F.coalesce("outer", "inner"))
    classes = run.store.put("labelled", classes.select(*PRINTS, "component", "least_doc", F.col("place.content").alias("least_content")))
    least = classes.groupBy("component").agg(F.min("least_doc").alias("component_id"), F.min("least_content").alias("least_content"))
    least = run.store.put("least", least)  # so that a component with very many classes can be split in the join
    nodes = run.store.put("nodes", classes.select(*PRINTS, "component").join(least, "component"))
    run.store.keep("signed", "nodes")
    out = run.signed.select("doc_id", "content", *PRINTS).join(nodes, PRINTS, "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    of_ids = F.col("doc_id").eqNullSafe(component_id)
    of_none = F.col("doc_id").isNotNull() | F.col("component").isNull() | (F.col("content") == F.col("least_content"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), (of_ids & of_none).alias("kept"), "content", "component")
