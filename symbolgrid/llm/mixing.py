"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token counts are raked: scaled to
the target share of each source, then language, then topic, over and over, until all three
marginals hold. A document's rate, the expected number of its copies in the sample, is its cell's
raked weight against the cell's tokens, times the budget. It is above 1 for scarce cells, which are
repeated; clipping it would give back the mixture there was. A hash of the document decides on the
fraction of the rate.

Topics are clusters of word profiles. A profile is the document's counts of words by hash slot, taken
against the mean profile of its language, so that a topic is not just a language. The clusters'
centres are found by rounds over all documents (spherical k-means from a fixed start), each of
which sends the driver ``TOPICS`` times ``SLOTS`` sums, whatever the corpus. Sums are of integers, so
a task that runs again adds the same.

Only cell totals are ever shuffled; a document's cell is joined back to it by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid.llm.durable import Store
from symbolgrid.llm.words import Words, filled, pieces, tidy

KEYS = ("source", "lang", "topic")
#: Topics, slots of a profile, rounds of clustering; words of fewer bytes than LEAST say little.
TOPICS, SLOTS, ROUNDS, LEAST = 8, 256, 3, 5
#: Default targets are the present shares to this power, made to sum to one: rarer gets more.
TEMPER = 0.8
SWEEPS, TOLERANCE = 20, 1e-4
#: Sweeps between two looks at the marginals.
TOGETHER = 4
#: Share of all tokens that the sample is to hold.
BUDGET = 0.9


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words, n = Words(filled(part.column("text")), lower=True), part.num_rows
            slots = words.text * SLOTS + (words.hashes % np.uint64(SLOTS)).astype(np.int64)
            counts = np.sqrt(np.bincount(slots[words.stops - words.starts >= LEAST], minlength=n * SLOTS).reshape(n, SLOTS))
            profile = np.rint(255 * counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "content", "source", "lang")), pa.array(words.counts.astype(np.int64)), pa.array([x.tobytes() for x in profile], pa.binary())],
                names=["doc_id", "content", "source", "lang", "tokens", "profile"],
            )


def _profiles(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("profile").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS).astype(np.float64)


def against(profiles: np.ndarray, langs: list[str], means: dict[str, np.ndarray]) -> np.ndarray:
    """Profiles less the mean of their language, as unit vectors; a profile of nothing stays nothing."""
    rest = profiles - np.array([means[x] for x in langs]).reshape(-1, SLOTS)
    rest[~profiles.any(axis=1)] = 0
    return rest / np.maximum(np.sqrt((rest**2).sum(axis=1, keepdims=True)), 1e-9)


def _sums(rows: DataFrame, key: str, kind: str, of) -> dict:
    """Sums of integer vectors by a key of few values: (vector, count) for each. ``of`` gives keys and vectors of a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            keys, vectors = of(batch)
            for k in dict.fromkeys(keys):
                mine = vectors[[x == k for x in keys]]
                held = total.setdefault(k, np.zeros(SLOTS + 1, dtype=np.int64))
                held[:SLOTS] += mine.sum(axis=0)
                held[SLOTS] += len(mine)
        for k, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (SLOTS + 1)), pa.array(np.arange(SLOTS + 1)), pa.array(held)], names=[key, "slot", "n"])

    table = rows.select("lang", "profile").mapInArrow(run, f"{key} {kind}, slot long, n long").groupBy(key, "slot").agg(F.sum("n").alias("n")).collect()
    out: dict = {}
    for r in table:
        out.setdefault(r[key], np.zeros(SLOTS + 1))[r["slot"]] = r["n"]
    return {k: (v[:SLOTS], v[SLOTS]) for k, v in out.items()}


def topics(rows: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Centres of the topics and mean profiles of the languages, from rows(lang, profile)."""
    found = _sums(rows, "lang", "string", lambda b: (b.column("lang").to_pylist(), _profiles(b).astype(np.int64)))
    means = {lang: total / n for lang, (total, n) in found.items()}
    centres = (np.arange(SLOTS)[None, :] % TOPICS == np.arange(TOPICS)[:, None]) / np.sqrt(SLOTS / TOPICS)
    for _ in range(ROUNDS):
        now = centres.copy()

        def assigned(batch: pa.RecordBatch, now: np.ndarray = now) -> tuple[list[int], np.ndarray]:
            vectors = against(_profiles(batch), batch.column("lang").to_pylist(), means)
            return (vectors @ now.T).argmax(axis=1).tolist(), np.rint(vectors * (1 << 20)).astype(np.int64)

        for k, (total, _) in _sums(rows, "topic", "long", assigned).items():
            if total.any():
                centres[k] = total / np.sqrt((total**2).sum())
    return centres, means


def describe(store: Store, docs: DataFrame) -> DataFrame:
    """doc_id, content, source, lang, topic, tokens. Null source or lang become the empty string; a
    text without words of LEAST bytes is of topic t0, as are ties."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), text("source"), text("lang"), "text")
    rows = store.put("profiles", rows.mapInArrow(_describe, "doc_id long, content long, source string, lang string, tokens long, profile binary"))
    centres, means = topics(rows)

    @tidy
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = (against(_profiles(batch), batch.column("lang").to_pylist(), means) @ centres.T).argmax(axis=1)
            columns = [*(batch.column(c) for c in ("doc_id", "content", "source", "lang")), pa.array([f"t{t}" for t in topic.tolist()], pa.string()), batch.column("tokens")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "source", "lang", "topic", "tokens"])

    out = store.put("rows", rows.mapInArrow(label, "doc_id long, content long, source string, lang string, topic string, tokens long"))
    store.drop("profiles")
    return out


def tempered(cells: DataFrame, key: str, temper: float = TEMPER) -> DataFrame:
    """(key, target): present token shares to the power ``temper``, made to sum to one."""
    sums = cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("raised"))
    total = sums.agg(F.sum("raised").alias("total"))
    return sums.join(F.broadcast(total)).select(key, (F.col("raised") / F.col("total")).alias("target"))  # one row


def completed(cells: DataFrame, key: str, given: DataFrame) -> DataFrame:
    """(key, target) for every category present: one that ``given`` does not list keeps its present
    share, those listed divide the rest in proportion to their targets."""
    sums = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0").join(given, key, "left")
    whole = sums.agg(F.sum("tokens").alias("all"), F.sum("target").alias("listed"), F.sum(F.when(F.col("target").isNull(), F.col("tokens"))).alias("unlisted"))
    joined = sums.join(F.broadcast(whole))  # one row
    rest = 1 - F.coalesce("unlisted", F.lit(0.0)) / F.col("all")
    return joined.select(key, F.when(F.col("target").isNull(), F.col("tokens") / F.col("all")).otherwise(F.try_divide("target", "listed") * rest).alias("target"))


def rake(store: Store, cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with ``weight``: token shares with the targets as marginals.

    A sweep scales to each marginal in turn: one window sum over the cells for each. Sweeps end when
    every marginal was within ``tolerance`` of its target before it was scaled, or after ``sweeps``.
    Categories without tokens cannot be given any; targets count relative to the categories present.
    """
    total = cells.agg(F.sum("tokens").alias("all")).collect()[0]["all"]
    present = cells.filter("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for key, target in targets.items():
        present = present.join(target.select(key, F.col("target").alias(f"target_{key}")), key)
    if not total:
        return present
    for k in range(0, sweeps, TOGETHER):
        now = present
        for _ in range(TOGETHER):
            off = F.lit(0.0)
            for key in targets:
                ratio = F.col(f"target_{key}") / F.sum("weight").over(Window.partitionBy(key))
                now = now.withColumn("ratio", ratio).withColumns({"weight": F.col("weight") * F.col("ratio"), f"off_{key}": F.abs(F.col("ratio") - 1)})
                off = F.greatest(off, F.col(f"off_{key}"))
        now = store.put(f"weights{k}", now.withColumn("off", off).drop("ratio"), files=4)
        off = now.agg(F.max("off").alias("off")).collect()[0]["off"]
        present = now.drop("off", *[f"off_{key}" for key in targets])
        if off is None or off < tolerance:
            break
    return present


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with ``rate``, the expected copies of a document: the sample's expected tokens are
    ``budget`` of all tokens, and in every cell the raked share of that."""
    total = cells.agg(F.sum("tokens").alias("all"), F.sum("weight").alias("whole"))
    joined = cells.join(F.broadcast(total))  # one row
    share = F.col("weight") / F.col("whole")
    return joined.withColumn("rate", F.lit(budget * (1 - 1e-9)) * share * F.col("all") / F.col("tokens")).drop("all", "whole")  # rounding stays within the budget


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, content, source, lang, topic, tokens, probability, selected,
    rate, copies.

    ``copies`` is how often the row is in the sample: ``rate`` rounded down or up, ``rate`` in
    expectation. ``selected`` says that it is there at all, which has ``probability``.
    ``targets`` maps source, lang or topic to target shares; a marginal not given is tempered,
    a category not listed keeps its present share.
    Columns used: doc_id, text, lang, source; others are ignored. Null source or lang are a
    category of their own. Documents without words have no tokens to weigh: rate 1.
    Repeated rows are decided alike. Texts of any length are taken whole. An empty table gives no
    rows. See ``marginals`` for what the sample holds.
    """
    store = Store(spark, "mixing")
    rows = describe(store, docs)
    cells = store.put("cells", rows.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), files=4)
    given = {key: spark.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{key} string, target double") for key, shares in (targets or {}).items()}
    # Targets are written once: a sweep reads them and does not derive them again.
    target = {key: store.put(f"target-{key}", completed(cells, key, given[key]) if key in given else tempered(cells, key), files=1) for key in KEYS}
    raked = rake(store, cells, target)
    weights = store.put("calibrated", calibrate(raked, budget).select(*KEYS, "rate"), files=4)
    store.keep("rows", "calibrated")
    joined = rows.join(weights, list(KEYS), "left")
    joined = joined.withColumn("rate", F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("rate", F.lit(0.0))))
    dice = F.shiftrightunsigned(F.xxhash64("doc_id", "content", F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    probability = F.least(F.lit(1.0), F.col("rate"))
    return joined.select("doc_id", "content", *KEYS, "tokens", probability.alias("probability"), (copies > 0).alias("selected"), "rate", copies.alias("copies"))


def marginals(sampled: DataFrame) -> DataFrame:
    """(marginal, category, present, wanted, sampled): token shares of what sample() returned: as they
    are, as the rates have them in expectation, and as the drawn copies have them."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("marginal"), F.col(k).alias("category")) for k in KEYS])).alias("of")
    each = sampled.select(parts, "tokens", "rate", "copies").groupBy("of")
    sums = each.agg(F.sum("tokens").alias("present"), F.sum(F.col("tokens") * F.col("rate")).alias("wanted"), F.sum(F.col("tokens") * F.col("copies")).alias("sampled"))
    whole = sums.groupBy("of.marginal").agg(*[F.sum(c).alias(f"all_{c}") for c in ("present", "wanted", "sampled")])
    joined = sums.select("of.*", "present", "wanted", "sampled").join(whole, "marginal")
    return joined.select("marginal", "category", *[F.try_divide(F.col(c).cast("double"), F.col(f"all_{c}")).alias(c) for c in ("present", "wanted", "sampled")])
