r"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every document gets a vector of transformed statistics. For each language and source the minimum
covariance determinant (MCD) estimate is searched from two starts, medians with quartile ranges
and the plain mean and covariance. A concentration step takes the ``SUPPORT`` share of documents
nearest in Mahalanobis distance and re-estimates mean and covariance from them; steps go on until
no determinant falls any more, and each group takes the start that ended with the smaller one.
Documents whose distance from it exceeds the cutoff are rejected.

Distances are binned on a fine logarithmic grid, and counts and moments are kept per (group, bin);
of the bin in which the share ends, the fitting fraction counts. One concentration step is
therefore one map-side-combined aggregation whose result has at most ``BINS`` rows a group and
start; no group is ever gathered, however many documents it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid.llm.durable import Store
from symbolgrid.llm.native import let

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SUPPORT = 0.7
#: Concentration steps at most, and the fall of a log determinant below which they end.
STEPS, FALL = 8, 0.01
#: Bins per doubling of the squared distance, and the range of the grid (2**-10 to 2**30).
BINS_PER_DOUBLING, LOWEST, HIGHEST = 8, -10, 30
#: Smallest standard deviation of each transformed statistic: differences below it mean nothing.
FLOORS = (0.12, 0.2, 0.25, 0.2, 0.25)
#: Weight, in documents, of the floors in a group's covariance; steadies groups of few documents.
PRIOR = 10.0
#: A chi-square variable with five degrees of freedom: its median, and as the cutoff its 0.99999
#: quantile: of 100,000 documents that vary as their group does, one is rejected.
CHI2_MEDIAN, CUTOFF = 4.351, 30.856
P = len(FLOORS)
FEATURES = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array.

    Window hashes and their positions are packed in one long each and sorted, so equal windows
    are neighbours: n log n for any text, no quadratic search.
    """

    def of(h: Column, n: Column) -> Column:
        room = F.floor(F.lit(1 << 61) / n).cast("long")

        def pack(i: Column) -> Column:
            return F.pmod(F.xxhash64(*[F.get(h, i + k) for k in range(width)]), room) * n + i

        def covered(v: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                p, q = F.pmod(a, n).cast("int"), F.pmod(b, n).cast("int")
                words_too = F.slice(h, p + 1, width) == F.slice(h, q + 1, width)
                return F.coalesce(((a - p) == (b - q)) & words_too, F.lit(False))

            twice = F.filter(v, lambda x, i: same(x, F.get(v, i - 1)) | same(x, F.get(v, i + 1)))
            starts = F.sort_array(F.transform(twice, lambda x: F.pmod(x, n)))
            zero = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(width).cast("long"), p - acc["last"])).alias("sum"))
            return F.aggregate(starts, zero, step, lambda acc: acc["sum"])

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), (n - width).cast("int")), pack)), covered)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) > width, of(h, F.size(h).cast("long"))).otherwise(F.lit(0).cast("long")))


def base_statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    )
    per_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    )
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    return {
        "per_words": per_words,
        "per_lines": per_lines,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": count(SYMBOLS),
        "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, content key, lang, source (null: empty), the base statistics and the vector x0..x4."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    parts = docs.select(
        "doc_id",
        key.alias("content"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        *[c.alias(name) for name, c in base_statistics(F.col("text")).items()],
    )
    base = parts.select(
        "doc_id", "content", "lang", "source", "per_words.n_words", "word_chars", "n_symbols",
        F.col("per_lines.dup").alias("n_dup_lines"), "per_words.n_repeat_words",
        F.col("per_lines.n").alias("n_lines"), "n_upper",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = lambda part, whole, pad: F.log1p(10 * F.col(part) / (F.col(whole) + pad))
    vector = [
        F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        share("n_symbols", "n_words", 20),
        share("n_dup_lines", "n_lines", 5),
        share("n_repeat_words", "n_words", 20),
        share("n_upper", "word_chars", 100),
    ]
    return base.withColumn("base_failed", failed).withColumns(dict(zip(FEATURES, vector, strict=True)))


def cholesky(frame: DataFrame) -> DataFrame:
    """Adds l_i_j, the factor of the covariance in c_i_j, as plain columns."""
    for j in range(P):
        inner = reduce(lambda a, b: a - b, [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{j}_{j}"))
        frame = frame.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, P):
            inner = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{i}_{j}"))
            below[f"l_{i}_{j}"] = inner / F.col(f"l_{j}_{j}")
        frame = frame.withColumns(below) if below else frame
    return frame.withColumn("log_det", reduce(lambda a, b: a + b, [2 * F.log(f"l_{j}_{j}") for j in range(P)]))


GROUP = ["lang", "source"]


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the estimate of the row's group."""
    joined = rows.join(estimate, GROUP)
    for i in range(P):
        inner = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)], F.col(f"x{i}") - F.col(f"m_{i}"))
        joined = joined.withColumn(f"y_{i}", inner / F.col(f"l_{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(P)])
    keep = [c for c in joined.columns if not c.startswith(("y_", "l_", "m_", "c_"))]
    return joined.select(*keep, d2.alias("d2"))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, sums and sums of products of the vector for each value of the keys."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s_{i}") for i in range(P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s_{i}_{j}") for i, j in PAIRS],
    )


def from_moments(sums: DataFrame, *keep: str) -> DataFrame:
    """Means and factored covariances of summed moments.

    The floors are in the covariance once as what clean text may differ by, and again, with weight
    PRIOR / (n + PRIOR), as its prior.
    """
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(P)})
    spread = {}
    for i, j in PAIRS:
        cov = F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
        floor = FLOORS[i] ** 2 if i == j else 0.0
        spread[f"c_{i}_{j}"] = (cov * F.col("n") + PRIOR * floor) / (F.col("n") + PRIOR) + floor
    names = [f"m_{i}" for i in range(P)] + [f"c_{i}_{j}" for i, j in PAIRS]
    return cholesky(out.withColumns(spread).select(*GROUP, *keep, *names))


def starts(rows: DataFrame) -> DataFrame:
    """Estimates to begin with: start 0 of medians and quartile ranges, start 1 of plain moments."""
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = rows.groupBy(*GROUP).agg(*[F.percentile_approx(f"x{i}", quartiles, 2000).alias(f"q{i}") for i in range(P)])
    spread = {f"c_{i}_{j}": F.lit(0.0) for i, j in PAIRS}
    for i in range(P):
        scale = F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
        spread[f"c_{i}_{i}"] = scale * scale
    robust = q.select(*GROUP, F.lit(0).alias("start"), F.lit(1.0).alias("scale"), *[F.col(f"q{i}")[1].alias(f"m_{i}") for i in range(P)], *[c.alias(n) for n, c in spread.items()])
    plain = moments(rows, *GROUP).withColumns({"start": F.lit(1), "scale": F.lit(1.0)})
    return cholesky(robust).unionByName(from_moments(plain, "start", "scale"))


def concentrate(store: Store, rows: DataFrame, estimate: DataFrame, name: str) -> DataFrame:
    """One concentration step; ``scale`` makes the median squared distance that of chi-square.

    Counting the floors twice (see from_moments) makes distances too small by 1 + PRIOR / (n +
    PRIOR) at most. It is the least that ``scale`` takes back.
    """
    grid = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**LOWEST))) * BINS_PER_DOUBLING)
    binned = with_distance(rows, estimate.drop("scale", "log_det")).withColumn("bin", F.least(grid, F.lit(HIGHEST * BINS_PER_DOUBLING)))
    # As a table it has a row a bin; without, a window's task would get one of each map task.
    found = store.put(f"moments{name}", moments(binned, *GROUP, "start", "bin"), files=4)
    group = Window.partitionBy(*GROUP, "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumns({"before": before, "all": F.sum("n").over(group)})
    middle = F.when(F.col("before") + F.col("n") >= 0.5 * F.col("all"), F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_DOUBLING))
    part = F.least(F.greatest((F.ceil(SUPPORT * F.col("all")) - F.col("before")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    names = ["n", *[f"s_{i}" for i in range(P)], *[f"s_{i}_{j}" for i, j in PAIRS]]
    sums = ranked.groupBy(*GROUP, "start").agg(F.min(middle).alias("median"), *[F.sum(part * F.col(c)).alias(c) for c in names])
    scale = F.greatest(F.col("median") / CHI2_MEDIAN, 1 / (1 + PRIOR / (F.col("n") + PRIOR)))
    # A table's size is known to the planner: while it is small, no document is dealt by its group.
    return store.put(f"estimate{name}", from_moments(sums.withColumn("scale", scale), "start", "scale"), files=1)


def estimates(store: Store, rows: DataFrame) -> DataFrame:
    """Per group the estimate of the smaller determinant, from rows(lang, source, x0..x4)."""
    estimate = store.put("starts", starts(rows), files=1)
    for step in range(STEPS):
        after = concentrate(store, rows, estimate, str(step))
        both = after.join(estimate.select(*GROUP, "start", F.col("log_det").alias("last")), [*GROUP, "start"])
        fall = both.agg(F.max(F.abs(F.col("last") - F.col("log_det"))).alias("fall")).first()["fall"]
        estimate = after
        if fall is None or fall < FALL:
            break
    columns = [c for c in estimate.columns if c not in (*GROUP, "start")]
    best = estimate.groupBy(*GROUP).agg(F.min(F.struct("log_det", "start", *[c for c in columns if c != "log_det"])).alias("best"))
    return store.put("best", best.select(*GROUP, *[F.col(f"best.{c}").alias(c) for c in columns]), files=1)


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, content, base statistics, base_failed, distance, kept.

    Columns used: doc_id, text, lang, source; others are ignored. Null text is empty, null lang or
    source are a group of their own. An empty table gives no rows; a group of one document keeps
    it unless the base rules fail it. Repeated rows are judged alike, each on its own. Texts of any
    length are taken whole; one text's words are arrays of one row.
    """
    store = Store(spark, "outliers")
    rows = store.put("statistics", statistics(docs))
    # What the base rules reject is no evidence of how clean text looks.
    sound = rows.filter(~F.col("base_failed")).select(*GROUP, *FEATURES)
    near = with_distance(rows.filter(~F.col("base_failed")), estimates(store, sound).drop("log_det"))
    store.keep("statistics", "best")
    distance = F.sqrt(F.col("d2") / F.col("scale"))
    out = ["doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = near.select(*out, distance.alias("distance"), (F.col("d2") <= CUTOFF * F.col("scale")).alias("kept"))
    failed = rows.filter("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)
