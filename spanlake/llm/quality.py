"""Quality rules by robust multivariate outliers.

Every document gets counts over its words; transformed, they form a statistic vector. For each
language and source the minimum-covariance-determinant estimate is found by concentration
steps over all of the group's documents: from each of four deterministic starts, the half with the
least Mahalanobis distances gives the next mean and covariance. The start that reaches the least
determinant goes on until the determinant falls no more. Documents whose distance from
the final (reweighted) estimate is beyond a chi-square quantile are rejected.

Statistics are whole multiples of 1e-4, and their sums exact, so the estimates do not depend on
the order of rows. Groups of any size are aggregated before any shuffle: distances are counted
in narrow classes, and only class counts and moments move.

Defined results: a null text has no words; null languages or sources form groups like others;
groups with fewer than MIN_GROUP usable documents take the estimate of all documents; variances
never fall under a floor, so groups of equal documents are kept; equal rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import map_batches, materialize, read

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: Steps from every start, and at most so many more from the best one.
STEPS, FURTHER, HALF, MIN_GROUP = 3, 10, 0.5, 30
#: Growth of the covariance of the rows within the cut.
REWEIGHTED = 1.05
#: A fall of the determinant's logarithm that counts.
FALL = 0.01
#: chi-square quantile (5 degrees of freedom, p = 1 - 1e-6) beyond which a document is an outlier.
CUT = 35.89
#: Documents' statistics are pulled toward a typical text by so many words, so that short texts do not look extreme.
PULL = 60
NAMES = ("word_length", "symbols", "dup_lines", "repeats", "variety")
#: Least standard deviation of each statistic.
FLOOR = (0.18, 0.02, 0.06, 0.06, 0.06)
UNIT = 10_000
CLASSES = 64
#: Groups (languages times sources) up to which their estimates are broadcast, a few hundred bytes each.
BROADCAST_GROUPS = 100_000


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ws = data.split()
    n = len(ws)
    chars = sum(map(len, ws))
    if not data.isascii():
        # continuation bytes are no code points of their own
        chars -= int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(data.count, (bytes([s]) for s in SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    of: dict[bytes, int] = {}
    ids = [of.setdefault(w, len(of)) for w in ws]
    repeats = repeat_words(np.array(ids, np.int64)) if n > REPEAT_WINDOW else 0
    return n, chars, symbols, dup, repeats, len(of)


def repeat_words(ids: np.ndarray) -> int:
    """Words inside eight-word windows that occur at least twice; windows are named exactly, by doubling."""
    name, width = ids, 1
    while width < REPEAT_WINDOW:
        pair = name[:-width] * (int(name.max()) + 1) + name[width:]
        _, name = np.unique(pair, return_inverse=True)
        if len(name) == int(name.max()) + 1 and width * 2 <= REPEAT_WINDOW:
            return 0  # all windows of this width differ, so all wider ones do
        width *= 2
    again = np.bincount(name)[name] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(n: int, chars: int, symbols: int, dup: int, repeats: int, distinct: int) -> tuple[int, ...]:
    """The transformed vector, in whole multiples of 1 / UNIT."""
    held = n + PULL
    values = (
        (chars + 5.0 * PULL) / held,
        math.sqrt(symbols / held),
        math.sqrt(dup / (n / 10 + 6)),
        math.sqrt(repeats / held),
        # Heaps' law: distinct words against a power of the length
        math.log(distinct + 0.8 * PULL) - 0.85 * math.log(held),
    )
    return tuple(round(v * UNIT) for v in values)


def document_statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the vector's coordinates x0, x1, …"""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    xs = [f"x{i}" for i in range(len(NAMES))]

    def make():
        def work(cols):
            got = [base_counts(t) for t in cols.pop("text")]
            vectors = [statistics(*g) for g in got]
            return cols | {c: [g[i] for g in got] for i, c in enumerate(counts)} | {x: [v[i] for v in vectors] for i, x in enumerate(xs)}

        return work

    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in (*counts, *xs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return map_batches(docs, make, schema, "text").withColumn("base_failed", failed)


def distance(xs: list[str], mean: str = "mean", inverse: str = "inverse") -> F.Column:
    """Squared Mahalanobis distance of the row's vector by the row's mean and inverse covariance (flat, by rows)."""
    p = len(xs)
    d = [F.col(x) - F.col(mean)[i] for i, x in enumerate(xs)]
    return sum((d[i] * d[j] * F.col(inverse)[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def moments(xs: list[str]) -> list:
    """Exact sums: whole numbers in decimals."""
    whole = lambda c: c.cast("decimal(20,0)")
    return [F.count("*").alias("n"), *[F.sum(whole(F.col(x))).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(whole(F.col(xs[i]) * F.col(xs[j]))).alias(f"q{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]]


def consistency(half: float) -> float:
    """By what the covariance of a normal's central share is too small, in five dimensions."""
    if half >= 1:
        return 1.0
    tail = lambda x: math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    below5 = lambda x: math.erf(math.sqrt(x / 2)) - tail(x) * (1 + x / 3)
    low, high = 0.0, 200.0
    for _ in range(100):
        at = (low + high) / 2
        low, high = (at, high) if below5(at) < half else (low, at)
    return half / (below5(low) - tail(low) * low**2 / 15)


def covariance(row: dict, p: int) -> tuple[list[float], np.ndarray]:
    """Mean and covariance from a row of moments."""
    from fractions import Fraction

    n = int(row["n"])
    mean = [Fraction(int(row[f"s{i}"]), n) for i in range(p)]
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = float(Fraction(int(row[f"q{i}_{j}"]), n) - mean[i] * mean[j])
    return [float(m) for m in mean], cov


def solved(mean: list[float], cov: np.ndarray) -> dict:
    """Mean, inverse covariance (flat) and the covariance's log determinant, with floored variances."""
    cov = cov + np.diag([(f * UNIT) ** 2 for f in FLOOR[: len(mean)]])
    return {"mean": mean, "inverse": np.linalg.inv(cov).flatten().tolist(), "logdet": float(np.linalg.slogdet(cov)[1])}


ESTIMATE = "key string, start int, mean array<double>, inverse array<double>, logdet double"


def solve(rows: DataFrame, of: Callable[[dict], dict]) -> DataFrame:
    """key, start and the estimate that ``of`` makes of each row."""

    def make():
        def work(cols):
            made = [of(dict(zip(cols, r, strict=True))) for r in zip(*cols.values(), strict=True)]
            return {"key": cols["key"], "start": cols["start"]} | {c: [m[c] for m in made] for c in ("mean", "inverse", "logdet")}

        return work

    return map_batches(rows, make, ESTIMATE)


def robust_estimates(stats: DataFrame, group: list[str], xs: list[str], *, steps: int = STEPS, half: float = HALF, min_group: int = MIN_GROUP, cut: float = CUT, reweighted: bool = True) -> DataFrame:
    """key, mean, inverse and logdet: for each group with at least ``min_group`` rows its MCD estimate, reweighted by the rows within the cut.

    Estimates are a table of a few hundred bytes a group, solved by the executors.
    """
    p = len(xs)
    key = F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]), {"ignoreNullFields": "false"}) if group else F.lit("all")
    rows = stats.withColumn("key", key).select("key", *xs)

    def estimates(kept: DataFrame, grow: float) -> DataFrame:
        def of(row):
            mean, cov = covariance(row, p)
            return solved(mean, cov * grow)

        return solve(kept.groupBy("key", "start").agg(*moments(xs)), of)

    def concentrated(found: DataFrame) -> DataFrame:
        """One concentration step of every start."""
        near = rows.join(few(found.select("key", "start", "mean", "inverse")), "key").withColumn("d2", distance(xs))
        near = near.withColumn("klass", F.floor(F.log(F.col("d2") + 1e-3) * CLASSES).cast("int"))
        counted = near.groupBy("key", "start", "klass").agg(F.count("*").alias("n"))
        by = Window.partitionBy("key", "start")
        upto = counted.withColumns({"upto": F.sum("n").over(by.orderBy("klass")), "total": F.sum("n").over(by)})
        bound = upto.filter(F.col("upto") >= half * F.col("total")).groupBy("key", "start").agg(F.min("klass").alias("most"))
        # consistency: the central share of a normal has a smaller covariance
        return materialize(estimates(near.join(few(bound), ["key", "start"]).filter("klass <= most"), consistency(half)), "estimates")

    # Starts: medians and median absolute deviations, by counts of narrow classes of each coordinate.
    middle = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(xs)]).filter(F.col("n") >= min_group)
    middle = materialize(middle, "medians")
    few = F.broadcast if middle.count() <= BROADCAST_GROUPS else lambda df: df
    spread = rows.join(few(middle), "key").groupBy("key").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"d{i}") for i, x in enumerate(xs)])
    deviation = lambda i: F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) + (FLOOR[i] * UNIT) ** 2)
    scales = middle.join(spread, "key").select("key", F.array(*[F.col(f"m{i}").cast("double") for i in range(p)]).alias("m"), F.array(*[deviation(i) for i in range(p)]).alias("sd"))
    scales = materialize(scales, "scales")

    def diagonal(row):
        return {"mean": row["m"], "inverse": np.diag(1 / np.square(row["sd"])).flatten().tolist(), "logdet": 0.0}

    def rescaled(row):
        shape = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                shape[i, j] = shape[j, i] = float(row[f"q{i}_{j}"]) / int(row["n"]) / UNIT**2 * row["sd"][i] * row["sd"][j]
        return solved(row["m"], shape)

    found = solve(scales.withColumn("start", F.lit(0)), diagonal)
    # … the covariance of all rows, of their hyperbolic tangents and of their spatial signs; the last two about the medians.
    scaled = rows.join(few(scales), "key")
    found = found.unionByName(estimates(scaled.withColumn("start", F.lit(1)), 1.0))
    z = [(F.col(x) - F.col("m")[i]) / F.col("sd")[i] for i, x in enumerate(xs)]
    norm = F.sqrt(sum(v * v for v in z) + 1e-12)
    for start, bent in ((2, [F.tanh(v) for v in z]), (3, [v / norm for v in z])):
        # whole multiples of 1 / UNIT, so that sums are exact
        whole = scaled.select("key", F.lit(start).alias("start"), *[F.round(v * UNIT).cast("long").alias(x) for v, x in zip(bent, xs, strict=True)])
        found = found.unionByName(solve(whole.groupBy("key", "start").agg(*moments(xs)).join(few(scales), "key"), rescaled))
    found = materialize(found, "starts")
    for _ in range(max(1, steps)):  # the determinant is known after a step
        found = concentrated(found)
    best = found.groupBy("key").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("x"))
    found = materialize(best.select("key", "x.*", F.lit(True).alias("moves")), "best")
    for _ in range(FURTHER):
        after = concentrated(found.filter("moves")).select("key", F.struct("start", "mean", "inverse", "logdet").alias("y"))
        falls = F.coalesce(F.col("y.logdet") < F.col("logdet") - FALL, F.lit(False))
        kept = F.when(falls, F.col("y")).otherwise(F.struct("start", "mean", "inverse", "logdet"))
        found = materialize(found.join(after, "key", "left").select("key", kept.alias("x"), falls.alias("moves")).select("key", "x.*", "moves"), "best")
        if found.filter("moves").isEmpty():
            break
    if not reweighted:
        return found.select("key", "mean", "inverse", "logdet")
    final = rows.join(few(found.select("key", "start", "mean", "inverse")), "key").withColumn("d2", distance(xs)).filter(F.col("d2") <= cut)
    # the cut takes a millionth of a normal's rows and hardly any of its covariance; heavier tails lose more
    return materialize(estimates(final, REWEIGHTED).drop("start"), "estimates")


def verdicts(stats: DataFrame, *, cut: float = CUT, min_group: int = MIN_GROUP, steps: int = STEPS, half: float = HALF) -> DataFrame:
    """``stats`` with distance2 (null where there is nothing to compare with) and kept."""
    stats = materialize(stats, "statistics")
    xs = [f"x{i}" for i in range(len(NAMES))]
    usable = stats.filter("not base_failed")
    key = F.to_json(F.struct(F.col("lang").alias("g0"), F.col("source").alias("g1")), {"ignoreNullFields": "false"})
    own = robust_estimates(usable, ["lang", "source"], xs, steps=steps, half=half, min_group=min_group, cut=cut)
    every = robust_estimates(usable, [], xs, steps=steps, half=half, min_group=1, cut=cut).select(F.col("mean").alias("mean_all"), F.col("inverse").alias("inverse_all"))
    own = own.drop("logdet")
    rows = stats.withColumn("key", key).join(own if own.count() > BROADCAST_GROUPS else F.broadcast(own), "key", "left").join(F.broadcast(every), F.lit(True), "left")
    rows = rows.withColumns({"mean": F.coalesce("mean", "mean_all"), "inverse": F.coalesce("inverse", "inverse_all")})
    rows = rows.withColumn("distance2", distance(xs))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cut)).drop("key", "mean", "inverse", "mean_all", "inverse_all")


def judge(df: DataFrame, **columns) -> DataFrame:
    """doc_id, base counts, base_failed, kept, distance2."""
    return verdicts(document_statistics(df, **columns)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
