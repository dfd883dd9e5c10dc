"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant (MCD).

Text statistics come from built-in functions alone: words are bound once per text inside a lambda, and repeated
three-word windows are found by sorting the windows of the text.

Documents that pass the base limits are points of four transformed statistics: log of the mean word length, and
square roots of the shares of symbols, repeated lines and repeated words.  For each group the MCD estimate is the mean
and covariance of the share ``H`` of points that a few concentration steps gather, from two starts (medians with
median deviations, and plain moments); the start that ends with the smaller determinant wins.  A step needs a
quantile of distances per group, read from counts in fine logarithmic bins, so nothing larger than a group's bins
meets in one task and results don't depend on the partitioning but for the last bits of sums.

Estimates are made per language and source, per language, and over all; a document is judged by the first of these
groups that holds ``MIN_GROUP`` points.  It is rejected when its squared distance exceeds ``CUTOFF``, the quantile of
chi-square that one in a thousand clean documents exceeds.  ``FLOORS`` are standard deviations added to each estimate,
since shares are exactly zero in most clean texts.  They follow single events in short texts, which must not reject by
themselves: one symbol or one repeated window in 50 words, and one repeated line of six, are 1.6 to 2.9 floors; the
mean length of 50 words varies by about one.  Where a group has no spread, a statistic alone rejects from about 3 % of
symbols, 42 % of repeated lines, 27 % of repeated words, or 1.41 times the mean word length.

Null and empty texts have no words and fail the base limits; null languages and sources are groups of their own.
Repeated rows are judged each for itself.  Other columns are kept as they are; columns of the given names that the
operator adds are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark.llm.base import SPACE_BYTES, materialize, text_or_empty

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
H = 0.75
#: h / F_6(q) with q the h-quantile of chi-square with 4 degrees of freedom: makes the trimmed covariance consistent.
CONSISTENCY = 1.49
STEPS = 4
MIN_GROUP = 100
#: Chi-square with 4 degrees of freedom at 99.9 %.
CUTOFF = 18.467
FLOORS = (0.08, 0.04, 0.15, 0.12)
BINS_PER_OCTAVE = 32
DIM = len(FLOORS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
UPPER = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))

    def covered(t: Column) -> Column:
        ranked = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(r: Column) -> Column:
            same = F.transform(
                F.sequence(F.lit(1), F.size(r) - 1), lambda j: F.when(r[j]["x"] == r[j - 1]["x"], F.array(r[j - 1]["i"], r[j]["i"]))
            )
            starts = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_bind(ranked, twice))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bind(windows, covered))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``STATS`` and ``base_failed``."""
    text = text_or_empty(text_col)
    words = F.filter(F.split(text, f"[{SPACE_BYTES}]+"), lambda x: x != "")
    counts = _bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_BYTES}]"))
    line_counts = _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (*STATS, "base_failed")]
    rows = docs.select(
        *others,
        counts.alias("__counts"),
        line_counts.alias("__lines"),
        F.char_length(F.translate(text, SPACES, "")).alias("__chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("__symbols"),
    )
    n, repeated = F.col("__counts.n").cast("long"), F.col("__counts.r").cast("long")
    return rows.select(
        *others,
        n.alias("n_words"),
        F.col("__chars").cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.col("__lines.n") - F.col("__lines.d")).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.col("__lines.n").cast("long").alias("n_lines"),
        ((n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)).alias("base_failed"),
    )


def _vector() -> list[Column]:
    """The transformed statistics; only asked of documents with words."""
    return [
        F.log(F.col("word_chars") / F.col("n_words")),
        F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / F.col("n_words")),
    ]


def _moments(points: DataFrame, scale: float) -> DataFrame:
    """Means ``__m0..`` and covariances ``__s00..`` per ``g, start``."""
    sums = [F.avg(f"__x{i}").alias(f"__m{i}") for i in range(DIM)] + [
        F.avg(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"p{i}{j}") for i, j in UPPER
    ]
    rows = points.groupBy("g", "start").agg(*sums)
    return rows.select(
        "g",
        "start",
        *[f"__m{i}" for i in range(DIM)],
        *[(scale * (F.col(f"p{i}{j}") - F.col(f"__m{i}") * F.col(f"__m{j}"))).alias(f"__s{i}{j}") for i, j in UPPER],
    )


def _factors(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``__l00..`` of covariance plus floors, and its log determinant."""
    rows = estimates
    for i, j in UPPER:
        inner = reduce(add, [F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}") for k in range(j)], F.lit(0.0))
        floor = FLOORS[i] ** 2 if i == j else 0.0
        rest = F.col(f"__s{i}{j}") + floor - inner
        # Rounding aside, the diagonal never falls below its floor.
        rows = rows.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floor / 2))) if i == j else rest / F.col(f"__l{j}{j}"))
    return rows.withColumn("logdet", reduce(add, [2 * F.log(f"__l{i}{i}") for i in range(DIM)]))


def _distance(rows: DataFrame, out: str) -> DataFrame:
    """Adds the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIM):
        inner = reduce(add, [F.col(f"__l{i}{k}") * F.col(f"__y{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"__y{i}", (F.col(f"__x{i}") - F.col(f"__m{i}") - inner) / F.col(f"__l{i}{i}"))
    squared = reduce(add, [F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(DIM)])
    return rows.withColumn(out, squared).drop(*[f"__y{i}" for i in range(DIM)])


def _nearest_share(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """The share ``H`` of each group's points with the smallest distances; a bin's points come or go together."""
    rows = _distance(points.join(_factors(estimates), ["g", "start"]), "d2")
    rows = rows.withColumn("bin", F.floor(F.log2(1 + F.col("d2") * 16) * BINS_PER_OCTAVE).cast("int"))
    bins = rows.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_group = bins.groupBy("g", "start").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("last"))
    reached = F.aggregate(
        "bins",
        start,
        lambda s, b: F.when(s["seen"] >= F.col("total") * H, s).otherwise(
            F.struct((s["seen"] + b["n"]).alias("seen"), b["bin"].alias("last"))
        ),
    )
    limits = per_group.select("g", "start", reached["last"].alias("last"))
    kept = rows.select("g", "start", "bin", *[f"__x{i}" for i in range(DIM)]).join(limits, ["g", "start"])
    return kept.where("bin <= last").drop("bin", "last")


def _groups() -> list[Column]:
    """Names of a document's groups, the narrowest first."""
    lang = F.coalesce(F.concat(F.lit("l:"), F.col("__lang")), F.lit("n"))
    source = F.coalesce(F.concat(F.lit("s:"), F.col("__source")), F.lit("n"))
    return [F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("[]")]


def mcd_estimates(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per group ``g``: ``n``, means, Cholesky factor; from ``g, __x0..``."""
    xs = [f"__x{i}" for i in range(DIM)]
    counts = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5).alias(f"__m{i}") for i, x in enumerate(xs)])
    counts = materialize(counts, "mcd-medians")
    away = points.join(counts.drop("n"), "g")
    deviations = away.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"__m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(xs)])
    median_start = counts.join(deviations, "g").select(
        "g",
        F.lit("median").alias("start"),
        *[f"__m{i}" for i in range(DIM)],
        *[(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"__s{i}{j}") for i, j in UPPER],
    )
    starts = F.explode(F.array(F.lit("median"), F.lit("mean"))).alias("start")
    both = points.select("g", starts, *xs)
    mean_start = _moments(points.withColumn("start", F.lit("mean")), 1.0)
    estimates = materialize(median_start.unionByName(mean_start), "mcd-start")
    for _ in range(steps):
        estimates = materialize(_moments(_nearest_share(both, estimates), CONSISTENCY), "mcd-step")
    factors = _factors(estimates)
    best = factors.groupBy("g").agg(F.min_by(F.struct(*[c for c in factors.columns if c != "g"]), F.struct("logdet", "start")).alias("e"))
    wanted = [f"__m{i}" for i in range(DIM)] + [f"__l{i}{j}" for i, j in UPPER]
    return materialize(best.join(counts.select("g", "n"), "g").select("g", "n", *[F.col(f"e.{c}").alias(c) for c in wanted]), "mcd-estimates")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if None) with ``STATS``, ``base_failed``, ``distance`` (squared, null where
    base limits failed) and ``kept``."""
    carry = list(docs.columns) if carry is None else carry
    carry = [c for c in carry if c not in (*STATS, "base_failed", "distance", "kept")]
    groups = [F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source")]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], *groups, F.col(text_col).alias("__text"))
    stats = text_statistics(rows, "__text").drop("__text")
    stats = materialize(stats, "mcd-statistics")
    xs = [x.alias(f"__x{i}") for i, x in enumerate(_vector())]
    points = stats.where("not base_failed").select(F.explode(F.array(*_groups())).alias("g"), *xs)
    estimates = mcd_estimates(points)
    large = estimates.where(F.col("n") >= MIN_GROUP).select("g", F.struct(*[c for c in estimates.columns if c not in ("g", "n")]).alias("e"))
    whole = estimates.where(F.col("g") == "[]").select("g", F.struct(*[c for c in estimates.columns if c not in ("g", "n")]).alias("e"))
    # Groups are few against documents; each level is a left join on the group's name.
    judged = stats.select(*[F.col(f"`{c}`") for c in stats.columns], *[g.alias(f"__g{i}") for i, g in enumerate(_groups())])
    for i in range(3):
        side = (large if i < 2 else whole).select(F.col("g").alias(f"__g{i}"), F.col("e").alias(f"__e{i}"))
        judged = judged.join(side, f"__g{i}", "left")
    fields = [f"__m{i}" for i in range(DIM)] + [f"__l{i}{j}" for i, j in UPPER]
    chosen = judged.withColumn("__e", F.coalesce("__e0", "__e1", "__e2"))
    passed = ~F.col("base_failed")
    chosen = chosen.select(
        *[F.col(f"`{c}`") for c in (*carry, *STATS, "base_failed")],
        *[F.when(passed, x).alias(f"__x{i}") for i, x in enumerate(_vector())],
        *[F.col(f"__e.{c}").alias(c) for c in fields],
    )
    out = _distance(chosen, "distance")
    return out.select(
        *[F.col(f"`{c}`") for c in (*carry, *STATS, "base_failed", "distance")],
        (passed & (F.col("distance") <= CUTOFF)).alias("kept"),
    )
