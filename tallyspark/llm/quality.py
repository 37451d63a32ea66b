"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Base rules per text: fewer than ``MIN_WORDS`` words, or over 20 % of its words lie
in 5-word windows that the text repeats.

Method: each text becomes a vector of four transformed statistics (log mean word
length, symbols per word, repeated lines, repeated windows).  For each (language,
source) unit the minimum-covariance-determinant estimate is found by C-steps: the
``SUPPORT`` share of vectors nearest to the current centre gives the next centre
and covariance; two starts run side by side and the smaller determinant wins.  A
text is rejected when its squared Mahalanobis distance passes the chi-square
quantile ``CONFIDENCE``.  ``FLOORS`` are added to the covariance's diagonal, so a
statistic that hardly varies in clean text does not reject its first deviation.

Vectors are fixed-point integers and all moments are exact sums, so a result does
not depend on partitions.  The nearest share is cut on a histogram of log distance,
counted per unit and bin.  Only DataFrame functions are used.

Defined results: a null text has no words and fails the base rules; null language
or source is a unit like any other; sources with under ``MIN_UNIT`` passing texts
pool into a unit of their language; a pooled unit still under it keeps what
passes the base rules; an empty table gives an empty result; other columns,
whatever their names, come back unchanged; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, store, unused

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW_WORDS = 5

UNITS_PER_ONE = 10_000  # fixed point of a statistic
SHRINK = 30  # words of prior weight, which steadies the ratios of short texts
FLOORS = (0.06, 0.10, 0.10, 0.10)  # standard deviations added to every covariance
SUPPORT = 0.75
MIN_UNIT = 50
STEPS = 3
CONFIDENCE = 1 - 1e-7
BINS_PER_DOUBLING = 32
DIM = 4
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more among ``grams`` (one window a start)."""
    w = WINDOW_WORDS

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(w), F.coalesce(F.get(starts, k + 1) - x, F.lit(w))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])), covered)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(pairs, repeated))


def measure(text: Column) -> Column:
    """Struct of counts of one text, each long."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    empty = F.array().cast("array<string>")
    words = F.when(trimmed == "", empty).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW_WORDS),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW_WORDS)]),
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) <= WINDOW_WORDS, 0).otherwise(let(grams, _repeat_words)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        n = F.size(x).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    both = F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"))
    return let(
        both,
        lambda b: F.struct(
            b["w"]["n_words"].alias("n_words"),
            b["w"]["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            b["l"]["n_lines"].alias("n_lines"),
            b["l"]["n_dup_lines"].alias("n_dup_lines"),
            b["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def vector(m: Column) -> list[Column]:
    """The transformed statistics in fixed point."""
    n = m["n_words"] + SHRINK
    raw = [
        F.log((m["word_chars"] + 5 * SHRINK) / n),
        F.sqrt(m["n_symbols"] / n),
        F.sqrt(m["n_dup_lines"] / (m["n_lines"] + 5)),
        F.sqrt(m["n_repeat_words"] / n),
    ]
    return [F.round(x * UNITS_PER_ONE).cast("long") for x in raw]


def chi_square_quantile(share: float, dim: int = DIM) -> float:
    """Quantile for an even number of dimensions, by bisection on the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, dim) < share else (low, mid)
    return high


def chi_square_share(x: float, dim: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def _estimates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Centre c0.., inverse covariance p00.. and determinant of the vectors x0.. per ``by`` (exact sums)."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = [exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)]
    cross = [exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)
    col = lambda name: F.col(name).cast("double")
    out = out.withColumns({f"c{i}": col(f"s{i}") / F.col("n") for i in range(DIM)})
    # consistency: the covariance of the nearest share understates that of a normal bulk
    inside = SUPPORT / chi_square_share(chi_square_quantile(SUPPORT), DIM + 2)
    cov = {(i, j): inside * (col(f"s{i}{j}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}")) for i, j in PAIRS}
    for i in range(DIM):
        cov[i, i] = F.greatest(cov[i, i], F.lit(0.0)) + (FLOORS[i] * UNITS_PER_ONE) ** 2
    out = out.withColumns({f"v{i}{j}": c for (i, j), c in cov.items()})
    for i in range(DIM):  # Cholesky factor, row by row
        for j in range(i):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
        rest = F.col(f"v{i}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{i}{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"l{i}{i}", F.sqrt(rest))
    for j in range(DIM):  # its inverse, column by column
        out = out.withColumn(f"m{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, DIM):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"m{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"m{i}{j}", -rest / F.col(f"l{i}{i}"))
    inverse = {f"p{i}{j}": sum((F.col(f"m{k}{i}") * F.col(f"m{k}{j}") for k in range(i, DIM)), F.lit(0.0)) for i, j in PAIRS}
    logdet = sum((F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0))
    out = out.withColumns(inverse).withColumn("logdet", logdet)
    return out.select(*by, "n", "logdet", *[f"c{i}" for i in range(DIM)], *inverse)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under c0.., p00.. of the same row."""
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(DIM)]
    return sum(((1 if i == j else 2) * F.col(f"p{i}{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(1 + d2) * BINS_PER_DOUBLING)


def _nearest_share(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per unit the last bin of the nearest ``SUPPORT`` share of its rows."""
    running = Window.partitionBy(*by).orderBy("bin")
    total = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(total))
    return counts.where(F.col("upto") >= F.col("all") * SUPPORT).groupBy(*by).agg(F.min("bin").alias("last_bin"))


def fit(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD estimate per unit of ``vectors`` (unit, x0..): centre and inverse covariance.

    Rows stay where they are; each step joins them with a table of one row a
    unit, which is written out so that Spark sees its size.
    """
    by = ["unit", "start"]
    twice = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    # start 0: all vectors; start 1: the vectors in the middle half of every statistic's coarse histogram
    first = _estimates(vectors.withColumn("start", F.lit(0)), by)
    spread = vectors.select("unit", F.posexplode(F.array(*[f"x{i}" for i in range(DIM)])).alias("k", "x"))
    spread = spread.select("unit", "k", F.round(F.col("x") / 250).alias("bin"))
    running = Window.partitionBy("unit", "k").orderBy("bin")
    counts = spread.groupBy("unit", "k", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(running)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("unit", "k"))
    )
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    box = counts.groupBy("unit", "k").agg(quarter(0.2).alias("low"), quarter(0.8).alias("high"))
    side = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    box = store(box.groupBy("unit").agg(*[side(k, c) for k in range(DIM) for c in ("low", "high")]), "mcd")
    inner = [F.round(F.col(f"x{k}") / 250).between(F.col(f"low{k}"), F.col(f"high{k}")) for k in range(DIM)]
    middle = vectors.join(box, "unit").where(sum((F.when(c, 1).otherwise(0) for c in inner), F.lit(0)) >= DIM - 1)
    second = _estimates(middle.select("unit", *[f"x{i}" for i in range(DIM)]).withColumn("start", F.lit(1)), by)
    now = store(first.unionByName(second), "mcd")
    for _ in range(steps):
        binned = twice.join(now, by).withColumn("bin", _bin(_distance()))
        cut = store(_nearest_share(binned, by), "mcd")
        now = store(_estimates(binned.join(cut, by).where("bin <= last_bin").select(*by, *[f"x{i}" for i in range(DIM)]), by), "mcd")
    best = F.row_number().over(Window.partitionBy("unit").orderBy("logdet", "start"))
    return store(now.withColumn("nth", best).where("nth = 1").drop("nth", "start"), "mcd")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` and the columns quality (counts), base_failed, distance, kept (names get ``_`` where taken).

    The measured rows are stored once, so texts are read and measured once.
    """
    q, failed, dist, kept, unit = (unused(x, docs.columns) for x in ("quality", "base_failed", "distance", "kept", "unit"))
    measured = docs.withColumn(q, measure(F.col(text_col))).withColumn(failed, base_failed(F.col(q)))
    measured = store(measured, "quality")
    own = F.concat(F.lit("source"), F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))))
    pooled = F.concat(F.lit("pooled"), F.to_json(F.struct(F.col(lang_col).alias("l"))))
    rows = measured.where(~F.col(failed)).select(own.alias("own"), pooled.alias("pooled"), *[
        x.alias(f"x{i}") for i, x in enumerate(vector(F.col(q)))
    ])
    sizes = store(rows.groupBy("own").agg(F.count(F.lit(1)).alias("size")), "mcd")
    large = sizes.where(F.col("size") >= MIN_UNIT).select("own")
    units = rows.join(large.withColumn("large", F.lit(True)), "own", "left")
    units = units.withColumn("unit", F.when(F.col("large"), F.col("own")).otherwise(F.col("pooled")))
    units = store(units.select("unit", *[f"x{i}" for i in range(DIM)]), "mcd")
    held = store(units.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_UNIT), "mcd")
    model = fit(units.join(held.select("unit"), "unit", "left_semi"))
    # the model of a row: that of its own source, else the pooled one
    x = {f"x{i}": e for i, e in enumerate(vector(F.col(q)))}
    model = model.select("unit", *[c for c in model.columns if c[0] in "cp"])
    names = {c: unused(c, [*docs.columns, q, failed, "unit"]) for c in model.columns}
    d = [x[f"x{i}"] - F.col(names[f"c{i}"]) for i in range(DIM)]
    d2 = sum(((1 if i == j else 2) * F.col(names[f"p{i}{j}"]) * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))
    large_name = unused("large", docs.columns)
    own_name = unused("own", docs.columns)
    out = measured.withColumn(own_name, own)
    out = out.join(large.select(F.col("own").alias(own_name), F.lit(True).alias(large_name)), own_name, "left")
    out = out.withColumn(unit, F.when(F.col(large_name), F.col(own_name)).otherwise(pooled))
    out = out.join(model.select(*[F.col(c).alias(unit if c == "unit" else n) for c, n in names.items()]), unit, "left")
    out = out.withColumn(dist, d2)
    verdict = ~F.col(failed) & F.coalesce(F.col(dist) <= chi_square_quantile(CONFIDENCE), F.lit(True))
    return out.withColumn(kept, verdict).select(*docs.columns, q, failed, dist, kept)
