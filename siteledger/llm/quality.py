"""Quality rules and robust multivariate outliers, as DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated five-word windows of the whole text. For documents
that pass, a vector of transformed statistics is held against a minimum-covariance-determinant estimate of its
language and source. There are several starts: the half of the group that is nearest to the medians on all axes
together, and on each axis alone. From each, concentration steps take the half that lies nearest (by Mahalanobis
distance) and estimate mean and covariance from it again, until the determinant falls no more; the start of the
smallest determinant is kept. A document is rejected if its distance lies more than SPREADS robust standard deviations
over the median distance of its group, so the cut follows each group's own distances.

All sums are grouped with map-side combining, and halves, medians and cuts are found from counts of bins, so that
no group is gathered anywhere and equal input gives equal results. Groups of fewer than MIN_GROUP documents use
their language's estimate, and languages as small as that the estimate over all.

Defined cases: null and blank texts have no words and fail the base rules; very long texts are read whole; ties (equal
distances) are on one side of a cut; null language and source are values of their own; repeated rows are judged each,
and counted each; rows with a null id are judged too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import SPACE, materialise

MIN_GROUP = 50
SPREADS = 10.0
BINS = 32  # bins for each doubling of a distance
#: The axes are logarithms and a share: differences under four hundredths mean nothing, so no axis is narrower.
FLOOR = 0.04
#: A determinant that falls by less than this share of it has stopped falling.
STILL = 1e-3
VECTOR = ["x0", "x1", "x2"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.split(text, SPACE, -1)  # between any two white space characters, empty or not
    words = F.filter(parts, lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words.alias("words"), F.size(parts).alias("n_parts"))
    n = F.size("words")
    # A 64-bit hash of each window; sorted, equal windows are neighbours.
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 5)))).otherwise(F.array().cast("array<long>"))
    hashed = narrow.select("doc_id", "lang", "source", n.alias("n_words"), (F.length("text") - F.col("n_parts") + 1).alias("word_chars"), (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), windows.alias("windows"))
    distinct = F.size(F.array_distinct("windows"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return hashed.select("doc_id", "lang", "source", *counts, F.when(distinct == F.size("windows"), F.lit(0)).otherwise(repeated_words(F.col("windows"))).cast("long").alias("n_repeat_words"))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: their places in order, each adding its uncovered words."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(windows)

    def twice(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, size - 1))
        after = F.concat(F.slice(s, 2, size), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        here = F.zip_with(s, before, lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))
        both = F.zip_with(here, after, lambda a, b: F.when(a["same"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]))
        return F.array_sort(F.filter(both, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    added = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(F.element_at(F.transform(F.array(placed), twice), 1), start, added, lambda acc: acc["n"])


def with_vector(stats: DataFrame) -> DataFrame:
    """Base verdict, and the transformed statistics of documents that pass it."""
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    x0 = F.log(F.col("word_chars") / n)  # mean length of a word
    x1 = F.log(1 + 1000 * F.col("n_symbols") / F.col("word_chars"))
    x2 = (F.col("n_repeat_words") + F.col("n_dup_lines")) / n
    return stats.withColumn("base_failed", failed).withColumns({c: F.when(~failed, x) for c, x in zip(VECTOR, (x0, x1, x2), strict=True)})


def _quantile(df: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """For each group the smallest value (rounded to a bin) that at least this share of its rows reach."""
    bins = df.select(*keys, F.floor(value).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    # One row for each group and bin: at most some thousands a group, however many documents it has.
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return bins.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _distance(vector: list[str], d: int) -> Column:
    """Squared Mahalanobis distance, from mean m<i> and the covariance's Cholesky factor l<i><j>."""
    z: list[Column] = []
    for i in range(d):
        value = F.col(vector[i]) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * z[j]
        z.append(value / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _cholesky(df: DataFrame, d: int) -> DataFrame:
    """Adds the factor of the covariance c<i><j>; the floor keeps it regular."""
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR**2))) if i == j else rest / F.col(f"l{j}{j}"))
    return df


def _bin(distance: Column) -> Column:
    return F.greatest(F.least(F.log2(distance + 1e-9) * BINS, F.lit(40.0 * BINS)), F.lit(-30.0 * BINS))


def estimates(rows: DataFrame, key: str = "cell", vector: list[str] = VECTOR) -> DataFrame:
    """key, mean m<i>, Cholesky factor l<i><j> and determinant (its logarithm) of each group's estimate. rows: key and vector."""
    d = len(vector)
    # Estimates are written tables, so that Spark knows their size: it broadcasts them only while they are small.
    long = rows.select(key, F.posexplode(F.array(*vector)).alias("axis", "x"))
    median = _quantile(long, [key, "axis"], F.col("x") * 200, 0.5).select(key, "axis", ((F.col("bin") + 0.5) / 200).alias("med"))
    median = materialise(median, "median")
    spread = _quantile(long.join(median, [key, "axis"]), [key, "axis"], F.abs(F.col("x") - F.col("med")) * 200, 0.5)
    width = F.greatest(1.4826 * (F.col("bin") + 0.5) / 200, F.lit(FLOOR))
    at = lambda c, i: F.max(F.when(F.col("axis") == i, c))
    first = median.join(spread, [key, "axis"]).groupBy(key).agg(*[at(F.col("med"), i).alias(f"m{i}") for i in range(d)], *[at(width, i).alias(f"l{i}{i}") for i in range(d)])
    for i in range(d):
        for j in range(i):
            first = first.withColumn(f"l{i}{j}", F.lit(0.0))
    # Start -1 is near on all axes, start i on axis i: the others are a thousand times as wide.
    starts = first.select("*", F.explode(F.sequence(F.lit(-1), F.lit(d - 1))).alias("start"))
    wide = lambda i: F.when((F.col("start") >= 0) & (F.col("start") != i), 1000.0).otherwise(1.0)
    now = starts.withColumns({f"l{i}{i}": F.col(f"l{i}{i}") * wide(i) for i in range(d)}).withColumn("determinant", F.lit(float("inf")))
    now, settled = materialise(now, "mcd"), []
    while True:
        far = rows.join(now, key).withColumn("bin", F.floor(_bin(_distance(vector, d))))
        half = _quantile(far, [key, "start"], F.col("bin"), 0.5).withColumnRenamed("bin", "half")
        near = far.join(materialise(half, "half"), [key, "start"]).filter(F.col("bin") <= F.col("half"))
        shifted = [(F.col(v) - F.col(f"m{i}")) for i, v in enumerate(vector)]  # about the last mean, for exactness
        exact = lambda c: F.sum(F.round(c, 9).cast("decimal(28,9)")).cast("double")
        sums = near.groupBy(key, "start", "determinant", *[f"m{i}" for i in range(d)]).agg(F.count("*").alias("n"), *[exact(s).alias(f"s{i}") for i, s in enumerate(shifted)], *[exact(shifted[i] * shifted[j]).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)])
        n = F.col("n")
        # The half that lies nearest is narrower than the whole; 2.5 makes three normal axes agree again.
        cov = {f"c{i}{j}": 2.5 * (F.col(f"p{i}{j}") / n - F.col(f"s{i}") * F.col(f"s{j}") / n / n) for i in range(d) for j in range(i + 1)}
        moved = sums.withColumns(cov).withColumns({f"m{i}": F.col(f"m{i}") + F.col(f"s{i}") / n for i in range(d)})
        moved = _cholesky(moved, d).withColumn("was", F.col("determinant")).withColumn("determinant", sum(F.log(f"l{i}{i}") for i in range(d)) * 2)
        moved = materialise(moved.select(*now.columns, (F.col("determinant") < F.col("was") + F.log1p(F.lit(-STILL))).alias("falls")), "mcd")
        settled.append(moved.filter("not falls").drop("falls"))
        now = materialise(moved.filter("falls").drop("falls"), "mcd")
        # Every further round lowers each determinant by its share STILL, and the floors bound it, so rounds end.
        if now.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    fields = [c for c in every.columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct("determinant", "start")).alias("best"))
    return materialise(best.select(key, *[F.col("best")[c].alias(c) for c in fields if c != "start"]), "mcd")


def cuts(rows: DataFrame, fitted: DataFrame, key: str = "cell", vector: list[str] = VECTOR, spreads: float = SPREADS) -> DataFrame:
    """key, cut: the square of the distance that lies ``spreads`` robust standard deviations over the median one."""
    far = rows.join(fitted, key).select(key, (F.least(F.sqrt(_distance(vector, len(vector))), F.lit(1e4)) * BINS).alias("d"))
    middle = materialise(_quantile(far, [key], F.col("d"), 0.5).withColumnRenamed("bin", "middle"), "middle")
    spread = _quantile(far.join(middle, key), [key], F.abs(F.col("d") - F.col("middle") - 0.5), 0.5)
    cut = (F.col("middle") + 0.5 + spreads * 1.4826 * (F.col("bin") + 0.5)) / BINS
    return middle.join(spread, key).select(key, (cut * cut).alias("cut"))


def cells(stats: DataFrame) -> DataFrame:
    """lang, source, cell: the group whose estimate judges the documents of a language and source."""
    passing = stats.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = passing.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    joined = passing.alias("p").join(by_lang.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang")))
    lang, source = F.coalesce(F.col("p.lang"), F.lit("\x00")), F.coalesce(F.col("p.source"), F.lit("\x00"))
    own, of_lang = F.concat(lang, F.lit("\x01"), source), F.concat(lang, F.lit("\x02"))
    cell = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, of_lang).otherwise(F.lit("\x03"))
    return joined.select(F.col("p.lang").alias("lang"), F.col("p.source").alias("source"), cell.alias("cell"), F.array_distinct(F.array(own, of_lang, F.lit("\x03"))).alias("of"))


def judge(docs: DataFrame, spreads: float = SPREADS) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and distance and its cut (null where the base failed)."""
    stats = with_vector(materialise(statistics(docs), "statistics"))
    groups = materialise(cells(stats), "cells")
    if groups.isEmpty():
        return stats.select(*_OUT, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("cut"))
    named = groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "cell", "of")
    on = stats["lang"].eqNullSafe(F.col("of_lang")) & stats["source"].eqNullSafe(F.col("of_source"))
    passing = stats.filter("not base_failed").join(named, on).select("cell", "of", *VECTOR)
    # A document counts for its own cell and, where that is too small, for the wider ones that are in use.
    wide = materialise(passing.select(F.explode("of").alias("cell"), *VECTOR).join(groups.select("cell").distinct(), "cell", "left_semi"), "vectors")
    fitted = estimates(wide)
    limits = materialise(fitted.join(cuts(wide, fitted, spreads=spreads), "cell"), "limits")
    judged = stats.join(named, on & ~F.col("base_failed"), "left")
    far = judged.join(limits, "cell", "left").withColumn("distance", _distance(VECTOR, len(VECTOR)))
    return far.select(*_OUT, (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cut"), F.lit(True))).alias("kept"), "distance", "cut")


_OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
