"""A sorted curve of any length: places of values, exact quantiles of one or by key, and pieces with margins, without one task that orders all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a piece; values of a strip, about, and strips at most.
PIECE, STRIP, MOST_STRIPS = 1_000_000, 1_000_000, 10_000


def strips_of(n: int, strip: int = STRIP) -> int:
    return min(MOST_STRIPS, max(1, n // strip))


def sorted_runs(values: DataFrame, n: int, strip: int = STRIP, cuts: list[float] | None = None) -> DataFrame:
    """(value, first, m) of each distinct number in column value: the place of its first copy in ascending order, from 0, and its copies.

    n: the rows of values; cuts: between strips, if they are known. Copies are counted before anything is ordered. Approximate quantiles deal the distinct
    values to strips, each ordered by itself; they only decide how even the strips are.
    """
    counts = values.groupBy("value").agg(F.count("*").alias("m"))
    k = strips_of(n, strip)
    if cuts is None:
        cuts = values.approxQuantile("value", [i / k for i in range(1, k)], 1 / (4 * k)) if k > 1 else []
    cuts = sorted(set(cuts))
    rows = counts.withColumn("strip", F.lit(0.0))
    if cuts:
        rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="value", outputCol="strip").transform(counts)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("strip").alias("of")).agg(F.sum("m").alias("all"))
    starts = starts.select("of", F.coalesce(F.sum("all").over(before(Window.orderBy("of"))), F.lit(0)).alias("start"))  # a row per strip
    within = F.coalesce(F.sum("m").over(before(Window.partitionBy("strip").orderBy("value"))), F.lit(0))
    return rows.withColumn("within", within).join(F.broadcast(starts), F.col("strip") == F.col("of")).select("value", (F.col("start") + F.col("within")).alias("first"), "m")


def pieces(runs: DataFrame, n: int, size: int = PIECE, before: int = 0, after: int = 0) -> DataFrame:
    """(piece, i, value, own): every place of the curve of n values in its piece, so that windows by piece see their neighbours.

    Up to `before` places ahead of a piece and `after` behind it are in it too, with own false. Copies of one
    value are dealt to the pieces before they are written out.
    """
    end, p = F.col("first") + F.col("m") - 1, F.col("piece")
    low = F.greatest(F.floor((F.col("first") - after) / size), F.lit(0).cast("long"))
    high = F.least(F.floor((end + before) / size), F.lit((n - 1) // size).cast("long"))
    rows = runs.withColumn("piece", F.explode(F.sequence(low, high))).repartition("piece")
    places = F.sequence(F.greatest("first", p * size - before), F.least(end, (p + 1) * size - 1 + after))
    return rows.select("piece", F.explode(places).alias("i"), "value").withColumn("own", F.floor(F.col("i") / size) == p)


def quantile(values: DataFrame, q: float, strip: int = STRIP) -> float | None:
    """The exact linear quantile of column value; None without rows."""
    n = values.count()
    if not n:
        return None
    at = (n - 1) * q
    low = int(at)
    holds = lambda i: F.max(F.when((F.col("first") <= i) & (F.col("first") + F.col("m") > i), F.col("value")))
    a, b = sorted_runs(values, n, strip).agg(holds(low), holds(min(low + 1, n - 1))).first()
    return a + (b - a) * (at - low)


def quantiles(rows: DataFrame, key: str, at: dict[str, float], strip: int = STRIP, strips: int | None = None) -> DataFrame:
    """(key, and a column per name in `at`): exact linear quantiles of column value, which comes freq times, by key.

    Equal values are counted before anything is ordered. Approximate quantiles of a key deal its distinct values
    to strips, each ordered by itself; their number is counted unless it is given. Keys are few, as those of maps and modules.
    """
    counts = rows.groupBy(key, "value").agg(F.sum("freq").alias("m"))
    strips = min(1024, max(1, counts.count() // strip)) if strips is None else strips
    counts = counts.withColumn("strip", F.lit(0))
    if strips > 1:
        cuts = rows.groupBy(F.col(key).alias("of")).agg(F.percentile_approx("value", [i / strips for i in range(1, strips)], 10 * strips).alias("cuts"))
        counts = counts.join(F.broadcast(cuts), F.col(key) == F.col("of"))  # a row per key
        counts = counts.withColumn("strip", F.size(F.filter("cuts", lambda c: c < F.col("value")))).select(key, "value", "m", "strip")
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy(F.col(key).alias("of"), F.col("strip").alias("s")).agg(F.sum("m").alias("m"))
    sums = sums.select("of", "s", before(Window.partitionBy("of").orderBy("s")).alias("start"), F.sum("m").over(Window.partitionBy("of")).alias("n"))
    runs = counts.withColumn("within", before(Window.partitionBy(key, "strip").orderBy("value")))
    runs = runs.join(F.broadcast(sums), (F.col(key) == F.col("of")) & (F.col("strip") == F.col("s")))  # strips of few keys
    first = F.col("start") + F.col("within")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    holds = lambda i: F.max(F.when((first <= i) & (first + F.col("m") > i), F.col("value")))
    ends = [c for name, q in at.items() for c in (holds(F.floor(place(q))).alias(f"{name}_a"), holds(F.least(F.floor(place(q)) + 1, F.col("n") - 1)).alias(f"{name}_b"), F.max(place(q) - F.floor(place(q))).alias(f"{name}_t"))]
    out = runs.groupBy(key).agg(*ends)
    return out.select(key, *((F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_t")).alias(n) for n in at))
