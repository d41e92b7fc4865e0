"""Bins, cells and regions: counts by bin, support, cells of regions, knees, polygons, assignment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichegraph.operators import curve
from nichegraph.operators.niche import Region, grid_bins


def bin_gene_counts(binned: DataFrame, keep_empty: DataFrame | None = None) -> DataFrame:
    """(bin_id, gene, n), null genes left out; with a grid, its empty bins too, with a null gene and 0."""
    out = binned.filter("gene is not null").groupBy("bin_id", "gene").agg(F.count("*").alias("n"))
    if keep_empty is None:
        return out
    return grid_bins(keep_empty).join(out, "bin_id", "left").fillna(0, ["n"])


def bin_gene_split(binned: DataFrame) -> DataFrame:
    """(bin_id, gene, assigned, unassigned); column cell is null for points without a cell."""
    return binned.filter("gene is not null").groupBy("bin_id", "gene").agg(F.count("cell").alias("assigned"), F.count_if(F.col("cell").isNull()).alias("unassigned"))


def bin_counts(binned: DataFrame) -> DataFrame:
    """(bin_id, n_total, n_unassigned), null genes included."""
    return binned.groupBy("bin_id").agg(F.count("*").alias("n_total"), F.count_if(F.col("cell").isNull()).alias("n_unassigned"))


def cells_by_bin(binned: DataFrame) -> DataFrame:
    """(bin_id, cells): the distinct cells, sorted."""
    return binned.filter("cell is not null").groupBy("bin_id").agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def cells_in(selected: DataFrame, cells: DataFrame, by_bin: bool = False) -> DataFrame:
    """Distinct cells of selected bins (bin_id, and k if there is one); by_bin: their lists (bin_id, cells) instead."""
    if by_bin:
        return cells.join(selected, "bin_id")
    key = [c for c in selected.columns if c != "bin_id"]
    pairs = cells.select("bin_id", F.explode("cells").alias("cell"))
    numbers = cell_numbers(pairs).persist()  # read for the sets and to name their members
    return members(cell_sets(pairs.join(numbers, "cell").join(selected, "bin_id"), key), numbers, key)


def cell_numbers(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """(cell, number): a number from 1 for each distinct cell, without gaps; buckets of cells are numbered each by itself."""
    cells = rows.filter("cell is not null").select("cell").distinct().withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    starts = cells.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n"))
    starts = starts.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("cell"))
    return cells.withColumn("rank", rank).join(F.broadcast(starts), F.col("bucket") == F.col("of")).select("cell", (F.col("start") + F.col("rank")).cast("long").alias("number"))


def cell_sets(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, bits): sets of numbers as bitmaps, which tasks build before anything is shuffled."""
    return rows.groupBy(*key, F.bitmap_bucket_number("number").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def members(sets: DataFrame, numbers: DataFrame, key: list[str]) -> DataFrame:
    """(key, cell) of the cells whose numbers' bits are set."""
    at = F.bitmap_bit_position("number")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    of = numbers.withColumn("part", F.bitmap_bucket_number("number"))
    return of.join(sets, "part").filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*key, "cell")


def support(selected: DataFrame, counts: DataFrame, genes: list[str], min_types: int = 2, min_points: int = 5, case_sensitive: bool = True) -> DataFrame:
    """Selected bins with n_gene_types, n_gene_transcripts of the listed genes, and passes_support.

    Without case, variants of a gene in other case match the list but count as types of their own.
    """
    if not genes:
        raise ValueError("the list of genes is empty")
    if min_types < 0 or min_points < 0:
        raise ValueError("minima can't be negative")
    g = F.col("gene") if case_sensitive else F.lower("gene")
    of = counts.filter(g.isin([x if case_sensitive else x.lower() for x in genes]) & (F.col("n") > 0)).groupBy("bin_id").agg(F.count_distinct("gene").alias("n_gene_types"), F.sum("n").alias("n_gene_transcripts"))
    out = selected.join(of, "bin_id", "left").fillna(0, ["n_gene_types", "n_gene_transcripts"])
    return out.withColumn("passes_support", (F.col("n_gene_types") >= min_types) & (F.col("n_gene_transcripts") >= min_points))


def assignment_stats(selected: Region, thresholds: DataFrame, binned: DataFrame, n_niches: int | None = None) -> DataFrame:
    """Per niche k: threshold, bins, distinct cells, assigned and unassigned points and their shares (null without points).

    binned: points with bin_id and cell. Background pixels are a number; of them only bins with points are read.
    Cells are sets of numbers, so that neither their lists nor pairs of niche and cell are shuffled.
    """
    if n_niches is not None:
        if n_niches <= 0:
            raise ValueError("there are no niches to process")
        thresholds = thresholds.filter(F.col("k") < n_niches)
    points = binned.groupBy("bin_id", "cell").agg(F.count_if(F.col("gene").isNotNull()).alias("n")).persist()  # read for numbers, cells and sums
    numbers = cell_numbers(points)
    rows = selected.rows_of(points.join(numbers, "cell", "left").select("bin_id", "cell", "n", "number"))
    of = rows.groupBy("k", F.bitmap_bucket_number("number").alias("part")).agg(
        F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))).alias("a"), F.sum(F.when(F.col("cell").isNull(), F.col("n"))).alias("u"), F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    sums = of.groupBy("k").agg(F.sum("a").alias("a"), F.sum("u").alias("u"), F.sum(F.when(F.col("part").isNotNull(), F.bitmap_count("bits"))).alias("cells"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = thresholds.join(selected.sizes(), "k", "left").join(sums, "k", "left").select(F.col("k").alias("niche_k"), F.col("t").alias("threshold_value"), zero("bins").alias("n_selected_bins"), zero("cells").alias("n_cells_subset"), zero("a").alias("assigned_transcripts"), zero("u").alias("unassigned_transcripts"))
    total = F.col("assigned_transcripts") + F.col("unassigned_transcripts")
    return out.withColumn("total_transcripts", total).withColumn("prop_assigned", F.try_divide("assigned_transcripts", "total_transcripts")).withColumn("prop_unassigned", F.try_divide("unassigned_transcripts", "total_transcripts"))


def _crossings(edges: DataFrame, grid: DataFrame, bin_size: float, shift: float) -> DataFrame:
    """(gy, gx, turns, border): events of grid rows that edges cross, in bins.

    turns 1: the bins up to gx have the edge on their right. border: the bin's point is on the edge. An edge is
    dealt to the grid rows between its ends before anything else; the crossing's bin, first a quotient, is put right by the
    exact test of the bins beside it.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y, by: (F.floor((y - F.col("y_min")) / bin_size - shift) + by).cast("long")
    first, last = F.greatest(row(low, -1), F.lit(0).cast("long")), F.least(row(high, 2), F.col("height").cast("long") - 1)
    e = edges.crossJoin(F.broadcast(grid)).withColumn("gy", F.explode(F.when(first <= last, F.sequence(first, last)))).repartition("gy")  # a grid is one row
    e = e.withColumn("py", F.col("y_min") + (F.col("gy") + shift) * bin_size).filter((F.col("py") >= low) & (F.col("py") <= high))
    px = lambda gx: F.col("x_min") + (gx + shift) * bin_size
    turn = lambda gx: (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px(gx) - F.col("x1"))
    left = lambda gx: ((F.col("y2") > F.col("y1")) & (turn(gx) > 0)) | ((F.col("y2") < F.col("y1")) & (turn(gx) < 0))
    place = lambda x: F.floor((x - F.col("x_min")) / bin_size - shift).cast("long")
    level = F.col("y1") == F.col("y2")
    e = e.withColumn("about", place(F.when(level, F.least("x1", "x2")).otherwise(F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))))
    at = [F.col("about") + k for k in (2, 1, 0, -1, -2)]
    gx = F.coalesce(*(F.when(left(c), c) for c in at), F.col("about") - 3)
    inside = lambda c: (turn(c) == 0) & px(c).between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    event = lambda gx, turns, border: F.struct(gx.cast("long").alias("gx"), F.lit(turns).alias("turns"), F.lit(border).alias("border"))
    crossing = F.when((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py")), F.array(event(gx, 1, 0)))
    far = F.when(level, place(F.greatest("x1", "x2"))).otherwise(F.col("about"))
    a, b = F.greatest(F.col("about") - 2, F.lit(0).cast("long")), F.least(far + 2, F.col("width").cast("long") - 1)
    spots = F.when(a <= b, F.transform(F.filter(F.sequence(a, b), inside), lambda c: event(c, 0, 1)))
    none = F.array().cast("array<struct<gx:bigint,turns:int,border:int>>")
    return e.select("gy", F.inline(F.concat(F.coalesce(crossing, none), F.coalesce(spots, none))))


def bins_in_polygon(bins: DataFrame, edges: DataFrame, grid: DataFrame, bin_size: float, use_center: bool = True) -> DataFrame:
    """Bins (bin_id) whose centre, or low corner, is inside the polygon and not on its border.

    Scanlines: a bin is inside if an odd number of the crossings in its grid row are on its right, holes
    included, which a running count over the row's crossings and bins says. No bin meets an edge.
    """
    events = _crossings(edges, grid, bin_size, 0.5 if use_center else 0.0)
    at = bins.select("bin_id").distinct().crossJoin(F.broadcast(grid.select("width")))  # a grid is one row
    at = at.select((F.floor(F.col("bin_id") / F.col("width"))).alias("gy"), (F.col("bin_id") % F.col("width")).alias("gx"), F.lit(0).alias("turns"), F.lit(0).alias("border"), "bin_id")
    rows = at.unionByName(events.withColumn("bin_id", F.lit(None).cast("long")))
    right = F.sum("turns").over(Window.partitionBy("gy").orderBy(F.desc("gx"), F.desc("turns"), F.desc("border")))
    on = F.max("border").over(Window.partitionBy("gy", "gx"))
    return rows.select("bin_id", right.alias("right"), on.alias("on")).filter("bin_id is not null and right % 2 = 1 and on = 0").select("bin_id")


def _start(runs: DataFrame, n: int, slope_quantile: float, min_run: int, smooth_window: int, piece: int) -> DataFrame:
    """(start) in one row: the place where the first min_run smoothed slopes in a row exceed the quantile of positive ones, else 0."""
    half = max(3, smooth_window) // 2
    by = Window.partitionBy("piece").orderBy("i")
    before, after = F.lag("value").over(by), F.lead("value").over(by)
    slope = F.when(before.isNull(), after - F.col("value")).when(after.isNull(), F.col("value") - before).otherwise((after - before) / 2)
    s = curve.pieces(runs, n, piece, half + 1, half + min_run).withColumn("dx", slope)
    s = s.select("piece", "i", "own", (F.sum("dx").over(by.rowsBetween(-half, half)) / (2 * half + 1)).alias("dx"))
    cut = curve.quantiles(s.filter("own and dx > 0").select(F.lit(0).alias("k"), F.col("dx").alias("value"), F.lit(1).cast("long").alias("freq")), "k", {"cut": slope_quantile}, strips=curve.strips_of(n, piece))
    s = s.crossJoin(F.broadcast(cut.select("cut")))  # one row
    above = F.sum((F.col("dx") > F.col("cut")).cast("int")).over(by.rowsBetween(0, min_run - 1))
    return s.withColumn("above", above).filter(F.col("own") & (F.col("above") == min_run)).agg(F.coalesce(F.min("i"), F.lit(0).cast("long")).alias("start"))


def _chord(first: Column, low: Column, high: float, n: int) -> Column:
    """The distance of a place of the curve from the chord between place `first`, of value low, and the last, in the unit square."""
    span = F.lit(high) - low
    scale = span + 1e-12
    top = span / scale
    return F.abs((F.col("value") - low) / scale - F.try_divide(F.col("i") - first, F.lit(n - 1) - first) * top) / F.sqrt(1 + top * top)


def _peak(distance: Column, where: Column) -> Column:
    """(d, place, value) of the largest distance, the first of equal ones."""
    return F.max(F.when(where, F.struct(distance.alias("d"), (-F.col("i")).alias("less"), F.col("value").alias("value"))))


def _fallen(distance: Column, at: Column, peak: Column, fraction: float) -> Column:
    """(i, value) of the first place from `at` on where the distance has fallen to the fraction of the peak."""
    return F.min(F.when((F.col("i") >= at) & (distance <= fraction * peak), F.struct("i", "value")))


def _next(at: Column) -> Column:
    return F.min(F.when(F.col("i") == at + 1, F.struct("i", "value")))


#: Numbers of one knee in the record.
KNEE = "index_fit long, index_all long, x double, threshold double, occupancy double, percentile double"
RECORD = "n long, start_index long, start_x double, " + ", ".join(f"{k} struct<{KNEE}>" for k in ("first", "first_sharper", "second", "second_sharper"))


def knee_record(
    values: DataFrame, start_mode: str | int = "auto", slope_quantile: float = 0.2, min_run: int = 25, smooth_window: int = 11, fraction: float = 0.95, second_fraction: float | None = None,
    piece: int = curve.PIECE, mask: Column | None = None, second: bool = True, sharper: bool = True, sharper_second: bool | None = None,
) -> DataFrame:
    """One row (RECORD's columns) of the knees of sorted finite values: where each is, its threshold and what is above it.

    index_fit counts from the start of the fit, index_all is the first place of the threshold's value among all,
    x its share of the way, occupancy the share of values above it, percentile 100 times the rest. Knees that
    aren't sought, and second ones with fewer than ten values from the first on, are null. The options are those of knee().

    The curve is read in three jobs: its length, end and cuts between strips; the start with the first knee's peak; and the rest,
    where the second knee's chord begins at the first's peak. What a place needs of them are single numbers.
    """
    sharper_second = sharper if sharper_second is None else sharper_second
    values = values if mask is None else values.filter(mask)
    ok = values.filter("value is not null and not isnan(value) and abs(value) < double('infinity')").select(F.col("value").cast("double").alias("value"))
    n, high, cuts = ok.agg(F.count("*"), F.max("value"), F.percentile_approx("value", [i / 1024 for i in range(1, 1024)], 10_000)).first()
    if n < 10:
        raise ValueError("there are too few values for a knee")
    k = curve.strips_of(n, piece)
    runs = curve.sorted_runs(ok, n, piece, [] if k == 1 else cuts[:: 1024 // k] if k <= 1024 else None).persist()
    spark, places = values.sparkSession, curve.pieces(runs, n, piece).select("i", "value")
    if start_mode == "auto":
        start = _start(runs, n, slope_quantile, min_run, smooth_window, piece)
    elif start_mode == "zero":
        start = runs.agg(F.least(F.coalesce(F.sum(F.when(F.col("value") <= 0, F.col("m"))), F.lit(0)), F.lit(n - 1)).alias("start"))
    elif isinstance(start_mode, int):
        start = spark.range(1).select(F.lit(min(max(start_mode, 0), n - 1)).cast("long").alias("start"))
    else:
        raise ValueError("start_mode is auto, zero or a place")
    holds = lambda i: (F.col("first") <= i) & (F.col("first") + F.col("m") > i)
    begin = runs.join(F.broadcast(start), holds(F.col("start"))).select("start", F.col("value").alias("low"))  # one row
    one = _peak(_chord(F.col("start"), F.col("low"), high, n), F.col("i") >= F.col("start"))
    r = places.crossJoin(F.broadcast(begin)).agg(F.max("start").alias("start"), F.max("low").alias("low"), one.alias("p")).first()
    if n - r.start < 10:
        runs.unpersist()
        raise ValueError("there are too few values after the start")
    at = -r.p.less
    d1, d2 = _chord(F.lit(r.start), F.lit(r.low), high, n), _chord(F.lit(at), F.lit(r.p.value), high, n)
    wanted = second and n - at >= 10
    row = places.agg(_fallen(d1, F.lit(at), F.lit(r.p.d), fraction).alias("f"), _next(F.lit(at)).alias("n"), _peak(d2, F.lit(wanted) & (F.col("i") >= at)).alias("p"))
    tail = places.crossJoin(F.broadcast(row.select((-F.col("p.less")).alias("at"), F.col("p.d").alias("d"))))  # one row
    tail = tail.agg(_fallen(d2, F.col("at"), F.col("d"), fraction if second_fraction is None else second_fraction).alias("f2"), _next(F.col("at")).alias("n2"))
    rest = row.crossJoin(tail).first()

    def steep(at: int, peak: float, fallen, following) -> int:
        place = at if peak <= 0 else n - 1 if fallen is None else fallen.i
        return following.i if place <= at < n - 1 else place

    found = {"first": at}
    if sharper:
        found["first_sharper"] = steep(at, r.p.d, rest.f, rest.n)
    if rest.p is not None:
        found["second"] = -rest.p.less
        if sharper_second:
            found["second_sharper"] = steep(found["second"], rest.p.d, rest.f2, rest.n2)
    marks = spark.createDataFrame(list(found.items()), "knee string, i long")
    above = (F.lit(n) - F.col("first") - F.col("m")) / F.lit(n)
    of = F.struct((F.col("i") - r.start).alias("index_fit"), F.col("first").alias("index_all"), (F.col("first") / F.lit(n - 1)).alias("x"), F.col("value").alias("threshold"), above.alias("occupancy"), (100 * (1 - above)).alias("percentile"))
    at_marks = runs.join(F.broadcast(marks), holds(F.col("i"))).select("knee", of.alias("of"))  # four places at most
    one_of = lambda k: F.max(F.when(F.col("knee") == k, F.col("of"))).alias(k)
    return at_marks.agg(*map(one_of, ("first", "first_sharper", "second", "second_sharper"))).select(F.lit(n).cast("long").alias("n"), F.lit(r.start).cast("long").alias("start_index"), (F.lit(r.start) / F.lit(n - 1)).alias("start_x"), "first", "first_sharper", "second", "second_sharper")


def knee(values: DataFrame, *args, **options) -> DataFrame:
    """(knee, threshold, occupancy) of sorted finite values: first, first_sharper, second, second_sharper.

    The fit starts at a sustained rise ("auto"), above 0 ("zero") or at a place. A sharper knee is where the
    distance to the chord has fallen to the fraction of its peak on the right, or else the next value.
    occupancy: share of values above the threshold. The second knee needs ten values from the first on. The
    curve is dealt to pieces of `piece` places with margins as wide as the windows; single numbers alone reach
    the driver. mask: only values where it holds count; second and sharper: whether those knees are sought.
    ValueError for fewer than ten values. Options are those of knee_record().
    """
    names = ("first", "first_sharper", "second", "second_sharper")
    rows = knee_record(values, *args, **options).select(F.explode(F.array(*(F.struct(F.lit(k).alias("knee"), F.col(k).alias("of")) for k in names))).alias("r"))
    return rows.filter("r.of is not null").select("r.knee", "r.of.threshold", "r.of.occupancy")
