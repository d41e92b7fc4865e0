"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling. Native.

The cells of source x language x topic hold token counts. Raking scales their weights to each target
marginal in turn until all hold; a cell's sampling probability is its weight over its tokens, scaled by one
factor so that LEAST_SHARE of the tokens is expected to stay, and 1 where that gives more. Only the table of
cells, which has no more rows than combinations that occur, is iterated over; documents are read twice, to
count and to sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

DIMENSIONS = ["source", "lang", "topic"]
#: Exponents of the default targets: shares of a dimension's values are tempered by it; 1 holds them as they are.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Share of the tokens of cells with a weight that is expected to stay at least, however rare the rarest cell.
LEAST_SHARE = 0.6
#: The gap at which targets count as met; looks in a row that don't lower the least gap to this share of it, after which it stands still.
TOLERANCE, STANDS, LOOKS = 1e-6, 0.99, 4
#: Cells that are worked on in one task and sent to all; it changes where the work is done alone.
ONE_TASK = 50_000


def topic(text: Column) -> Column:
    """A text's topic by its form, the first that fits: empty, markup, table, numbers, list, long or prose."""
    n = F.length(text)
    return (
        F.when(n == 0, "empty")
        .when(F.regexp_count(text, F.lit(r"[<>{}\[\];]")) * 50 > n, "markup")
        .when(F.regexp_count(text, F.lit(r"[|\t]")) * 25 > n, "table")
        .when(F.regexp_count(text, F.lit(r"[0-9]")) * 10 > n, "numbers")
        .when(F.regexp_count(text, F.lit(r"\n")) * 60 > n, "list")
        .when(n > 8000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """docs with _source, _lang, _topic and _tokens; null sources and languages count as "", null texts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DIMENSIONS[:2]}
    return docs.withColumns(named | {"_topic": topic(text), "_tokens": F.regexp_count(text, F.lit(shared.WORD)).cast("long")})


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, documents) of each combination that occurs, as a written table."""
    keys = [F.col(f"_{d}").alias(d) for d in DIMENSIONS]
    return shared.written(described(docs.select("text", *DIMENSIONS[:2])).groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents")))


def default_targets(cells: DataFrame, temper: dict[str, float] = TEMPER) -> dict[str, DataFrame]:
    """For each dimension (value, share): its values' shares of tokens, tempered and brought to sum 1."""
    out = {}
    for d in DIMENSIONS:
        t = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper[d])).alias("p"))
        out[d] = t.crossJoin(t.agg(F.sum("p").alias("total"))).select("value", F.try_divide("p", "total").alias("share"))  # one row
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells with weight, the token counts raked to the targets, and gap: by how much the marginals of the cell's values miss theirs at most.

    Values with a target but no tokens can't be met: the shares of those that have tokens are brought to sum
    1. Values without a target get weight 0, as do cells without tokens. Slow sweeps are sped up: from the factors of two
    sweeps, the product of powers of them that their change points to is the start of the next ones. It is a start of the same
    form, cells times a factor per value, so raking ends at the same weights. It ends when every gap is within the tolerance, or when LOOKS
    such leaps and the plain sweeps after them don't lower the largest gap any more: then the targets contradict
    each other on the cells that occur, weights are true to the last dimension, and gap says what the others lack.
    """
    rows, n = cells.withColumn("weight", F.col("tokens").cast("double")), cells.count()
    shares = [f"share_{d}" for d in targets]
    for d, t in targets.items():
        share = t.join(cells.filter("tokens > 0").select(F.col(d).alias("value")).distinct(), "value")
        share = share.crossJoin(share.agg(F.sum(F.col("share").cast("double")).alias("total")))  # one row
        share = share.select(F.col("value").alias(d), F.try_divide(F.col("share").cast("double"), "total").alias(f"share_{d}"))
        rows = rows.join(share, d, "left").fillna(0.0, [f"share_{d}"])
    rows = shared.written(rows.coalesce(1) if n <= ONE_TASK else rows)

    def marginals(rows: DataFrame, d: str, name: str) -> DataFrame:
        """rows with the sum of weights of their value of d; beyond ONE_TASK sums are added up before they are dealt out."""
        if n <= ONE_TASK:
            return rows.withColumn(name, F.sum("weight").over(Window.partitionBy(d)))
        return rows.join(rows.groupBy(F.col(d).alias("_value")).agg(F.sum("weight").alias(name)), F.col(d) == F.col("_value")).drop("_value")

    def swept(rows: DataFrame) -> DataFrame:
        for d in targets:
            rows = marginals(rows, d, "_sum")
            rows = rows.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(f"share_{d}", "_sum"), F.lit(0.0))).drop("_sum")
        return rows

    least, still, leap = None, 0, True
    while n:
        if n <= ONE_TASK:
            rows = rows.coalesce(1)
        first = swept(rows.withColumn("_w0", F.col("weight"))).withColumn("_w1", F.col("weight"))
        rows = swept(first)
        rows = rows if n <= ONE_TASK else shared.written(rows)
        if leap:
            step = F.log(F.try_divide("_w1", "_w0"))
            turn = F.log(F.try_divide("weight", "_w1")) - step
            some = rows.filter("_w0 > 0 and _w1 > 0 and weight > 0")
            far = some.agg(F.greatest(F.sqrt(F.try_divide(F.sum(step * step), F.sum(turn * turn))), F.lit(1.0)).alias("_far"))  # one row
            power = F.greatest(F.least(2 * F.col("_far") * step + F.col("_far") * F.col("_far") * turn, F.lit(100.0)), F.lit(-100.0))
            rows = rows.crossJoin(far).withColumn("weight", F.coalesce(F.col("_w0") * F.exp(power), F.col("weight"))).drop("_far")
        rows = swept(swept(rows.drop("_w0", "_w1")))
        for d in targets:
            rows = marginals(rows, d, f"_gap_{d}")
        gap = F.greatest(*(F.abs(F.col(f"_gap_{d}") - F.col(f"share_{d}")) for d in targets), F.lit(0.0))
        rows = shared.written(rows.withColumn("gap", gap).select(*cells.columns, "weight", "gap", *shares))
        largest = rows.filter("tokens > 0").agg(F.max("gap")).first()[0] or 0.0
        still = still + 1 if least is not None and largest > STANDS * least else 0
        leap = least is None or largest <= least  # after a leap that widened the gap come plain sweeps
        least = largest if least is None else min(least, largest)
        if largest <= tolerance or still >= LOOKS:
            break
        rows = rows.drop("gap")
    return rows.select(*cells.columns, "weight", F.col("gap") if n else F.lit(0.0).alias("gap"))


def factor(cells: DataFrame, share: float = LEAST_SHARE) -> float:
    """The factor c of probabilities min(1, c * weight / tokens) by which the share of tokens is expected to stay.

    Only cells with a weight count. Where the weights hold exactly at a larger share, c is that of the largest:
    1 over the largest ratio. Expected tokens are a concave function of c made of straight pieces, so steps
    along its slope never pass the solution and end at it.
    """
    ratio = F.col("weight") / F.col("tokens")
    some = cells.filter("tokens > 0 and weight > 0")
    top, total = some.agg(F.max(ratio), F.sum("tokens")).first()
    if not top:
        return 1.0
    c = 1 / top
    while True:
        full = ratio * c >= 1
        whole, rest = some.agg(F.sum(F.when(full, F.col("tokens")).otherwise(F.lit(0))), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))).first()
        new = (share * total - whole) / rest if rest > 0 else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def with_probability(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 17, share: float = LEAST_SHARE) -> DataFrame:
    """_row, the struct of a row of docs, and its description with _weight, _probability and _short of the cell and the document's _draw.

    _probability: the cell's weight over its tokens times factor(), 1 at most; 1 in cells without tokens, whose
    documents change no weight. _short: by how much the cell's share of the tokens expected to stay is below its
    weight, as all of its documents stay and are too few; 0 in cells that are sampled. _gap: as rake() has it, what
    weights miss of the targets at most, for the document's source, language and topic. _draw: uniform in [0, 1)
    from the id and the seed, so any rerun keeps the same documents, and repeated ids stay or go together; a null
    id draws from its description.
    """
    cells = cells_of(docs)
    done = rake(cells, targets or default_targets(cells))
    one = F.coalesce(F.least(F.try_divide("weight", "tokens") * factor(done, share), F.lit(1.0)), F.lit(1.0))
    done = done.withColumn("_probability", one)
    stays = done.agg(F.sum(F.col("tokens") * F.col("_probability")).alias("_stays"))
    short = F.when((F.col("_probability") >= 1) & (F.col("tokens") > 0), F.greatest(F.col("weight") - F.try_divide("tokens", "_stays"), F.lit(0.0))).otherwise(F.lit(0.0))
    done = done.crossJoin(stays).select(*(F.col(d).alias(f"_cell_{d}") for d in DIMENSIONS), F.col("weight").alias("_weight"), "_probability", short.alias("_short"), F.col("gap").alias("_gap"))
    if cells.count() <= ONE_TASK:
        done = F.broadcast(done)
    on = [F.col(f"_{d}") == F.col(f"_cell_{d}") for d in DIMENSIONS]
    by = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", *(f"_{d}" for d in DIMENSIONS), "_tokens"))
    draw = F.shiftrightunsigned(F.xxhash64(by, F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = described(docs.select(F.struct("*").alias("_row"), "doc_id", "text", *DIMENSIONS[:2]))
    return rows.join(done, on).withColumn("_draw", draw).drop(*(f"_cell_{d}" for d in DIMENSIONS))


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, short, gap, draw, kept) per document; kept: draw < probability."""
    names = [*DIMENSIONS, "tokens", "weight", "probability", "short", "gap", "draw"]
    rows = with_probability(docs.select("doc_id", "text", "source", "lang"), targets, seed)
    return rows.select("doc_id", *(F.col(f"_{n}").alias(n) for n in names), (F.col("_draw") < F.col("_probability")).alias("kept"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs that calibrated() keeps, with the columns of docs; null texts have no tokens, so their rows always stay."""
    return with_probability(docs, targets, seed).filter("_draw < _probability").select("_row.*")
