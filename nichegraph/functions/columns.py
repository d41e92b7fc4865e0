"""Column expressions: names, grids, cell ids, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, IntegralType

#: Marks of probes that aren't genes, case-sensitive.
NOT_GENES = ["BLANK", "NegControl", "antisense", "Blank", "SystemControl", "Negative", "NegPrb", "_"]
GENE, OTHER = "predesigned_gene", "something_else"


def gene_category(name: Column) -> Column:
    return F.when(name.rlike("|".join(NOT_GENES)), OTHER).otherwise(GENE)


def decoded(df: DataFrame) -> DataFrame:
    """df with every binary column as UTF-8 text."""
    return df.withColumns({f.name: F.decode(F.col(f.name), "UTF-8") for f in df.schema.fields if isinstance(f.dataType, BinaryType)})


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def floor_bin(c: Column, size: float) -> Column:
    """The absolute bin of a coordinate, in float arithmetic; negative bins are allowed."""
    return F.floor((c.cast("float") / F.lit(float(size)).cast("float")).cast("float")).cast("int")


def raster_bin(c: Column, low: Column, size: float, extent: Column) -> Column:
    """The bin of a coordinate counted from the grid's low end, truncated and clipped to the grid."""
    return F.least(F.greatest(F.floor((c.cast("double") - low) / size).cast("int"), F.lit(0)), extent - 1)


def cell_id(df: DataFrame, column: str, tokens: list = ("UNASSIGNED", -1), keep_strings: bool = True) -> Column:
    """The cell's id as text, null where unassigned; what counts as unassigned depends on the column's type.

    Whole numbers: null, -1 and numeric tokens. Floating: also NaN; written without a fraction where the value
    has none (with_cell looks at the whole column). Text: trimmed; empty, "-1" and any token in either case; upper case unless keep_strings.
    """
    c, kind = F.col(column), df.schema[column].dataType
    numbers = {-1.0}
    for t in tokens:
        try:
            numbers.add(float(t))
        except ValueError:
            pass
    if isinstance(kind, IntegralType):
        return F.when(c.isNotNull() & ~c.isin([int(n) for n in numbers if n == int(n)]), c.cast("string"))
    if isinstance(kind, (FloatType, DoubleType)):
        d = c.cast("double")
        whole = (F.abs(d) < 2.0**53) & (d == F.floor(d))
        return F.when(is_number(d) & ~d.isin(sorted(numbers)), F.when(whole, F.when(F.abs(d) < 2.0**53, d).cast("long").cast("string")).otherwise(d.cast("string")))
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    none = [str(t).strip().upper() for t in tokens] + ["", "-1"]
    return F.when(text.isNotNull() & ~F.upper(text).isin(none), text if keep_strings else F.upper(text))


def with_cell(df: DataFrame, column: str, tokens: list = ("UNASSIGNED", -1), keep_strings: bool = True, name: str = "cell") -> DataFrame:
    """df with cell_id() as a column. Floating ids are written without a fraction only if every assigned value has none."""
    out = df.withColumn(name, cell_id(df, column, tokens, keep_strings))
    if not isinstance(df.schema[column].dataType, (FloatType, DoubleType)):
        return out
    d = F.col(column).cast("double")
    whole = out.filter(F.col(name).isNotNull()).agg(F.coalesce(F.bool_and((F.abs(d) < 2.0**53) & (d == F.floor(d))), F.lit(True)).alias("_all_whole"))
    ids = F.when(F.col(name).isNotNull(), F.when(F.col("_all_whole"), F.col(name)).otherwise(d.cast("string")))
    return out.crossJoin(F.broadcast(whole)).withColumn(name, ids).drop("_all_whole")  # one row


def coerce_threshold(t: str | float) -> str | float:
    """"P98" to "p98", other text to a number."""
    if isinstance(t, str):
        t = t.strip().lower()
        return t if t.startswith("p") else float(t)
    return float(t)


def parse_tokens(tokens: list[str] | None) -> list:
    """Given tokens added to the defaults UNASSIGNED and -1, as numbers where they are."""
    out: list = ["UNASSIGNED", -1]
    for t in tokens or []:
        try:
            out.append(int(t))
        except ValueError:
            out.append(t)
    return out
