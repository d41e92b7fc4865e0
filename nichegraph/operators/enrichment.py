"""Over-representation of gene sets in modules: hypergeometric tails and adjusted P values.

Conventions: modules and terms are cut to the background; terms without overlap are left out; P is the chance
of at least the overlap; Adjusted_P follows Benjamini and Hochberg within a module; the odds ratio adds one
half to each cell of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enrichment(modules: DataFrame, terms: DataFrame, background: DataFrame, top_n: int = 200) -> DataFrame:
    """(module, term, overlap, module_size, term_size, P, Adjusted_P, odds_ratio, genes), top_n of each module by P and term.

    The background is a table of genes, of a million at most, as log factorials up to its size are one array.
    """
    bg = background.select("gene").distinct()
    m = modules.select("module", F.explode("genes").alias("gene")).distinct().join(bg, "gene", "left_semi")
    t = terms.select("term", F.explode("genes").alias("gene")).distinct().join(bg, "gene", "left_semi")
    hits = m.join(t, "gene").groupBy("module", "term").agg(F.count("*").alias("overlap"), F.array_sort(F.collect_list("gene")).alias("genes"))
    rows = hits.join(m.groupBy("module").agg(F.count("*").alias("module_size")), "module").join(t.groupBy("term").agg(F.count("*").alias("term_size")), "term").crossJoin(bg.agg(F.count("*").alias("size")))
    # log factorials up to the number of genes in the background
    lf = bg.select(F.row_number().over(Window.orderBy("gene")).alias("i")).select("i", F.sum(F.log(F.col("i").cast("double"))).over(Window.orderBy("i")).alias("lf"))
    lf = lf.agg(F.array_prepend(F.transform(F.array_sort(F.collect_list(F.struct("i", "lf"))), lambda x: x["lf"]), F.lit(0.0)).alias("lf"))
    choose = lambda n, k: F.get("lf", n.cast("int")) - F.get("lf", k.cast("int")) - F.get("lf", (n - k).cast("int"))
    n, a, b = F.col("size"), F.col("module_size"), F.col("term_size")
    some = F.sequence(F.greatest(F.col("overlap"), a + b - n), F.least(a, b))
    p = F.aggregate(some, F.lit(0.0), lambda s, x: s + F.exp(choose(b, x) + choose(n - b, a - x) - choose(n, a)))
    rows = rows.crossJoin(F.broadcast(lf)).withColumn("P", F.least(p, F.lit(1.0)))
    by = Window.partitionBy("module").orderBy("P", "term")
    rows = rows.withColumn("rank", F.row_number().over(by)).withColumn("of", F.count("*").over(Window.partitionBy("module")))
    rows = rows.withColumn("Adjusted_P", F.least(F.lit(1.0), F.min(F.col("P") * F.col("of") / F.col("rank")).over(Window.partitionBy("module").orderBy(F.desc("rank")))))
    x = F.col("overlap")
    odds = ((x + 0.5) * (n - a - b + x + 0.5)) / ((a - x + 0.5) * (b - x + 0.5))
    return rows.filter(F.col("rank") <= top_n).select("module", "term", "overlap", "module_size", "term_size", "P", "Adjusted_P", odds.alias("odds_ratio"), "genes")


def enriched_modules(modules: DataFrame, terms: DataFrame, background: DataFrame, top_n: int = 200) -> DataFrame:
    """enrichment() with a row for each module that has no term in common, with nulls beside its number: empty modules too."""
    return modules.select("module").distinct().join(enrichment(modules, terms, background, top_n), "module", "left")
