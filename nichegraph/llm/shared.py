"""What several corpus operators need: tables, the shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the six ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one of so many rows is joined where the rows are.
HOT_SHARE = 10_000
#: Rows of a few short columns that are worth a file of a written table.
ROWS_A_FILE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that further columns of any name can't clash; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, text, times): rows of texts() that are equal as one, with their number, so that they burden one task no more than one row.

    Ids and hashes say first whether there are any; the texts are only grouped if so.
    """
    again = rows.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return rows.withColumn("times", F.lit(1).cast("long"))
    return rows.groupBy("doc_id", "text").agg(F.count("*").alias("times"))


def held_out(id_column: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy", rows: int | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors.

    rows: about how many its last stage reads, if known. That stage then has a task for each rows_a_file of them at most, so
    that a small table isn't a file for every shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_a_file)))
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_class(rows: DataFrame, of: DataFrame, key: str, few_files: bool = False) -> DataFrame:
    """rows joined by the key to `of`, which has a row and the number n of rows for each key.

    Keys with more than a HOT_SHARE-th of all rows, HOT_SHARE at most, are sent to the rows where they are; all
    other keys deal out so few rows each that no task gets many more than others. few_files: `of` is written by as few
    tasks as rows' number asks for.
    """
    total = rows.count()
    of = written(of, rows=total if few_files else None)
    hot = of.filter(F.col("n") > max(1, total // HOT_SHARE))
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True)).drop("n")), key, "left")
    names = [c for c in of.columns if c not in (key, "n")]
    rest = rows.filter("hot is null").drop("hot", *names).join(of.drop("n"), key)
    return rows.filter("hot").drop("hot").unionByName(rest.select(*rows.drop("hot").columns))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per linked node, root the smallest node.

    Alternates large-star and small-star contraction; each round is written to the shared folder. A node's
    links are read by joins that Spark may split, never gathered into one row. Null ends and loops are left
    out. Ends when a round changes nothing. Rounds never add to the number of links.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ends.filter("a is not null and b is not null and a <> b").distinct())

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = sign(now)
    while was[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), rows=was[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least).distinct(), rows=was[0])
        if (new := sign(now)) == was:
            break
        was = new
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
