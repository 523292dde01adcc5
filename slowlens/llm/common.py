"""What the text operators share: words as expressions, tables on disk, sizes, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slowlens.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever is no digit, no lower-case letter and no character beyond ASCII ends a word.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What ends a word in a text whose A-Z are still in upper case.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    It cuts the lineage, survives lost executors and tells the planner the real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(lowered(text), WORD_GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of ``words_of`` a text, without a lower-case copy of it."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), RAW_GAP), lambda w: w != "")).cast("long")


def tokens_of(text: Column) -> Column:
    """What white space separates; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: a text of its own) in joins and groups."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def indexes(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def broadcast_if(df: DataFrame, rows: int, weight: Column | None = None, most: int = 0) -> DataFrame:
    """``df`` marked for broadcast if counting shows at most ``rows`` rows, else as it is.

    Rows that hold values without a bound are weighed as well: the sum of ``weight`` must not exceed ``most``.
    ``df`` should be a written table, so that the count is cheap.
    """
    if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) > rows:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > most:
        return df
    return F.broadcast(df)


def rank_in(df: DataFrame, key: str, slice_by: Column, order: list[Column], out: str) -> DataFrame:
    """Row numbers from 0 per ``key``, without a task that holds a whole key.

    Rows are ranked inside slices of a key; a table with one row per slice carries the
    number of rows in earlier slices.  ``slice_by`` must not decrease along ``order``.
    """
    return running_before(df, key, slice_by, order, F.lit(1), out)


def running_before(df: DataFrame, key: str, slice_by: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its ``key``, by slices as ``rank_in``."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value.cast("long"))
    totals = sliced.groupBy(key, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(key).alias("_key"),
        F.col("_slice").alias("_in"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"),
    )
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_before", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_in")))
        .withColumn(out, F.col("_carry") + F.col("_before"))
        .drop("_slice", "_value", "_before", "_key", "_in", "_carry")
    )


def same_components(edges: DataFrame, label: str, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of undirected edges ``(a, b)``; root is the least node.

    Each round links every node's larger neighbours to its least one, then the smaller
    ones likewise (large star, small star), which shrinks paths by a constant factor.  A
    hub's neighbours are pre-aggregated to their least before any join; no group is
    collected.  Every round is written, so a lost executor costs one round at most.
    """
    def links(df):
        return df.where("a <> b").distinct()

    current = saved(links(edges.select("a", "b")), label)
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b")))
        after = saved(links(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), label)
        if same_rows(current, after):
            break
        current = after
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal numbers and equal sums of two row hashes, for tables without repeated rows."""
    def mark(df):
        return df.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
        ).first()

    return tuple(mark(left)) == tuple(mark(right))
