"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share as many words as
all documents have; a source gives at most ``most`` times its words, and what exceeds
that is shared anew by weight.  The shared level has a closed form over sources ordered by
cap per weight, so no loop is needed.

The words of each source are cut into blocks of equal length (within a word): about
``slots`` for all words, and at least ``least`` for a source that has so many words.  There are as
many slots as the targets ask for blocks.  The golden-ratio points of the slots go through
the cumulative wanted blocks to sources and are ranked per source: the r-th slot of a
source takes the r-th block of its shuffled documents, round after round, ``most`` rounds
at the utmost.  So the points alone decide which blocks are taken and how often; their low
discrepancy keeps each source within a few blocks of its target.  The number of slots does
not grow with the words, only with the number of sources; blocks become longer instead.

Documents are shuffled by a digest of id and text.  Their places in a source come from
sums per slice of the digest, so a source with a third of all rows is spread over 4,096
slices.  Texts are read once; afterwards rows hold numbers only.  Null and blank texts
have size 0 and are never taken.  Identical rows are separate documents that may swap
places, which changes no result.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import broadcast_if, running_before, saved, table

WEIGHTS = (5, 2, 1)
MOST = 3
SLOTS = 1 << 18
LEAST_BLOCKS = 256
GOLDEN = 0.6180339887498949
BUCKETS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest_of(doc_id: Column, text: Column) -> Column:
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.md5(whole.cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, sid, source_size, target, total)``: one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    return (
        by_source.withColumn("sid", rank)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", rest / weight_left)
        .withColumn("level", F.max("level").over(every))
        .select(
            "source",
            "sid",
            "source_size",
            F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
            "total",
        )
    )


def block_counts(sources: DataFrame, slots: int = SLOTS, least: int = LEAST_BLOCKS) -> DataFrame:
    """``sources`` with words, and their number of ``blocks`` and of ``wanted`` slots."""
    length = F.greatest(F.lit(1), F.expr(f"(total + {slots - 1}) div {slots}"))
    even = F.greatest(F.expr("(source_size + length - 1) div length"), F.least(F.lit(least), F.col("source_size")))
    return (
        sources.where("source_size > 0")
        .withColumn("length", length)
        .withColumn("blocks", even.cast("long"))
        .withColumn("wanted", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"))
        .drop("length")
    )


def slot_blocks(counted: DataFrame, most: int = MOST) -> DataFrame:
    """``(sid, block, times, slot)``: how often each block is taken, and its first slot."""
    n = counted.agg(F.sum("wanted")).first()[0] or 0
    until = F.sum("wanted").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))  # a row per source
    whole = F.sum("wanted").over(Window.partitionBy())
    shares = counted.where("wanted > 0").withColumn("high", until / whole).withColumn("low", (until - F.col("wanted")) / whole)
    buckets = F.sequence(F.floor(F.col("low") * BUCKETS), F.floor(F.col("high") * BUCKETS))
    spread = shares.select("sid", "blocks", "low", "high", F.explode(buckets).alias("bucket"))
    at = F.col("slot") * F.lit(GOLDEN)
    points = (
        counted.sparkSession.range(1, n + 1)
        .select(F.col("id").alias("slot"))
        .withColumn("point", at - F.floor(at))
        .withColumn("bucket", F.floor(F.col("point") * BUCKETS))
    )
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1
    ranked = points.join(spread, "bucket").where("low <= point and point < high").select("sid", "slot", "blocks", rank.cast("long").alias("rank"))
    return (
        ranked.where(F.col("rank") < F.col("blocks") * most)
        .groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """A row per document: ``doc_id, source, digest, size, source_size, target, taken, first_slot``.

    ``taken`` counts the words the mix takes, repeats included; ``first_slot`` is the first
    slot that takes a word of the document, null if none does.
    """
    read = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), digest_of(F.col("doc_id"), F.col("text")).alias("digest"))
    sizes = saved(read, "mix-sizes")
    sources = saved(source_targets(sizes, weights, most), "mix-sources")
    counted = block_counts(sources, slots)
    schedule = saved(slot_blocks(counted, most), "mix-slots")
    known = sources.join(counted.select("sid", "blocks"), "sid", "left")
    near = broadcast_if(saved(known, "mix-blocks"), 10_000).withColumnRenamed("source", "_source")
    placed = running_before(
        sizes.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"),
        "sid",
        F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"),
        [F.col("digest")],
        F.col("size"),
        "begins",
    )
    # word w of a source lies in block ((w + 1) * blocks - 1) div source_size
    touched = F.expr("sequence(((begins + 1) * blocks - 1) div source_size, ((begins + size) * blocks - 1) div source_size)")
    blocks = placed.where("size > 0").select("*", F.explode(touched).alias("block"))
    start, end = F.expr("block * source_size div blocks"), F.expr("(block + 1) * source_size div blocks")
    overlap = F.least(F.col("begins") + F.col("size"), end) - F.greatest("begins", start)
    takes = blocks.join(schedule, ["sid", "block"], "left").withColumn("words", overlap * F.coalesce("times", F.lit(0)))
    columns = ["doc_id", "source", "digest", "size", "source_size", "target"]
    taken = takes.groupBy("sid", "begins", *columns).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    blank = placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.select(*columns, "taken", "first_slot").union(blank)


SQL = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as digest from documents),
z as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) - 1 as sid from z),
w as (select *, case sid % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight, source_size * {MOST} as cap,
    cast(sum(source_size) over () as bigint) as total from r),
v as (select *, cast(total - coalesce(sum(cap) over o, 0) as double) / cast(sum(weight) over () - coalesce(sum(weight) over o, 0) as double) as level
  from w window o as (order by cast(cap as double) / weight, sid rows between unbounded preceding and 1 preceding)),
s as (select source, sid, source_size, total, least(cast(cap as double), max(level) over () * weight) as target,
    greatest(1, (total + {SLOTS - 1}) // {SLOTS}) as length from v),
n as (select *, cast(floor(target * blocks / source_size + 0.5) as bigint) as wanted from (
  select *, greatest((source_size + length - 1) // length, least({LEAST_BLOCKS}, source_size)) as blocks from s where source_size > 0) x),
e as (select sid, blocks, cast(sum(wanted) over (order by sid) as double) / cast(sum(wanted) over () as double) as high,
    cast(sum(wanted) over (order by sid) - wanted as double) / cast(sum(wanted) over () as double) as low from n where wanted > 0),
g as (select unnest(range(1, (select cast(sum(wanted) as bigint) from n) + 1)) as slot),
p as (select slot, slot * {GOLDEN}::double - floor(slot * {GOLDEN}::double) as point from g),
k as (select sid, slot, blocks, row_number() over (partition by sid order by slot) - 1 as rank from p join e on point >= low and point < high),
b as (select sid, rank % blocks as block, count(*) as times, min(slot) as slot from k where rank < blocks * {MOST} group by all),
o as (select doc_id, digest, size, s.sid, s.source_size, target, blocks,
    cast(sum(size) over (partition by s.sid order by digest rows between unbounded preceding and current row) - size as bigint) as begins
  from d join s on d.source is not distinct from s.source left join (select sid, blocks from n) nb on nb.sid = s.sid),
x as (select *, unnest(range(((begins + 1) * blocks - 1) // source_size, ((begins + size) * blocks - 1) // source_size + 1)) as block
  from o where size > 0),
y as (select x.*, slot, (least(begins + size, (x.block + 1) * source_size // blocks) - greatest(begins, x.block * source_size // blocks))
    * coalesce(times, 0) as words from x left join b on x.sid = b.sid and x.block = b.block),
m as (select doc_id, sid, begins, size, source_size, target, cast(sum(words) as bigint) as taken, min(slot) as first_slot
  from y group by all)
select doc_id, cast(size as bigint) as size, source_size, target, taken, first_slot from m
union all select doc_id, cast(size as bigint), source_size, target, cast(0 as bigint), null from o where size = 0"""


@query("op10_slot_schedule", SQL)
def op10_slot_schedule(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it, rounded to whole copies; columns of ``documents``."""
    times = (
        mix(docs)
        .where("size > 0")
        .groupBy(F.col("digest").alias("_digest"), F.col("source").alias("_source"))
        .agg(F.expr("round(avg((2 * taken + size) div (2 * size)))").cast("int").alias("_copies"))
        .where("_copies > 0")
    )
    keyed = docs.withColumn("_key", digest_of(F.col("doc_id"), F.col("text")))
    same = (F.col("_key") == F.col("_digest")) & F.col("source").eqNullSafe(F.col("_source"))
    repeated = keyed.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)
