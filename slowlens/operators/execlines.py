"""Statements of reports too large to be read whole, from lines.

A block of such a report may be longer than a value or a task can hold, so no
block is put together.  Lines are dealt by block and slice of ``slice_lines``
lines.  Keyed aggregates, summed per slice and then per block, give the
positions that matter (first text, call table, plan, waits and their ends);
each is sent back to the slices of its block, and only the lines between them
are collected.  The result equals that of ``exec_statements`` on whole blocks.

Most blocks of a large report are short, though.  Those of at most ``slice_lines``
lines, as many as a task collects of a slice anyhow, and no larger than a text that is
read whole are put together and parsed as blocks, so that only others go by lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.labels import bind_type_name
from slowlens.functions.ordered import running_state, running_sum
from slowlens.functions.text import BLANKS, rstrip, strip
from slowlens.operators import execreport as e
from slowlens.session import scratch_path
from slowlens.sources.texts import PACK_MARK, PackLines, TextSet, with_pack_path

BLOCK = ("file", "block_no")
OPENS_BINDS = rf"^[ \t]*{e.BINDS_OPEN}"
CLOSES_BINDS = rf"^[ \t]*{e.BINDS_CLOSE}"
OPENS_BIND = rf"^[ \t]*{e.BIND_OPEN}"


def report_statements(reports: TextSet, settings: Settings = DEFAULTS) -> DataFrame:
    """``exec_statements`` of a report set; lines of large reports are numbered and written once, then read by block.

    Of large packs, blocks that lie in one split are written as values and need no other shuffle.
    """
    whole = e.exec_statements(e.exec_blocks(TextSet(reports.texts), settings))
    if reports.long_lines is None:
        return whole
    if reports.packs is not None:
        pieces = block_pieces(reports.packs, settings)
        small = (F.col("n") < settings.slice_lines) & (F.col("bytes") <= DEFAULTS.whole_file_bytes)
        ended = F.col("inside") & (F.col("slice") == 0) & small
        block = F.array_join("lines", "\n").alias("block")
        whole = whole.unionByName(e.exec_statements(e.kept_blocks(pieces.filter(ended).select(*BLOCK, block))))
        numbered = pieces.filter(~ended).select(*BLOCK, "line_no", F.posexplode("lines").alias("_i", "line"))
        lines = numbered.select(*BLOCK, (F.col("line_no") + F.col("_i")).alias("line_no"), "line")
    else:
        lines = _written(block_lines(reports.long_lines, settings), "block-lines")
    sizes = lines.groupBy(*BLOCK).agg(F.count("*").alias("_n"), F.sum(F.octet_length("line") + 1).alias("_bytes"))
    large = sizes.filter((F.col("_n") > settings.slice_lines) | (F.col("_bytes") > DEFAULTS.whole_file_bytes)).select(*BLOCK)
    if large.isEmpty():
        return whole.unionByName(e.exec_statements(blocks_of_lines(lines)))
    short = e.exec_statements(blocks_of_lines(lines.join(large, [*BLOCK], "left_anti")))
    long = statements_of_lines(lines.join(large, [*BLOCK], "left_semi"), settings)
    return whole.unionByName(short).unionByName(long)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_pieces(packs: PackLines, settings: Settings = DEFAULTS) -> DataFrame:
    """``(file, block_no, slice, line_no, lines, n, bytes, inside)``: the blocks of texts in large packs, cut at the ends
    of splits and after ``slice_lines`` lines; ``line_no`` is that of the first of ``lines``, and ``inside``
    tells that neither end of the block can lie in another split.

    Lines are dealt by split once, in compressed files, and sorted.  In a split, blocks are counted from the last mark of
    a text or from the split's begin; pieces are written, and what lies in splits before follows from one row per split.
    """
    with _dealt(packs.lines, "pack-lines", "pack", "split") as read:
        pieces = _written(_pieces_in_splits(read, settings.slice_lines), "block-pieces")
    starts = _starts_of_splits(pieces.select("pack", "split", "at", "name", "block", "low", "high"))
    placed = with_pack_path(
        pieces.filter("block >= 0")
        .join(F.broadcast(starts), ["pack", "split"])  # one row per split
        .withColumn("name", F.coalesce("name", "_open.name"))
    )
    own = F.col("at").isNotNull()
    return placed.select(
        packs.file,
        F.when(own, F.col("block")).otherwise(F.col("_open.block") + F.col("block")).alias("block_no"),
        "slice",
        F.when(own, F.col("low") - F.col("at")).otherwise(F.col("low") + F.col("_shift") - F.col("_open.at")).cast("bigint").alias("line_no"),
        "lines",
        F.size("lines").alias("n"),
        "bytes",
        ((own | (F.col("block") > 0)) & (F.col("high") < F.col("_high"))).alias("inside"),
    ).filter("line_no > 0")


@contextmanager
def _dealt(df: DataFrame, label: str, *by: str) -> Iterator[DataFrame]:
    """``df`` dealt by columns to as many tasks as a shuffle has, by way of files in the shared folder.

    Rows in compressed columns take a tenth of the disk of shuffled ones.  Files by bucket are known to
    the catalog only, so there is a table while they are read.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    table = f"dealt_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.mode("errorifexists").option("path", path).option("compression", "zstd").bucketBy(tasks, *by).saveAsTable(table, format="parquet")
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"drop table {table}")


def _pieces_in_splits(read: DataFrame, n: int) -> DataFrame:
    """``(pack, split, at, name, block, slice, low, high, bytes, lines)``: lines ``low`` to ``high`` of a block in a split,
    counted from the mark ``at`` of its text, or from the begin of the split where it has none before."""
    line = F.col("line")
    in_split = Window.partitionBy("pack", "split").orderBy("id")
    upto, before = (in_split.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    is_mark = line.startswith(PACK_MARK)
    cut = F.when(is_mark, F.array(F.lit(None).cast("string"))).otherwise(F.split(line, e.STAR_RULE, -1))
    parts = read.withColumn("_cut", cut).withColumn("_cuts", F.size("_cut") - 1)
    begins = F.when(is_mark, F.col("id") + 1).when(F.col("_cuts") > 0, F.col("id"))
    counted = parts.withColumn("_after", F.sum("_cuts").over(upto)).withColumn("_begun", F.last(begins, ignorenulls=True).over(before))
    head = F.when(is_mark, F.struct(F.col("id").alias("at"), F.substr(line, F.lit(2)).alias("name"), F.col("_after").alias("cuts")))
    headed = counted.withColumn("_head", F.last(head, ignorenulls=True).over(upto)).select(
        "pack", "split", "id", "_head.at", "_head.name", is_mark.alias("_is_mark"), "_begun",
        (F.col("_after") - F.col("_cuts") - F.coalesce("_head.cuts", F.lit(0))).alias("_before"),
        F.posexplode("_cut").alias("_i", "part"),
    )
    # the mark of a text is a row of its own, without a block
    block = F.when(F.col("_is_mark"), -1).otherwise(F.col("_before") + F.col("_i")).cast("bigint")
    since = F.col("id") - F.when(F.col("_i") > 0, F.col("id")).otherwise(F.coalesce("_begun", F.lit(0)))
    slices = headed.groupBy("pack", "split", "at", "name", block.alias("block"), F.floor(since / n).alias("slice")).agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("part", F.lit("")).alias("part")))).alias("l"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.sum(F.octet_length("part") + 1).alias("bytes"),
    )
    return slices.select("*", F.col("l.part").alias("lines")).drop("l")


def _starts_of_splits(pieces: DataFrame) -> DataFrame:
    """``(pack, split, _shift, _high, _open)``: what makes an id a line number of the pack, the last id, and the text that is open
    where the split begins: its name, the line of its mark and the block that goes on."""
    last = F.max(F.struct("at", "block", "name"))  # that of no text in the split is the least
    sizes = pieces.groupBy("pack", "split").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), last.alias("_last"))
    by_split = Window.partitionBy("pack").orderBy("split")
    before = by_split.rowsBetween(Window.unboundedPreceding, -1)
    has_mark = F.col("_last.at").isNotNull()
    shift = F.coalesce(F.sum(F.col("_high") - F.col("_low") + 1).over(before), F.lit(0)) - F.col("_low") + 1
    shifted = sizes.withColumn("_shift", shift).withColumn("_texts", F.sum(has_mark.cast("int")).over(by_split))
    # blocks that ended since the last mark, in this split and those before
    ended = F.sum(F.greatest("_last.block", F.lit(0))).over(
        Window.partitionBy("pack", "_texts").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    )
    mark = F.when(has_mark, F.struct((F.col("_last.at") + F.col("_shift")).alias("at"), F.col("_last.name").alias("name")))
    open_ = F.last("_mark", ignorenulls=True).over(before)
    return shifted.select("*", ended.alias("_ended"), mark.alias("_mark")).select(
        "pack",
        "split",
        "_shift",
        "_high",
        F.struct(
            open_["at"].alias("at"), open_["name"].alias("name"), F.lag("_ended").over(by_split).alias("block")
        ).alias("_open"),
    )


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """``exec_blocks`` of the lines of blocks that are small enough for a value."""
    # a fixed number of tasks: shuffled lines compress so well that their size says little about the parse
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = lines.repartition(tasks, *BLOCK).groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return e.kept_blocks(listed.select(*BLOCK, F.array_join(F.col("_l.line"), "\n").alias("block")))


def block_lines(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(file, block_no, line_no, line)`` of a large report's lines; star rules belong to no block."""
    cut = F.split("line", e.STAR_RULE, -1)
    counted = running_sum(
        lines.withColumn("_cuts", F.size(cut) - 1), "file", ["line_no"], F.col("_cuts"), "_after", settings.slice_lines
    )
    parts = counted.select(
        "file", "line_no", (F.col("_after") - F.col("_cuts")).alias("_before"), F.posexplode(cut).alias("_i", "_part")
    )
    return parts.select(
        "file", (F.col("_before") + F.col("_i")).cast("bigint").alias("block_no"), "line_no", F.col("_part").alias("line")
    )


def _per_block(lines: DataFrame, **found: Column) -> DataFrame:
    """Aggregates per block, each a least or greatest struct, by way of its slices."""
    named = {name: (F.min if name.startswith("first") else F.max) for name in found}
    slices = lines.groupBy(*BLOCK, "slice").agg(*[named[n](value).alias(n) for n, value in found.items()])
    return slices.groupBy(*BLOCK).agg(*[named[n](n).alias(n) for n in found])


def _to_slices(blocks: DataFrame, slice_lines: int) -> DataFrame:
    """A row of a block for each slice from its first line of text to its last."""
    slices = F.sequence(F.floor(F.col("from_no") / slice_lines), F.floor(F.col("to_no") / slice_lines))
    return blocks.withColumn("slice", F.explode(slices))


def _at(test: Column) -> Column:
    """The line number where ``test`` holds."""
    return F.when(test, F.col("line_no"))


def statements_of_lines(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Statements of ``(file, block_no, line_no, line)``; columns of ``exec_statements``."""
    n, line, no = settings.slice_lines, F.col("line"), F.col("line_no")
    dealt = lines.withColumn("slice", F.floor(no / n))
    has_text = strip(line) != ""
    shape = _per_block(
        dealt,
        first_text=F.when(has_text, F.struct("line_no", F.ltrim(line, F.lit(BLANKS)).rlike(e.CALL_HEADER).alias("is_call"))),
        last_text=F.when(has_text, F.struct("line_no", F.length(rstrip(line)).alias("size"))),
        first_call=_at(line.rlike(e.CALL_HEADER)),
    )
    # a block that begins with its call table has no text
    headed = shape.filter((F.col("first_call") > F.col("first_text.line_no")) & ~F.col("first_text.is_call")).select(
        *BLOCK, F.col("first_text.line_no").alias("from_no"), F.col("last_text.line_no").alias("to_no"), F.col("first_call").alias("head")
    )
    inside = dealt.join(_to_slices(headed, n), [*BLOCK, "slice"]).filter(no.between(F.col("from_no"), F.col("to_no")))
    before, body = no < F.col("head"), no >= F.col("head")
    is_id = line.rlike(e.STATEMENT_ID)
    near = body & (no < F.col("head") + e.PHASE_ROWS)
    phases = {
        f"last_{p}": F.when(near & strip(line).rlike(f"(?i)^{p}{e.PHASE_NUMBERS}"), F.struct("line_no", strip(line).alias("row")))
        for p in e.ALL_PHASES
    }
    found = _per_block(
        inside,
        last_id=F.when(before & is_id, F.struct("line_no", F.regexp_extract(line, e.STATEMENT_ID, 1).alias("id"))),
        first_plan=_at(body & (line.contains(e.PLAN_HEADER_PHRASE) | line.rlike(e.PLAN_HEADER))),
        first_wait=_at(body & line.rlike(e.WAIT_HEADER)),
        **phases,
    )
    placed = headed.join(found, [*BLOCK])
    listed = dealt.join(_to_slices(placed.select(*BLOCK, "from_no", "to_no", "head", "first_plan", "first_wait"), n), [*BLOCK, "slice"]).filter(
        no.between(F.col("from_no"), F.col("to_no"))
    )
    ends = _per_block(
        listed,
        first_plan_end=_at((no > F.col("first_plan")) & line.rlike(e.PLAN_END)),
        first_wait_end=_at((no >= F.col("first_wait") + 2) & ((strip(line) == "") | strip(line).startswith("****"))),
    )
    pieces = _collected(dealt, placed.join(ends, [*BLOCK]), n)
    binds = _binds_of_lines(lines, n)
    empty = F.array().cast("array<string>")
    parts = pieces.join(binds, [*BLOCK], "left").select(
        *BLOCK,
        F.coalesce("last_id.id", F.lit("")).alias("sql_id"),
        strip(F.array_join(F.coalesce("texts", empty), "\n")).alias("sql_text"),
        *[e.words(F.regexp_extract(f"last_{p}.row", f"(?i)^{p}{e.PHASE_NUMBERS}", 0)).alias(f"_{p}") for p in e.ALL_PHASES],
        F.coalesce("plans", empty).alias("_plan"),
        F.coalesce("waits", empty).alias("_waits"),
        F.coalesce("bind_variables", F.array().cast(binds.schema["bind_variables"].dataType)).alias("bind_variables"),
        "size",
    )
    kept = parts.filter((F.col("sql_text") != "") & (F.col("size") >= e.MIN_BLOCK_CHARS))
    timed, counters = e.with_counters(kept)
    return timed.select(
        *BLOCK,
        "sql_id",
        "sql_text",
        *counters,
        F.transform("_plan", rstrip).alias("execution_plan"),
        e.wait_structs(F.transform("_waits", strip)).alias("wait_events"),
        "bind_variables",
    )


def _collected(dealt: DataFrame, blocks: DataFrame, slice_lines: int) -> DataFrame:
    """``blocks`` with the lines of their statement, plan and waits, and their size without outer blanks.

    Only lines of these three are collected, in slices first.
    """
    line, no = F.col("line"), F.col("line_no")
    spread = dealt.join(_to_slices(blocks, slice_lines), [*BLOCK, "slice"]).filter(no.between(F.col("from_no"), F.col("to_no")))
    one = F.struct("line_no", "line")

    def until(end: str) -> Column:
        return F.col(end).isNull() | (no < F.col(end))

    wanted = {
        "texts": (no < F.col("head")) & ~line.rlike(e.STATEMENT_ID),
        "plans": (no > F.col("first_plan")) & until("first_plan_end"),
        "waits": (no >= F.col("first_wait") + 2) & until("first_wait_end"),
    }
    trimmed = F.when(no == F.col("from_no"), F.ltrim(line, F.lit(BLANKS))).otherwise(line)
    trimmed = F.when(no == F.col("to_no"), rstrip(trimmed)).otherwise(trimmed)
    slices = spread.groupBy(*BLOCK, "slice").agg(
        *[F.collect_list(F.when(test, one)).alias(name) for name, test in wanted.items()], F.sum(F.length(trimmed) + 1).alias("size")
    )
    whole = slices.groupBy(*BLOCK).agg(
        *[F.array_sort(F.flatten(F.collect_list(name)))["line"].alias(name) for name in wanted], (F.sum("size") - 1).alias("size")
    )
    return blocks.join(whole, [*BLOCK])


def _binds_of_lines(lines: DataFrame, slice_lines: int) -> DataFrame:
    """``(file, block_no, bind_variables)``: a piece is the lines from one marker to the next, in an open section."""
    line = F.col("line")
    opens, closes, starts = line.rlike(OPENS_BINDS), line.rlike(CLOSES_BINDS), line.rlike(OPENS_BIND)
    value, kind = line.rlike(e.BIND_VALUE), line.rlike(e.BIND_TYPE)
    marked = lines.filter(opens | closes | starts | value | kind).withColumn("key", F.struct(*BLOCK))
    counted = running_sum(marked, "key", ["line_no"], (opens | closes | starts).cast("int"), "piece", slice_lines)
    section = {"section": F.when(opens | closes, F.struct(opens.alias("open")))}
    inside = running_state(counted, "key", "line_no", section, {}, slice_lines).filter("section.open")
    number = F.when(starts, F.regexp_extract(line, e.BIND_NUMBER, 1).cast("bigint") + 1)
    pieces = inside.groupBy("key", "piece").agg(
        F.max(number).alias("position"),
        F.max_by(e.last_value(line, e.BIND_TYPE), F.when(kind, F.col("line_no"))).alias("type"),
        F.max_by(e.last_value(line, e.BIND_VALUE), F.when(value, F.col("line_no"))).alias("value"),
        F.max(starts | value | kind).alias("is_bind"),
    )
    bind = F.struct("piece", "position", bind_type_name(F.col("type")).alias("type"), "value")
    listed = pieces.filter("is_bind").groupBy("key").agg(F.array_sort(F.collect_list(bind)).alias("b"))
    return listed.select(
        "key.file",
        "key.block_no",
        F.transform("b", lambda b: F.struct(b["position"].alias("position"), b["type"].alias("type"), b["value"].alias("value"))).alias(
            "bind_variables"
        ),
    )
