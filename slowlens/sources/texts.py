"""Text file sets: execution reports and optimizer traces.

Files up to ``Settings.whole_file_bytes`` are read whole, one row each, so
that everything up to the statement or line level is a map-only step.  Larger
files are read split by split (many tasks per file) and their lines numbered
by counting lines per split.  Nothing is cut or rejected for size.

Very many small texts are kept in packs: files that hold a text after the other,
so that listing, opening and committing files costs little beside reading them.
A pack is cut at its marks by the reader of text files, split by split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.ordered import running_sum
from slowlens.functions.text import unix_newlines

# File name patterns of the two kinds of text.
TRACE_GLOB = "10053_*.trc"
REPORT_GLOB = "*.prf"
# Phrases at least one of which every usable trace holds.
TRACE_MARKERS = ("SINGLE TABLE ACCESS PATH", "PARAMETERS USED BY THE OPTIMIZER")
# Fixed value: begins the line that names a text in a pack; the text follows, ended by one more line end.
PACK_MARK = "\x1e"


@dataclass(frozen=True)
class PackLines:
    """``lines(pack, split, line, id)`` of large packs; ``id`` is consecutive in a split and only there.

    The lines of a text follow the one with its mark and name, in splits after that, too.
    ``file`` is its key, made from ``path``.
    """

    lines: DataFrame
    file: Column


@dataclass(frozen=True)
class TextSet:
    """``texts(file, text)`` plus the lines of files too large to read whole.

    ``file`` is the key of a text everywhere: the full path where texts are read.
    ``long_lines(file, line_no, line)`` is None when no file is that large;
    ``line_no`` starts at 1.  ``followed`` has those of them that are not blank, with
    ``next1`` and ``next2``, where the reader finds these on the way.  ``packs`` has the lines of
    large packs as they are read, before they are numbered.
    """

    texts: DataFrame
    long_lines: DataFrame | None = None
    followed: DataFrame | None = None
    packs: PackLines | None = None


def file_path() -> Column:
    """The key of a file: its full path, as names may repeat in other folders."""
    return F.col("_metadata.file_path")


def _pack_path() -> Column:
    """The path of a text in a pack: that of the pack, then the name of the text in it."""
    return F.concat("pack", F.lit("!/"), F.col("name"))


def folder_value(column: str = "file", path: Column | None = None) -> Column:
    """The key of a file that lies alone in a folder ``column=value``: the value."""
    return F.regexp_extract(file_path() if path is None else path, rf"/{column}=([^/]+)/[^/]*$", 1)


def number_lines(rows: DataFrame, packed: bool = False) -> DataFrame:
    """Line numbers for ``(file, split, value, bytes, file_bytes)`` rows read in file order.

    Inside a split the reading order is that of ``monotonically_increasing_id``;
    only the order is used, never the id itself, so the result does not depend
    on how splits were packed into tasks.  A split is the unit of the sort.

    The reader gives no row for what follows a final line end.  The file has
    one when its lines with a line end each fill it, or when its last line keeps a
    carriage return; then an empty line is added, as cutting the whole text gives.

    Of packs, ``file`` is the pack in the rows, and lines come with the ``name`` of their
    text and numbered in it: a split gives on the last name in it to those after it.
    ``next1`` and ``next2`` are the lines with text after each in its text.
    """
    in_order = _lines_in_order(rows)
    if packed:
        return _numbered_in_packs(in_order.select("file", "split", "line", "_id"))
    ordered = in_order.withColumn("_n", F.row_number().over(Window.partitionBy("file", "split").orderBy("_id")))
    filled = F.sum(F.when(F.col("_piece") == 0, F.col("bytes") + 1))
    sizes = ordered.groupBy("file", "split").agg(
        F.max("_n").alias("_size"), filled.alias("_filled"), F.max("file_bytes").alias("_file_bytes"), F.max_by("_cr", "_n").alias("_cr")
    )
    by_split = Window.partitionBy("file").orderBy("split")
    before = by_split.rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.lead("split").over(by_split).isNull()
    is_full = F.sum("_filled").over(Window.partitionBy("file")) == F.col("_file_bytes")
    starts = sizes.select(
        "file",
        "split",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.when(is_last & (is_full | F.col("_cr")), F.col("_size")).alias("_ends_at"),
    )
    no = (F.col("_start") + F.col("_n")).cast("bigint")
    own = F.struct(no.alias("line_no"), F.col("line"))
    after = F.struct((no + 1).alias("line_no"), F.lit("").alias("line"))
    found = F.when(F.col("_n").eqNullSafe(F.col("_ends_at")), F.array(own, after)).otherwise(F.array(own))
    return ordered.drop("_cr").join(starts, ["file", "split"]).select("file", F.inline(found))


def _lines_in_order(rows: DataFrame) -> DataFrame:
    """The lines of ``number_lines`` rows, which may hold some, with an ``_id`` in reading order."""
    pieces = F.split(F.regexp_replace("value", "\r$", ""), "\r", -1)
    return (
        rows.withColumn("_cr", F.endswith("value", F.lit("\r")))
        .select("file", "split", "bytes", "file_bytes", "_cr", F.posexplode(pieces).alias("_piece", "line"))
        .withColumn("_id", F.monotonically_increasing_id())
    )


def _numbered_in_packs(lines: DataFrame) -> DataFrame:
    """``(file, name, line_no, line, text, next1, next2)`` of a pack's lines in the order ``_id`` of their split;
    ``text`` is the line unless it is blank.

    One sort inside splits tells everything but what lies in other splits: the name and the
    first line of a text that goes on, and the lines after the end.  These follow from
    one row per split.  The rows of a split are read by one task, so that their ids are consecutive.
    """
    in_split = Window.partitionBy("file", "split").orderBy("_id")
    upto = in_split.rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").startswith(PACK_MARK), F.struct(F.col("_id").alias("at"), F.substr("line", F.lit(2)).alias("name")))
    later = [F.expr(f"lead(_text, {i}) ignore nulls over (partition by file, split order by _id)").alias(f"_next{i}") for i in (1, 2)]
    headed = lines.withColumn("_text", F.when(_has_text(F.col("line")), F.col("line"))).select(
        "*", F.last(named, ignorenulls=True).over(upto).alias("_head"), *later
    )
    first = F.min(F.when(F.col("_text").isNotNull(), F.struct("_id", "_text", "_next1")))
    sizes = headed.groupBy("file", "split").agg(
        F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.max("_head").alias("_last"), first.alias("_first")
    )
    by_split = Window.partitionBy("file").orderBy("split")
    before, after = by_split.rowsBetween(Window.unboundedPreceding, -1), by_split.rowsBetween(1, Window.unboundedFollowing)
    size = F.col("_high") - F.col("_low") + 1
    started = sizes.select(
        "*",
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_start"),
        F.first("_first._text", ignorenulls=True).over(after).alias("_after1"),
    )
    # an open text goes on in this split from the line before its first
    last = F.when(
        F.col("_last").isNotNull(),
        F.struct((F.col("_start") + F.col("_last.at") - F.col("_low") + 1).alias("at"), F.col("_last.name").alias("name")),
    )
    second = F.struct(F.coalesce("_first._next1", "_after1").alias("line"))
    starts = started.select(
        "file",
        "split",
        (F.col("_start") - F.col("_low") + 1).alias("_shift"),
        F.last(last, ignorenulls=True).over(before).alias("_open"),
        "_after1",
        F.first(F.when(F.col("_first").isNotNull(), second), ignorenulls=True).over(after)["line"].alias("_after2"),
    )
    next1 = F.coalesce("_next1", "_after1")
    next2 = F.coalesce("_next2", F.when(F.col("_next1").isNull(), F.col("_after2")).otherwise(F.col("_after1")))
    ends1, ends2 = next1.startswith(PACK_MARK), next2.startswith(PACK_MARK)
    at = F.coalesce("_head.at", F.col("_open.at") - F.col("_shift"))
    return (
        headed.join(F.broadcast(starts), ["file", "split"])  # one row per split
        .select(
            "file",
            F.coalesce("_head.name", "_open.name").alias("name"),
            (F.col("_id") - at).cast("bigint").alias("line_no"),
            "line",
            F.col("_text").alias("text"),
            F.when(~ends1, next1).alias("next1"),
            F.when(~ends1 & ~ends2, next2).alias("next2"),
        )
        .filter("line_no > 0")
    )


def clean_bytes(value: Column, drop_undecodable: bool) -> Column:
    """Text of a file whose bytes may not be UTF-8: those are dropped or replaced."""
    valid = F.make_valid_utf8(value)
    return F.replace(valid, F.lit("\ufffd"), F.lit("")) if drop_undecodable else valid


def read_texts(
    spark: SparkSession,
    path: str | list[str],
    glob: str,
    settings: Settings = DEFAULTS,
    drop_undecodable: bool = False,
    file: Column | None = None,
) -> TextSet:
    """The texts below a path, or of a list of files; ``file`` is the key of a text, by default its full path."""
    file = file_path() if file is None else file
    limit = settings.whole_file_bytes
    size = F.col("_metadata.file_size")

    whole = (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .filter(size <= limit)
        .select(file.alias("file"), unix_newlines(clean_bytes(F.col("value"), drop_undecodable)).alias("text"))
    )
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("length")
    if listing.filter(F.col("length") > limit).isEmpty():
        return TextSet(whole)
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(path)
        .filter(size > limit)
        .select(
            file.alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            clean_bytes(F.col("value"), drop_undecodable).alias("value"),
            F.octet_length("value").alias("bytes"),
            size.alias("file_bytes"),
        )
    )
    return TextSet(whole, number_lines(lines))


def packed_texts(records: DataFrame, drop_undecodable: bool = False, file: Column | None = None) -> DataFrame:
    """``(file, text)`` of the records of packs, read with ``PACK_MARK`` as line end; ``file`` may use ``path``."""
    value = clean_bytes(F.col("value"), drop_undecodable)
    found = records.filter("value <> ''").select(file_path().alias("pack"), value.alias("record"), F.substring_index(value, "\n", 1).alias("name"))
    body = F.regexp_replace(F.substr("record", F.length("name") + 2), r"\r?\n\z", "")
    keyed = found.select(_pack_path().alias("path"), unix_newlines(body).alias("text"))
    return keyed.select((F.col("path") if file is None else file).alias("file"), "text")


def read_packs(
    spark: SparkSession,
    path: str | list[str],
    glob: str,
    settings: Settings = DEFAULTS,
    drop_undecodable: bool = False,
    file: Column | None = None,
) -> TextSet:
    """The texts in packs; packs larger than ``whole_file_bytes`` are read by lines.

    That is their size as they lie there.  A compressed pack is read by one task, so ``per_pack``
    of its writer should keep it small.  ``file`` may use ``path``, by default the key: that of the pack and the name in it.
    """
    limit = settings.whole_file_bytes
    size = F.col("_metadata.file_size")
    reader = spark.read.option("pathGlobFilter", glob)
    whole = packed_texts(reader.option("lineSep", PACK_MARK).text(path).filter(size <= limit), drop_undecodable, file)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("length")
    if listing.filter(F.col("length") > limit).isEmpty():
        return TextSet(whole)
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(path)
        .filter(size > limit)
        .select(
            file_path().alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            clean_bytes(F.col("value"), drop_undecodable).alias("value"),
            F.octet_length("value").alias("bytes"),
            size.alias("file_bytes"),
        )
    )
    numbered = with_pack_path(number_lines(lines, packed=True).withColumnRenamed("file", "pack"))
    key = (F.col("path") if file is None else file).alias("file")
    followed = numbered.filter("text is not null").select(key, "line_no", F.col("text").alias("line"), "next1", "next2")
    read = _lines_in_order(lines).select(F.col("file").alias("pack"), "split", "line", F.col("_id").alias("id"))
    return TextSet(whole, numbered.select(key, "line_no", "line"), followed, PackLines(read, key))


def with_pack_path(rows: DataFrame) -> DataFrame:
    """Rows of ``pack`` and ``name`` with the ``path`` that keys are made from."""
    return rows.withColumn("path", _pack_path())


def read_traces(
    spark: SparkSession,
    path: str | list[str],
    glob: str = TRACE_GLOB,
    settings: Settings = DEFAULTS,
    file: Column | None = None,
    packed: bool = False,
) -> TextSet:
    """Optimizer traces, in files or in packs; bytes that are not UTF-8 are dropped."""
    return (read_packs if packed else read_texts)(spark, path, glob, settings, drop_undecodable=True, file=file)


def read_exec_reports(
    spark: SparkSession,
    path: str | list[str],
    glob: str = REPORT_GLOB,
    settings: Settings = DEFAULTS,
    file: Column | None = None,
    packed: bool = False,
) -> TextSet:
    """Execution reports, in files or in packs; bytes that are not UTF-8 are replaced."""
    return (read_packs if packed else read_texts)(spark, path, glob, settings, file=file)


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line")))


def _has_text(line: Column) -> Column:
    return line.rlike(r"\S")


def _with_followers(lines: Column) -> Column:
    """Numbered lines with the two lines after each.

    ``lines`` must be a stored column: an expression would be evaluated again
    for every line.
    """
    return F.transform(
        lines,
        lambda e, i: F.struct(
            e["line_no"].alias("line_no"),
            e["line"].alias("line"),
            F.get(lines, i + 1)["line"].alias("next1"),
            F.get(lines, i + 2)["line"].alias("next2"),
        ),
    )


def _long_lines_with_followers(lines: DataFrame, slice_lines: int) -> DataFrame:
    """The same for long files: windows per slice of lines with text, each slice
    also holding a copy of the first two lines of the slice after it."""
    counted = running_sum(lines, "file", ["line_no"], F.lit(1), "_no", slice_lines)
    own = F.floor(F.col("_no") / slice_lines)
    offset = F.col("_no") % slice_lines
    slices = F.when((offset < 2) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = counted.withColumn("_own", own).withColumn("_slice", F.explode(slices))
    w = Window.partitionBy("file", "_slice").orderBy("line_no")
    return (
        spread.withColumn("next1", F.lead("line", 1).over(w))
        .withColumn("next2", F.lead("line", 2).over(w))
        .filter(F.col("_own") == F.col("_slice"))
        .select("file", "line_no", "line", "next1", "next2")
    )


def lines_with_followers(texts: TextSet, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """``(file, line_no, line, next1, next2)`` of all lines that are not blank.

    Blank lines are counted, but are nobody's follower.  Two frames: lines of
    whole files and lines of long files.
    """
    numbered = _numbered(F.split("text", "\n", -1))
    kept = texts.texts.select("file", F.filter(numbered, lambda e: _has_text(e["line"])).alias("lines"))
    whole = kept.select("file", F.inline(_with_followers(F.col("lines"))))
    if texts.long_lines is None or texts.followed is not None:
        return whole, texts.followed
    return whole, _long_lines_with_followers(texts.long_lines.filter(_has_text(F.col("line"))), settings.slice_lines)


def trace_lines(traces: TextSet) -> DataFrame:
    """``(file, line_no, line)`` of all lines of a trace set, both kinds of file together."""
    whole = traces.texts.select("file", F.inline(_numbered(F.split("text", "\n", -1))))
    return whole if traces.long_lines is None else whole.unionByName(traces.long_lines)


def texts_of(df: DataFrame) -> TextSet:
    """A text set of ``(file, text)`` rows that are already at hand."""
    return TextSet(df.select("file", unix_newlines(F.col("text")).alias("text")))


def text_files(texts: TextSet) -> DataFrame:
    """``(file)``, each file once."""
    names = texts.texts.select("file")
    return names if texts.long_lines is None else names.unionByName(texts.long_lines.select("file").distinct())


def trace_content_check(traces: TextSet) -> DataFrame:
    """Per file the number of lines that hold a marker phrase; 0 means reject."""

    def marked(line):
        return line.contains(TRACE_MARKERS[0]) | line.contains(TRACE_MARKERS[1])

    per_text = F.size(F.filter(F.split("text", "\n", -1), marked))
    out = traces.texts.select("file", per_text.cast("bigint").alias("marker_lines"))
    if traces.long_lines is None:
        return out
    long = traces.long_lines.groupBy("file").agg(F.count_if(marked(F.col("line"))).cast("bigint").alias("marker_lines"))
    return out.unionByName(long)


def rejected_traces(traces: TextSet) -> DataFrame:
    """Files without any marker line: read, but with nothing to extract."""
    return trace_content_check(traces).filter("marker_lines = 0").select("file")
