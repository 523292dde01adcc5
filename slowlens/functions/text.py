"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The blank characters that trimming removes.
BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Remove blanks, tabs and line ends on both sides."""
    return F.btrim(col, F.lit(BLANKS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives null, not an empty text, without a match."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def unix_newlines(col: Column) -> Column:
    """Both other line-end conventions become a single newline."""
    return F.regexp_replace(col, "\r\n?", "\n")


def preview(col: Column, n: int, ellipsis: bool = False) -> Column:
    """First ``n`` characters; on one line, or with dots where text was cut."""
    cut = F.substring(col, 1, n)
    if ellipsis:
        return F.when(F.length(col) > n, F.concat(cut, F.lit("..."))).otherwise(cut)
    return F.translate(cut, "\n", " ")


def plan_text(plan: Column) -> Column:
    """Plan lines as one text; rules of dashes get the width of the widest line."""
    widths = F.transform(F.filter(plan, lambda l: strip(l) != ""), F.length)
    width = F.coalesce(F.array_max(widths), F.lit(80))
    return F.array_join(
        F.transform(plan, lambda l: F.when(strip(l).rlike("^-+$"), F.repeat(F.lit("-"), width)).otherwise(l)),
        "\n",
    )


def parse_num(col: Column) -> Column:
    """``1,234`` / ``12K`` / ``3.5M`` / ``1G`` as a double; anything else is 0."""
    text = F.regexp_replace(strip(col.cast("string")), ",", "")
    suffix = F.substring(text, -1, 1)
    scale = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "G", 1e9).otherwise(1.0)
    digits = F.regexp_replace(text, "[KMG]$", "")
    return F.coalesce(digits.try_cast("double") * scale, F.lit(0.0))


def strip_explain(sql: Column) -> Column:
    """The statement behind a leading ``EXPLAIN PLAN FOR``."""
    text = strip(sql)
    # The prefix, and the 16 characters of its full form.
    return F.when(F.upper(text).startswith("EXPLAIN PLAN"), strip(F.substring(text, 17, 1 << 30))).otherwise(text)


def bind_placeholders(sql: Column) -> Column:
    """Names of the ``:word`` placeholders, in text order."""
    return F.regexp_extract_all(sql, F.lit(r":(\w+)"), F.lit(1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def split_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def literal_of(datatype: Column, value: Column) -> Column:
    """A captured bind value as SQL literal: numbers bare, all else quoted."""
    kind = F.upper(F.coalesce(datatype, F.lit("")))
    textual = kind.contains("CHAR") | kind.contains("DATE")
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return (
        F.when(value.isNull(), F.lit("NULL"))
        .when(~textual & kind.contains("NUMBER"), value)
        .otherwise(quoted)
    )


def literalise(statements: DataFrame, binds: DataFrame) -> DataFrame:
    """Statements with their placeholders replaced by captured values.

    ``statements(sql_id, sql_text)``, ``binds(sql_id, position, name,
    datatype_string, value_string)``.  Names are compared without case; the
    first position wins when a name was captured more than once; a placeholder
    without a capture becomes ``'DUMMY'``.  The text is cut at its placeholders
    once and put together again, so values are never scanned for placeholders.

    Captures are reduced to one per statement and name before anything is
    collected, so the map of a statement is as long as its list of names, no
    matter how often it was captured.
    """
    name = F.lower(F.regexp_replace("name", "^:", ""))
    named = binds.filter((F.col("name") != "") & F.col("name").isNotNull()).select(
        "sql_id", name.alias("bind"), "position", literal_of(F.col("datatype_string"), F.col("value_string")).alias("literal")
    )
    firsts = named.groupBy("sql_id", "bind").agg(F.min(F.struct("position", "literal")).alias("first"))
    maps = firsts.groupBy("sql_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bind", F.col("first.literal")))).alias("literals")
    )
    joined = statements.join(maps, "sql_id", "left")
    known = F.coalesce("literals", F.map_from_entries(F.array().cast("array<struct<bind:string,literal:string>>")))
    values = F.transform(
        bind_placeholders(F.col("sql_text")),
        lambda n: F.coalesce(F.try_element_at(known, F.lower(n)), F.lit("'DUMMY'")),
    )
    pieces = F.zip_with(
        F.split("sql_text", r":\w+", -1),
        values,
        lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))),
    )
    return joined.select("sql_id", F.array_join(pieces, "").alias("literal_sql"))
