"""Quality rules, line first: judge every line, drop failing ones, then judge what is left.

A line goes if it is navigation (three separators or more, at least one in five tokens),
symbol noise or shouting, short boilerplate, or ten tokens and more without a single
punctuation mark.  A document is rejected if its base measures fail or if more than
``max_lost`` percent of its tokens stood in dropped lines.

Built-in functions only, one row per document, no shuffle: what is needed of a text
stays in its row, and all work is proportional to the text (times a logarithm for
repeated phrases).  Null and blank texts have no tokens and fail the base measures.
Repeated rows are judged one by one; other columns are passed through untouched by
``clean_lines`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import SPACES, free_name, indexes, let, table, tokens_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›"
MARKS = ".!?,;:…。！？،؟।"
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie",
    "javascript",
    "lorem ipsum",
    "sign up",
    "log in",
    "subscribe",
    "click here",
    "read more",
)
BOILERPLATE_TOKENS = 20
UNMARKED_TOKENS = 10
MIN_TOKENS = 50
MAX_REPEAT = 50
MAX_LOST = 50


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether the rules drop a line; blank lines stay."""
    def judge(n):
        symbols, shouts, separators = count_of(line, SYMBOLS), count_of(line, "!"), count_of(line, SEPARATORS)
        low = F.lower(line)
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate = boilerplate | F.contains(low, F.lit(phrase))
        return (
            ((separators >= 3) & (separators * 5 >= n))
            | ((symbols >= 3) & (symbols * 2 >= n))
            | ((shouts >= 3) & (shouts * 2 >= n))
            | ((n >= UNMARKED_TOKENS) & (count_of(line, MARKS) == 0))
            | ((n <= BOILERPLATE_TOKENS) & boilerplate)
        )

    return let(line_tokens(line), judge)


def line_tokens(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def repeated_tokens(tokens: Column) -> Column:
    """Tokens inside three-token windows that occur twice or more in ``tokens``."""
    def places(order):
        last = F.size(order) - 1

        def hash_at(i):
            return order[i]["h"]

        twice = F.filter(
            indexes(last + 1),
            lambda j: ((j > 0) & (hash_at(j) == hash_at(F.greatest(j - 1, F.lit(0)))))
            | ((j < last) & (hash_at(j) == hash_at(F.least(j + 1, last)))),
        )
        at = F.transform(twice, lambda j: order[j]["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def windows(w):
        return F.transform(indexes(F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def count(hashes):
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(order, places))

    return let(tokens, lambda w: let(windows(w), count))


def clean_lines(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with a struct column: the measures, ``kept`` and the text without dropped lines.

    It is called ``quality``, with underscores after it where a column has that name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def measure(t):
        def of_lines(parts):
            filled = F.filter(parts["line"], lambda x: F.translate(x, SPACES, "") != "")
            lost = F.aggregate(parts, F.lit(0), lambda s, p: s + F.when(p["fails"], line_tokens(p["line"])).otherwise(0))
            return F.struct(
                let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                lost.cast("long").alias("n_lost"),
                F.array_join(F.filter(parts, lambda p: ~p["fails"])["line"], "\n").alias("clean_text"),
            )

        judged = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))
        return let(
            tokens_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
                repeated_tokens(w).cast("long").alias("n_repeat_words"),
                let(judged, of_lines).alias("lines"),
            ),
        )

    def verdict(m):
        failed = (m["n_words"] < MIN_TOKENS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT)
        lines = m["lines"]
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
            lines["n_dup_lines"].alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (lines["n_lost"] * 100 <= m["n_words"] * max_lost)).alias("kept"),
            lines["n_lost"].alias("n_lost_words"),
            lines["clean_text"].alias("clean_text"),
        )

    return docs.withColumn(free_name(docs, "quality"), let(let(text, measure), verdict))


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")

_marked = " or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)


def _sql_count(value: str, chars: str) -> str:
    return f"(length({value}) - length(translate({value}, '{chars}', '')))"


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w),
h as (select doc_id, i, concat_ws(chr(32), words[i], words[i + 1], words[i + 2]) as gram from g),
r as (select doc_id, i, count(*) over (partition by doc_id, gram) as c from h),
p as (select distinct doc_id, i + o as at from r, (values (0), (1), (2)) v(o) where c >= 2),
rep as (select doc_id, count(*) as n from p group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
c as (select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    {_sql_count("line", SYMBOLS)} as symbols, {_sql_count("line", "!")} as shouts,
    {_sql_count("line", SEPARATORS)} as separators, {_sql_count("line", MARKS)} as marks from l),
f as (select *, (separators >= 3 and separators * 5 >= n) or (symbols >= 3 and symbols * 2 >= n) or (shouts >= 3 and shouts * 2 >= n)
    or (n >= {UNMARKED_TOKENS} and marks = 0) or (n <= {BOILERPLATE_TOKENS} and ({_marked})) as fails from c),
s as (select doc_id, sum(case when fails then n else 0 end) as lost,
    count(*) filter (n > 0) - count(distinct line) filter (n > 0) as dups from f group by doc_id),
m as (select w.doc_id, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast({_sql_count("t", SYMBOLS)} as bigint) as n_symbols, cast(dups as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(lost as bigint) as n_lost_words
  from w join s using (doc_id) left join rep using (doc_id))
select *, n_words < {MIN_TOKENS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed,
  not (n_words < {MIN_TOKENS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words) and 100 * n_lost_words <= {MAX_LOST} * n_words as kept
from m"""


@query("op6_line_rules", SQL)
def op6_line_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", *[F.col("quality")[c].alias(c) for c in DIGEST])


def quality_stage(spark, docs, sf_dir):
    """Documents that pass, without the lines that failed; columns of ``documents``."""
    found = F.col(free_name(docs, "quality"))
    changed = found["n_lost_words"] > 0
    text = F.when(changed, found["clean_text"]).otherwise(F.col("text"))
    return clean_lines(docs).where(found["kept"]).select(
        *[
            text.alias(c) if c == "text" else F.when(changed, F.length(text)).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        ]
    )
