"""Benchmark decontamination by winnowing.

A window is ten consecutive words of an item (the whole item if it is shorter).  Of the
five-word grams of every window the least hash is kept as its fingerprint, in texts and
items alike, so a text that holds a window of an item holds its fingerprint: no shared
span of ten words is missed.  Runs of text positions with one fingerprint become one
record, about two in seven positions.  Records are joined to the fingerprints of the
items, and each hit is extended: the words behind it are compared with the window.

The item side is broadcast only if counting shows at most ``broadcast_windows`` windows.
Beyond that, hashes alone are shuffled to find texts with a hit, and only those texts
are extended in a second join.  Hits are written once; all later steps are small.
Equal texts share their hits, so copies, repeated or null ids do no harm.  Null and empty
texts and items have no words; an item without an id hits words but is no listed item; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import broadcast_if, count_words, free_name, indexes, let, saved, table, text_key, words_of

WINDOW = 10
GRAM = 5


def _grams(words: Column, k: int) -> Column:
    return F.transform(indexes(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))


def winnowed(words: Column, length: int, gram: int = GRAM) -> Column:
    """Runs ``(fingerprint, first, last)`` of the starts of ``length``-word windows in ``words``."""
    k = min(gram, length)
    span = length - k + 1

    def runs(least):
        last = F.size(least) - 1
        opens = F.filter(indexes(last + 1), lambda i: (i == 0) | (least[i] != least[F.greatest(i - 1, F.lit(0))]))

        def records(starts):
            def record(j):
                end = F.when(j < F.size(starts) - 1, starts[F.least(j + 1, F.size(starts) - 1)] - 1).otherwise(last)
                return F.struct(least[starts[j]].alias("fingerprint"), starts[j].alias("first"), end.alias("last"))

            return F.transform(indexes(F.size(starts)), record)

        return let(opens, records)

    def least_of(h):
        return F.transform(indexes(F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i + 1, span)))

    return let(words, lambda w: let(let(_grams(w, k), least_of), runs))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, length, span, fingerprint)``: the distinct windows of every item, span as text."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("length", F.least(F.lit(window), F.size("words")))
    starts = sized.select("item_id", "length", "words", F.explode(indexes(F.size("words") - F.col("length") + 1)).alias("at"))
    spans = starts.select("item_id", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("w")).distinct()
    print_of = reduce(
        lambda rest, n: F.when(F.col("length") == n, F.array_min(_grams(F.col("w"), min(GRAM, n)))).otherwise(rest),
        range(1, window + 1),
        F.lit(None).cast("long"),
    )
    return spans.select("item_id", "length", F.array_join("w", " ").alias("span"), print_of.alias("fingerprint"))


def _places(length: int) -> Column:
    """Offsets in ``near`` at which the words of ``span`` stand."""
    return F.filter(
        indexes(F.size("near") - (length - 1)),
        lambda i: F.array_join(F.slice("near", i + 1, length), " ") == F.col("span"),
    )


def window_hits(texts: DataFrame, windows: DataFrame, broadcast_windows: int) -> DataFrame:
    """``(k1, k2, length, span, start)`` of every place in ``texts`` where an item window stands."""
    spans = windows.select("length", "span", "fingerprint").distinct()
    sizes = {r["length"]: r["count"] for r in spans.groupBy("length").count().collect()}  # ten lengths at most
    small = sum(sizes.values()) <= broadcast_windows
    words = texts.select(*text_key(F.col("text")), words_of(F.col("text")).alias("words"))
    found = []
    for length in sorted(sizes):
        wanted = spans.where(F.col("length") == length)
        source = words
        if not small:
            prints = words.select("k1", "k2", F.explode(winnowed(F.col("words"), length)["fingerprint"]).alias("fingerprint"))
            hit = prints.join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi").select("k1", "k2").distinct()
            source = words.join(hit, ["k1", "k2"])
        records = source.select("k1", "k2", "words", F.inline(winnowed(F.col("words"), length)))
        near = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + length)
        if small:  # the words of a record are taken from the row after the join, only for hits
            joined = records.join(F.broadcast(wanted), "fingerprint").withColumn("near", near)
        else:
            joined = records.withColumn("near", near).drop("words").join(wanted, "fingerprint")
        found.append(joined.select("k1", "k2", "length", "span", "first", F.explode(_places(length)).alias("at")))
    schema = "k1 long, k2 long, length int, span string, first int, at int"
    hits = reduce(DataFrame.union, found, texts.sparkSession.createDataFrame([], schema))
    return hits.select("k1", "k2", "length", "span", (F.col("first") + F.col("at")).alias("start")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 200_000) -> DataFrame:
    """``docs`` with a struct column: word counts and the items found.

    It is called ``contamination``, with underscores after it where a column has that name.
    """
    windows = saved(item_windows(benchmark), "item-windows")
    hits = saved(window_hits(docs.select("text"), windows, broadcast_windows), "window-hits")
    covered = F.flatten(F.transform("at", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1)))
    words = (
        hits.select("k1", "k2", "start", "length")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "length")).alias("at"))
        .select("k1", "k2", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    )
    items = (
        hits.select("k1", "k2", "span", "length")
        .distinct()
        .join(windows, ["span", "length"])
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    key1, key2, n_words, found_in = (free_name(docs, n) for n in ("_k1", "_k2", "_n_words", "_found"))
    found = words.join(items, ["k1", "k2"]).select(F.col("k1").alias(key1), F.col("k2").alias(key2), F.struct("n_hit", "items").alias(found_in))
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumns({key1: k1, key2: k2, n_words: count_words(F.col("text"))})
    n_hit = F.coalesce(F.col(found_in)["n_hit"], F.lit(0).cast("long"))
    listed = F.coalesce(F.col(found_in)["items"], F.array().cast("array<string>"))
    return keyed.join(found, [key1, key2], "left").select(
        *docs.columns,
        F.struct(
            F.col(n_words).alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            listed.alias("items"),
        ).alias(free_name(docs, "contamination")),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 200_000, broadcast_texts: int = 200_000) -> DataFrame:
    """``docs`` without those that hold a benchmark window.

    Only the keys of texts with a hit are needed, two numbers each: as long as counting shows
    few of them they are broadcast and no text is moved.
    """
    windows = saved(item_windows(benchmark), "item-windows")
    hits = window_hits(docs.select("text"), windows, broadcast_windows)
    key1, key2 = (free_name(docs, n) for n in ("_k1", "_k2"))
    hit = saved(hits.select(F.col("k1").alias(key1), F.col("k2").alias(key2)).distinct(), "texts-with-hits")
    k1, k2 = text_key(F.col("text"))
    kept = docs.withColumns({key1: k1, key2: k2}).join(broadcast_if(hit, broadcast_texts), [key1, key2], "left_anti")
    return kept.select(*docs.columns)


def _sql_words(table_name: str, key: str) -> str:
    return rf"""select {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from {table_name}"""


SQL = f"""
with d as ({_sql_words("documents", "doc_id")}), b as ({_sql_words("benchmark", "item_id")}),
iw as (select distinct item_id, l, array_to_string(words[i:i + l - 1], ' ') as span
  from (select *, least({WINDOW}, len(words)) as l from b where len(words) > 0) s, lateral (select unnest(range(1, len(words) - l + 2)) as i) u),
lengths as (select distinct l from iw),
dw as (select doc_id, l, i, array_to_string(words[i:i + l - 1], ' ') as span
  from d, lengths, lateral (select unnest(range(1, len(words) - l + 2)) as i) u),
h as (select doc_id, item_id, i, l from dw join iw using (l, span)),
p as (select distinct doc_id, i + unnest(range(0, l)) as at from h),
n as (select doc_id, count(*) as n_hit from p group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
  from h group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)"""

DIGEST = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_winnowing", SQL)
def op3_winnowing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", *[F.col("contamination")[c].alias(c) for c in DIGEST])


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a benchmark window; columns of ``documents``."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
