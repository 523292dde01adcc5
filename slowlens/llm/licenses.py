"""License scan by diagonal voting.

Every rolling two-word gram of a text is hashed and looked up among the grams of the
templates; hits are joined to the template positions on the hash and confirmed on the
words themselves.  A hit votes for the diagonal ``text position - template position``.  A
base phrase stands where one diagonal has all its grams.  Longer notices may be edited,
so neighbouring diagonals are merged first: a span takes all votes from a diagonal up
to ``drift`` diagonals after it, a quarter of the template and three at least.  A span counts if it
has ``MIN_VOTES`` grams and covers four fifths of the template's words; as its diagonals are
close, it is no longer than the template and the drift.

A text is read and cut into words once: what is written of it is a row without text, its
number of words and its hits.  The lookup is a table of marks that every task holds, and
the templates are broadcast; both are bounded by the templates, up to ``TEMPLATE_GRAMS``
grams, beyond which the join is left to the planner.  Votes of equal texts are made distinct
before they are grouped, and groups are per text and template, so bounded by one text.

Null and empty texts have no words and no hits; equal texts share their hits, whatever
their ids.  Columns other than ``text`` pass through; the result stands under a name that
is not taken, ``licenses`` if it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import free_name, indexes, let, saved, table, text_key, words_of

# Phrases that must be found, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words of common notices, as words, with labels of this scan.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-full",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache-full",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
    "by the free software foundation either version 3 of the license or at your option any later version": "gpl-full",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-full",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-statement",
    "licensed under the apache license version 2 0": "apache-statement",
    "released under the mit license": "mit-statement",
    "licensed under cc by nc 4 0": "cc-by-nc-statement",
}
MIN_VOTES = 3
MIN_SHARE = 0.8
MARKS = 1 << 16
TEMPLATE_GRAMS = 200_000


def drift(length: int) -> int:
    """Diagonals that a span of a template may reach over."""
    return max(3, length // 4)


def template_rows(notices: dict[str, str] | None = None) -> list[tuple]:
    """(template, label, is base, its words, drift, gram position, first and second word of the gram)."""
    rows = []
    for base, phrases in ((True, PHRASES), (False, NOTICES if notices is None else notices)):
        for phrase, label in phrases.items():
            w = phrase.split()
            rows += [(phrase, label, base, len(w), drift(len(w)), i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return rows


ROW = "template string, label string, base boolean, length int, drift int, tpos int, first string, second string"


def templates(spark: SparkSession, notices: DataFrame | None = None) -> DataFrame:
    """Grams of the base phrases and of ``notices(text, label)``, by default the notices above."""
    if notices is None:
        rows = spark.createDataFrame(template_rows(), ROW)
    else:
        words = notices.select(words_of(F.col("text")).alias("w"), F.col("label").cast("string").alias("label")).where(F.size("w") > 1)
        length = F.size("w")
        each = words.select(
            F.array_join("w", " ").alias("template"),
            "label",
            F.lit(False).alias("base"),
            length.alias("length"),
            F.greatest(F.lit(3), F.floor(length / 4).cast("int")).alias("drift"),
            F.posexplode(F.transform(indexes(length - 1), lambda i: F.struct(F.col("w")[i].alias("first"), F.col("w")[i + 1].alias("second")))).alias("tpos", "g"),
        )
        own = each.select("template", "label", "base", "length", "drift", "tpos", "g.first", "g.second").distinct()
        rows = spark.createDataFrame(template_rows({}), ROW).unionByName(own)
    return saved(rows.withColumn("gram", F.xxhash64("first", "second")), "license-templates")


def text_hits(docs: DataFrame, wanted: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of ``docs`` without text: keys of the text, number of words, hits ``(pos, gram, first, second)``."""
    taken = {r["bit"] for r in wanted.select(F.pmod("gram", F.lit(MARKS)).cast("int").alias("bit")).distinct().collect()}  # MARKS at most
    marks, marked = F.lit(bytes(i in taken for i in range(MARKS))), F.lit(b"\x01")

    def hits(w: Column) -> Column:
        def hit(i: Column) -> Column:
            gram = F.xxhash64(w[i], w[i + 1])
            found = F.struct(i.alias("pos"), gram.alias("gram"), w[i].alias("first"), w[i + 1].alias("second"))
            place = (F.pmod(gram, F.lit(MARKS)) + 1).cast("int")
            return F.when(F.substring(marks, place, F.lit(1)) == marked, found)

        return F.array_compact(F.transform(indexes(F.size(w) - 1), hit))

    seen = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits")))
    k1, k2 = text_key(F.col("text"))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, k1.alias(names["k1"]), k2.alias(names["k2"]), F.inline(F.array(seen)).alias(names["n_words"], names["hits"]))
    return saved(rows, "license-hits")


def votes(rows: DataFrame, wanted: DataFrame, names: dict[str, str]) -> DataFrame:
    """``(k1, k2, template, label, base, length, drift, diagonal, tpos)`` of all hits that are template grams."""
    keyed = rows.select(F.col(names["k1"]).alias("k1"), F.col(names["k2"]).alias("k2"), F.inline(names["hits"]))
    small = wanted.count() <= TEMPLATE_GRAMS
    grams = F.broadcast(wanted) if small else wanted
    hits = keyed.join(grams.withColumnsRenamed({"first": "_first", "second": "_second"}), "gram")
    return hits.where((F.col("first") == F.col("_first")) & (F.col("second") == F.col("_second"))).select(
        "k1", "k2", "template", "label", "base", "length", "drift", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos"
    )


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans ``(k1, k2, label, base, start, share)``.

    A gram covers two words, so a text with fewer different grams of a notice than
    half of the words that must be covered holds no span of it.
    """
    key = ["k1", "k2", "template", "label", "base", "length"]
    exact = (
        votes.where("base")
        .select(*key, "diagonal", "tpos")
        .distinct()
        .groupBy(*key, "diagonal")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.col("length") - 1)
        .select("k1", "k2", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    )
    needed = F.greatest(F.lit(MIN_VOTES), F.ceil(F.col("length") * MIN_SHARE / 2))
    enough = (
        votes.where("not base")
        .groupBy(*key, "drift")
        .agg(F.collect_set(F.struct("diagonal", "tpos")).alias("votes"))
        .where(F.size(F.array_distinct("votes.tpos")) >= needed)
    )
    reached = F.sequence(F.col("diagonal") - F.col("drift"), "diagonal")
    merged = (
        enough.select(*key, "drift", F.inline("votes"))
        .withColumn("anchor", F.explode(reached))
        .groupBy(*key, "anchor")
        .agg(F.collect_set("tpos").alias("at"), F.min(F.col("diagonal") + F.col("tpos")).alias("start"))
        .where(F.size("at") >= needed)
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1)))))
    noted = merged.withColumn("share", covered / F.col("length")).where(F.col("share") >= MIN_SHARE)
    return exact.union(noted.select("k1", "k2", "label", "base", "start", "share"))


def scan_licenses(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """``docs`` without their text, and a struct column with what was found in it."""
    def labels(only):
        return F.array_join(F.sort_array(F.collect_set(F.when(only, F.col("label")))), ",")

    names = {n: free_name(docs, f"_{n}") for n in ("k1", "k2", "n_words", "hits", "found")}
    wanted = templates(docs.sparkSession, notices)
    rows = text_hits(docs, wanted, names)
    base = F.col("base")
    found = (
        spans(votes(rows, wanted, names))
        .groupBy("k1", "k2")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.lit(True)).alias("labels"),
            F.max("share").alias("score"),
        )
    )
    on = [names["k1"], names["k2"]]
    hit = found.select(F.col("k1").alias(on[0]), F.col("k2").alias(on[1]), F.struct(*found.columns[2:]).alias(names["found"]))
    f = F.col(names["found"])
    return rows.drop(names["hits"]).join(hit, on, "left").select(
        *[c for c in docs.columns if c != "text"],
        F.struct(
            F.col(names["n_words"]).alias("n_words"),
            F.coalesce(f["n_base"], F.lit(0)).cast("long").alias("n_base"),
            f["first_word"].alias("first_word"),
            f["last_word"].alias("last_word"),
            F.coalesce(f["base_labels"], F.lit("")).alias("base_labels"),
            F.coalesce(f["labels"], F.lit("")).alias("labels"),
            F.coalesce(f["score"], F.lit(0.0)).alias("score"),
        ).alias(free_name(docs, "licenses")),
    )


_rows = ",\n  ".join(f"('{t}', '{lb}', {str(b).lower()}, {n}, {d}, {i}, '{x}', '{y}')" for t, lb, b, n, d, i, x, y in template_rows())
SQL = rf"""
with tpl(template, label, base, length, drift, tpos, first, second) as (values {_rows}),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
p as (select doc_id, unnest(range(0, len(words) - 1)) as pos, words from d),
v as (select distinct doc_id, template, label, base, length, drift, pos - tpos as diagonal, tpos
  from p join tpl on words[pos + 1] = first and words[pos + 2] = second),
s as (select doc_id, template, label, length, diagonal + tpos as pos, tpos, unnest(range(diagonal - drift, diagonal + 1)) as anchor
  from v where not base),
m as (select doc_id, template, label, length, anchor, min(pos) as start, count(distinct tpos) as n from s group by all),
c as (select doc_id, template, anchor, count(distinct tpos + o) as covered from s, (values (0), (1)) x(o) group by all),
f as (select doc_id, label, true as base, diagonal as start, cast(1 as double) as share from v where base
    group by doc_id, template, label, length, diagonal having count(*) = length - 1
  union all
  select doc_id, label, false, start, covered / length from m join c using (doc_id, template, anchor)
  where n >= {MIN_VOTES} and covered / length >= {MIN_SHARE}),
a as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
    coalesce(string_agg(distinct label, ',' order by label), '') as labels, max(share) as score
  from f group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
  cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, cast(0 as double)) as score
from d left join a using (doc_id)"""


@query("op7_license_diagonals", SQL)
def op7_license_diagonals(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
