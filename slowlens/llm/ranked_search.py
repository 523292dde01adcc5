"""Ranked lexical search over a length-stratified index.

The normaliser ``m`` of a document is a whole number, so documents of equal ``m`` form a
stratum in which a term's impact depends on its frequency alone and is computed once per
frequency.  One scan of the texts counts the terms that are asked for.  The counts are
laid out by ``m`` (and by id within a large stratum, so that a stratum with a third of all
documents is spread over tasks) and cut into blocks of one stratum each: postings by term
and frequency, and for every term its greatest frequency.

The greatest frequencies bound the score that any document of a block can reach for an
item.  First every item's most promising blocks are scored, which gives a score that
twenty documents reach; then all blocks whose bound reaches it are visited, those with
the highest bounds first, and the score to reach rises on the way.  Nothing else is left
out, so the result is exact, ties included.  A block is scored as one product of a matrix
of items by terms and one of terms by documents, in doubles as long as these hold all sums exactly.

Texts are never shuffled, only term numbers and counts.  What a task or the driver holds
is bounded by ``entries``, the distinct terms of the items searched at once; more items
take more rounds over the same table.  Results are 20 rows per item and task, then ranked.

Null and empty texts have no terms: such documents do not count, such items find nothing.
Every row is a document or an item of its own, so repeated or null ids and equal texts do
no harm; equal scores go by ascending id, null last.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import saved, table

TOP = 20
BLOCK = 1024
ITEMS = 256
ENTRIES = 1_000_000
FIRST_BLOCKS, FIRST_DOCUMENTS = 64, 200
EXACT = 1 << 53
NO_ID = np.iinfo(np.int64).max
_GAPS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CLEAN = bytes.maketrans(_GAPS + _UPPER, b" " * len(_GAPS) + _UPPER.lower())
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z as a-z."""
    return text.translate(_CLEAN).split() if text else []


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, item_id, terms, counts)`` of every item with a term; ``item`` numbers the rows."""
    kind = items.schema[item_id].dataType.simpleString()

    def counted(batches):
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([list(c) for c in found], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in found], _LONGS),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "terms", "counts"])

    rows = items.select(item_id, F.col(text).cast("binary"))
    found = rows.mapInArrow(counted, f"item_id {kind}, terms array<binary>, counts array<long>")
    return saved(found.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "search-items")


class Asked:
    """Items searched at once: term numbers, and per item its terms with their counts."""

    def __init__(self, rows: list):
        self.keys = [r["item"] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = [[self.vocabulary.setdefault(bytes(t), len(self.vocabulary)) for t in r["terms"]] for r in rows]
        self.starts = np.cumsum([0, *map(len, number)])
        self.terms = np.fromiter((t for n in number for t in n), np.int64, self.starts[-1])
        self.counts = np.fromiter((c for r in rows for c in r["counts"]), np.int64, self.starts[-1])
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.starts))


def term_counts(docs: DataFrame, asked: Asked, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tfs)``: all terms of a document counted, those that are asked for listed."""
    vocabulary = asked.vocabulary

    def counted(batches):
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for data in batch.column(1).to_pylist():
                found = terms_of(data)
                count = Counter(found)
                known = count.keys() & vocabulary.keys()
                sizes.append(len(found))
                terms.append([vocabulary[t] for t in known])
                tfs.append([count[t] for t in known])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, _INTS), pa.array(tfs, _INTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    return rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(lengths))


def _blocks(batches):
    """Index rows from documents that come in order of ``m``; a block is of one stratum."""
    for batch in batches:
        m = batch.column("m").to_numpy()
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        terms, ends = _flat(batch.column("terms"))
        tfs, _ = _flat(batch.column("tfs"))
        out = []
        for lo in np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else []:
            hi = lo + int(np.argmax(np.append(m[lo:], m[lo] + 1) != m[lo]))
            for at in range(lo, hi, BLOCK):
                to = min(hi, at + BLOCK)
                order = np.argsort(ids[at:to], kind="stable")
                place = np.empty(to - at, np.int64)
                place[order] = np.arange(to - at)
                doc = np.repeat(place, np.diff(ends[at : to + 1]))
                t, f = terms[ends[at] : ends[to]], tfs[ends[at] : ends[to]]
                by = np.lexsort((doc, -f, t))
                t, f, doc = t[by], f[by], doc[by]
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
                out.append((m[lo], ids[at:to][order], t[first], f[first], np.diff(np.append(first, len(t))), f, doc))
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), _LONGS, _INTS, _INTS, _INTS, _INTS, _INTS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=INDEX)


INDEX = ["m", "ids", "terms", "tops", "sizes", "tfs", "docs"]


def stratified_index(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of documents with equal ``m``: ids, terms with their greatest frequency, postings by term and frequency."""
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
    listed = counts.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    laid = listed.repartitionByRange("m", F.xxhash64("doc_id")).sortWithinPartitions("m")
    schema = "m long, ids array<long>, terms array<int>, tops array<int>, sizes array<int>, tfs array<int>, docs array<int>"
    return saved(laid.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id()), "search-index")


class Scorer:
    """Bounds and scores of blocks for the items asked; sent to tasks, of bounded size."""

    def __init__(self, asked: Asked, weights: np.ndarray, top: int):
        self.asked, self.weights, self.top = asked, weights, top

    def bounds(self, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """The most that a document of a block can score, per item."""
        a, most = self.asked, np.zeros(len(self.weights), np.int64)
        most[terms] = self.weights[terms] * impacts(tops, m)
        return np.add.reduceat(a.counts * most[a.terms], a.starts[:-1]) if len(a.keys) else np.zeros(0, np.int64)

    def scores(self, items: np.ndarray, row: dict, exact_in_doubles: bool) -> np.ndarray:
        """Items by documents of the block."""
        a, terms = self.asked, row["terms"]
        lengths = a.starts[items + 1] - a.starts[items]
        entry = np.repeat(a.starts[items] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        place = np.searchsorted(terms, a.terms[entry])
        held = (place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == a.terms[entry])
        used, column = np.unique(place[held], return_inverse=True)
        kind = np.float64 if exact_in_doubles else np.int64
        asks = np.zeros((len(items), len(used)), kind)
        asks[np.repeat(np.arange(len(items)), lengths)[held], column] = a.counts[entry[held]]
        ends = np.append(0, np.cumsum(row["sizes"]))
        sizes = row["sizes"][used]
        posting = np.repeat(ends[used] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        tf, inverse = np.unique(row["tfs"][posting], return_inverse=True)
        given = np.zeros((len(used), len(row["ids"])), kind)
        line = np.repeat(np.arange(len(used)), sizes)
        given[line, row["docs"][posting]] = impacts(tf, row["m"])[inverse] * self.weights[terms[used]][line]
        return (asks @ given).astype(np.int64)

    def promising(self, batches):
        """Per task and item: the blocks with the highest bounds."""
        kept = []
        for batch in batches:
            for row in _rows(batch):
                bound = self.bounds(row["m"], row["terms"], row["tops"])
                i = np.flatnonzero(bound)
                kept.append(np.stack([i, bound[i], np.full(len(i), row["block"]), np.full(len(i), row["n"])], axis=1))
            kept = [_best(np.concatenate(kept), FIRST_BLOCKS)] if kept else []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0].T], names=["item", "bound", "block", "n"])

    def visit(self, floor: np.ndarray, only: dict[int, list[int]] | None = None):
        """Per task: the best documents of each item in blocks whose bound reaches ``floor`` (or in ``only``, items by place)."""
        keys = np.array(self.asked.keys, np.int64) if only is None else np.arange(len(floor))

        def scored(batches):
            reach = floor.copy()
            found = [np.zeros((0, 3), np.int64)]
            for batch in batches:
                rows = list(_rows(batch))
                bounds = [self.bounds(r["m"], r["terms"], r["tops"]) for r in rows]
                for k in sorted(range(len(rows)), key=lambda k: -int(bounds[k].max(initial=0))):
                    row, bound = rows[k], bounds[k]
                    asks = np.flatnonzero((bound > 0) & (bound >= reach))
                    if only is not None:
                        asks = np.intersect1d(asks, only.get(row["block"], []))
                    for at in range(0, len(asks), ITEMS):
                        items = asks[at : at + ITEMS]
                        score = self.scores(items, row, int(bound[items].max()) < EXACT)
                        best = np.argsort(-score, axis=1, kind="stable")[:, : self.top]
                        value = np.take_along_axis(score, best, axis=1)
                        i, j = np.nonzero((value > 0) & (value >= reach[items][:, None]))
                        found.append(np.stack([items[i], value[i, j], row["ids"][best[i, j]]], axis=1))
                    if sum(map(len, found)) > 4 * self.top * len(reach):
                        found = [_best(np.concatenate(found), self.top)]
                        reach = np.maximum(reach, _nth(found[0], self.top, len(reach)))
            best = _best(np.concatenate(found), self.top)
            ids = pa.array(best[:, 2], pa.int64(), mask=best[:, 2] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(keys[best[:, 0]]), pa.array(best[:, 1]), ids], names=["item", "score", "doc_id"])

        return scored


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _best(rows: np.ndarray, most: int) -> np.ndarray:
    """Of rows ``(item, value, tie, ...)`` each item's ``most`` with the highest values, least ties first."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[rank < most]


def _nth(rows: np.ndarray, n: int, items: int) -> np.ndarray:
    """What ``n`` documents reach, per item; 0 if there are fewer.  ``rows`` come from ``_best``."""
    out = np.zeros(items, np.int64)
    held = np.bincount(rows[:, 0], minlength=items)
    ends = np.cumsum(held)
    full = np.flatnonzero(held >= n)
    out[full] = rows[ends[full] - held[full] + n - 1, 1]
    return out


def _rows(batch: pa.RecordBatch):
    """Blocks of a batch as arrays, for the columns that are there."""
    names = batch.schema.names
    lists = {c: _flat(batch.column(c)) for c in names if pa.types.is_list(batch.schema.field(c).type)}
    single = {c: batch.column(c).to_numpy() for c in names if c not in lists}
    for i in range(batch.num_rows):
        yield {c: int(v[i]) for c, v in single.items()} | {c: v[e[i] : e[i + 1]] for c, (v, e) in lists.items()}


def _search(docs: DataFrame, asked: Asked, top: int) -> DataFrame:
    """``(item, score, doc_id)``: per task and item the best documents; all that can be among the best are there.

    ``term_counts`` keeps documents with a term only, so its rows and sizes are those that the statistics ask for.
    """
    counts = saved(term_counts(docs, asked), "search-counts")
    total = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    weights = np.zeros(len(asked.vocabulary), np.int64)
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
    ratio = F.lit(2.0 * total["docs"] + 2.0) / (2.0 * F.col("count") + 1.0)
    for r in df.select("term", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("w")).collect():  # bounded by the terms asked
        weights[r["term"]] = r["w"]
    none = np.zeros(len(asked.keys), np.int64)
    if not total["docs"]:
        return docs.sparkSession.createDataFrame([], "item long, score long, doc_id long")
    index, scorer = stratified_index(counts, total["docs"], total["terms"]), Scorer(asked, weights, top)
    bounds = index.select("block", "m", F.size("ids").cast("long").alias("n"), "terms", "tops").mapInArrow(
        scorer.promising, "item long, bound long, block long, n long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST_BLOCKS)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    only: dict[int, list[int]] = {}
    for r in first.withColumn("before", before).where(F.col("before") < FIRST_DOCUMENTS).collect():  # at most 64 blocks an item
        only.setdefault(r["block"], []).append(r["item"])
    columns = index.select("block", *INDEX)
    schema = "item long, score long, doc_id long"
    some = columns.where(F.col("block").isin(list(only))).mapInArrow(scorer.visit(none, only), schema)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == top)
    floor = none.copy()
    for r in best.collect():  # a row per item
        floor[r["item"]] = r["score"]
    return columns.mapInArrow(scorer.visit(floor), schema)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """``(item, item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0."""
    listed = item_terms(items)
    size = listed.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    rounds = max(1, -(-size // entries))
    part = F.pmod(F.xxhash64("item"), F.lit(rounds))
    found = docs.sparkSession.createDataFrame([], "item long, score long, doc_id long")
    for k in range(rounds):
        asked = Asked(listed.where(part == k).select("item", "terms", "counts").orderBy("item").collect())  # about ``entries`` terms
        found = found.union(_search(docs, asked, top))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(listed.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def _sql_terms(table_name: str, key: str) -> str:
    return rf"""select k, {key}, unnest(words) as word, len(words) as n from (select row_number() over () as k, {key},
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from {table_name}) s"""


SQL = f"""
with d as materialized ({_sql_terms("documents", "doc_id")}), i as ({_sql_terms("benchmark", "item_id")}),
t as (select k, doc_id, word, n, count(*) as tf from d group by all),
s as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from (select distinct k, n from d) x),
w as (select word, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from t, s group by word, docs),
q as (select k as item, item_id, word, count(*) as c from i group by all),
p as (select item, item_id, t.k, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as score
  from q join t using (word) join w using (word), s group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item order by score desc, doc_id asc nulls last) as rank from p where score > 0)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from r where rank <= {TOP}"""


@query("op12_stratified_search", SQL)
def op12_stratified_search(spark, sf_dir):
    found = ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
