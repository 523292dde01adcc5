"""Substring dedup: repeated paragraphs by MinHash banding.

Paragraphs are the lines of five words and more; joined lines, so that paragraphs wrapped at
any width are found; and, so that passages inside longer lines are found, the 24-word pieces that
begin at anchors: the least five-word hash of every 27 successive ones.  Any 50 words that stand in
two documents share an anchor and its piece.  Lines are joined up to a line without words, in texts
that have none also up to a line of 24 words or more; what is joined is compared as a whole and
cut at words whose five-word hash is the least of 32 before and after.
Lines and joined lines are compared by 8 bands of 3 MinHash values (99.7 % of pairs at a similarity of 0.8
collide).  Pairs are verified by exact Jaccard similarity of five-word shingles: first each line
with the least and the greatest line of its buckets, then, in every bucket whose lines are not all linked by
that, every two lines that are not, in pairs of blocks that are tasks of their own.
Components of verified pairs are classes.  Pieces are so short that one changed word ends the similarity; their
signature is their whole content.  A class found in two documents is repeated; the
document with the least id keeps it and the others lose it.

Paragraphs are compared once per content, so a passage in a third of all documents is one
node, and the two ends of buckets come from map-side sums.  Only documents
that hold a candidate line are read again.  All intermediate tables are written.
A document is an id and a text: texts that share an id, or have none, are documents of their own, and rows
equal in both are one.  Of documents with the least id of a class the one with the least text hash keeps it.
Rows without text have no paragraphs.  Empty tables give no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import broadcast_if, same_components, saved, table, text_key
from slowlens.llm.hashing import SHINGLE, mixed, placed_words, range_minhashes, shingle_hashes
from slowlens.llm.ngram_join import BLOCK, by_leaf, leaf_groups

WORDS = 24
REACH = 27
#: Joined lines are cut where a five-word hash is the least among so many before and after.
APART = 32
BANDS = 8
ROWS = 3
THRESHOLD = 0.8
_LINE, _PIECE = 0x5BD1E995, 0x27D4EB2F
_STEP = 0x9E3779B97F4A7C15
#: Stands for a null id where ids are compared.
_NONE = -(1 << 63)
DOC = ["doc_id", "k1", "k2"]


def content_hash(words: np.ndarray, salt: int) -> np.ndarray:
    """One hash per row of a matrix of word hashes."""
    total = np.full(words.shape[0], salt, np.uint64)
    for i in range(words.shape[1]):
        total = total * np.uint64(_STEP) + words[:, i]
    return mixed(total)


def anchors(words: np.ndarray) -> np.ndarray:
    """Where pieces begin: places of the least five-word hash in every ``REACH`` successive ones."""
    grams = shingle_hashes(words)
    if len(words) < WORDS or len(grams) < 2:
        return np.zeros(0, np.int64)
    reach = min(REACH, len(grams))
    found = []
    for at in range(0, len(grams) - reach + 1, 1 << 16):
        part = grams[at : at + (1 << 16) + reach - 1]
        seen = np.lib.stride_tricks.sliding_window_view(part, reach)
        found.append(at + np.arange(len(seen)) + seen.argmin(axis=1))
    starts = np.unique(np.concatenate(found))
    return starts[starts + WORDS <= len(words)]


def cuts(grams: np.ndarray) -> np.ndarray:
    """Places of five-word hashes that are less than ``APART`` before and not more than ``APART`` after."""
    if len(grams) <= 2 * APART:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, len(grams) - 2 * APART, 1 << 16):
        part = grams[at : at + (1 << 16) + 2 * APART]
        seen = np.lib.stride_tricks.sliding_window_view(part, 2 * APART + 1)
        found.append(at + APART + np.flatnonzero(seen.argmin(axis=1) == APART))
    return np.concatenate(found)


def ranges(raw: bytes, places: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the word after the last, of every line, of lines joined and of their parts, with five words or more.

    ``places`` are the bytes where the words of ``raw`` begin, ``grams`` its five-word hashes.
    """
    ends = np.append(np.searchsorted(places, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)), len(places))
    starts = np.concatenate(([0], ends[:-1]))
    n = ends - starts
    apart = n == 0
    filled = np.flatnonzero(n)
    if len(filled) and not apart[filled[0] : filled[-1]].any():  # before and after the text they part nothing
        apart = apart | (n >= WORDS)
    found = [np.stack((starts, ends), axis=1)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], apart, [True])).astype(np.int8)))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if last - first > 1:
            lo, hi = int(starts[first]), int(ends[last - 1])
            inner = lo + cuts(grams[lo : hi - SHINGLE + 1])
            bounds = np.concatenate(([lo], inner, [hi]))
            found.append(np.stack((bounds[:-1], bounds[1:]), axis=1))
            if len(inner):
                found.append(np.array([[lo, hi]]))
    both = np.unique(np.concatenate(found), axis=0)
    return tuple(both[both[:, 1] - both[:, 0] >= SHINGLE].T)


def keyed_ranges(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words, grams, starts, ends, keys``: the words of a text, its five-word hashes and its ``ranges``, keyed by content."""
    words, places = placed_words(raw)
    grams = shingle_hashes(words) if len(words) >= SHINGLE else words[:0]
    starts, ends = ranges(raw, places, grams)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(grams + np.uint64(_LINE)), dtype=np.uint64)))
    keys = mixed(sums[ends - SHINGLE + 1] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP)).view(np.int64)
    return words, grams, starts, ends, keys


def _paragraphs(least: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, start, n, bands, banded = [], [], [], [], [], []
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                words, grams, begins, ends, lines = keyed_ranges(raw)
                starts = anchors(words) if least <= WORDS else words[:0].view(np.int64)
                if len(starts):
                    pieces = np.lib.stride_tricks.sliding_window_view(words, WORDS)[starts]
                    row.append(np.full(len(starts), k))
                    key.append(content_hash(pieces, _PIECE).view(np.int64))
                    start.append(starts)
                    n.append(np.full(len(starts), WORDS))
                    banded.append(np.zeros(len(starts), bool))
                long = ends - begins >= least
                begins, ends, lines = begins[long], ends[long], lines[long]
                if len(begins):
                    values = range_minhashes(grams, begins, ends - SHINGLE + 1, BANDS * ROWS).astype(np.uint64)
                    row.append(np.full(len(begins), k))
                    key.append(lines)
                    start.append(begins)
                    n.append(ends - begins)
                    banded.append(np.ones(len(begins), bool))
                    bands.append(content_hash(values.reshape(-1, ROWS), _LINE).view(np.int64))
            if not row:
                continue
            at, has = pa.array(np.concatenate(row)), np.concatenate(banded)
            offsets = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(at) for c in DOC],
                    pa.array(np.concatenate(key)),
                    pa.array(np.concatenate(start).astype(np.int32)),
                    pa.array(np.concatenate(n).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~has)),
                ],
                names=[*DOC, "paragraph", "start", "n", "bands"],
            )

    return go


def located(texts: DataFrame, least: int = SHINGLE) -> DataFrame:
    """``(doc_id, k1, k2, paragraph, start, n, bands)``: lines with their bands, and pieces, of keyed ``raw`` texts."""
    return texts.mapInArrow(_paragraphs(least), "doc_id long, k1 long, k2 long, paragraph long, start int, n int, bands array<long>")


def _bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of the wanted paragraphs of a document."""
    for f in frames:
        keys, sets = [], []
        for raw, wanted in zip(f["raw"], f["wanted"]):
            wanted = set(wanted.tolist())
            _, grams, begins, ends, lines = keyed_ranges(raw)
            for key, lo, hi in zip(lines.tolist(), begins.tolist(), ends.tolist()):
                if key in wanted:
                    wanted.discard(key)
                    keys.append(key)
                    sets.append(np.unique(grams[lo : hi - SHINGLE + 1]).tobytes())
        yield pd.DataFrame({"paragraph": keys, "shingles": sets})


def _similar(threshold: float):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = []
            for x, y in zip(f["x"], f["y"]):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= threshold * (len(a) + len(b) - both))
            yield f.loc[np.array(good, bool), ["a", "b"]]

    return go


def _linked(threshold: float):
    """Per pair of blocks the lines of different roots that are alike, without pairs that follow from others."""
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, block, other), g in leaf_groups(frames):
            node, root, side, band = g["paragraph"].to_numpy(), g["root"].to_numpy().copy(), g["side"].to_numpy(), g["band"].iloc[0]
            bands = np.stack(g["bands"].to_list())
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            sizes = np.array([len(x) for x in sets])
            begins = np.concatenate(([0], np.cumsum(sizes)))
            ids, shingle = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(shingle, kind="stable")
            holders = np.repeat(np.arange(len(g)), sizes)[order]
            first = np.searchsorted(shingle[order], np.arange(len(ids) + 1))
            roots, counts = np.unique(root, return_counts=True)
            found = []
            for i in np.flatnonzero(root != roots[counts.argmax()]).tolist():  # of two roots one is not the largest
                open_to = (root != root[i]) & ~(bands[:, :band] == bands[i, :band]).any(axis=1)  # not met in a lesser band
                if block != other:
                    open_to &= side != side[i]
                if not open_to.any():
                    continue
                both = np.bincount(np.concatenate([holders[first[x] : first[x + 1]] for x in shingle[begins[i] : begins[i + 1]]]), minlength=len(g))
                for j in np.flatnonzero(open_to & (both >= threshold * (sizes[i] + sizes - both))).tolist():
                    if root[j] != root[i]:
                        found.append((node[i], node[j]))
                        root[root == root[j]] = root[i]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return go


def line_classes(found: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(node, root)`` of lines that are alike but not the same."""
    lines = found.where("bands is not null").groupBy("paragraph").agg(F.first(F.struct(*DOC, "bands")).alias("held"))
    lines = saved(lines.select("paragraph", "held.*"), "lines")
    banded = lines.select("paragraph", F.posexplode("bands").alias("band", "value"))
    ends = banded.groupBy("band", "value").agg(F.min("paragraph").alias("lo"), F.max("paragraph").alias("hi"), F.count(F.lit(1)).alias("size"))
    ends = saved(ends.where("lo < hi"), "line-buckets")
    pairs = banded.join(ends, ["band", "value"]).select(
        F.explode(F.array(F.struct(F.col("paragraph").alias("a"), F.col("lo").alias("b")), F.struct(F.col("paragraph").alias("a"), F.col("hi").alias("b")))).alias("p")
    )
    pairs = saved(pairs.select(F.greatest("p.a", "p.b").alias("a"), F.least("p.a", "p.b").alias("b")).where("a <> b").distinct(), "line-pairs")
    sides = pairs.select(F.col("a").alias("paragraph")).union(pairs.select("b")).distinct()
    holders = lines.join(sides, "paragraph").groupBy(*DOC).agg(F.collect_list("paragraph").alias("wanted"))
    holders = saved(holders.withColumnRenamed("doc_id", "_id"), "line-holders")
    some = broadcast_if(holders, 200_000, F.size("wanted"), 2_000_000)
    here = F.coalesce("doc_id", F.lit(_NONE)) == F.coalesce("_id", F.lit(_NONE))
    held = texts.join(some.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & here)
    held = held.select("raw", "wanted")
    bodies = saved(held.mapInPandas(_bodies, "paragraph long, shingles binary").dropDuplicates(["paragraph"]), "line-bodies")
    left = bodies.select(F.col("paragraph").alias("a"), F.col("shingles").alias("x"))
    right = bodies.select(F.col("paragraph").alias("b"), F.col("shingles").alias("y"))
    alike = pairs.join(left, "a").join(right, "b").mapInPandas(_similar(threshold), "a long, b long")
    stars = saved(same_components(alike, "line-stars"), "line-stars")
    # up to three lines are all compared with both ends
    wide = banded.join(ends.where("size > 3").select("band", "value", "size"), ["band", "value"]).join(
        stars.withColumnRenamed("node", "paragraph"), "paragraph", "left"
    )
    wide = saved(wide.select("paragraph", "band", "value", "size", F.coalesce("root", "paragraph").alias("root")), "wide-buckets")
    split = wide.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "value")
    dealt = (
        wide.join(split, ["band", "value"])
        .withColumn("path", F.xxhash64("band", "value"))
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("paragraph", "path"), F.col("blocks")).cast("int"))
        .join(lines.select("paragraph", "bands"), "paragraph")
        .join(bodies, "paragraph")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    tasks = dealt.select(
        "path", F.least("side", "with").alias("block"), F.greatest("side", "with").alias("other"), "side", "band", "paragraph", "root", "bands", "shingles"
    )
    rest = saved(by_leaf(tasks).mapInPandas(_linked(threshold), "a long, b long"), "line-links")
    if rest.isEmpty():
        return stars
    return same_components(rest.union(stars.select("node", "root")), "line-classes")


def repeated_spans(docs: DataFrame, threshold: float = THRESHOLD, least: int = SHINGLE) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, class_id, first_doc_id, removed, kind)``: merged repeated spans.

    Word numbers count from 0, ``end_word`` is exclusive; ``class_id`` is the class of the
    first paragraph of the span, ``first_doc_id`` the least document that holds it.  ``kind`` is `near` if a
    paragraph of the span has near copies, else `exact`.  Paragraphs of fewer than ``least`` words are left out.
    """
    texts = docs.where("text is not null").select("doc_id", *text_key(F.col("text")), F.col("text").cast("binary").alias("raw"))
    found = saved(located(texts, least), "paragraphs")
    doc = F.coalesce("doc_id", F.lit(_NONE))
    # different ids or different texts; sums of numbers only, so that they combine before the shuffle
    ends = found.groupBy("paragraph").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.min("k1").alias("k_lo"), F.max("k1").alias("k_hi"))
    several_docs = "lo < hi or k_lo < k_hi"
    roots = saved(line_classes(found, texts, threshold), "line-roots")
    # what stands in two documents by itself, and the lines that are alike, by class
    own = saved(
        ends.join(roots, ends["paragraph"] == roots["node"], "left")
        .where(f"{several_docs} or root is not null")
        .select("paragraph", F.coalesce("root", "paragraph").alias("class_id"), "lo", "hi", "k_lo", "k_hi", F.col("root").isNotNull().alias("alike")),
        "repeated",
    )
    alike = own.where("alike").groupBy("class_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("k_lo").alias("k_lo"), F.max("k_hi").alias("k_hi")
    )
    several = own.where("alike").select("paragraph", "class_id", "alike").join(alike.where(several_docs), "class_id")
    columns = ["paragraph", "class_id", "lo", "alike"]
    classes = saved(several.select(*columns).union(own.where("not alike").select(*columns)), "paragraph-classes")
    at = found.select(*DOC, "paragraph", "start", "n").join(broadcast_if(classes, 500_000), "paragraph").drop("paragraph")
    at = saved(at, "repeats")
    # classes whose least id has several texts
    ties = at.where(doc == F.col("lo")).groupBy(F.col("class_id").alias("_class")).agg(F.min("k1").alias("keeps"), F.max("k1").alias("other"))
    ties = saved(ties.where("keeps < other").drop("other"), "ties")
    keeper = (doc == F.col("lo")) & (F.col("keeps").isNull() | (F.col("k1") == F.col("keeps")))
    placed = at.join(broadcast_if(ties, 500_000), F.col("class_id") == F.col("_class"), "left").select(
        *DOC, "class_id", "lo", "alike", "start", (F.col("start") + F.col("n")).alias("end"), (~keeper).alias("removed")
    )
    order = Window.partitionBy(*DOC, "removed").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        placed.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*DOC, "removed", "span")
        .agg(
            F.min("start").alias("start_word"),
            F.max("end").alias("end_word"),
            F.min(F.struct("start", "class_id", "lo")).alias("head"),
            F.max("alike").alias("alike"),
        )
    )
    return spans.select(
        "doc_id",
        F.col("start_word").cast("long").alias("start_word"),
        F.col("end_word").cast("long").alias("end_word"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
        F.col("head.class_id").alias("class_id"),
        F.when(F.col("head.lo") != _NONE, F.col("head.lo")).alias("first_doc_id"),
        "removed",
        F.when(F.col("alike"), "near").otherwise("exact").alias("kind"),
    )


@query("op1_paragraph_minhash")
def op1_paragraph_minhash(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
