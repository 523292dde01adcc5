"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Every distinct text is embedded as 64 MinHash tokens (coordinate, value).  A run starts with
one bucket; a bucket samples coordinates by a hash of its path, each text of it goes to
the child named by its value there, and buckets with more than ``limit`` texts are split again, up to
``depth`` times.  Leaves are compared by brute force, and as many runs are made as the target
recall asks for.  A pair is compared in the least of its common leaves only, first on the
embedding, then exactly on the whole shingle sets, so links can be counted per text
without listing pairs; groups of near copies are linked by stars inside each leaf.

Leaves that stay large are cut into blocks, and every pair of blocks is a task of its own, so
nothing is capped.  Equal texts are one text throughout; a group of copies costs one entry.
Texts travel only if they have a candidate.  All steps are written tables.
Null and blank texts have no shingles and equal only themselves; texts of fewer than five
words have one shingle.  A class without any id has a null id.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import broadcast_if, same_components, saved, table, text_key
from slowlens.llm.hashing import minhashes, mixed, shingle_set

THRESHOLD = 0.8
SPLIT = 0.7
TARGET = 0.999
TOKENS = 64
DEPTH = 4
LIMIT = 128
BLOCK = 512
KEY = ["k1", "k2"]
LEAF = ["path", "block", "other"]


def runs_for(target: float, threshold: float, split: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in some leaf with probability ``target``."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-threshold / split * meets)
    return math.ceil(math.log(1 - target) / math.log(1 - meets))


def least_shared(threshold: float) -> int:
    """Tokens that a pair at the threshold shares on average less five deviations; fewer end the comparison."""
    return max(0, math.ceil(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))))


def _children(paths: np.ndarray, values: np.ndarray, split: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children of nodes ``paths`` whose texts have the tokens ``values``."""
    lanes = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64))
    picks = mixed(paths[:, None] ^ lanes[None, :])
    row, lane = np.nonzero(picks < np.uint64(int(2**64 / (split * TOKENS))))
    return row, mixed(picks[row, lane] + values[row, lane])


def _embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        sets = [shingle_set(t) for t in f["raw"]]
        keep = np.array([len(s) > 0 for s in sets], bool)
        yield pd.DataFrame(
            {
                "k1": f["k1"][keep],
                "k2": f["k2"][keep],
                "n": [len(s) for s in sets if len(s)],
                "tokens": [minhashes(s, TOKENS).astype("<u4").tobytes() for s in sets if len(s)],
            }
        )


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, TOKENS).astype(np.uint64)


def _split_nodes(runs: int, split: float):
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32))

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            values = _values(f["tokens"])
            paths = f["paths"] if "paths" in f else [roots] * len(f)
            text = np.repeat(np.arange(len(f)), [len(p) for p in paths])
            nodes = np.concatenate([np.asarray(p, np.int64).view(np.uint64) if p is not roots else roots for p in paths])
            for at in range(0, len(nodes), 16_384):
                own = text[at : at + 16_384]
                row, child = _children(nodes[at : at + 16_384], values[own], split)
                k = own[row]
                yield pd.DataFrame({"path": child.view(np.int64), "k1": f["k1"].to_numpy()[k], "k2": f["k2"].to_numpy()[k]})

    return go


def leaves(embedded: DataFrame, runs: int, split: float, depth: int, limit: int) -> DataFrame:
    """``(path, k1, k2, n_texts)``: the leaves with two texts or more."""
    frontier, found = embedded, None
    for level in range(1, depth + 1):
        children = saved(frontier.mapInPandas(_split_nodes(runs, split), "path long, k1 long, k2 long").distinct(), "paths")
        sizes = children.groupBy("path").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
        shared = saved(children.join(sizes, "path"), "buckets")
        done = shared if level == depth else shared.where(F.col("n_texts") <= limit)
        found = done if found is None else found.union(done)
        nodes = shared.where(F.col("n_texts") > limit).groupBy(*KEY).agg(F.collect_list("path").alias("paths"))
        frontier = embedded.join(nodes, KEY)
    return found


def leaf_groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal leaves in sorted rows; a leaf may span batches."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        ids = f[LEAF].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(f)]
        for lo, hi in zip(bounds, bounds[1:]):
            if held and tuple(held[-1][LEAF].iloc[0]) != tuple(ids[lo]):
                yield tuple(held[-1][LEAF].iloc[0]), pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(f.iloc[lo:hi])
    if held:
        yield tuple(held[-1][LEAF].iloc[0]), pd.concat(held) if len(held) > 1 else held[0]


def _candidates(threshold: float):
    """Per leaf the pairs that the embedding lets pass and that meet in no lesser leaf."""
    share, shared = math.floor(threshold * 1000), least_shared(threshold)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (path, block, other), g in leaf_groups(frames):
            values, n, side = _values(g["tokens"]), g["n"].to_numpy(), g["side"].to_numpy()
            lists = [frozenset(p.tolist()) for p in g["paths"]]
            partners = defaultdict(list)
            for i in range(len(g) - 1):
                rest = slice(i + 1, len(g))
                good = (np.minimum(n[i], n[rest]) * 1000 >= np.maximum(n[i], n[rest]) * share) & (
                    (values[i] == values[rest]).sum(axis=1) >= shared
                )
                if block != other:
                    good &= side[rest] != side[i]
                for j in (np.flatnonzero(good) + i + 1).tolist():
                    if min(lists[i] & lists[j]) == path:
                        partners[i].append(j)
            used = sorted({*partners, *(j for js in partners.values() for j in js)})
            if used:
                at = {i: x for x, i in enumerate(used)}
                rows = g.iloc[used]
                yield pd.DataFrame(
                    {
                        "path": path,
                        "block": block,
                        "other": other,
                        "k1": rows["k1"].to_numpy(),
                        "k2": rows["k2"].to_numpy(),
                        "place": np.arange(len(used)),
                        "partners": [[at[j] for j in partners.get(i, ())] for i in used],
                    }
                )

    return go


def _verified(threshold: float):
    """Per leaf and text with a link: number of links here and the least text of its component here."""
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in leaf_groups(frames):
            g = g.sort_values("place")
            sets = [shingle_set(t) for t in g["raw"]]
            links, root = [0] * len(g), list(range(len(g)))

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, js in enumerate(g["partners"]):
                for j in js:
                    a, b = sets[i], sets[j]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= threshold * (len(a) + len(b) - both):
                        links[i] += 1
                        links[j] += 1
                        x, y = top(i), top(j)
                        root[max(x, y)] = min(x, y)
            rows = [i for i, c in enumerate(links) if c]
            if rows:
                k1, k2, r = g["k1"].to_numpy(), g["k2"].to_numpy(), [top(i) for i in rows]
                yield pd.DataFrame({"k1": k1[rows], "k2": k2[rows], "links": [links[i] for i in rows], "r1": k1[r], "r2": k2[r]})

    return go


def by_leaf(df: DataFrame) -> DataFrame:
    return df.repartition(*LEAF).sortWithinPartitions(*LEAF)


def text_links(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    split: float = SPLIT,
    target: float = TARGET,
    depth: int = DEPTH,
    limit: int = LIMIT,
    block: int = BLOCK,
) -> DataFrame:
    """``(k1, k2, links, r1, r2)``: links found in one leaf for one text, and a text of its component."""
    raw = F.col("text").cast("binary").alias("raw")
    texts = docs.where("text is not null").select(*text_key(F.col("text")), raw)
    embedded = saved(
        texts.mapInPandas(_embed, "k1 long, k2 long, n int, tokens binary").dropDuplicates(KEY),
        "embedded",
    )
    found = leaves(embedded, runs_for(target, threshold, split, depth), split, depth, limit)
    own = found.groupBy(*KEY).agg(F.collect_list(F.struct("path", "n_texts")).alias("own"))
    member = embedded.join(own, KEY).select("*", F.col("own.path").alias("paths"), F.explode("own").alias("leaf")).drop("own")
    blocks = F.ceil(F.col("leaf.n_texts") / block).cast("int")
    dealt = member.withColumn("path", F.col("leaf.path")).withColumn("blocks", blocks)
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("k2", "path"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.select(
        "path", F.least("side", "with").alias("block"), F.greatest("side", "with").alias("other"), "side", *KEY, "n", "tokens", "paths"
    )
    pairs = "path long, block int, other int, k1 long, k2 long, place int, partners array<int>"
    candidates = saved(by_leaf(tasks).mapInPandas(_candidates(threshold), pairs), "candidates")
    wanted = saved(candidates.select(*KEY).distinct(), "candidate-texts")
    bodies = texts.join(broadcast_if(wanted, 500_000), KEY).dropDuplicates(KEY)
    checked = by_leaf(candidates.join(bodies, KEY)).mapInPandas(
        _verified(threshold), "k1 long, k2 long, links int, r1 long, r2 long"
    )
    return saved(checked, "links")


def text_classes(docs: DataFrame, **options) -> DataFrame:
    """A row per distinct text: ``k1, k2, first_id, n_copies, n_first, n_links, class_id, c1, c2, class_texts``.

    ``first_id`` is the least id among its rows and ``n_first`` the number of rows with it;
    ``c1, c2`` name the class by its first text, the one with the least id.
    """
    ids = docs.select("doc_id", *text_key(F.col("text")))
    by_id = ids.groupBy(*KEY, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("first")
    texts = by_id.groupBy(*KEY).agg(first, F.sum("rows").alias("n_copies"))
    links = text_links(docs.select("text"), **options)
    counts = links.groupBy(*KEY).agg(F.sum("links").alias("n_links"))
    edges = links.select(F.struct(*KEY).alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    roots = same_components(edges, "classes").select("node.k1", "node.k2", "root")
    known = texts.join(counts, KEY, "left").join(roots, KEY, "left")
    rooted = saved(
        known.select(
            *KEY,
            F.col("first.doc_id").alias("first_id"),
            F.col("first.rows").alias("n_first"),
            "n_copies",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", F.struct(*KEY)).alias("root"),
        ),
        "texts",
    )
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", *KEY)).alias("least")
    linked = rooted.where("n_links > 0")
    classes = linked.groupBy("root").agg(least, F.count(F.lit(1)).alias("class_texts"))
    columns = [*KEY, "first_id", "n_copies", "n_first", "n_links"]
    joined = linked.join(classes, "root").select(
        *columns, F.col("least.first_id").alias("class_id"), F.col("least.k1").alias("c1"), F.col("least.k2").alias("c2"), "class_texts"
    )
    alone = rooted.where("n_links = 0").select(
        *columns, F.col("first_id").alias("class_id"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.lit(1).cast("long").alias("class_texts")
    )
    return joined.union(alone)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """A row per document: ``doc_id, class_id, n_links`` (to different texts) and ``n_copies`` (rows with its text)."""
    classes = saved(text_classes(docs, **options), "text-classes")
    rows = docs.select("doc_id", *text_key(F.col("text")))
    return rows.join(classes.select(*KEY, "class_id", "n_links", "n_copies"), KEY).select("doc_id", "class_id", "n_links", "n_copies")


@query("op5_chosen_path_join")
def op5_chosen_path_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each class, the one with the least id; columns of ``documents``.

    Only texts with copies or links are looked up, so that texts are not shuffled.
    """
    special = (F.col("class_texts") > 1) | (F.col("n_copies") > 1)
    first: Column = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    grouped = saved(
        text_classes(docs.select("doc_id", "text"))
        .where(special)
        .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("first_id").alias("_id"), first.alias("_first"), (F.col("n_first") > 1).alias("_twice")),
        "class-members",
    )
    k1, k2 = text_key(F.col("text"))
    looked = docs.withColumns({"_k1": k1, "_k2": k2}).join(broadcast_if(grouped, 500_000), ["_k1", "_k2"], "left")
    kept = looked.where(F.col("_first").isNull() | (F.col("_first") & F.col("doc_id").eqNullSafe(F.col("_id"))))
    single = kept.where(F.coalesce("_twice", F.lit(False)) == F.lit(False))
    once = kept.where("_twice").dropDuplicates(["_k1", "_k2"])
    return single.union(once).select(*docs.columns)
