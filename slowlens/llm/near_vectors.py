"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node with their number.  Every node has a list of its nearest
nodes, at first the best of some windows of nodes in the order of random hyperplane
signatures.  A round sends each node, with a code of one byte per dimension, to all
members of its list; nodes that meet at a common neighbour are compared there and take
each other into their lists, until few entries change.  A list whose every entry is as
near as a link is saturated: it is doubled and refined further, up to ``LIST_MOST``.

Rows are laid out by range of the node they are sent to and compared in windows of
bounded length, so a hub or a signature that very many nodes share is spread over tasks
and no group is ever held whole.  Entries near the threshold are verified in doubles and
give components.  Links are then counted exactly inside components, small ones in one
piece.  In a large one, members close to its centre are linked to all by the triangle
inequality of angles and need no comparison; the others are compared in pairs of blocks,
and only counts leave a task.  So a saturated list of bounded length loses no link of its
component; the work grows with the square of those distinct members that lie far from
the centre of one large component.

The audit compares ``audited`` nodes with all vectors, in blocks.  If too few links were
found, more signatures and rounds follow; the recall at the end is a column of the result.

A vector that is null, all zeros or holds null, NaN or infinite entries links with
nothing, and vectors of different lengths never link; such rows are returned as well.
Rows without id take part; a component's id is its least id that is not null.  Rows with
equal ids stay rows of their own.  Columns other than id and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import same_components, saved, table
from slowlens.llm.vectors import finite, matrix

THRESHOLD = 0.9
NEIGHBOURS, LIST_MOST = 10, 80
SIGNATURES, BITS = 8, 32
WINDOW, STEP, EACH = 64, 32, 8
ROUNDS, FEW = 8, 0.01
MILLION = 1_000_000
#: What a cosine of one-byte codes may be off.
MARGIN = 30_000
BLOCK = 512
AUDITED, RECALL, ATTEMPTS = 1_000, 0.97, 3
#: Angles that decide without a comparison must be this far from the threshold.
SAFE = 1e-6


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def vector_classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(node, k1, k2, vector, copies, least)`` of the different usable vectors."""
    usable = finite(F.col("vector")) & F.exists("vector", lambda c: c != 0)
    named = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(usable)
    found = named.groupBy(*vector_key(F.col("vector"))).agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("least")
    )
    return saved(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def vector_key(vector: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit("second"), vector, F.size(vector)).alias("k2")]


def _coded(signatures: int, seed: int):
    """One byte per dimension, and signatures: the signs of random projections as numbers."""

    def coded(batches):
        planes = np.zeros((0, 0))
        for batch in batches:
            values, lengths = matrix(batch.column("vector"))
            if not len(values):
                continue
            unit = _unit(values)
            if planes.shape[1] < values.shape[1]:  # each dimension has its own seed, so all tasks agree
                rows = [np.random.Generator(np.random.PCG64([seed, i])).standard_normal(signatures * BITS) for i in range(values.shape[1])]
                planes = np.array(rows).T
            signs = (unit @ planes[:, : values.shape[1]].T > 0).reshape(len(unit), signatures, BITS)
            marks = signs @ (1 << np.arange(BITS - 1, -1, -1))
            codes = np.rint(127 * (unit / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([c[:n].tobytes() for c, n in zip(codes, lengths)], pa.binary()),
                    pa.array(list(marks), pa.list_(pa.int64())),
                ],
                names=["node", "code", "marks"],
            )

    return coded


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as rows of whole numbers, their norms and their lengths."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.float32 if width <= 1024 else np.float64)  # products stay whole
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(column.to_pylist()), np.int8)
    return out, np.sqrt((out.astype(np.float64) ** 2).sum(axis=1)), lengths


def _met(batches):
    """Nodes that meet in a window of consecutive rows: for each the nearest ones that it does not know, in millionths."""
    for batch in batches:
        node, k, reach = (batch.column(c).to_numpy() for c in ("node", "k", "reach"))
        codes, norms, lengths = _codes(batch.column("code"))
        known = batch.column("known")
        ids = known.flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(known.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
        out = [np.zeros((0, 4), np.int64)]
        for at in range(0, len(node), STEP):
            if at and len(node) - at <= WINDOW - STEP:
                break
            here, first = np.unique(node[at : at + WINDOW], return_index=True)
            rows = at + first
            if len(rows) < 2:
                continue
            sim = (codes[rows] @ codes[rows].T) / (norms[rows][:, None] * norms[rows][None, :])
            near = (sim * MILLION).astype(np.int64)
            near[lengths[rows][:, None] != lengths[rows][None, :]] = -2 * MILLION
            np.fill_diagonal(near, -2 * MILLION)
            sizes = ends[rows + 1] - ends[rows]
            entry = np.repeat(ends[rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            place = np.minimum(np.searchsorted(here, ids[entry]), len(here) - 1)
            held = here[place] == ids[entry]
            near[np.repeat(np.arange(len(rows)), sizes)[held], place[held]] = -2 * MILLION
            each = min(EACH, len(rows) - 1)
            best = np.argpartition(-near, each - 1, axis=1)[:, :each]
            value = np.take_along_axis(near, best, axis=1)
            i, j = np.nonzero(value > reach[rows][:, None])
            out.append(np.stack([here[i], k[rows][i], here[best[i, j]], value[i, j]], axis=1))
        found = np.concatenate(out).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found], names=["node", "k", "nbr", "sim"])


MET = "node long, k long, nbr long, sim long"


def _taken(entries: DataFrame) -> DataFrame:
    """``(node, k, near)``: each node's ``k`` nearest of ``entries`` (node, k, nbr, sim)."""
    nearest = F.sort_array(F.collect_set(F.struct("sim", "nbr")), asc=False)
    lists = entries.groupBy("node").agg(F.max("k").alias("k"), nearest.alias("near"))
    return lists.select("node", "k", F.expr("slice(near, 1, cast(k as int))").alias("near"))


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("node", "k", F.inline("near")).select("node", "k", "nbr", "sim")


def first_lists(classes: DataFrame, coded: DataFrame, neighbours: int, salt: int) -> DataFrame:
    """Lists from windows of nodes in the order of each signature."""
    each = coded.select("node", "code", F.length("code").alias("size"), F.posexplode("marks").alias("signature", "mark"))
    spread = F.xxhash64("node", F.lit(salt))
    laid = each.repartitionByRange("signature", "size", "mark", spread).sortWithinPartitions("signature", "size", "mark", spread)
    none = F.array().cast("array<long>").alias("known")
    rows = laid.select("node", "code", F.lit(neighbours).cast("long").alias("k"), F.lit(-2 * MILLION).cast("long").alias("reach"), none)
    return rows.mapInArrow(_met, MET)


def meet(lists: DataFrame, coded: DataFrame, active: Column, salt: int) -> DataFrame:
    """New entries from one round: active nodes go to all members of their lists and meet there."""
    state = lists.where(active).join(coded.select("node", "code"), "node")
    full = F.size("near") >= F.col("k")
    reach = F.when(full, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2 * MILLION)).cast("long")
    known = F.col("near.nbr")
    sent = state.select(
        F.explode(F.array_append(known, F.col("node"))).alias("at"), "node", "code", "k", reach.alias("reach"), known.alias("known")
    )
    spread = F.xxhash64("node", F.lit(salt))
    laid = sent.repartitionByRange("at", spread).sortWithinPartitions("at", spread)
    return laid.drop("at").mapInArrow(_met, MET)


def refined(lists: DataFrame, coded: DataFrame, least: int, salt: int) -> DataFrame:
    """Rounds until few entries change; then saturated lists are doubled and refined, up to ``LIST_MOST``."""
    saturated = (F.size("near") >= F.col("k")) & (F.element_at("near", -1)["sim"] >= least)
    active, longest = F.lit(True), lists.agg(F.max("k")).first()[0] or 0
    for step in range(ROUNDS * 4):
        met = meet(lists, coded, active, salt + step)
        after = saved(_taken(_entries(lists).unionByName(met)), "near-lists")
        before = lists.select("node", F.col("near").alias("old"))
        change = after.join(before, "node").agg(
            F.sum(F.size(F.array_except("near", "old"))).alias("new"), F.sum(F.when(active, F.size("near"))).alias("all")
        )
        counted = change.first()
        lists = after
        if (counted["new"] or 0) > FEW * (counted["all"] or 0) and (step + 1) % ROUNDS:
            continue
        if 2 * longest > LIST_MOST or not lists.where(saturated & (F.col("k") == longest)).take(1):
            break
        lists = lists.withColumn("k", F.when(saturated & (F.col("k") == longest), 2 * F.col("k")).otherwise(F.col("k")))
        longest *= 2
        active = F.col("k") == longest
    return lists


def _verified(threshold: float):
    def verified(batches):
        for batch in batches:
            a, _ = matrix(batch.column("va"))
            b, _ = matrix(batch.column("vb"))
            good = (_unit(a) * _unit(b)).sum(axis=1) >= threshold if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return verified


def links(lists: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of list entries whose cosine in doubles reaches the threshold."""
    close = _entries(lists).where(F.col("sim") >= int(threshold * MILLION) - MARGIN)
    pairs = close.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    va = classes.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    vb = classes.select(F.col("node").alias("b"), F.col("vector").alias("vb"))
    return pairs.join(va, "a").join(vb, "b").mapInArrow(_verified(threshold), "a long, b long")


def _counted(threshold: float):
    """For rows ``(members, other)`` of blocks of one component: links of each member into the other block.

    A null ``other`` is the same block; between two blocks both sides are counted.
    """

    def side(scalar):
        rows = scalar.as_py() or []
        return (
            np.array([r["node"] for r in rows], np.int64),
            np.array([r["copies"] for r in rows], np.int64),
            _unit(np.array([r["vector"] for r in rows])) if rows else None,
        )

    def counted(batches):
        for batch in batches:
            node, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                ids, copies, unit = side(batch.column("members")[i])
                others, more, facing = side(batch.column("other")[i])
                if unit is None:
                    continue
                if facing is None:
                    linked = unit @ unit.T >= threshold
                    np.fill_diagonal(linked, False)
                    node.append(ids)
                    count.append(linked @ copies)
                else:
                    linked = unit @ facing.T >= threshold
                    node += [ids, others]
                    count += [linked @ more, linked.T @ copies]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(count))], names=["node", "links"])

    return counted


def _centre_parts(batches):
    """Per task and component: the sum of its unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        values, _ = matrix(batch.column("vector"))
        if not len(values):
            continue
        root, unit = batch.column("root").to_numpy(), _unit(values)
        order = np.argsort(root, kind="stable")
        first = np.flatnonzero(np.append(True, root[order][1:] != root[order][:-1]))
        for r, s in zip(root[order][first], np.add.reduceat(unit[order], first, axis=0)):
            old = sums.get(r, np.zeros(0))
            total = np.zeros(max(len(old), len(s)))
            total[: len(old)] += old
            total[: len(s)] += s
            sums[r] = total
        if len(sums) > 1 << 12:
            yield _sums_batch(sums)
            sums = {}
    yield _sums_batch(sums)


def _sums_batch(sums: dict) -> pa.RecordBatch:
    columns = [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["root", "total"])


def _angles(batches):
    """The angle of each member to the centre of its component."""
    for batch in batches:
        values, _ = matrix(batch.column("vector"))
        centres, _ = matrix(batch.column("centre"), values.shape[1])
        if not len(values):
            continue
        norm = np.sqrt((centres * centres).sum(axis=1))
        cosine = (_unit(values) * centres).sum(axis=1) / np.where(norm > 0, norm, 1)
        angle = np.where(norm > 0, np.arccos(np.clip(cosine, -1, 1)), math.pi)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("root", "node", "copies", "vector")] + [pa.array(angle)], names=["root", "node", "copies", "vector", "angle"])


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(node, links)`` of ``members`` (root, node, copies, vector): copies of other vectors of the component that are linked."""
    one = F.struct("node", "copies", "vector")
    kind = "array<struct<node:bigint,copies:bigint,vector:array<double>>>"
    schema = "node long, links long"
    sizes = saved(members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("mass")), "component-sizes")
    sized = members.join(sizes, "root")
    whole = sized.where(F.col("n") <= block).groupBy("root").agg(F.collect_list(one).alias("members"))
    found = whole.select("members", F.lit(None).cast(kind).alias("other")).mapInArrow(_counted(threshold), schema)
    if not sizes.where(F.col("n") > block).take(1):
        return found
    large = sized.where(F.col("n") > block)
    parts = large.select("root", "vector").mapInArrow(_centre_parts, "root long, total array<double>")
    centres = (
        parts.select("root", F.posexplode("total").alias("i", "v"))
        .groupBy("root", "i")
        .agg(F.sum("v").alias("v"))
        .groupBy("root")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("centre"))
    )
    placed = large.join(centres, "root").select("root", "node", "copies", "vector", "centre")
    angled = saved(placed.mapInArrow(_angles, "root long, node long, copies long, vector array<double>, angle double"), "component-angles")
    limit = math.acos(threshold) - SAFE
    far = angled.groupBy("root").agg(F.max("angle").alias("radius"))
    # members within limit - radius of the centre are linked to every other member
    split = angled.join(far, "root").join(sizes, "root").withColumn("core", F.col("angle") + F.col("radius") <= limit)
    tally = saved(
        split.groupBy("root").agg(
            F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_mass"), F.count(F.when(~F.col("core"), 1)).alias("outer")
        ),
        "component-cores",
    )
    inner = split.where("core").select("node", (F.col("mass") - F.col("copies")).alias("links"))
    outer = split.where(~F.col("core")).join(tally, "root")
    given = outer.select("node", F.col("core_mass").alias("links"))
    blocks = F.ceil(F.col("outer") / F.lit(block)).cast("int")
    dealt = outer.select("root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), "node", "copies", "vector")
    pairs = dealt.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "facing"), F.greatest("own", "facing")
    both = pairs.groupBy("root", low.alias("low"), high.alias("high")).agg(
        F.collect_list(F.when(F.col("own") == low, one)).alias("members"), F.collect_list(F.when(F.col("own") != low, one)).alias("other")
    )
    compared = both.select("members", F.when(F.col("low") < F.col("high"), F.col("other")).alias("other"))
    among = compared.where((F.col("low") == F.col("high")) | (F.size("other") > 0)).mapInArrow(_counted(threshold), schema)
    rest = given.unionByName(among).groupBy("node").agg(F.sum("links").alias("links"))
    return found.unionByName(inner).unionByName(rest)


def audit(classes: DataFrame, counted: DataFrame, threshold: float, audited: int) -> float:
    """Share of the links of ``audited`` nodes, compared with all vectors, that were found; copies of a vector do not count."""
    chosen = classes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(audited).select("node", "vector").collect()
    if not chosen:
        return 1.0
    nodes, sizes = np.array([r["node"] for r in chosen], np.int64), np.array([len(r["vector"]) for r in chosen])
    wide = np.zeros((len(chosen), int(sizes.max())))
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = np.concatenate([r["vector"] for r in chosen])
    unit = _unit(wide)

    def compared(batches):
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            values, lengths = matrix(batch.column("vector"))
            if not len(values):
                continue
            width = min(values.shape[1], unit.shape[1])
            linked = (_unit(values)[:, :width] @ unit[:, :width].T >= threshold) & (lengths[:, None] == sizes[None, :])
            linked &= batch.column("node").to_numpy()[:, None] != nodes[None, :]
            total += batch.column("copies").to_numpy() @ linked
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "links"])

    true = classes.select("node", "copies", "vector").mapInArrow(compared, "node long, links long")
    wanted = true.groupBy("node").agg(F.sum("links").alias("wanted"))
    got = wanted.join(counted, "node", "left").agg(F.sum("wanted").alias("wanted"), F.sum(F.least("wanted", "links")).alias("found")).first()
    return (got["found"] or 0) / got["wanted"] if got["wanted"] else 1.0


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    audited: int = AUDITED,
    recall: float = RECALL,
) -> DataFrame:
    """``(key, n_links, component_id, kept, recall)`` for every row."""
    classes = vector_classes(rows, key, vector)
    least = int(threshold * MILLION) - MARGIN
    lists = None
    for attempt in range(ATTEMPTS):
        coding = _coded(SIGNATURES << attempt, attempt)
        coded = saved(classes.select("node", "vector").mapInArrow(coding, "node long, code binary, marks array<long>"), "vector-codes")
        entries = first_lists(classes, coded, neighbours, attempt)
        entries = entries if lists is None else entries.unionByName(_entries(lists))
        lists = refined(saved(_taken(entries), "near-lists"), coded, least, 1_000 * attempt)
        root = saved(same_components(saved(links(lists, classes, threshold), "vector-links"), "vector-components"), "vector-roots")
        members = saved(classes.select("node", "copies", "vector", "least").join(root, "node"), "vector-members")
        counted = saved(count_links(members.select("root", "node", "copies", "vector"), threshold), "vector-counts")
        found = audit(classes, counted, threshold, audited)
        if found >= recall:
            break
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    each = members.select("root", "node").join(ids, "root").join(counted, "node").select("node", "links", "component_id")
    known = classes.select("k1", "k2", "node", "copies", "least").join(each, "node", "left")
    result = known.select(
        "k1",
        "k2",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    usable = finite(F.col("vector")) & F.exists("vector", lambda c: c != 0)
    named = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    keyed = named.select("key", *[F.when(usable, k).alias(n) for k, n in zip(vector_key(F.col("vector")), ("k1", "k2"))])
    joined = keyed.join(result, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
        F.lit(found).alias("recall"),
    )


SQL = f"""
with recursive v as (select row_number() over () as k, vec_id, case when embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    then cast(embedding as double[]) end as e from embeddings),
l as materialized (select a.k as a, b.k as b from v a, v b where a.k <> b.k
    and case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= {THRESHOLD} else false end),
r(k, other) as (select k, k from v union select r.k, l.b from r join l on l.a = r.other),
c as (select r.k, min(v.vec_id) as component_id from r join v on v.k = r.other group by r.k),
n as (select a as k, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from v join c using (k) left join n using (k)"""


@query("op11_nn_descent", SQL)
def op11_nn_descent(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
