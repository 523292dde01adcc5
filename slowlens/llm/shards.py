"""Sharding by balanced label propagation: equal texts move together while counts stay even.

Documents start in shards by rank of a hash, so counts differ by one at most.  In every
round each group of linked documents (equal texts) has a home, the shard that holds most
of it, and members elsewhere ask for a place there; a group larger than half a shard
claims as many shards as its size needs, and small groups settle elsewhere.  Requests
between two shards in opposite directions are swapped, then those along cycles over more
shards; of the rest a shard admits as many as it holds documents without links, and
those make room by moving to the shards that lost members.  For what is left, whole small groups
that stand together move the other way, as many as the requests make room for.  All of
these keep every count as it was, so the law ``rows`` holds exactly after each round.
Ties between homes are drawn anew in each round; rounds end when documents outside their homes
have not become fewer for ``PATIENCE`` rounds.

A group may be far larger than a shard: it is counted per shard with map-side sums, its
rows are never collected, and adaptive execution splits their join with the homes.  Ranks
are taken inside slices of a hash.  What reaches the driver are counts per pair of shards
and per large group and shard (fewer than 3,200 rows each).  Every round is a written table.  Texts are read once; rows then hold
numbers only.  A null text has no bytes and equals other null texts; identical rows and
null ids are separate documents.  An empty table gives no shards.
"""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import free_name, rank_in, running_before, saved, table, text_key

SHARDS = 40
#: Rounds without fewer documents outside their homes after which rounds end.
PATIENCE = 3
GROUP = ["k1", "k2"]


def _slice():
    return F.shiftright("mark", 52)


def cycles(wanted: dict[tuple[int, int], int]) -> list[tuple[list[tuple[int, int]], int]]:
    """Cycles of pairs of shards, and how often each is gone round, until the requests left have none."""
    out: dict[int, dict[int, int]] = {}
    for (a, b), n in sorted(wanted.items()):
        if n > 0:
            out.setdefault(a, {})[b] = n
    found = []
    for start in sorted(out):
        path = [start]
        while path:
            there = out.get(path[-1])
            if not there:  # leads nowhere, so it lies on no cycle
                dead = path.pop()
                if path:
                    del out[path[-1]][dead]
                continue
            to = next(iter(there))
            if to not in path:
                path.append(to)
                continue
            ring = [*path[path.index(to) :], to]
            pairs = list(zip(ring, ring[1:]))
            n = min(out[a][b] for a, b in pairs)
            found.append((pairs, n))
            for a, b in pairs:
                out[a][b] -= n
                if not out[a][b]:
                    del out[a][b]
            del path[path.index(to) + 1 :]
    return found


def plan_round(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int):
    """Requests admitted per pair of shards, and by how many documents each shard grows before room is made."""
    admitted = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    for cycle, n in cycles({p: n - admitted[p] for p, n in wanted.items()}):
        for p in cycle:
            admitted[p] += n
    for b in range(shards):
        room = free.get(b, 0)
        for a in range(shards):
            extra = min(room, wanted.get((a, b), 0) - admitted.get((a, b), 0))
            if extra > 0:
                admitted[a, b] += extra
                room -= extra
    grows = [sum(admitted.get((a, s), 0) - admitted.get((s, a), 0) for a in range(shards)) for s in range(shards)]
    return admitted, grows


def claim_homes(held: list[tuple], shards: int, capacity: int) -> tuple[list[tuple], set[int]]:
    """Rows ``(k1, k2, homes, doors)`` for large groups ``(k1, k2, size, shard, n)``, and the shards that these mostly fill.

    Largest group first; a home is a shard with room for it, if there is one, and then
    the one that holds most of the group.  ``doors`` repeats homes as they lack members.
    """
    groups: dict[tuple, dict[int, int]] = {}
    for k1, k2, size, shard, n in held:
        groups.setdefault((size, k1, k2), {})[shard] = n
    load, claims = [0] * shards, []
    for (size, k1, k2), on in sorted(groups.items(), reverse=True):
        homes, needs, left = [], [], size
        while left > 0 and len(homes) < shards:
            part = min(left, capacity)
            s = min((s for s in range(shards) if s not in homes), key=lambda s: (max(0, load[s] + part - capacity), -on.get(s, 0), s))
            homes.append(s)
            needs.append(max(0, part - on.get(s, 0)))
            load[s] += part
            left -= part
        doors = [h for h, need in zip(homes, needs) for _ in range(-(-need * 256 // max(1, sum(needs))))]
        claims.append((k1, k2, homes, doors or homes))
    return claims, {s for s in range(shards) if load[s] * 2 > capacity}


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``(rid, mark, k1, k2, linked, shard)`` of ``rows`` (``rid, mark, k1, k2``), counts at most one apart."""
    linked = rows.groupBy(*GROUP).count().where("count > 1").select(*GROUP, F.lit(True).alias("linked"))
    known = rows.select("rid", "mark", *GROUP).join(linked, GROUP, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    ranked = rank_in(known.withColumn("all", F.lit(0)), "all", _slice(), [F.col("mark"), F.col("rid")], "rank")
    state = saved(ranked.select("rid", "mark", *GROUP, "linked", (F.col("rank") % shards).cast("int").alias("shard")), "shards")
    capacity = max(1, -(-state.count() // shards))
    least, idle = None, 0
    for turn in count() if rounds is None else range(rounds):
        held = saved(state.where("linked").groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n")), "shard-held")
        sizes = held.groupBy(*GROUP).agg(F.sum("n").alias("c"))
        large = sizes.where(F.col("c") * 2 > capacity)  # fewer than two per shard
        claims, busy = claim_homes([tuple(r) for r in held.join(large, GROUP).select(*GROUP, "c", "shard", "n").collect()], shards, capacity)
        quiet = [s for s in range(shards) if s not in busy] or list(range(shards))
        calm = F.array_contains(F.lit(quiet), F.col("shard"))
        best = F.max(F.struct(calm.alias("calm"), "n", F.xxhash64(*GROUP, "shard", F.lit(turn)).alias("t"), "shard"))
        other = F.element_at(F.lit(quiet), F.pmod(F.xxhash64(*GROUP), F.lit(len(quiet))).cast("int") + 1)
        small = held.join(sizes.where(F.col("c") * 2 <= capacity), GROUP, "left_semi").groupBy(*GROUP).agg(best.alias("best"))
        one = F.array(F.when(F.col("best.calm"), F.col("best.shard")).otherwise(other))
        homes = small.select(*GROUP, one.alias("homes"), one.alias("doors")).union(
            state.sparkSession.createDataFrame(claims, "k1 long, k2 long, homes array<int>, doors array<int>")
        )
        home = F.col("doors")[F.pmod(F.xxhash64("mark", "rid", F.lit(turn)), F.size("doors")).cast("int")]
        asks = saved(
            state.where("linked")
            .join(homes, GROUP)
            .where(~F.array_contains("homes", F.col("shard")))
            .select("rid", "mark", F.col("shard").alias("a"), home.alias("b"), (F.col("shard") * shards + home).alias("pair")),
            "shard-asks",
        )
        wanted = {(r["a"], r["b"]): r["count"] for r in asks.groupBy("a", "b").count().collect()}
        free = {r["shard"]: r["count"] for r in state.where("not linked").groupBy("shard").count().collect()}
        outside = sum(wanted.values())
        least, idle = (outside, 0) if least is None or outside < least else (least, idle + 1)
        if not outside or idle >= PATIENCE:
            break
        admitted, grows = plan_round(wanted, free, shards)
        left = {(a, b): n - admitted.get((a, b), 0) for (a, b), n in wanted.items() if n > admitted.get((a, b), 0)}
        yielding = None
        if left:  # whole groups of ``b`` make room for requests from ``a``
            wide = F.lit([left.get((p // shards, p % shards), 0) for p in range(shards * shards)])
            sources = F.array(*[F.array(*[F.lit(a) for a in quiet if (a, b) in left]).cast("array<int>") for b in range(shards)])
            whole = held.where(calm).join(sizes.where(F.col("c") * 2 <= capacity), GROUP).where("n = c").select(
                *GROUP, F.col("c"), F.col("shard").alias("b"), F.element_at(sources, F.col("shard") + 1).alias("from")
            )
            whole = whole.where(F.size("from") > 0).withColumn("a", F.element_at("from", F.pmod(F.xxhash64(*GROUP, F.lit(turn)), F.size("from")).cast("int") + 1))
            whole = whole.withColumn("pair", F.col("a") * shards + F.col("b")).withColumn("order", F.xxhash64(*GROUP, F.lit(turn)))
            in_turn = running_before(whole, "pair", F.shiftright("order", 52), [F.col("order"), *GROUP], F.col("c"), "before")
            yielding = saved(
                in_turn.where(F.col("before") + F.col("c") <= F.element_at(wide, F.col("pair") + 1)).select(*GROUP, "a", "b", "c"), "shard-yields"
            )
            for r in yielding.groupBy("a", "b").agg(F.sum("c").alias("n")).collect():
                admitted[r["a"], r["b"]] += r["n"]
        if not sum(admitted.values()):
            continue
        allowed = F.lit([admitted.get((p // shards, p % shards), 0) for p in range(shards * shards)])
        in_order = [F.col("mark"), F.col("rid")]
        enter = rank_in(asks, "pair", _slice(), in_order, "rank").where(F.col("rank") < F.element_at(allowed, F.col("pair") + 1))
        moves = enter.select("rid", F.col("b").alias("to"))
        over, gaps = [max(0, g) for g in grows], [s for s, g in enumerate(grows) if g < 0]
        if sum(over):
            first = F.lit([0, *accumulate(over)][:-1])
            ends = list(accumulate(-grows[s] for s in gaps))
            place = rank_in(state.where(~F.col("linked") & (F.element_at(F.lit(over), F.col("shard") + 1) > 0)), "shard", _slice(), in_order, "rank")
            leave = place.where(F.col("rank") < F.element_at(F.lit(over), F.col("shard") + 1)).withColumn(
                "place", F.element_at(first, F.col("shard") + 1) + F.col("rank")
            )
            gap = F.size(F.filter(F.lit(ends), lambda e: e <= F.col("place")))
            moves = moves.union(leave.select("rid", F.element_at(F.lit(gaps), gap + 1).alias("to")))
        if yielding is not None:
            moves = moves.union(state.where("linked").join(yielding, GROUP).select("rid", F.col("a").alias("to")))
        state = saved(
            state.join(moves, "rid", "left").select("rid", "mark", *GROUP, "linked", F.coalesce("to", "shard").cast("int").alias("shard")),
            "shards",
        )
    return state


def _rows_of(docs: DataFrame, rid: str) -> DataFrame:
    """Numbers of every document: size, checksum, keys of its text and the place ``mark`` it begins from."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    read = docs.select(
        "doc_id",
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *text_key(F.col("text")),
        F.col(rid).alias("rid"),
    )
    return saved(read.withColumn("mark", F.xxhash64("doc_id", *GROUP)), "shard-rows")


def _slots(rows: DataFrame, shards: int, rounds: int | None) -> DataFrame:
    """``(rid, shard, slot)`` of every row."""
    state = propagate(rows, shards, rounds)
    return rank_in(state, "shard", _slice(), [F.col("mark"), F.col("rid")], "slot").select("rid", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    rid = free_name(docs, "_rid")
    rows = _rows_of(docs.withColumn(rid, F.monotonically_increasing_id()), rid)
    return rows.join(_slots(rows, shards, rounds), "rid").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_corpus(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (names that are free), laid out by both, so that a writer's files hold them in order.

    Numbers go through the rounds; whole rows are moved twice at the end, to their place and into order.
    """
    rid, shard, slot = (free_name(docs, n) for n in ("_rid", "shard", "slot"))
    numbered = saved(docs.withColumn(rid, F.monotonically_increasing_id()), "shard-documents")
    found = _slots(_rows_of(numbered, rid), shards, rounds)
    placed = numbered.join(found.select(F.col("rid").alias(rid), F.col("shard").alias(shard), F.col("slot").alias(slot)), rid)
    return placed.drop(rid).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)


@query("op4_label_propagation")
def op4_label_propagation(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sharding_stage(spark, docs, sf_dir):
    """The corpus: every remaining document with its shard and slot, in that order."""
    return sharded_corpus(docs)
