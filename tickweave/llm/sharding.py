"""Sharding by balanced label propagation.

Documents of equal text are linked. Each group of linked documents is cut into cells (by a hash of doc_id, so that a
very large group has many small cells and no task holds a group); a cell starts in a shard given by its hash. Then rounds of
propagation: a cell asks to move to the shard where its group has most documents, its own shard included. Requests between two shards are
granted by gain: as much as goes the other way is a swap and needs no room, so that full shards exchange cells too; more is granted until the
shard's room is used up. Both are read off a table of request sizes by (from, to, gain, lot), of bounded size. Documents without links do not move in the rounds; at the end they are what evens out the shards.

Law `rows`: the shards' counts are at most one apart. After the rounds, shards above their quota give their
last slots (documents without links come last) to the shards below; both are read off the slot
numbers, without another shuffle.

Cases: a null text is an empty one (size 1, the checksum of no bytes); a null doc_id is placed like any other; repeated rows count one by one;
fewer documents than shards leave shards empty; an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import bucketed_prefix, checkpointed, partitions_for, table, text_or_empty

CELLS = 1024  # cells of a group at most
LOTS = 64  # parts of the requests of one gain that can be granted separately
GAINS = 32  # levels of gain (powers of two)
ROUNDS = 10  # at most; it ends when no cell moves
SLOT_BUCKET_ROWS = 40_000


def _granted(asked: list[tuple[int, int, int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """asked (from, to, lot, documents) -> the last lot granted of each (from, to); lots of a pair are granted in order."""
    lots: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, lot, n in sorted(asked):
        lots.setdefault((a, b), []).append((lot, n))
    total = {k: sum(n for _, n in v) for k, v in lots.items()}
    last, used, room = dict.fromkeys(lots, -1), dict.fromkeys(lots, 0), list(room)
    for (a, b), own in lots.items():  # swaps
        both, moved = min(total[a, b], total.get((b, a), 0)), 0
        for lot, n in own:
            if moved + n > both:
                break
            moved, last[a, b], used[a, b] = moved + n, lot, used[a, b] + 1
        room[b] -= moved
        room[a] += moved
    full: set[tuple[int, int]] = set()
    rest = sorted((lot, a, b, n) for (a, b), own in lots.items() for lot, n in own[used[a, b] :])
    for lot, a, b, n in rest:
        if (a, b) not in full and n <= room[b]:
            last[a, b] = lot
            room[b] -= n
            room[a] += n
        else:
            full.add((a, b))
    return last


def _propagate(cells: DataFrame, shards: int, sizes: list[int], capacity: int, rounds: int) -> DataFrame:
    """cells (grp, cell, n, shard) -> the same with shards after the rounds. sizes: linked documents in each shard now.

    capacity bounds the linked documents of a shard; up to there, documents without links can even the shards out.
    """
    for _ in range(rounds):
        held = cells.groupBy("grp").agg(*[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"h{s}") for s in range(shards)])
        # the best shard: most documents of the group; ties to the one that the group's hash comes to first
        turn = lambda s: F.pmod(F.lit(s) - F.xxhash64("grp"), F.lit(shards))
        score = lambda s: F.struct(F.col(f"h{s}").alias("held"), (-turn(s)).alias("turn"), F.lit(s).alias("to"))
        own = F.element_at(F.array(*[F.col(f"h{s}") for s in range(shards)]), F.col("shard") + 1)
        wish = cells.join(held, "grp").withColumn("best", F.greatest(*map(score, range(shards))) if shards > 1 else score(0))
        gain = F.least(F.floor(F.log2((F.col("best.held") - own + 1).cast("double"))), F.lit(GAINS - 1)).cast("int")
        turn_to = (GAINS - 1 - gain) * LOTS + F.pmod(F.xxhash64("grp", "cell"), F.lit(LOTS)).cast("int")  # the highest gain is served first
        wish = checkpointed(wish.select("grp", "cell", "n", "shard", F.col("best.to").alias("to"), turn_to.alias("lot")))
        asked = wish.filter("to <> shard").groupBy("shard", "to", "lot").agg(F.sum("n").alias("n")).collect()  # shards x shards x GAINS x LOTS rows at most
        if not asked:
            break
        last = _granted([tuple(r) for r in asked], [capacity - s for s in sizes])
        limits = F.array(*[F.lit(last.get((a, b), -1)) for a in range(shards) for b in range(shards)])
        moved = (F.col("to") != F.col("shard")) & (F.col("lot") <= F.element_at(limits, F.col("shard") * shards + F.col("to") + 1))
        cells = wish.select("grp", "cell", "n", F.when(moved, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        change = sum(r["n"] for r in asked if r["lot"] <= last[r["shard"], r["to"]])
        for r in asked:
            if r["lot"] <= last[r["shard"], r["to"]]:
                sizes[r["shard"]] -= r["n"]
                sizes[r["to"]] += r["n"]
        if not change:
            break
    return cells


def _step(value: Column, bounds: list[tuple[int, int]]) -> Column:
    """The label of the last bound that is not above value."""
    out = F.lit(bounds[0][1])
    for low, label in bounds[1:]:
        out = F.when(value >= low, F.lit(label)).otherwise(out)
    return out


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot): counts of the shards at most one apart, slots gapless from 0."""
    text = text_or_empty(text_col)
    cell = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(CELLS)).cast("int")
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(shards)).cast("int")
    plain = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("grp"),
            cell.alias("cell"),
            start.alias("start"),
        )
    )
    # cells are counted first, so a group's total is a sum over its cells
    counted = plain.groupBy("grp", "cell").agg(F.count("*").alias("n"))
    linked = counted.groupBy("grp").agg(F.sum("n").alias("group_n")).filter("group_n > 1")
    first = F.pmod(F.xxhash64("grp", "cell"), F.lit(shards)).cast("int")
    cells = checkpointed(counted.join(linked, "grp", "left_semi").select("grp", "cell", "n", first.alias("shard")))
    total = plain.count()
    in_cells = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    cells = _propagate(cells, shards, [in_cells.get(s, 0) for s in range(shards)], total // shards, rounds)

    placed = plain.join(cells.select("grp", "cell", F.col("shard").alias("to")), ["grp", "cell"], "left")
    buckets = partitions_for(total, SLOT_BUCKET_ROWS)
    linked_first = F.when(F.col("to").isNotNull(), 0).otherwise(1)
    placed = placed.select(
        "doc_id", "size", "text_crc32", "grp",
        F.coalesce("to", "start").alias("shard"),
        (linked_first * buckets + F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(buckets))).cast("long").alias("bucket"),
    )
    ranked = checkpointed(bucketed_prefix(placed, ["shard"], "bucket", [F.col("doc_id"), F.col("grp")], None, "slot"))

    has = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    given, surplus = [], 0  # shard's quota -> place of its first surplus document in the row of all surplus documents
    for s in range(shards):
        given.append(surplus)
        surplus += max(0, has.get(s, 0) - quota[s])
    takers, at = [], 0
    for s in range(shards):
        if (short := quota[s] - has.get(s, 0)) > 0:
            takers.append((at, s, has.get(s, 0)))
            at += short
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    over = F.col("slot") >= of(quota)
    place = F.col("slot") - of(quota) + of(given)
    moved_to = _step(place, [(a, s) for a, s, _ in takers] or [(0, 0)])
    moved_slot = place - _step(place, [(a, a) for a, *_ in takers] or [(0, 0)]) + _step(place, [(a, n) for a, _, n in takers] or [(0, 0)])
    return ranked.select(
        "doc_id", "size", "text_crc32", "grp",
        F.when(over, moved_to).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(over, moved_slot).otherwise(F.col("slot")).cast("long").alias("slot"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
