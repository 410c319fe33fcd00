"""Sharding by balanced label propagation.

Documents of equal text are linked. They start in shards dealt at random, equal in
number. The goals of a group are the shards that hold most of it, as many as it needs to fit in. In each
round a document astray, one that isn't at a goal of its group, wants to go to one; a shard takes as many
as it has documents that are astray or unlinked, and sends such ones back for what it gains. So counts stay
at most one apart throughout (the law ``rows``) and documents at a goal stay there. A shard in which
all documents are at a goal is closed: the rest of its groups gathers in the other shards.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import heavy_keys, join_keyed
from .common import drop_path, ship, staged

SHARDS = 8


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> tuple[DataFrame, str]:
    """Adds ``number``: 0, 1, ... in each group of ``by`` in the given order, without gaps.

    A range exchange sorts the rows; only a row per task and group comes to the driver, so ``by``
    must have few values. ``order`` should have few ties, as tied rows stay in one task.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in (*by, *order)]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    rows, path = staged(sorted_.withColumn("part", F.shiftright("mid", 33)), name)
    stats = rows.groupBy("part", *by).agg(F.min("mid").alias("lo"), F.count("*").alias("n")).collect()
    at: dict[tuple, int] = {}
    offsets = []
    for r in sorted(stats, key=lambda r: r["part"]):
        g = tuple(r[c] for c in by)
        offsets.append((r["part"], *g, at.get(g, 0) - r["lo"]))
        at[g] = at.get(g, 0) + r["n"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(["part long", *(f"{c} {kinds[c]}" for c in by), "shift long"])
    shifts = spark.createDataFrame(offsets, schema)
    out = rows.join(F.broadcast(shifts), ["part", *by]).withColumn("number", F.col("mid") + F.col("shift"))
    return out.drop("mid", "part", "shift"), path


def quotas(wanted: dict[tuple[int, int], int], spare: list[int]) -> tuple[dict[tuple[int, int], int], list[tuple[int, int, int]]]:
    """How many documents may go from shard to shard, and how many spare ones are sent on (from, to, number).

    A shard takes no more than it has spare documents, those that leave it included; what it takes
    beyond what leaves it sends spare ones to the shards that would be short.
    """
    allowed = dict(wanted)
    gain = [0] * len(spare)
    for b in range(len(spare)):
        over = sum(k for (_, to), k in wanted.items() if to == b) - spare[b]
        for key in sorted((k for k in allowed if k[1] == b), key=lambda k: (allowed[k], k)):
            less = min(max(over, 0), allowed[key])
            allowed[key] -= less
            over -= less
    for (a, b), k in allowed.items():
        gain[b] += k
        gain[a] -= k
    back, short = [], [(b, -g) for b, g in enumerate(gain) if g < 0]
    for a in range(len(spare)):
        left = gain[a]
        while left > 0:
            b, need = short.pop()
            k = min(left, need)
            back.append((a, b, k))
            left -= k
            if need > k:
                short.append((b, need - k))
    return {k: v for k, v in allowed.items() if v}, back


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of each row.

    Null texts have size 1 and count as equal to empty ones. Rows that repeat, or share an id,
    are documents of their own; null ids are allowed. Empty tables give empty ones. Extra columns
    may have any name. Each round raises the number of documents at their groups' goals or closes a shard, so
    the rounds end; there is no other limit, also where every document is linked.
    """
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    state, path = numbered(rows.withColumn("h", F.xxhash64("doc_id", "g")), [], ["h", "doc_id"], "deal")
    group = ["g", "text_crc32", "size"]
    shared, shared_path = staged(state.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").withColumn("linked", F.lit(True)), "groups")
    state = join_keyed(state.drop("h").withColumnRenamed("number", "rid"), shared.drop("n"), group, heavy_keys(shared, group), "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    first = path
    state, path = staged(state.withColumn("shard", (F.col("rid") % shards).cast("int")), "state")
    drop_path(spark, first)
    drop_path(spark, shared_path)
    unlinked = {r["shard"]: r["n"] for r in state.where("not linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    room = -(-state.count() // shards)
    closed: set[int] = set()
    for turn in count():
        old = []
        held, held_path = staged(state.where("linked").where(~F.col("shard").isin(list(closed))).groupBy(*group, "shard").agg(F.count("*").alias("c")), "held")
        old.append(held_path)
        own = Window.partitionBy(*group)  # a row for each shard
        goals = F.ceil(F.sum("c").over(own) / F.lit(room))
        place = F.row_number().over(own.orderBy(F.desc("c"), F.xxhash64(*group, "shard")))
        parts = held.withColumn("goal", place <= goals)
        parts = parts.withColumn("goals", F.collect_list(F.when(F.col("goal"), F.struct("shard", F.col("c").alias("there")))).over(own))
        astray, astray_path = staged(parts.where("not goal").drop("goal"), "astray")
        old.append(astray_path)
        out = {r["shard"]: r["n"] for r in astray.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        spare = [0 if s in closed else out.get(s, 0) + unlinked.get(s, 0) for s in range(shards)]
        now_closed = {s for s in range(shards) if not spare[s]}
        moved = False
        if out:
            to = F.element_at("goals", (F.pmod(F.xxhash64("rid", F.lit(turn)), F.size("goals")) + 1).cast("int"))
            strays = join_keyed(state.where("linked"), astray, [*group, "shard"], heavy_keys(held, [*group, "shard"], "c"))
            strays = strays.withColumn("goal", to).select("rid", "shard", F.col("goal.shard").alias("to"), "c", (-F.col("goal.there")).alias("rank"))
            movers, mover_path = numbered(strays, ["shard", "to"], ["rank", "c", "rid"], "movers")
            old.append(mover_path)
            wanted = {(a, b): n for a, b, n in movers.groupBy("shard", "to").count().collect()}
            allowed, back = quotas(wanted, spare)
            if allowed:
                moved = True
                limits = F.broadcast(spark.createDataFrame([(a, b, k) for (a, b), k in allowed.items()], "shard int, to int, k long"))
                marked = movers.join(limits, ["shard", "to"], "left").withColumn("goes", F.col("number") < F.coalesce("k", F.lit(0)))
                going = marked.where("goes").select("rid", "to")
                if back:
                    ranges, at = [], {}
                    for a, b, k in back:
                        ranges.append((a, b, at.get(a, 0), at.get(a, 0) + k))
                        at[a] = ranges[-1][3]
                    others = state.where("not linked").select("rid", "shard", F.lit(0).cast("long").alias("c")).unionByName(marked.where("not goes").select("rid", "shard", "c"))
                    others, others_path = numbered(others, ["shard"], ["c", "rid"], "spare")
                    old.append(others_path)
                    dealt = F.broadcast(spark.createDataFrame(ranges, "shard int, to int, lo long, hi long"))
                    going = going.unionByName(others.join(dealt, "shard").where("number >= lo and number < hi").select("rid", "to"))
                new, new_path = staged(state.join(going, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "state")
                old.append(path)
                state, path = new, new_path
                if back:
                    unlinked = {r["shard"]: r["n"] for r in state.where("not linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        for p in old:
            drop_path(spark, p)
        if not out or not moved and now_closed <= closed:
            break
        closed |= now_closed
    final, _ = numbered(state.select("doc_id", "size", "text_crc32", "shard", "rid"), ["shard"], ["doc_id", "rid"], "slots")
    drop_path(spark, path)
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame) -> int:
    """Groups of equal texts spread over shards: the sum of the shards beyond each group's first; for reports and tests."""
    per = assigned.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n"))
    return per.agg(F.sum(F.col("n") - 1)).first()[0] or 0
