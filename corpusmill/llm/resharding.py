"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.llm.words import shuffles_removed, stored

#: Size steps to each doubling, and hash parts of a size step: blocks are at most shards * 31 * 4 * 8, whatever the input.
_STEPS, _PARTS = 4, 8

#: Parts of all rows by a hash of their number, in the order of the slots; and waves in which rows are rewritten, each of as many parts.
_DEALT, WAVES = 256, 8

#: The row's number, from ``numbered``.
SERIAL = "__serial"


def least_moves(held: Sequence[int], room: Sequence[int]) -> dict[tuple[int, int], int]:
    """``{(from, to): bytes}`` of a minimum-cost flow: old shards send all they hold, new shards take at most their room.

    Staying costs nothing, a byte that changes its shard costs one. Cheapest augmenting paths one after another; shards are
    few, so the graph is tiny. The rooms must add up to at least what is held.
    """
    n, m = len(held), len(room)
    source, sink = n + m, n + m + 1
    ends: list[int] = []
    left: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def connect(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(ends))
            ends.append(y)
            left.append(c)
            price.append(p)

    for i in range(n):
        connect(source, i, held[i], 0)
        for j in range(m):
            connect(i, n + j, held[i], int(i != j))
    for j in range(m):
        connect(n + j, sink, room[j], 0)
    waiting = sum(held)
    while waiting > 0:
        cost: dict[int, int] = {source: 0}
        came: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            for a in list(cost):
                for e in out[a]:
                    if left[e] > 0 and cost[a] + price[e] < cost.get(ends[e], 1 << 60):
                        cost[ends[e]], came[ends[e]], changed = cost[a] + price[e], e, True
        if sink not in cost:
            raise ValueError("the new shards have too little room")
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = ends[came[node] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
        waiting -= amount
    return {(i, ends[e] - n): left[e ^ 1] for i in range(n) for e in out[i] if not e & 1 and left[e ^ 1] > 0}


def _moved(rows: DataFrame, shards: int, smallest_first: bool) -> DataFrame:
    """``rows`` (shard, size, serial, ...) with shards of near-equal bytes; a shard's smallest rows leave it, or rows of all sizes."""
    spark = rows.sparkSession
    by_size = F.floor(F.log2(F.col("size").cast("double")) * _STEPS).cast("int")
    blocks_of = rows.withColumn("step", by_size if smallest_first else F.pmod(F.xxhash64(F.lit(1), "serial"), F.lit(31 * _STEPS)).cast("int")).withColumn("part", F.pmod(F.xxhash64("serial"), F.lit(_PARTS)).cast("int"))
    blocks = blocks_of.groupBy("shard", "step", "part").agg(F.sum("size").alias("bytes")).orderBy("shard", "step", "part").collect()
    held = [0] * shards
    for b in blocks:
        held[b["shard"]] += b["bytes"]
    total = sum(held)
    flow = least_moves(held, [total // shards + (1 if j < total % shards else 0) for j in range(shards)])
    ends: dict[int, list[tuple[int, int]]] = {}  # of a shard: (up to which byte of its order, new shard); what stays comes last
    for i in range(shards):
        at, ends[i] = 0, []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j == i, j)):
            at += flow[i, j]
            ends[i].append((at, j))
    whole, split, at = [], [], {i: 0 for i in range(shards)}
    for b in blocks:
        i, start = b["shard"], at[b["shard"]]
        at[i] = stop = start + b["bytes"]
        upto, target = next(x for x in ends[i] if start < x[0])
        if stop <= upto:
            whole.append((i, b["step"], b["part"], target, None, None))
        else:
            split.append((i, b["step"], b["part"], None, start, [{"upto": x, "to": j} for x, j in ends[i]]))
    table = spark.createDataFrame(
        whole + split, "shard int, step int, part int, target int, start long, ends array<struct<upto: long, to: int>>")
    known = blocks_of.join(F.broadcast(table), ["shard", "step", "part"])
    keep = [c for c in rows.columns if c != "shard"]
    place = F.col("start") + F.sum("size").over(Window.partitionBy("shard", "step", "part").orderBy("size", "serial")) - F.col("size")
    cut = known.where("target IS NULL").withColumn("place", place).select(
        *keep, F.filter("ends", lambda x: F.col("place") < x["upto"])[0]["to"].alias("shard"))
    return known.where("target IS NOT NULL").select(*keep, F.col("target").alias("shard")).unionByName(cut)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``SERIAL``, numbered once and stored: the plan and the rewriting speak of the same rows."""
    return stored(docs.withColumn(SERIAL, F.monotonically_increasing_id()), "rows")


def reshard(docs: DataFrame, old_shard: Column, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, old_shard, shard, slot`` per row under the law ``bytes``: shards of near-equal bytes.

    ``old_shard`` (0 to ``shards - 1``) says where a row lies now. Old sizes and equal capacities give the flow with the fewest moved bytes.
    Blocks (a shard's rows by a hash) follow it whole; a block that two new
    shards share is cut at a row. A second flow evens out what whole rows left over, with the smallest rows
    (blocks of about one size). The driver sees block totals only.
    Size: UTF-8 bytes plus 1; a null text counts as empty. Null and repeated keys and copies are rows like others. A null old
    shard is shard 0. An empty table gives an empty result. Rows from ``numbered`` keep their ``SERIAL`` as a last column.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("crc"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old"),
                       *([F.col(SERIAL).alias("serial")] if SERIAL in docs.columns else []))
    if SERIAL not in docs.columns:
        base = base.withColumn("serial", F.monotonically_increasing_id())
    base = stored(base, "shards")  # numbered once, then read from files
    first = stored(_moved(base.withColumn("shard", F.col("old")), shards, False), "shards")
    last = stored(_moved(first, shards, True), "shards")
    dealt = last.withColumn("part", F.pmod(F.xxhash64(F.col("serial")), F.lit(_DEALT)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("serial"))
    return dealt.withColumn("number", number).join(F.broadcast(before), ["shard", "part"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard",
        (F.col("before") + F.col("number") - 1).alias("slot"), *([F.col("serial").alias(SERIAL)] if SERIAL in docs.columns else []))


def rewrite(docs: DataFrame, plan: DataFrame, folder: str, key: str = "doc_id") -> list[int]:
    """Writes the files of the affected shards (rows came or went) to ``folder/shard=N`` and returns their numbers.

    Shards that neither gave nor took a row keep their old files and are not read again; an affected shard that has no row left loses
    its files. Rows from ``numbered`` are met by their ``SERIAL``, so null and repeated keys are rows like others (and ``folder`` may be where the
    rows came from); other rows are met by ``key``, and a null or repeated one raises.
    The texts move in ``WAVES``, each with a part of the rows, and the shuffle files of a wave go when it has ended. A wave holds one stretch of
    a shard's slots (where ``SERIAL`` is known). New files replace the old ones when all waves are written.
    """
    by = SERIAL if SERIAL in docs.columns else key
    if by == key and not plan.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{key} is null or repeated: take the rows from numbered()")
    moves = plan.where("old_shard <> shard")
    touched = sorted(r[0] for r in moves.select("old_shard").union(moves.select("shard")).distinct().collect())
    wanted = plan.where(F.col("shard").isin(touched)).select(by, "shard", "slot")
    wave = F.floor(F.pmod(F.xxhash64(F.col(by)), F.lit(_DEALT)) / (_DEALT // WAVES))
    spark, fresh = plan.sparkSession, f"{folder}/_new-{uuid.uuid4().hex}"  # readers pass over names with a line in front
    for i in range(WAVES if touched else 0):
        rows = docs.drop("shard", "slot").where(wave == i).join(wanted.where(wave == i), by).drop(SERIAL)
        with shuffles_removed(spark):
            rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("append").parquet(fresh)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(fresh)
    files = at.getFileSystem(conf)
    for shard in touched:
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{root}/shard={shard}") for root in (folder, fresh))
        files.delete(old, True)
        if files.exists(new) and not files.rename(new, old):
            raise OSError(f"the new files of shard {shard} stay in {fresh}")
    files.delete(at, True)
    return touched
