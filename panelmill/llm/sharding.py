"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

All rows of one text are a group that stays together. Groups are weighed by one aggregation over narrow rows (no text
leaves the scan) and dealt evenly over leaves by their key. In each leaf a task differences its groups: every group is a
partial partition of ``shards`` sums; the two with the largest spread are merged, their sums in opposite order,
until one is left. Leaves are then partial partitions themselves and are differenced in turn, ``fan_in`` at a time,
level by level, until one remains; so neither the driver nor a task ever holds all groups. Each level is a table
(child, child's part, parent's part), joined down at the end.

Slots number the rows of a shard without gaps: rows are dealt over bins of a shard, a bin is numbered in one task,
and the bins' counts give the offsets.

Defined results: a null text has size 8, checksum 0 and is a group of its own, apart from the empty text. Repeated
rows each get a slot. Rows with a null id are dealt like all others. An empty table gives an empty result. A group larger than a fair
share cannot be split: its shard is larger by what the group exceeds.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import checked_partitions, read_table, staged

GROUPS_PER_LEAF = 20_000
ROWS_PER_BIN = 100_000
FAN_IN = 256


def differencing(sums: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions: (sums of the merged one, the merged part of each part of each input)."""
    # A heap entry: (-spread, serial, sums descending, members); members[k] lists the (input, part) pairs merged in k.
    heap = []
    for i, row in enumerate(sums):
        order = sorted(range(shards), key=lambda k: -row[k])
        values = [row[k] for k in order]
        heap.append((values[-1] - values[0], i, values, [[(i, k)] for k in order]))
    heapq.heapify(heap)
    serial = len(sums)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        parts = []
        for k in range(shards):
            x, y = of_a[k], of_b[shards - 1 - k]
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            parts.append((a[k] + b[shards - 1 - k], x))
        parts.sort(key=lambda p: -p[0])
        values = [p[0] for p in parts]
        heapq.heappush(heap, (values[-1] - values[0], serial, values, [p[1] for p in parts]))
        serial += 1
    _, _, values, members = heap[0]
    placed = [[0] * shards for _ in sums]
    for k, pairs in enumerate(members):
        for i, part in pairs:
            placed[i][part] = k
    return values, placed


def difference_groups(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The same for single groups, each of which is one part with all of its bytes: (sums, part of each group)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [(-sizes[i], i, [sizes[i]], [[i]]) for i in order]  # empty parts are left out until they are needed
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        if len(a) + len(b) <= shards:
            parts = list(zip(a + b, of_a + of_b))
        else:
            a, of_a = a + [0] * (shards - len(a)), of_a + [[] for _ in range(shards - len(of_a))]
            b, of_b = b + [0] * (shards - len(b)), of_b + [[] for _ in range(shards - len(of_b))]
            parts = []
            for k in range(shards):
                x, y = of_a[k], of_b[shards - 1 - k]
                if len(x) < len(y):
                    x, y = y, x
                x.extend(y)
                parts.append((a[k] + b[shards - 1 - k], x))
        parts.sort(key=lambda p: -p[0])
        values = [p[0] for p in parts]
        low = values[-1] if len(values) == shards else 0
        heapq.heappush(heap, (low - values[0], serial, values, [p[1] for p in parts]))
        serial += 1
    _, _, values, members = heap[0]
    part = [0] * len(sizes)
    for k, inside in enumerate(members):
        for i in inside:
            part[i] = k
    return values + [0] * (shards - len(values)), part


def group_parts(groups: DataFrame, leaves: int, shards: int) -> DataFrame:
    """(leaf, kind, key, part, bytes): the part of each group (kind 0) and the sums of each leaf (kind 1)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey"], ascending=[False, True])
        sums, part = difference_groups(pdf["bytes"].tolist(), shards)
        leaf = int(pdf["leaf"].iloc[0])
        members = pd.DataFrame({"leaf": leaf, "kind": 0, "gkey": pdf["gkey"].tolist(), "part": part, "bytes": pdf["bytes"].tolist()})
        totals = pd.DataFrame({"leaf": leaf, "kind": 1, "gkey": None, "part": range(shards), "bytes": sums})
        return pd.concat([members, totals], ignore_index=True)

    dealt = groups.withColumn("leaf", F.pmod(F.xxhash64("gkey"), F.lit(leaves)).cast("int"))
    return dealt.groupBy("leaf").applyInPandas(solve, "leaf int, kind int, gkey binary, part int, bytes long")


def merge_level(level: DataFrame, fan_in: int, shards: int) -> DataFrame:
    """One level of the tree: (leaf, kind, child, child_part, part, bytes) like ``group_parts``, leaf being the parent."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = int(pdf["parent"].iloc[0])
        wide = pdf.pivot(index="leaf", columns="part", values="bytes").sort_index()
        sums, placed = differencing(wide.to_numpy().tolist(), shards)
        rows = [(parent, 0, int(leaf), k, placed[i][k], 0) for i, leaf in enumerate(wide.index) for k in range(shards)]
        rows += [(parent, 1, None, None, k, sums[k]) for k in range(shards)]
        return pd.DataFrame(rows, columns=["leaf", "kind", "child", "child_part", "part", "bytes"])

    dealt = level.withColumn("parent", (F.col("leaf") / F.lit(fan_in)).cast("int"))
    return dealt.groupBy("parent").applyInPandas(solve, "leaf int, kind int, child int, child_part int, part int, bytes long")


def assign(groups: DataFrame, shards: int, groups_per_leaf: int = GROUPS_PER_LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """(gkey, shard) for groups (gkey binary, bytes long)."""
    groups = staged(groups, "shard-groups")
    leaves = checked_partitions(groups.count(), groups_per_leaf)
    solved = staged(group_parts(groups, leaves, shards), "shard-leaves")
    placed = solved.where("kind = 0").select("gkey", "leaf", "part")
    level = solved.where("kind = 1").select("leaf", "part", "bytes")
    while leaves > 1:
        merged = staged(merge_level(level, fan_in, shards), "shard-level")
        down = merged.where("kind = 0").select(F.col("child").alias("leaf"), F.col("child_part").alias("part"), F.col("leaf").alias("up"), F.col("part").alias("up_part"))
        placed = placed.join(down, ["leaf", "part"]).select("gkey", F.col("up").alias("leaf"), F.col("up_part").alias("part"))
        level = merged.where("kind = 1").select("leaf", "part", "bytes")
        leaves = checked_partitions(leaves, fan_in)
    return placed.select("gkey", F.col("part").alias("shard"))


def numbered(rows: DataFrame, order: list[Column], per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each shard, without gaps."""
    shards = rows.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bins = checked_partitions(shards, per_bin)
    rows = rows.withColumn("__bin", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "__bin").orderBy(*order)) - 1
    rows = rows.withColumn("__inside", inside).join(offsets, ["shard", "__bin"])
    return rows.withColumn("slot", (F.col("__inside") + F.col("__before")).cast("long")).drop("__bin", "__inside", "__before")


def balanced_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", groups_per_leaf: int = GROUPS_PER_LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; equal texts share a shard."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")).alias("gkey"),
    )
    rows = staged(rows, "shard-rows")
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign(groups, shards, groups_per_leaf, fan_in), "gkey")
    placed = staged(placed, "shard-placed")
    return numbered(placed, [F.col("doc_id"), F.col("gkey")]).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes (doc_id, text, slot) as one folder per shard, for ids that are unique."""
    where = balanced_shards(docs, shards, doc_id, text).select("doc_id", "shard", "slot")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(where, "doc_id")
    rows.write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
