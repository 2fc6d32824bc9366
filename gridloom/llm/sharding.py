"""Sharding of documents by near equal bytes, with groups that stay whole, by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Groups of at least ``1 / (shards * GRAIN)`` of all bytes are items of their own,
so there are at most shards * GRAIN of them; the others are gathered by a hash of their text into as many bins. The
differencing sees these items only, 2 * shards * GRAIN at most however large the corpus; its result is a broadcast map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import stored

#: Items for each shard that the differencing sees of large groups, and of bins of small ones, at most.
GRAIN = 256
#: Parts of a shard that are numbered side by side.
SLOT_PARTS = 64


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item. Each item starts as a partition of its own (one full part, the rest empty).

    The two partitions of largest spread (fullest less emptiest part) are combined, the fullest part of the one with
    the emptiest of the other, and so on, until one partition is left. Equal spreads are taken in order of the items.
    """
    if not sizes:
        return []
    # A part is (size, tree of items); trees are joined in constant time and read out at the end.
    heap = [(-size, n, [(size, n)] + [(0, None)] * (k - 1)) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [(a + b, s if t is None else t if s is None else (s, t)) for (a, s), (b, t) in zip(one, reversed(two), strict=True)]
        parts.sort(key=lambda part: -part[0])
        least = parts[-1][0]
        heapq.heappush(heap, (least - parts[0][0], number, parts))
        number += 1
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        trees = [tree]
        while trees:
            top = trees.pop()
            if isinstance(top, tuple):
                trees += top
            elif top is not None:
                out[top] = part
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per document: (id_col, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the text's UTF-8 bytes and ``overhead``; shards hold near equal sums of it, as near as whole groups
    allow: a group of equal texts larger than a shard's share has a shard to itself or nearly so. ``slot`` numbers a
    shard's documents from 0 without gaps. ``grown_shard`` is null, as the law is not by key.

    A null text has no bytes and crc32 0; null texts are one group, apart from empty ones. Null and repeated ids are
    rows like any other; rows that agree in all that is read differ in their slot only. Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    light = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("-")).alias("digest"),
    )
    light = stored(light.withColumn("bin", F.pmod(F.xxhash64("digest"), F.lit(shards * GRAIN)).cast("int")), "sizes")
    total = light.agg(F.sum("size")).first()[0] or 0
    groups = light.groupBy("digest", "bin").agg(F.sum("size").alias("size"))
    large = F.col("size") * shards * GRAIN >= total
    items = groups.groupBy(F.when(large, F.col("digest")).alias("digest"), F.when(~large, F.col("bin")).alias("bin")).agg(F.sum("size").alias("size"))
    # At most 2 * shards * GRAIN rows, whatever the input.
    found = sorted(items.collect(), key=lambda r: (-r["size"], r["digest"] or "", r["bin"] or 0))
    placed = [(r["digest"], r["bin"], p) for r, p in zip(found, karmarkar_karp([r["size"] for r in found], shards), strict=True)]
    kind = T.StructType([T.StructField("digest", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    spark = docs.sparkSession
    whole = spark.createDataFrame([p for p in placed if p[0] is not None], kind).select("digest", F.col("shard").alias("own_shard"))
    binned = spark.createDataFrame([p for p in placed if p[0] is None], kind).select("bin", F.col("shard").alias("bin_shard"))
    put = light.join(F.broadcast(whole), "digest", "left").join(F.broadcast(binned), "bin", "left")
    put = put.select("id", "size", "crc", F.coalesce("own_shard", "bin_shard").alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(SLOT_PARTS)).alias("part"))
    counted = put.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards * SLOT_PARTS rows at most
    before = counted.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size"))
    return put.withColumn("rank", rank).join(F.broadcast(before), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
