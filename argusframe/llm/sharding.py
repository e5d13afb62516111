"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly. Tokens are runs of characters other than white space, in any script.

Rows with equal texts form a group, and a group goes to the shard where the dot product of its vector (bytes,
tokens, rows, each as a share of a shard's capacity) with the room left is highest; large groups come first. Groups are dealt
by hash over chunks of about ``chunk_groups`` and each chunk is packed on its own against its share of the
capacity, so chunks balance in parallel and their small errors, with the shards in another order in each chunk,
don't add up. A group larger than a sixteenth of a shard's share of a chunk is first split by doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusframe.llm.common import shuffle_width, store

#: Bytes, tokens, rows: the law is on bytes, so their room counts most.
WEIGHTS = (4.0, 1.0, 1.0)
TOKEN = r"[^\x20\x09-\x0D]+"
KEY = ["h", "text_crc32", "size"]


def pack_vectors(vectors: np.ndarray, shards: int, turn: int) -> np.ndarray:
    """Shard of each row of ``vectors``, which are packed together; ``turn`` shifts which shard wins a tie."""
    capacity = np.maximum(vectors.sum(0) / shards, 1e-9)
    share = vectors / capacity
    weighted = share * np.array(WEIGHTS)
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(1))):
        best = int(np.argmax(room @ weighted[i]))
        room[best] -= share[i]
        out[i] = (best + turn) % shards
    return out


def vector_sharding(docs: DataFrame, shards: int = 16, chunk_groups: int = 2000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``size`` is the UTF-8 length plus 1; a null text counts as an empty one. Repeated rows are placed each. ``slot``
    counts from 0 without gaps in each shard, in no stated order. An empty table gives an empty result; only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (size + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
                             F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens")), "rows")
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    total = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    chunks = max(1, math.ceil((total.groups or 0) / chunk_groups))
    most = 16 * shards * chunks
    parts = F.ceil(F.greatest(F.col("n") * most / (total.rows or 1), F.col("n") * F.col("size") * most / (total.bytes or 1)))
    large = groups.withColumn("parts", F.least(parts, "n")).filter("parts > 1").select(*KEY, "parts")
    dealt = rows.join(large, KEY, "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))).drop("parts")

    items = dealt.groupBy(*KEY, "part").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    items = items.withColumn("chunk", F.pmod(F.xxhash64("h", "size", "part"), F.lit(chunks)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*KEY, "part"])
        vectors = np.stack([frame["rows"] * frame["size"], frame["tokens"], frame["rows"]], 1).astype(float)
        frame["shard"] = pack_vectors(vectors, shards, int(frame["chunk"].iloc[0]) % shards)
        return frame[[*KEY, "part", "shard"]]

    placed = items.groupBy("chunk").applyInPandas(pack, "h bigint, text_crc32 bigint, size bigint, part bigint, shard int")
    out = store(dealt.join(placed, [*KEY, "part"]).select("doc_id", "size", "text_crc32", "shard"), "placed")

    buckets = 2 * shuffle_width(spark)
    keyed = out.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    heads = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("head", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    slot = (F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id")) - 1).cast("long")
    return keyed.withColumn("slot", slot).join(heads, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
