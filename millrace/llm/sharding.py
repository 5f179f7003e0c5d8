"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic. They are ordered by a 64-bit hash of the
text, and the ordered sizes are cut into contiguous shards so that the largest
shard is as small as any contiguous cut allows: a binary search over the
capacity, each try checked greedily, then cuts at the smallest feasible one.

No task and no driver array ever holds all groups. The driver sees sums over
2**14 hash ranges, solves the cut with a bound from each side (ranges taken as
divisible, ranges taken as atomic), and asks for finer sums only of the ranges
in which a cut can lie, until these are single groups. Groups and the result
are written by as many tasks as the rows need, not fewer than cores: many small
files cost more than their rows.

Defined results: a null text has size 1 and is in the group of the empty text;
repeated rows each get a slot of their own, in order of id and text's hash; of
groups with equal sizes the one with the smaller hash comes first; a text of
any length is one group, of which only size and hashes are kept; an empty table
gives no rows; other columns are ignored. A group larger than an equal share
takes a shard alone and the rest is cut among the other shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import ROWS_A_TASK
from millrace.storage import materialize

FIRST_BITS, MORE_BITS = 14, 8
ROWS_A_BLOCK = 50_000
_TOP = -(2**63)


def _walk(sizes, atomic, prefix, capacity: int, shards: int, fluid: bool):
    """Greedy cuts: (ranges cut in or before, whether all sizes were placed)."""
    cuts, at, n = [], 0, len(sizes)
    for _ in range(shards):
        end = at + capacity
        if end >= prefix[n]:
            return cuts, True
        k = int(np.searchsorted(prefix, end, side="right")) - 1
        cuts.append(k)
        new = end if fluid and not atomic[k] else int(prefix[k])
        at = new if new > at else (end if not atomic[k] else at)
    return cuts, False


def _feasible(sizes, atomic, prefix, capacity: int, shards: int, fluid: bool) -> bool:
    if not fluid and len(sizes) and capacity < int(sizes.max()):
        return False
    if fluid and atomic.any() and capacity < int(sizes[atomic].max()):
        return False
    return _walk(sizes, atomic, prefix, capacity, shards, fluid)[1]


def _smallest(sizes, atomic, prefix, shards: int, fluid: bool, lo: int = 1) -> int:
    hi = max(1, int(prefix[-1]))
    while lo < hi:
        mid = (lo + hi) // 2
        if _feasible(sizes, atomic, prefix, mid, shards, fluid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity over contiguous cuts of ``sizes``, and where each next shard starts."""
    sizes = np.asarray(sizes, dtype=np.int64)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    atomic = np.ones(len(sizes), dtype=bool)
    capacity = _smallest(sizes, atomic, prefix, shards, False)
    return capacity, _walk(sizes, atomic, prefix, capacity, shards, False)[0]


def _range_of(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits) if bits < 64 else F.col("key")


def find_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the unsigned keys at which shards 1, 2, ... start. groups: key, bytes."""

    def sums(df: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
        rows = df.groupBy(_range_of(bits).alias("r")).agg(F.sum("bytes"), F.count(F.lit(1)))
        return sorted(((int(r) % 2**bits) << (64 - bits), bits, int(b), n == 1 or bits == 64) for r, b, n in rows.collect())

    parts = sums(groups, FIRST_BITS)
    while True:
        sizes = np.array([p[2] for p in parts], dtype=np.int64)
        atomic = np.array([p[3] for p in parts], dtype=bool)
        prefix = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        low = _smallest(sizes, atomic, prefix, shards, True)
        high = _smallest(sizes, atomic, prefix, shards, False, low)
        first, _ = _walk(sizes, atomic, prefix, low, shards, False)
        last, _ = _walk(sizes, atomic, prefix, high, shards, True)
        first += [len(parts) - 1] * (len(last) - len(first))
        last += [len(parts) - 1] * (len(first) - len(last))
        open_ = sorted({k for a, b in zip(first, last) for k in range(min(a, b), max(a, b) + 1) if not atomic[k]})
        if not open_:
            capacity = low
            cuts, _ = _walk(sizes, atomic, prefix, capacity, shards, False)
            return capacity, [parts[k][0] for k in cuts]
        finer = [p for k, p in enumerate(parts) if k not in set(open_)]
        for bits in sorted({parts[k][1] for k in open_}):
            wanted = [parts[k][0] >> (64 - bits) for k in open_ if parts[k][1] == bits]
            signed = [w - 2**64 if bits == 64 and w >= 2**63 else w for w in wanted]
            finer += sums(groups.where(_range_of(bits).isin(signed)), min(64, bits + MORE_BITS))
        parts = sorted(finer)


def number_rows(df: DataFrame, group: str, by: list[Column], rows: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, without bringing a group's rows together.

    Rows are dealt to blocks by a hash of ``by``; counts of blocks give each
    block its first number, and rows are numbered inside their block.
    """
    blocks = max(64, rows // ROWS_A_BLOCK)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(group, "_block").orderBy(*by)
    numbered = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        numbered.join(first, [group, "_block"])
        .withColumn(out, (F.col("_first") + F.col("_in")).cast("long"))
        .drop("_block", "_first", "_in")
    )


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, key, shard, slot."""
    text = F.col(text_col)
    bytes_ = F.coalesce(text.cast("binary"), F.lit(b""))
    slim = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        ),
        "shard-rows",
    )
    rows = slim.count()
    tasks = max(slim.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    groups = materialize(slim.groupBy("key").agg(F.sum("size").alias("bytes")).coalesce(tasks), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    alone, left = [], int(total)
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect():
        if shards - len(alone) > 1 and size * (shards - len(alone)) > left:
            alone.append(key)
            left -= size
        else:
            break
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    _, cuts = find_cuts(rest, shards - len(alone)) if rows else (0, [])
    ordered = F.col("key").bitwiseXOR(F.lit(_TOP))
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (ordered >= F.lit(cut + _TOP)).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), F.lit(k)).otherwise(shard)
    placed = slim.withColumn("shard", shard.cast("int"))
    return number_rows(placed, "shard", [F.col("doc_id"), F.col("key")], rows, "slot").coalesce(tasks)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
