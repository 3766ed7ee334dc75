"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points (virtual nodes) on a ring of hash values; a key belongs to the first point clockwise of
its hash.  A shard takes keys of its own arcs, in ring order, until its capacity of (1 + slack) times the mean is
full; what is left of an arc goes on clockwise to the next points whose shards have room.  Which bytes of an arc go
where is settled on arc totals alone (a fixed number of arcs); the keys then find their place by their running size
within the arc, so no shard's keys are ever gathered.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import mix64, written

VNODES = 256
SLACK = 0.0005
HOT_ROWS = 1000


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring positions and the shard of each."""
    shard, k = np.divmod(np.arange(shards * vnodes), vnodes)
    at = mix64(mix64(shard.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + k.astype(np.uint64))
    order = np.lexsort((shard, at))
    return at[order], shard[order]


def settle(loads: np.ndarray, owner: np.ndarray, shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which part of each arc's load each shard takes.

    First every shard takes from its own arcs, clockwise, what it has room for; then each remainder goes on clockwise
    to the shards of the points that follow.
    """
    room = np.full(shards, (1 + slack) * loads.sum() / shards)
    parts, rest = [], []
    for arc in np.flatnonzero(loads):
        took = int(min(loads[arc], max(0, room[owner[arc]] // 1)))
        room[owner[arc]] -= took
        if took:
            parts.append((int(arc), 0, took, int(owner[arc])))
        if took < loads[arc]:
            rest.append((int(arc), took))
    n = len(owner)
    points = [np.flatnonzero(owner == s).tolist() for s in range(shards)]
    for arc, at in rest:
        while at < loads[arc]:
            free = [s for s in range(shards) if room[s] >= 1]
            if not free:  # rounding has used the last byte of room
                parts.append((arc, at, int(loads[arc]), int(room.argmax())))
                break

            def ahead(s, arc=arc):
                i = bisect.bisect_right(points[s], arc)
                return (points[s][i] if i < len(points[s]) else points[s][0] + n) - arc

            shard = min(free, key=ahead)
            took = int(min(loads[arc] - at, room[shard] // 1))
            parts.append((arc, at, at + took, shard))
            room[shard] -= took
            at += took
    return sorted(parts)


def shard_documents(docs: DataFrame, *, shards: int = 40, slack: float = SLACK, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot): each row's shard, balanced in bytes, and its gapless place there.

    size: the text's UTF-8 bytes (null: none) plus `overhead`.  A key is the id and the text's hash, so a group of equal
    texts, which may hold a third of all rows, is spread over the ring: the law is on bytes, and no group is kept together.
    Equal rows follow one another; where more than HOT_ROWS are equal, each is a key of its own.  The few rows that lie
    across a cut (one a cut at most) go, the largest first, to the shard that holds least.  An empty table gives no row;
    other columns are not read.
    """
    spark = docs.sparkSession
    at, owner = ring_points(shards, vnodes)

    @F.pandas_udf(IntegerType())
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, h.to_numpy(np.int64).view(np.uint64)) % len(at), dtype="int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.when(F.col(text_col).isNotNull(), F.crc32(text.cast("binary"))).otherwise(F.crc32(F.lit("").cast("binary"))).alias("text_crc32"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so the numbers stay
    hot = written(rows.groupBy("hash").count().where(F.col("count") > HOT_ROWS).select("hash", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():  # the hash and number of equal rows: which is which changes nothing
        rows = rows.join(hot, "hash", "left").withColumn("hash", F.when(F.col("hot"), F.xxhash64("hash", "row")).otherwise(F.col("hash"))).drop("hot")
    rows = written(rows.drop("row").withColumn("arc", arc_of("hash")), "keys")
    loads = np.zeros(len(at), np.int64)
    for r in rows.groupBy("arc").agg(F.sum("size").alias("n")).collect():  # a row an arc at most
        loads[r["arc"]] = r["n"]
    parts = settle(loads, owner, shards, slack)
    by_arc: dict[int, list] = {}
    for arc, low, _, shard in parts:
        by_arc.setdefault(arc, []).append((low, shard))
    cuts = spark.createDataFrame([(a, [x[0] for x in v]) for a, v in by_arc.items()], "arc int, lows array<bigint>")
    order = Window.partitionBy("arc").orderBy("hash", id_col, "size", "text_crc32")
    after = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("after", after).join(F.broadcast(cuts), "arc")
    first = F.size(F.filter("lows", lambda x: x <= F.col("after") - F.col("size")))
    last = F.size(F.filter("lows", lambda x: x < F.col("after")))
    piece = F.when(first == last, first).otherwise(-first)  # a row across a cut is a piece of its own, of which a cut has one
    placed = placed.withColumn("piece", piece).drop("lows", "after")
    placed = written(placed.withColumn("nth", F.row_number().over(Window.partitionBy("arc", "piece").orderBy("hash", id_col, "size", "text_crc32"))), "placed")
    pieces = sorted(placed.groupBy("arc", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect())  # a row a cut arc
    held, homes = np.zeros(shards, np.int64), {}
    for r in pieces:
        if r["piece"] > 0:
            homes[r["arc"], r["piece"]] = by_arc[r["arc"]][r["piece"] - 1][1]
            held[homes[r["arc"], r["piece"]]] += r["size"]
    for r in sorted((r for r in pieces if r["piece"] <= 0), key=lambda r: (-r["size"], r["arc"], r["piece"])):
        homes[r["arc"], r["piece"]] = int(held.argmin())
        held[held.argmin()] += r["size"]
    base, before = [], [0] * shards
    for r in pieces:
        shard = homes[r["arc"], r["piece"]]
        base.append((r["arc"], r["piece"], shard, before[shard]))
        before[shard] += r["n"]
    starts = spark.createDataFrame(base, "arc int, piece int, shard int, first bigint")
    return placed.join(F.broadcast(starts), ["arc", "piece"]).select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))
