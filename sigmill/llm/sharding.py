"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into CELLS cells. A row falls into the cell of its hashed key; each cell belongs to the next virtual
node clockwise. Rows are offered in ring order; a row whose shard is full goes on clockwise to the next virtual node of a
shard with room. Which rows overflow depends only on how many rows each cell has, so the walk is planned on CELLS counts
(a constant, whatever the input's size) and then applied to the rows by a join and a rank within each cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table

CELLS = 8192


def ring(shards: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; no two in one cell. A shard's nodes don't depend on the others' number, but where two would meet."""
    nodes = max(4, min(64, cells // (4 * shards)))
    if shards < 1 or shards * nodes > cells:
        raise ValueError(f"1 to {cells // 4} shards are possible")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest, turn = None, 0
            while digest is None or digest in taken:
                digest = int.from_bytes(hashlib.md5(f"{shard}/{node}/{turn}".encode()).digest()[:8], "big") % cells
                turn += 1
            taken[digest] = shard
    return sorted(taken.items())


def quotas(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard. Without slack they add up to all rows and differ by one at most."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, cells: int = CELLS) -> list[dict]:
    """For each cell the runs of its ranks: from_rank, to_rank (exclusive), shard, slot_base (slot of the first).

    At most one run per cell, and one more each time a shard fills up: no more than cells + shards.
    """
    nodes = ring(shards, cells)
    places = [c for c, _ in nodes]
    room = quotas(sum(counts.values()), shards, slack)
    used = [0] * shards
    runs = []
    for cell in sorted(counts):
        left, rank, at = counts[cell], 0, bisect_left(places, cell)
        while left:
            shard = nodes[at % len(nodes)][1]
            if take := min(left, room[shard] - used[shard]):
                runs.append({"cell": cell, "from_rank": rank, "to_rank": rank + take, "shard": shard, "slot_base": used[shard]})
                used[shard] += take
                rank += take
                left -= take
            at += 1
    return runs


def key_hash(*key: Column) -> Column:
    """A 62-bit hash of the key columns."""
    return F.shiftrightunsigned(F.xxhash64(*key), 2)


def assign(rows: DataFrame, key: list[str], order: list[str], shards: int, slack: float = 0.0, cells: int = CELLS) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 within each shard).

    key: columns that place a row on the ring. order: columns that settle ties of the hash; rows equal in all of them
    are interchangeable. Null keys are hashed like any value; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("_h", key_hash(*[F.col(c) for c in key])).withColumn("_cell", (F.col("_h") % F.lit(cells)).cast("int"))
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `cells` rows
    plan = literal_table(spark, walk(counts, shards, slack, cells), "cell int, from_rank bigint, to_rank bigint, shard int, slot_base bigint")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", *order)).cast("long") - 1)
    on = (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank"))
    joined = ranked.join(F.broadcast(plan), on)  # at most cells + shards rows
    return joined.withColumn("slot", F.col("slot_base") + F.col("_rank") - F.col("from_rank")).drop("_h", "_cell", "_rank", "cell", "from_rank", "to_rank", "slot_base")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents on `shards` shards whose numbers of rows differ by one at most (law `rows`).

    Size: UTF-8 bytes of the text plus 16; a null text has none and the crc32 of no bytes, 0. Repeated rows each get a
    slot of their own. Extra columns are ignored. Groups of equal texts are not kept together: a row's place comes from
    its doc_id alone, so the copies of a text are spread like any other rows, and a large group overfills no shard. Rows
    with a null doc_id are spread by their text. A grown ring moves about a tenth of the rows (with slack 0.1 about 7 %;
    one part in shards + 1 at best), as exact quotas leave no room for the overflow to stay where it is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_spread", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    out = assign(rows, ["doc_id", "_spread"], ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
