"""Sharding by consistent hashing with bounded loads, without Python on the executors.

Shards stand at many points (virtual nodes) of a hash ring. A document's key is its text, so equal texts (a group)
meet at one point; it goes to the shard that owns the next point clockwise. A shard takes no more than its bound, an
equal share of all bytes times 1 + SLACK; what does not fit continues clockwise to the next shard with room. So
balance is guaranteed, and a change moves little beyond what bounds force.

Law: ``bytes``. The ring is cut into CELLS cells of hashes. Bytes are summed by cell over all documents (partial sums)
and the walk round the ring is done on those sums, heaviest cells first and then in the order of the ring, a table
whose size is set by CELLS and not by the corpus. A cell that holds a large group is dealt, by a hash of doc_id and of
the number of the copy, into salted parts of at most a CELLS-th of all bytes or so, and the parts overflow one by one;
so a group stays in one shard unless the bound splits it.

Slots: documents are numbered from 0 in each shard by counts of (shard, bucket) and the order inside a bucket, so no
shard is gathered in one task. Rows that are equal in id, size and checksum are counted first and dealt out last.

Cases: a null text is empty and has size 1. Null and repeated doc_id are placed row by row. A document larger than a
bound goes to the shard with most room. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import load, saved

SHARDS = 8
CELLS = 4096
VIRTUAL = 64
SLACK = 0.002
#: Documents of a shard that one bucket numbers, about.
BUCKET = 50_000


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in ring order; points are 32-bit."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(virtual))


def walk(parts: list[tuple[int, int, int]], shards: int, cells: int = CELLS, virtual: int = VIRTUAL, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """Shard of each (cell, salt) of parts (cell, salt, bytes), with bounded loads."""
    nodes = ring(shards, virtual)
    order: list[list[int]] = []  # by node: shards in the order in which a clockwise walk meets them
    for i in range(len(nodes)):
        met = dict.fromkeys(s for _, s in nodes[i:] + nodes[:i])
        order.append(list(met))
    total = sum(b for *_, b in parts)
    bound = -(-total * (1 + slack) // shards)
    load_, out, start = [0] * shards, {}, {}
    at = 0
    for cell in range(cells):  # the first node at or after each cell's place
        while at < len(nodes) and nodes[at][0] < cell * (1 << 32) // cells:
            at += 1
        start[cell] = at % len(nodes)
    for cell, salt, size in sorted(parts, key=lambda p: (-p[2].bit_length(), p[0], p[1])):
        walk_ = order[start[cell]]
        shard = next((s for s in walk_ if load_[s] + size <= bound), None)
        if shard is None:
            shard = min(walk_, key=lambda s: load_[s])
        load_[shard] += size
        out[cell, salt] = shard
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS, virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = saved(rows.groupBy("id", "size", "crc", "cell").agg(F.count(F.lit(1)).alias("copies")), "rows")
    sums = rows.groupBy("cell").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n")).collect()  # `cells` rows at most
    total, count = sum(r.bytes for r in sums), sum(r.n for r in sums)
    share = max(1, total // cells)
    many = {r.cell: min(cells, -(-r.bytes // share)) for r in sums if r.bytes > 4 * share}
    # tables by cell as literals that are split once, when the plan is made
    salted = F.element_at(F.split(F.lit(",".join(str(many.get(c, 1)) for c in range(cells))), ","), F.col("cell") + 1).cast("int")
    copies = rows.select("id", "size", "crc", "cell", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    copies = copies.withColumn("salt", F.pmod(F.xxhash64("id", "copy"), salted).cast("int"))
    # cells with a large group: the parts' own sums; `cells` + one part for each share of the bytes, 2 * cells at most
    parts = [(r.cell, r.salt, r.bytes) for r in copies.groupBy("cell", "salt").agg(F.sum("size").alias("bytes")).collect()]
    placed = walk(parts, shards, cells, virtual, slack)
    table: dict[int, list[int]] = {}
    for (cell, salt), s in placed.items():
        own = table.setdefault(cell, [0] * many.get(cell, 1))
        own[salt] = s
    lookup = F.element_at(F.split(F.lit(";".join(",".join(map(str, table.get(c, []))) for c in range(cells))), ";"), F.col("cell") + 1)
    buckets = max(64, count // (shards * BUCKET))
    copies = copies.select(
        "id", "size", "crc", "copy", F.element_at(F.split(lookup, ","), F.col("salt") + 1).cast("int").alias("shard"),
        F.pmod(F.xxhash64("id", "crc", "copy"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    copies = saved(copies, "placed")
    counts = copies.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size", "copy"))
    return copies.withColumn("number", number).join(before, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of documents into shards 0 to 7."""
    return shard(load(spark, sf_dir, "documents"))
