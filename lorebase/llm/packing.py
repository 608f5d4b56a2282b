"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed size.

A document is its token ids and one end id. Only documents longer than a sequence are cut, into pieces of a whole
sequence; the first piece is what is left over and may be shorter. Pieces are packed in order of falling length, each
into the open sequence with the least room that it fits in, found in a segment tree over the rooms.

Scale: the order of pieces of one length doesn't matter, and there are no more lengths and rooms than tokens in a
sequence. So best fit runs on the histogram of lengths, over all documents at once, and moves whole intervals of
sequences with one and the same room: a segment says "pieces number lo to hi of this length go, `each` to a sequence,
to the sequences from `bin` on, at `offset`". The histogram and the segments do not grow with the number of documents.
Pieces get their number within their length from counts by (length, bucket), so no length is gathered in one task;
equal rows are counted first and dealt out last.

Ids are those of a plain call of the vocabulary file's tokenizer without adding special tokens: the string of a special
token in a text stands for its id.

Cases: a null text is empty and makes a piece of the end id alone. Repeated rows are packed once each. Rows with null
doc_id are kept. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import lean, load, saved
from ._tokens import encoder

SIZE = 2048
END = 0
#: Pieces of one length that one bucket numbers, about.
BUCKET = 50_000


class Rooms:
    """Which rooms 0..size have open sequences: a segment tree that finds the least one of `need` or more."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, present: bool) -> None:
        i = room + self.leaves
        self.any[i] = present
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def best_fit(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, lo, hi, bin, each, offset) and the number of sequences, for counts of pieces by length."""
    rooms, open_ = Rooms(size), defaultdict(list)  # room: intervals (first sequence, how many)
    out, bins = [], 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if not open_[room]:
                rooms.set(room, True)
            open_[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        lo, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, many = size, bins, -(-left // (size // length))
                bins += many
            else:
                first, many = open_[room].pop()
                if not open_[room]:
                    rooms.set(room, False)
            # a sequence that has taken one piece is now the tightest, until it is full for this length
            each = room // length
            full = min(many, left // each)
            if full:
                out.append((length, lo, lo + full * each, first, each, size - room))
                put(room - each * length, first, full)
                lo, left = lo + full * each, left - full * each
            if left and full < many:  # fewer pieces are left than one sequence takes
                out.append((length, lo, lo + left, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, many - full)
    return out, bins


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, end: int, vocabulary: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches):
        encode = encoder(vocabulary, special=True)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + stop)
                total = len(ids) // 4
                start, length, k = 0, total % size or size, 0
                while start < total:
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length, k = start + length, size, k + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run, "ids"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, id_col, text_col, size, end, vocabulary), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    segments, _ = best_fit(histogram, size)
    buckets = max(64, sum(histogram.values()) // BUCKET)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = cut.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("inside", F.sum("copies").over(inside) - F.col("copies")).join(before, ["length", "bucket"])
    numbered = numbered.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("before") + F.col("inside")).alias("first")).select(*columns, (F.col("first") + F.col("copy")).alias("number"))
    # segments of one length as one array, ordered by lo: a few thousand in all, by the number of lengths and rooms
    plan: dict[int, list] = defaultdict(list)
    for length, lo, hi, first, each, offset in segments:
        plan[length].append((lo, hi, first, each, offset))
    table = spark.createDataFrame([(k, v) for k, v in sorted(plan.items())], "length long, segments array<struct<lo:long,hi:long,bin:long,each:long,at:long>>")
    found = numbered.join(F.broadcast(table), "length").select(
        *columns, "number", F.element_at(F.filter("segments", lambda s: (s["lo"] <= F.col("number")) & (F.col("number") < s["hi"])), 1).alias("s")
    )
    i = F.col("number") - F.col("s.lo")
    return found.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("s.bin") + F.floor(i / F.col("s.each"))).cast("long").alias("sequence_id"), (F.col("s.at") + F.pmod(i, F.col("s.each")) * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document of documents into sequences of 2048 tokens."""
    return pack(load(spark, sf_dir, "documents"))
