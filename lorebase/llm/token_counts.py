"""Token counts by document from flat token files that hold nothing but ids and end-of-document ids.

Writing: each partition of documents becomes one stream of ids, every document followed by the separator, cut into
blocks of a fixed number of ids wherever that falls. A ledger holds the documents' ids in the order of the stream.

Counting: the separator scan. Each block is searched for separators with one vectorised comparison and gives the
number of separators, the ids before the first, between them, and after the last. Documents that cross blocks are
stitched by a prefix scan over the blocks of a stream: the separators before a block number its documents, and the ids
after the last separator of earlier blocks are carried into its first one. Only these small rows are shuffled.

Ids take two bytes if the vocabulary and the separator let them, else four. Texts are ordinary text: the string of a
special token in them is encoded like any other, so the separator is never found inside a document.

Cases: a null text is empty and counts 0. Rows with repeated or null doc_id are counted one by one. Documents longer
than a block, and blocks without a separator, are stitched over any number of blocks. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import load, scratch
from ._tokens import encoder

SEPARATOR = 50256
#: Ids in a block.
BLOCK = 1 << 18


def id_type(separator: int, vocabulary: str | None = None) -> np.dtype:
    """The type of the files' ids, wide enough for all of them; a separator that ordinary text can have is refused."""
    ids = encoder(vocabulary)
    if separator in ids.ordinary or not 0 <= separator < 1 << 32:
        raise ValueError(f"{separator} cannot separate documents: it is an id of ordinary text or no 32-bit id")
    return np.dtype("<u2" if max(ids.size - 1, separator) < 1 << 16 else "<u4")


def write_stream(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, block: int = BLOCK, vocabulary: str | None = None) -> None:
    """The token files of docs below path: kind=tokens (stream, part, tokens) and kind=ledger (stream, part, ids)."""
    kind = id_type(separator, vocabulary)

    def run(batches):
        encode = encoder(vocabulary)
        stream, part, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([separator], kind).tobytes()
        step = block * kind.itemsize
        held = bytearray()

        def row(of, part, tokens, ids):
            return pa.record_batch([pa.array([of]), pa.array([stream], pa.int64()), pa.array([part], pa.int64()), pa.array([tokens], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["kind", "stream", "part", "tokens", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                held += np.frombuffer(encode(text.as_py() or ""), "<u4").astype(kind).tobytes() + end
                while len(held) >= step:
                    yield row("tokens", part, bytes(held[:step]), None)
                    del held[:step]
                    part += 1
            if ids:
                yield row("ledger", first, None, ids)
            first += len(ids)
        if held:
            yield row("tokens", part, bytes(held), None)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "kind string, stream long, part long, tokens binary, ids array<long>")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)


def count_stream(tokens: DataFrame, separator: int = SEPARATOR, vocabulary: str | None = None) -> DataFrame:
    """(stream, ordinal, n_tokens) of every document of blocks (stream, part, tokens)."""
    kind = id_type(separator, vocabulary)

    def scan(batches):
        for batch in batches:
            out = []
            for stream, part, blob in zip(*(batch.column(c).to_pylist() for c in ("stream", "part", "tokens")), strict=True):
                ids = np.frombuffer(blob, kind)
                at = np.flatnonzero(ids == separator)
                out.append((stream, part, len(at), len(ids) - 1 - int(at[-1]) if len(at) else len(ids), (np.diff(at, prepend=-1) - 1).tolist()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["stream", "part", "n", "tail", "sizes"]) if out else pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))], names=["stream", "part", "n", "tail", "sizes"])

    blocks = tokens.select("stream", "part", "tokens").mapInArrow(scan, "stream long, part long, n long, tail long, sizes array<long>")
    before = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "tails": F.coalesce(F.sum("tail").over(before), F.lit(0))})
    # the tails up to the last block with a separator do not reach this one
    settled = F.coalesce(F.last(F.when(F.col("n") > 0, F.col("tails")), ignorenulls=True).over(before), F.lit(0))
    blocks = blocks.withColumn("carry", F.col("tails") - settled).where("n > 0")
    return blocks.select("stream", "first", "carry", F.posexplode("sizes").alias("i", "size")).select("stream", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("size") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, block: int = BLOCK, vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_tokens) of every document, without its separator, by way of token files in the shared folder."""
    spark = docs.sparkSession
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    write_stream(docs, path, id_col, text_col, separator, block, vocabulary)
    files = spark.read.schema("stream long, part long, tokens binary, ids array<long>, kind string").option("basePath", path).parquet(path)
    counted = count_stream(files.where("kind = 'tokens'"), separator, vocabulary)
    ledger = files.where("kind = 'ledger'").select("stream", "part", F.posexplode("ids").alias("i", "doc")).select("stream", (F.col("part") + F.col("i")).alias("ordinal"), F.col("doc").alias(id_col))
    return ledger.join(counted, ["stream", "ordinal"]).select(id_col, "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document of documents."""
    return token_counts(load(spark, sf_dir, "documents"))
