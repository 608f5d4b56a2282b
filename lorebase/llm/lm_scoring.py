"""Scores of documents under a unigram base model and a byte-level prediction-by-partial-matching (PPM) model.

Both learn from every document whose crc32(doc_id as text) modulo 5 is not 1 and score all whole texts.

PPM: a trie of byte contexts of up to `order` bytes (ORDER; 3 to 6) with the counts of what followed them, learned from
the learning documents. Bytes are A-Z lower-cased; all 256 are told apart. In a context the probability of a byte
follows method C: seen bytes share n / (n + d), and the escape gets d / (n + d), n the context's count and d its number
of distinct bytes. After an escape the next shorter context excludes the bytes that the longer ones have seen. The bytes
that no learning text holds share equally what is left below the empty context. Nothing is pruned.

The trie is kept as rows (gram, n), a gram being a context of `order` bytes and its next byte; shorter contexts are sums
of longer ones. They are counted over all documents (n is 0 for grams of held-out texts only), so they grow with the
corpus. Rows are dealt by the last three bytes of the context: all longer contexts of a gram are then in one task; the
counts of shorter ones are those of three bytes at most, 2^24 numbers at the very most and some ten thousand in natural
text, and are broadcast. Each row gets its log10 probability there. The most frequent grams, HEAD_GRAMS at most (equally
frequent ones together), go to the workers (16 bytes each); all others are joined to the documents' grams. A text's score is the sum over its bytes and starts from
a context of line ends; documents do not run into each other. Long texts are worked on in pieces.

Base: log10((c + 0.5) / (N + 0.5 (V + 1))) summed over the words and one end token. Words are told apart by 64-bit
hashes. The HEAD most frequent words go to the workers (12 bytes each); counts of all other words are joined to the
documents' words by hash, so what is gathered grows with the corpus and nothing unbounded is broadcast. Each task
counts its words before it shuffles them.

Cases: a null text is empty: one end token, score 0. Rows with equal or null doc_id are scored one by one (a null
doc_id belongs to the learning part). With nothing to learn from, N = V = 0 and all bytes are equally likely. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, most_frequent, saved, slots
from ._text import CHUNK, LOWER, chunks, word_hashes

ORDER = 5
#: Bytes of grams by which rows are dealt: the last ones of the context. Grams of as many bytes are known to all tasks.
DEALT = 3
#: Rows of a bucket, about.
BUCKET = 500_000
#: Frequent grams whose probabilities are sent to the workers.
HEAD_GRAMS = 1 << 20
#: Frequent words whose counts are sent to the workers.
HEAD = 1 << 18
#: The end token's place among the words.
_END = np.uint64(0x656E645F6F665F74)


def _learning(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bucket = F.crc32(F.col(id_col).cast("string")) % 5
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(bucket == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))


def _grams(off: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """For each byte its `order` predecessors and itself as one number; a text is preceded by line ends."""
    s = LOWER[data].astype(np.int64)
    out = s.copy()
    for back in range(1, order + 1):
        p = np.full(len(s), 10, np.int64)
        p[back:] = s[:-back] if len(s) > back else p[back:]
        for k in range(back):  # the first bytes of each text
            at = off[:-1] + k
            p[at[at < off[1:]]] = 10
        out += p << (8 * back)
    return out


def _gram_runs(off: np.ndarray, data: np.ndarray, order: int):
    """(row offsets, grams) of the texts of one chunk at once, or of a long text in pieces."""
    if len(off) != 2 or len(data) <= CHUNK:
        yield off, _grams(off, data, order)
        return
    for p in range(0, len(data), CHUNK):
        before = min(p, order)
        part = data[p - before : p + CHUNK]
        g = _grams(np.array([0, len(part)]), part, order)[before:]
        yield np.array([0, len(g)]), g


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of n of each."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(gram, n): the distinct grams of (held_out, text), n times in texts that are not held out."""

    def run(batches):
        held, size = [], 0

        def flush():
            g, n = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held[:] = [(g, n)]
            return len(g)

        def out():
            g, n = held.pop()
            for a in range(0, len(g), 100_000):
                yield pa.record_batch([pa.array(g[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["gram", "n"])

        for batch in batches:
            away = batch.column(0).to_numpy(zero_copy_only=False)
            for a, off, data in chunks(batch.column(1)):
                for own, g in _gram_runs(off, data, order):
                    apart = np.repeat(away[a : a + len(own) - 1].astype(bool), np.diff(own))
                    u, n = np.unique(g[~apart], return_counts=True)
                    held.append((u, n.astype(np.int64)))
                    u = np.unique(g[apart])
                    held.append((u, np.zeros(len(u), np.int64)))
                    size += len(held[-1][0]) + len(held[-2][0])
                    if size > 4_000_000:
                        size = flush()
                        if size > 2_000_000:
                            yield from out()
                            size = 0
        if held:
            flush()
            yield from out()

    return rows.select("held_out", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def context(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted grams, their counts and their numbers of distinct bytes."""
    c, total = _sums(keys >> 8, times)
    return c, total, _sums(keys >> 8, np.ones(len(keys), np.int64))[1]


def shorter(known: tuple[np.ndarray, np.ndarray], dealt: int = DEALT) -> dict:
    """(grams, counts, context()) by context length below dealt, of the sorted grams of dealt bytes and their counts."""
    out = {}
    for j in range(dealt - 1, -1, -1):
        keys, times = known if j == dealt - 1 else _sums(out[j + 1][0] & np.int64((1 << (8 * (j + 1))) - 1), out[j + 1][1])
        out[j] = keys, times, context(keys, times)
    return out


def ppm_logs(gram: np.ndarray, n: np.ndarray, known: dict, order: int, dealt: int = DEALT) -> np.ndarray:
    """log10 probability of the last byte of each gram.

    gram has all grams whose contexts end in the same `dealt` bytes as any of them; known: shorter() of the whole corpus.
    """
    mask = lambda size: np.int64((1 << (8 * size)) - 1)
    found = n > 0
    own = {j: _sums(gram[found] & mask(j + 1), n[found]) for j in range(dealt, order + 1)}
    held = own | {j: x[:2] for j, x in known.items()}
    contexts = {j: context(*x) for j, x in own.items()} | {j: x[2] for j, x in known.items()}
    mass, out, open_ = np.zeros(len(gram)), np.zeros(len(gram)), np.ones(len(gram), bool)
    for j in range(order, -1, -1):
        keys, times = held[j]
        c, total, kinds = contexts[j]
        at, hit = _find(c, (gram >> 8) & mask(j))
        left, distinct = (np.where(hit, x[at], 0) if len(c) else np.zeros(len(gram), np.int64) for x in (total, kinds))
        fresh = distinct
        if j < order and len(held[j + 1][0]):  # what the longer context has seen is excluded
            longer, _, others = contexts[j + 1]
            gone = _sums(held[j + 1][0] >> 8, times[_find(keys, held[j + 1][0] & mask(j + 1))[0]])[1]
            up, hit = _find(longer, (gram >> 8) & mask(j + 1))
            left, fresh = left - np.where(hit, gone[up], 0), fresh - np.where(hit, others[up], 0)
        escape = np.where(distinct < 256, fresh, 0)  # otherwise nothing is left to escape to
        at, hit = _find(keys, gram & mask(j + 1))
        live = open_ & (left > 0)
        own, away = live & hit, live & ~hit
        if own.any():
            out[own] = mass[own] + np.log10(times[at[own]] / (left[own] + escape[own]))
        mass[away] += np.log10(escape[away] / (left[away] + escape[away]))
        open_ &= ~own
    out[open_] = mass[open_] - np.log10(max(1, 256 - len(held[0][0])))
    return out


def gram_logs(counts: DataFrame, order: int) -> DataFrame:
    """(gram, n, log) of every row of count_grams()."""
    spark = counts.sparkSession
    last = lambda c, size: c.bitwiseAND((1 << (8 * size)) - 1)
    short = counts.where("n > 0").groupBy(last(F.col("gram"), DEALT).alias("short")).agg(F.sum("n").alias("n")).toArrow().sort_by("short")  # 2^24 rows at most
    sent = spark.sparkContext.broadcast((short.column("short").to_numpy(), short.column("n").to_numpy()))
    buckets = max(64, 2 * slots(spark), counts.count() // BUCKET)
    memo: dict = {}  # of each task

    def run(table):
        if not memo:
            memo.update(shorter(sent.value))
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        return pa.table({"gram": gram, "n": n, "log": ppm_logs(gram, n, memo, order)})

    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64(last(F.shiftright("gram", 8), DEALT)), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "gram long, n long, log double")


def count_words(learning: DataFrame) -> DataFrame:
    """(word, n): hashes of the words of all learning texts and how often they occur, and the end token."""

    def run(batches):
        held, size, ends = [], 0, 0

        def flush():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            ends += batch.num_rows
            for _, off, data in chunks(batch.column(0)):
                held.append(word_hashes(off, data)[0])
                size += len(held[-1])
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        if ends:
            yield pa.record_batch([pa.array(np.array([_END]).view(np.int64)), pa.array([ends], pa.int64())], names=["word", "n"])

    return learning.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, order: int = ORDER, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    if not DEALT <= order <= 6:
        raise ValueError(f"order must be from {DEALT} to 6")
    spark = docs.sparkSession
    rows = _learning(docs, id_col, text_col)
    learning = rows.where("not held_out").select("text")
    logged = saved(gram_logs(saved(count_grams(rows, order), "grams"), order), "logs")
    often = most_frequent(logged, head_grams).select("gram", "log").toArrow().sort_by("gram")  # bounded by `head_grams`
    words = saved(count_words(learning), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(words, head).toArrow()  # bounded by `head`
    known, times = top.column("word").to_numpy(), top.column("n").to_numpy()
    place = np.argsort(known)
    base = total + 0.5 * (kinds + 1)
    model = spark.sparkContext.broadcast((often.column("gram").to_numpy(), often.column("log").to_numpy(), known[place], times[place], base, len(known) < kinds))

    def run(batches):
        grams, weights, known, times, base, more = model.value
        logs = np.log10((times + 0.5) / base)
        zero = float(np.log10(0.5 / base))
        for batch in batches:
            for a, off, data in chunks(batch.column(2)):
                n = len(off) - 1
                points, late, late_ends = np.zeros(n), [], np.zeros(n + 1, np.int64)
                for own, g in _gram_runs(off, data, order):
                    u, of = np.unique(g, return_inverse=True)
                    at, hit = _find(grams, u)
                    sums = np.concatenate(([0.0], np.cumsum(np.where(hit, weights[at], 0.0)[of] if len(grams) else np.zeros(len(of)))))
                    points += sums[own[1:]] - sums[own[:-1]]
                    beyond = np.flatnonzero(~hit[of])  # grams beyond the head: their probabilities are joined
                    late.append(u[of[beyond]])
                    late_ends += np.searchsorted(beyond, own)  # pieces are those of one row
                late_lists = pa.ListArray.from_arrays(pa.array(late_ends.astype(np.int32)), pa.array(np.concatenate(late)))
                hashes, first = word_hashes(off, data)
                ends = np.append(first[1:], 0)[:n]
                w = np.insert(hashes, ends, _END).view(np.int64)  # each text's end token after its words
                doc = np.repeat(np.arange(n), np.diff(first) + 1)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                hit = known[at] == w if len(known) else np.zeros(len(w), bool)
                gain = np.full(len(w), 0.0 if more else zero)
                gain[hit] = logs[at[hit]]
                tokens, seen = np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n)
                sums = np.bincount(doc, weights=gain, minlength=n)
                asked: list = [[] for _ in range(n)]
                if more:  # words beyond the head: their counts are joined
                    rest = np.flatnonzero(~hit)
                    cuts = np.searchsorted(doc[rest], np.arange(n + 1))
                    asked = [w[rest[cuts[i] : cuts[i + 1]]] for i in range(n)]
                part = batch.slice(a, n)
                flat = np.concatenate(asked) if more else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in asked]))).astype(np.int32)), pa.array(flat))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(tokens), pa.array(seen), pa.array(sums), pa.array(points), lists, late_lists],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "asked", "late"],
                )

    found = rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, asked array<long>, late array<long>")
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "scores")
    zero = float(np.log10(0.5 / base))
    asked = found.select("row", F.explode("asked").alias("word"))
    counted = asked.join(words, "word", "left").select("row", F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("hit"), F.when(F.col("n").isNotNull(), F.log10((F.col("n") + 0.5) / base)).otherwise(zero).alias("gain"))
    added = counted.groupBy("row").agg(F.sum("hit").alias("hit"), F.sum("gain").alias("gain"))
    late = found.select("row", F.explode("late").alias("gram")).join(logged.select("gram", "log"), "gram").groupBy("row").agg(F.sum("log").alias("late_gain"))
    return found.join(added, "row", "left").join(late, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("hit", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("late_gain", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document of documents."""
    return score(load(spark, sf_dir, "documents"))
