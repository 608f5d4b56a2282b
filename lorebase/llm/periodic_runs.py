"""Periodic runs of words in texts, by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(min_words, 3 q) that no neighbouring word extends keeping the period. For every period p the words at the grid
points jp and (j + 1)p are compared, some n / p of them, n log n for all periods. In a run of period p at least 2p words
in a row equal those p places on, so two neighbouring grid points pass and every word between them does; points are
probed for that first at jp, (j + 1)p and (j + 2)p (and on, if the period is short), then at seven places between. Survivors are extended to both sides
by comparing arrays chunk by chunk, each chunk twice as long as the last. Grid points within a run that was found are
skipped: those of the same period, and those of a multiple of its period whose step lies inside the run, since a stretch
of that period would be the run itself. Periods rise, so a stretch that comes again with a larger period is known.

Many texts are worked on at once: their words stand end to end, longest text first, with a place between two texts that
equals nothing. Periods up to about the root of the length are probed one by one, at all grid points at once; larger ones
are probed grid point by grid point, all periods at once. So the number of array operations grows with the root of the
longest text, and the probes with its length times the logarithm.

Words are the maximal runs of other characters than white space (0x20, 0x09-0x0D), compared by 64-bit hashes of their
bytes. Runs are found in one text alone, so a task needs nothing but its own texts; memory is some 60 bytes for each word
of BATCH bytes of text, or of the longest text. Nothing is shuffled and nothing goes to the driver.

Cases: a null or blank text has no words, no runs, and an empty collapsed text. Rows with equal or null ids are worked
on one by one. Of runs that overlap each is reported. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, words
from ._text import SAME, chunks, word_hashes

MIN_WORDS = 24
REPEATS = 3
#: Bytes of text whose words are probed at once (a longer text is probed alone).
BATCH = 1 << 20
#: Words of the first chunk of an extension, and of the longest.
_FIRST, _LONGEST = 32, 1 << 16


def _reach(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many words in a row from `at` on, forwards or backwards, equal those p places on."""
    out, size = 0, _FIRST
    while True:
        a, b = (at + out, min(at + out + size, len(w) - p)) if step > 0 else (max(0, at - out - size + 1), at - out + 1)
        if a >= b:
            return out
        same = w[a:b] == w[a + p : b + p]
        if not same.all():
            return out + int(np.argmin(same if step > 0 else same[::-1]))
        out += b - a
        size = min(2 * size, _LONGEST)


def _probes(w: np.ndarray, limit: np.ndarray, root: int, least: np.ndarray):
    """(period, grid places that pass the first probes), periods rising up to root and then all larger ones at once.

    limit: for each period the end of the texts that are long enough for it; least: how many words in a row equal those
    a period on in its shortest run.
    """
    for p in range(1, min(root, len(limit) - 1) + 1):
        g = w[: limit[p] : p]
        same = g[1:] == g[:-1]
        j = np.flatnonzero(same[1:] & same[:-1])
        for more in range(2, least[p] // p):  # a short period's run has more grid points than two
            j = j[: np.searchsorted(j, len(same) - more)]
            j = j[same[j + more]]
        if len(j):
            yield np.full(len(j), p), j * p
    if len(limit) - 1 <= root:
        return
    found = []
    period = np.arange(root + 1, len(limit))
    room = limit[period]
    j = 0
    while len(period):
        live = int(np.searchsorted((j + 2) * period - room, 0, "left"))  # rises with the period
        period, room = period[:live], room[:live]
        at = j * period
        mid = w[at + period]
        hit = np.flatnonzero((w[at] == mid) & (mid == w[at + 2 * period]))
        found.append((period[hit], at[hit]))
        j += 1
    p, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, p))
    yield p[order], at[order]


def runs(w: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in the words w; texts begin at `first` (with the end), longest first.

    The last word of each text is a place that equals no other.
    """
    size = np.diff(first) - 1
    longest = int(size[0]) // repeats if len(size) else 0
    # texts are sorted: those long enough for a period are a prefix
    enough = np.searchsorted(-size, -np.maximum(min_words, repeats * np.arange(longest + 1)), "right")
    limit = first[enough]
    out: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    end_of, period_of = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)  # of a run that covers a place
    least = np.maximum(min_words - np.arange(longest + 1), (repeats - 1) * np.arange(longest + 1))
    for p, at in _probes(w, limit, max(1, int(len(w) ** 0.5)), least):
        for eighth in (4, 1, 2, 3, 5, 6, 7):
            place = at + eighth * p // 8
            fine = w[place] == w[place + p]
            p, at = p[fine], at[fine]
        q = period_of[at]
        fine = (q == 0) | (p % np.maximum(1, q) != 0) | (at + p >= end_of[at])
        p, at = p[fine], at[fine]
        edges = np.flatnonzero(np.diff(p, prepend=-1, append=-1)).tolist()
        places = at.tolist()
        for i, last in pairwise(edges):
            q = int(p[i])
            while i < last:
                x = places[i]
                i += 1
                if period_of[x] and q % period_of[x] == 0 and x + q < end_of[x]:
                    continue
                ahead = _reach(w, x, q, 1)
                start, end = x - (_reach(w, x - 1, q, -1) if x else 0), x + ahead + q
                i = bisect_left(places, x + ahead, i, last)
                if end - start < max(min_words, repeats * q) or (start, end) in known:
                    continue
                known.add((start, end))
                out.append((start, end, q))
                part = slice(start, end)
                fresh = period_of[part] == 0
                end_of[part][fresh] = end
                period_of[part][fresh] = q
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """(id_col, n_words, runs by start and period, collapsed) of every row.

    collapsed is the text's words joined by one blank, without those that a run holds after its first period. A run repeats
    its period 3 times or more, as fewer would not hold two grid points.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")

    def run(batches):
        for batch in batches:
            for a, off, data in chunks(batch.column(1), BATCH):
                hashed, owner = word_hashes(off, data, SAME)
                n = len(off) - 1
                count = np.diff(owner)
                order = np.argsort(-count, kind="stable")
                # words of texts in that order, each followed by a place of its own
                first = np.concatenate(([0], np.cumsum(count[order] + 1)))
                w = np.empty(first[-1], np.uint64)
                stop = np.zeros(len(w), bool)
                stop[first[1:] - 1] = True
                source = np.repeat(owner[:-1][order] - first[:-1], count[order] + 1) + np.arange(len(w))
                w[~stop] = hashed[source[~stop]]
                w[stop] = _unequal(hashed, n)
                found = runs(w, first, min_words, repeats)
                drop = np.zeros(len(hashed), bool)
                of = np.searchsorted(first, [r[0] for r in found], "right") - 1
                lists: list[list] = [[] for _ in range(n)]
                for (s, e, p), k in zip(found, of.tolist(), strict=True):
                    row = int(order[k])
                    s, e = s - int(first[k]), e - int(first[k])
                    lists[row].append((s, e - s, p))
                    drop[owner[row] + s + p : owner[row] + e] = True
                texts, pool = [], data.tobytes()
                for i in range(n):
                    own = pool[off[i] : off[i + 1]].split()  # at the same six bytes
                    if lists[i]:
                        own = list(compress(own, (~drop[owner[i] : owner[i + 1]]).tolist()))
                    texts.append(b" ".join(own).decode("utf-8", "replace"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                rows = [[{"start": s, "length": m, "period": p} for s, m, p in sorted(x, key=lambda r: (r[0], r[2]))] for x in lists]
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(count), pa.array(rows, kind), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def _unequal(hashed: np.ndarray, n: int) -> np.ndarray:
    """n different numbers that are no word's hash."""
    taken = np.unique(hashed)
    out, at = np.empty(0, np.uint64), 0
    while len(out) < n:
        more = np.arange(at, at + n, dtype=np.uint64)
        out = np.concatenate((out, more[~np.isin(more, taken)]))
        at += n
    return out[:n]


def best(found):
    """The run of an array with the greatest exact length / period; of equals the first in the array's order."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document by crc32 of its doc_id is periodic from some word on.

    With g the crc32 divided by 10 and n words, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) / (3 + g % 8). A null doc_id or text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.expr("CAST(0 AS BIGINT)").alias("zero")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("w"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document of documents, of which every tenth is made periodic first."""
    found = detect(planted(load(spark, sf_dir, "documents"))).withColumn("best", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
