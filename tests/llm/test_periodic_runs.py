import hashlib
import random
import zlib

import numpy as np
import pytest
from lorebase.llm import periodic_runs as P
from pyspark.sql import functions as F

some = random.Random(5)


def plain(words, least=24):
    """Every (start, length, period) by trying all periods at all places."""
    n, out = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 3 * p):
                out.setdefault((i, j + p), p)  # the smallest period of this stretch
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed(words, found):
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, monkeypatch=None):
    """runs() of many texts at once, as the operator lays them out."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    first = np.cumsum([0] + [len(texts[i]) + 1 for i in order])
    codes: dict = {}
    w = []
    for i in order:
        w += [codes.setdefault(x, len(codes)) for x in texts[i]] + [-1 - i]
    out = [[] for _ in texts]
    for s, e, p in P.runs(np.array(w).astype(np.int64), first):
        k = int(np.searchsorted(first, s, "right")) - 1
        out[order[k]].append((int(s - first[k]), e - s, p))
    return [sorted(x) for x in out]


def some_text(kind):
    n = some.randrange(0, 260)
    words = [some.choice("abcdefghij") for _ in range(n)]
    if kind == 1:
        words = [some.choice("ab") for _ in range(n)]
    if kind == 2 and n:
        a, p = some.randrange(n), some.randrange(1, 60)
        words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
    if kind == 3:  # runs within periods of runs
        unit = ["x"] * some.randrange(20, 40) + [some.choice("yz")] * some.randrange(1, 30) + ["q"]
        words = words[: some.randrange(40)] + unit * some.randrange(3, 6) + unit[: some.randrange(len(unit))] + words[:20]
    if kind == 4:
        words = (["a", "b"] * 20 + ["a"] * 30 + ["b", "a", "c"] * 11)[: some.randrange(90)] * 3
    return words


def test_runs_equal_all_periods_at_all_places():
    for _ in range(60):
        texts = [some_text(some.randrange(5)) for _ in range(some.randrange(1, 12))]
        assert found(texts) == [plain(t) for t in texts]


def test_one_word_over_and_over_and_a_long_period():
    texts = [["a"] * 5000, [str(i % 1234) for i in range(4000)], [str(i % 1334) for i in range(4000)], ["a"] * 23, ["a"] * 24, []]
    assert found(texts) == [[(0, 5000, 1)], [(0, 4000, 1234)], [], [], [(0, 24, 1)], []]


def test_probes_grow_with_n_log_n(monkeypatch):
    calls = []
    reach = P._reach
    monkeypatch.setattr(P, "_reach", lambda *a: calls.append(a) or reach(*a))
    words = np.random.default_rng(1).zipf(1.5, 60_000) % 5000
    P.runs(words.astype(np.int64), np.array([0, 60_000]))
    P.runs(np.zeros(20_000, np.int64), np.array([0, 20_000]))
    assert len(calls) < 2500  # extensions are few, for common words and for a run that every period meets


def want(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))), sha(collapsed(words, runs)))


def asked(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return P.query(spark, str(tmp_path)).collect()


def test_query_equals_brute_force_with_odd_rows(spark, tmp_path):
    texts = [" ".join(some_text(i % 5)) for i in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (900, None, "x"), (901, "", "x"), (902, " \n\t ", "x"), (None, "a " * 40, None), (903, "A a " * 12 + " " + " Ä ä " * 30, "x"), (904, "w" * 3000, "x")]
    got = asked(spark, spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3), tmp_path)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((want(i, t) for i, t, _ in rows), key=key)
    assert any(r.n_runs for r in got) and [c for c, _ in P.query(spark, str(tmp_path)).dtypes] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in P.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count() and sum(r[1] > 0 for r in got.values()) > 10
    assert all(got[i] == want(i, t) for i, t in short.items())


def test_long_texts_in_small_pieces_and_empty_tables(spark, monkeypatch):
    rows = [(1, "ab " * 40_000 + " ".join(map(str, range(3000))) * 4), (2, "x y z " * 10)]
    got = {r.doc_id: r for r in P.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].runs[0].asDict() == {"start": 0, "length": 40_000, "period": 1} and got[2].collapsed == "x y z"
    assert P.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("least", [6, 40])
def test_other_limits(spark, least):
    rows = [(i, " ".join(some_text(i % 5))) for i in range(40)]
    for r in P.detect(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect():
        words = rows[r.doc_id][1].split()
        runs = plain(words, least)
        assert [(x.start, x.length, x.period) for x in r.runs] == sorted(runs, key=lambda x: (x[0], x[2])) and r.collapsed == collapsed(words, runs) and r.n_words == len(words)


def test_best_is_by_exact_ratio_then_place(spark):
    runs = [(0, 24, 8), (30, 25, 8), (60, 50, 16), (120, 75, 24)]
    frame = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in frame.select(P.best(F.col("runs"))).collect()] == [(30, 25, 8), None]
