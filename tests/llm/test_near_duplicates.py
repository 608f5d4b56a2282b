import random
import re

import numpy as np
import pytest
from lorebase.llm import _text, near_duplicates
import pyarrow as pa


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)], key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = []
    for _ in range(25):
        w = [word() for _ in range(rnd.choice([3, 6, 12, 40, 150]))]
        for _ in range(rnd.choice([1, 2, 6, 12])):
            v = list(w)
            for _ in range(rnd.randint(0, 1 + len(w) // 12)):
                v[rnd.randrange(len(v))] = word()
            texts.append(rnd.choice([" ", "\n", " \t"]).join(v) + rnd.choice(["", " ", " " + rnd.choice(shared)]))
    big = [word() for _ in range(80)]  # one group of near copies, longer than a short list, and outsiders
    for k in range(110):
        v = list(big)
        for _ in range(k % 5):
            v[rnd.randrange(80)] = word()
        texts.append(" ".join(v).upper() if k % 3 else " ".join(v))
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A B C D E", "é é é é é é", "x " * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[9]), (None, texts[30]), (None, "alone in the world with no id here"), (7, texts[7])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,frequent,wide,block", [(1, 16, 64, 4096), (2, 2, 4, 30), (3, 1000, 8, 40)])
def test_groups_equal_all_pairs(spark, monkeypatch, seed, frequent, wide, block):
    monkeypatch.setattr(near_duplicates, "WIDE", wide)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = near_duplicates.near_duplicates(frame, frequent=frequent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == plain_groups(rows)


def test_one_of_each_group_stays_and_empty_tables(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "A b c d e f g h", "y"), (3, None, None), (4, "other words stand in this one", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    assert sorted(r.doc_id for r in near_duplicates.deduplicated(frame).collect()) == [1, 3, 4]
    assert near_duplicates.deduplicated(frame.limit(0)).collect() == []


def test_deduplication_goes_by_rows_not_by_ids(spark):
    same, near = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s z"
    rows = [(5, same, "x", 1), (5, "a text of its own in five words", "y", 2), (7, near, "z", 3), (None, same, "n", 4), (None, "no id but words of its own", "n", 5)]
    rows += [(9, "equal rows of one text and id", "e", 6)] * 3 + [(8, "same id and text but other columns", "p", k) for k in range(3)] + [(4, None, "b", 7), (4, " \n", "b", 8), (4, " \n", "b", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string, row int").repartition(4)
    got = near_duplicates.deduplicated(frame)
    kept = got.collect()
    assert got.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "", r.id) for r in kept) == sorted([(5, same, "x"), (5, rows[1][1], "y"), (0, rows[4][1], "n"), (9, rows[5][1], "e"), (8, rows[8][1], "p"), (4, "", "b"), (4, " \n", "b"), (4, " \n", "b")])
    assert kept and sorted(map(str, kept)) == sorted(map(str, near_duplicates.deduplicated(frame.repartition(2)).collect()))


def test_very_long_texts_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(_text, "CHUNK", 1000)
    long_ = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(1, long_), (2, long_ + " more words"), (3, long_[: len(long_) // 2]), (4, "w" * 300_000), (5, "w" * 300_000), (6, "w" * 299_999)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == plain_groups(rows)


def test_bitmaps_of_large_sets_are_counted_alike():
    s = np.unique(np.random.default_rng(7).integers(0, 1 << 63, (1 << 20) + 9).astype(np.uint64))
    size = 1 << (2 * len(s) - 1).bit_length()
    plain = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    assert near_duplicates._bitmap(s) == np.packbits(plain.astype(np.uint8), bitorder="little").tobytes()


def test_links_of_long_chains_become_one_component(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000) for i in range(50)] + [(-5, -9)]
    random.Random(0).shuffle(links)
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got.get(1000 + i, 1000) == 1000 for i in range(50)) and got[2000] == 1000 and got[-5] == -9


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    tokens = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    counts = rng.integers(17, 999, len(tokens))
    marks = np.ones(1 << 16, bool)
    for n in (1, 4, 11, 60, 150, 700):
        for _ in range(60):
            pool = np.concatenate([rng.choice(tokens, n) << np.uint64(24), rng.integers(0, 1 << 63, n).astype(np.uint64)])
            x = np.unique(rng.choice(pool, n))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.choice(pool, max(1, n // 20))]))
            i = len(np.intersect1d(x, y))
            if 100 * i >= 80 * (len(x) + len(y) - i):
                assert np.intersect1d(*(near_duplicates.signatures(s, tokens, counts, marks) for s in (x, y))).size


def test_packed_steps_and_words(monkeypatch):
    rng = np.random.default_rng(6)
    v = np.unique(rng.integers(0, 1 << 36, 1000).astype(np.uint64))
    assert (near_duplicates._unpack(near_duplicates._pack(v)) == v).all()
    texts = [None, "", "a", " a  b\tA ", "é\x0bb", "b", "x" * 5000 + " a"]
    hashes = set()
    for limit, piece in ((1, 1 << 20), (3, 2), (1 << 20, 1 << 20), (1 << 20, 3), (1 << 20, 1), (1 << 20, 4999)):
        monkeypatch.setattr(_text, "CHUNK", piece)
        words = []
        for _, off, data in _text.chunks(pa.array(texts, pa.string()), limit):
            h, first = _text.word_hashes(off, data)
            words += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        a, b = words[2][0], words[5][0]
        hashes.add(str(words))
        assert [len(w) for w in words] == [0, 0, 1, 3, 2, 1, 2] and words[3] == [a, b, a] and words[4][1] == b and words[6][1] == a
    assert len(hashes) == 1


@pytest.mark.parametrize("seed,block,tokens", [(1, 1024, 1 << 20), (2, 7, 1 << 20), (3, 1024, 900)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, block, tokens):
    monkeypatch.setattr(near_duplicates, "LINK_BLOCK", block)
    monkeypatch.setattr(near_duplicates, "LINK_TOKENS", tokens)
    rows = corpus(seed)
    sets = {frozenset(plain_set(t)) for _, t in rows} - {frozenset()}
    links = {s: sum(s is not x and 100 * len(s & x) >= 80 * len(s | x) for x in sets) for s in sets}
    assert max(links.values()) > 2
    expected = [(*r, links.get(frozenset(plain_set(t)), 0)) for r, t in zip([(d, len(plain_set(t))) for d, t in rows], [t for _, t in rows], strict=True)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.n_links) for r in got], key=repr) == sorted(expected, key=repr)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == plain_groups(rows)


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[i * 30 : i * 30 + 30]) for i in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[3]), (201, texts[4] + " tail"), (5, texts[5]), (None, texts[6]), (300, None), (301, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_duplicates.deduplicated(spark.read.parquet(f"{tmp_path}/docs"))
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(i, t) for i, t in enumerate(texts)] + [(300, ""), (301, " ")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in plan]
    scans = [i for i, x in enumerate(plan) if "FileScan parquet [doc_id" in x]
    assert scans
    for i in scans:
        for j in range(i, -1, -1):
            if depth[j] < depth[i]:
                assert "Exchange" not in plan[j], "\n".join(plan)
                i = j


def test_long_lists_give_no_more_rows_than_they_have_members(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    # each pair shares most words, some pairs enough and most too little
    rows = [(i, " ".join(base[: 50 + i % 3] + [f"t{rng.integers(5)}-{k}" for k in range(int(rng.integers(4, 12)))])) for i in range(150)]
    sets = [np.unique(rng.integers(0, 1 << 63, 9).astype(np.uint64)) for _ in range(90)]
    common = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, s])) for s in sets]
    table = pa.table({"key": pa.array(range(90), pa.int64()), "root": pa.array(range(90), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "bits": [near_duplicates._bitmap(s) for s in sets], "block": pa.array([0] * 90, pa.int32()), "i": pa.array([0] * 90, pa.int32()), "j": pa.array([0] * 90, pa.int32())})
    near = near_duplicates.compare(table, 70)
    assert 0 < near.num_rows < 90
    for wide, block, link in ((64, 4096, 1024), (2, 4096, 1024), (2, 20, 16)):
        for name, value in (("WIDE", wide), ("BLOCK", block), ("LINK_BLOCK", link)):
            monkeypatch.setattr(near_duplicates, name, value)
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        want = plain_groups(rows)
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == want and 1 < len({c for *_, c in want}) < 100
