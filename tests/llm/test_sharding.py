import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from lorebase.llm import sharding


def verify(rows, shards=8):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in rows)
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(shards)})


def test_documents_are_near_equal_and_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    want = Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    load = verify(rows)
    assert max(load.values()) <= 1.03 * sum(load.values()) / 8 and min(load.values()) >= 0.97 * sum(load.values()) / 8
    assert rows == sharding.shard(docs).collect() or sorted(rows) == sorted(sharding.shard(docs).collect())


def test_a_group_with_most_rows_overflows_clockwise(spark):
    data = [(i, "copied text " * 20, 0) for i in range(3000)] + [(i % 7 or None, f"text {i % 400}" * 9, 1) for i in range(2000)] + [(9, None, 2)] * 500
    rows = sharding.shard(spark.createDataFrame(data, "doc_id long, text string, slot int")).collect()
    load = verify(rows)
    assert len(rows) == len(data) and max(load.values()) <= 1.05 * sum(load.values()) / 8
    small = defaultdict(set)
    for r in rows:
        small[r.text_crc32].add(r.shard)
    crc = zlib.crc32(b"copied text " * 20)
    assert len(small[crc]) > 1 and sum(len(v) == 1 for v in small.values()) > 0.95 * len(small)


def plain_ring(texts, shards, cells, virtual, slack):
    """Shards of texts by walking the ring for each group of equal places, heaviest first."""
    place = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    load = Counter()
    for t in texts:
        load[place(t) % cells] += len((t or "").encode()) + 1
    nodes = sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(virtual))
    room = [-(-sum(load.values()) * (1 + slack) // shards)] * shards
    at = {}
    for cell in sorted(load, key=lambda c: (-load[c].bit_length(), c)):
        clockwise = [s for p, s in nodes if p >= cell * (1 << 32) // cells] + [s for _, s in nodes]
        at[cell] = next((s for s in clockwise if room[s] >= load[cell]), None)
        if at[cell] is None:
            at[cell] = max(dict.fromkeys(clockwise), key=lambda s: room[s])
        room[at[cell]] -= load[cell]
    return [at[place(t) % cells] for t in texts]


@pytest.mark.parametrize("shards,cells,slack", [(8, 64, 0.05), (8, 64, 0.0), (3, 16, 0.3), (1, 16, 0.0)])
def test_places_equal_a_plain_walk_of_the_ring(spark, shards, cells, slack):
    texts = [f"text {i % 900} " + "x" * (i % 37) for i in range(4000)] + [None, "", "é" * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r.shard for r in sharding.shard(frame, shards=shards, cells=cells, slack=slack).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_ring(texts, shards, cells, sharding.VIRTUAL, slack)


def test_very_long_texts(spark):
    rows = sharding.shard(spark.createDataFrame([(1, "long text " * 300_000), (2, "short"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.size for r in rows} == {1: 3_000_001, 2: 6, 3: 1} and verify(rows)


def test_growth_moves_little_and_empty_tables():
    parts = [(c, 0, 100 + c % 7) for c in range(4096)]
    a, b = sharding.walk(parts, 8), sharding.walk(parts, 9)
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.2 * len(parts)  # 1 / 9 at the best


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
