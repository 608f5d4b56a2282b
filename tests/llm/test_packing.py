import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from lorebase.llm import packing, token_counts
from lorebase.llm._tokens import Ids

TEXTS = ["", None, "one two", "a  b\n\nc", "<|endoftext|> it's", "é 中文 " * 900, "same", "same", "word " * 5000, "x", " lead", "end "]


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


@pytest.mark.parametrize("size", [1, 7, 64, 200])
def test_best_fit_on_the_histogram_equals_best_fit_on_items(size):
    rnd = random.Random(size)
    for _ in range(60):
        lengths = [rnd.choice([1, size, rnd.randint(1, size), max(1, size // 3)]) for _ in range(rnd.randint(0, 120))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        segments, bins = packing.best_fit(dict(histogram), size)
        room = [size] * bins
        for length, lo, hi, first, each, offset in segments:
            for k in range(hi - lo):
                assert room[first + k // each] == size - offset - (k % each) * length
                room[first + k // each] -= length
        assert sum(hi - lo for _, lo, hi, *_ in segments) == len(lengths)
        assert sorted(room) == plain_best_fit(lengths, size)


def hugging(texts, ordinary=False):
    """Ids by a plain call of the tokenizers library; with ordinary, special tokens' strings are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = ordinary
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("ordinary", [False, True])
def test_ids_equal_the_tokenizers_library(ordinary):
    rnd = random.Random(8)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "\u200b", "a", "Word", "'s", "12", "\u00e9", "\u4e2d", "\U0001f600", "!?", "_", "\0", "<|endoftext|>", "<|endof"]
    texts = TEXTS + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(3000)] + [f"{i}<|endoftext|> <|endoftext|>" for i in range(3)]
    ids = Ids(special=not ordinary)
    for _ in range(2):  # from the text, and from what is remembered
        assert [np.frombuffer(ids(x or ""), "<u4").tolist() for x in texts] == hugging(texts, ordinary)
    assert np.frombuffer(Ids(special=True)("<|endoftext|>"), "<u4").tolist() == [50256] and ids.size == 50257 and 50256 not in ids.ordinary


def test_separators_that_texts_can_hold_are_refused(spark):
    assert token_counts.id_type(50256).itemsize == 2 and token_counts.id_type(70_000).itemsize == 4
    with pytest.raises(ValueError):
        token_counts.token_counts(docs(spark, TEXTS), separator=17)
    got = token_counts.token_counts(docs(spark, TEXTS[:8]), separator=70_000, block=64).collect()
    assert sorted(r.n_tokens for r in got) == sorted(map(len, hugging(TEXTS[:8], True)))


def docs(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, x, i, "clash") for i, x in enumerate(texts)], "doc_id long, text string, piece int, length string").repartition(3)


def test_pieces_rebuild_every_document(spark):
    rows = packing.pack(docs(spark, TEXTS)).collect()
    ids = {(i if i != 3 else None): x + [0] for i, x in enumerate(hugging(TEXTS))}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert sum(r.length for r in own) == len(ids[doc]) and all(r.length == 2048 for r in own[1:])
    for places in by_bin.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places[:-1]]).tolist() and sum(n for _, n in places) <= 2048
    assert sorted(2048 - sum(n for _, n in p) for p in by_bin.values()) == plain_best_fit([r.length for r in rows], 2048)


def test_repeated_rows_and_empty_tables(spark):
    rows = packing.pack(spark.createDataFrame([(7, "again and again")] * 50, "doc_id long, text string")).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 18])
def test_token_counts_over_block_boundaries(spark, block):
    texts = TEXTS[:8] + TEXTS[9:] if block < 64 else TEXTS
    got = token_counts.token_counts(docs(spark, texts), block=block).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens) for r in got) == sorted(((i == 3, i if i != 3 else 0), len(x)) for i, x in enumerate(hugging(texts, True)))


def test_token_counts_of_nothing(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
