import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lorebase.llm import lm_scoring

TEXTS = ["The cat sat on the mat.", "the CAT\nran", None, "", "  é 中 the the", "zebra quartz jumps", "the cat sat on the mat.", "mat cat " * 40, "sat", "\x0b\x0c", "one two three four", "Ünïcode", "the mat the cat the sat"] * 2


def words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


@pytest.mark.parametrize("head", [0, 3, 1 << 18])
def test_scores_equal_a_plain_model(spark, head):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens long").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score(docs, head=head).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(TEXTS))}
    assert any(held.values()) and not all(held.values())
    train = [t for i, t in enumerate(TEXTS) if not held[i]]
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for (i, t), ppm in zip(enumerate(TEXTS), byte_trie(train, TEXTS, lm_scoring.ORDER), strict=True):
        tokens = [*words(t), None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), abs=1e-9)
        assert got[i].score == pytest.approx(ppm, abs=1e-6)


def test_nothing_to_learn_from(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm_scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(3 * math.log10(1 / 256))


def byte_trie(train, texts, order):
    low = lambda t: b"\n" * order + bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    trie = defaultdict(Counter)
    for s in map(low, train):
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie[s[i - k : i]][s[i]] += 1
    for s in map(low, texts):
        total = 0.0
        for i in range(order, len(s)):
            out, p = set(), 1.0
            for k in range(order, -1, -1):
                seen = {y: n for y, n in trie[s[i - k : i]].items() if y not in out}
                n, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    p *= seen[s[i]] / (n + d)
                    break
                p *= d / (n + d) if seen else 1
                out |= set(seen)
            else:
                p /= 256 - len(out)
            total += math.log10(p)
        yield total


@pytest.mark.parametrize("order,head_grams", [(3, 0), (5, 40), (6, 1 << 20)])
def test_contexts_of_all_bytes_grow_with_the_corpus(spark, order, head_grams):
    spans = [("a", 26), ("а", 32), ("α", 24), ("一", 40), ("0", 10), ("ก", 40)]  # over 64 bytes, rare scripts among them
    texts = [" ".join("".join(chr(ord(first) + (i * 7 + k * k + j) % size) for j in range(6)) for k in range(9)) for i in range(8) for first, size in spans] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len({b for t in train for b in t.encode()}) > 64
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, order=order, head_grams=head_grams).collect()}
    for i, expected in enumerate(byte_trie(train, texts, order)):
        assert got[i] == pytest.approx(expected, abs=1e-6)


def test_a_gram_has_its_probability_whatever_the_pieces(spark, monkeypatch):
    texts = ["ab cd " * 50 + "x" * 90 + " end", "x" * 200, "short", None, "ab cx"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    expected = list(byte_trie([t for i, t in enumerate(texts) if i not in held], texts, 5))
    got = []
    for piece, head in ((7, 3), (1 << 20, 0)):
        monkeypatch.setattr(lm_scoring, "CHUNK", piece)
        monkeypatch.setattr(lm_scoring.chunks, "__defaults__", (piece,))
        got.append({r.doc_id: (r.score, r.base_score) for r in lm_scoring.score(docs, head=head, head_grams=head * 5).collect()})
    assert all(got[0][i] == pytest.approx(got[1][i], abs=1e-9) and got[0][i][0] == pytest.approx(expected[i], abs=1e-6) for i in range(len(texts)))


def test_probabilities_of_all_bytes_after_a_context_sum_to_one():
    rng = np.random.default_rng(2)
    g = rng.integers(97, 102, (400, 6))
    grams = (g.astype(np.int64) * (1 << (8 * np.arange(5, -1, -1)))).sum(axis=1)
    keys, n = lm_scoring._sums(grams, np.ones(len(grams), np.int64))
    known = lm_scoring.shorter(lm_scoring._sums(keys & 0xFFFFFF, n))
    for context in (int(keys[3]) >> 8, 0x6162636465, 0x7A7A7A6162):
        asked = (context << 8) + np.arange(256)
        new = np.setdiff1d(asked, keys)
        both, counts = np.concatenate([keys, new]), np.concatenate([n, np.zeros(len(new), np.int64)])
        logs = lm_scoring.ppm_logs(both, counts, known, 5)
        assert (10 ** logs[np.isin(both, asked)]).sum() == pytest.approx(1)
