import random
import zlib

import numpy as np
import pytest
from lorebase.llm import language_id as L
from pyspark.sql import functions as F

LETTER = L.letters()


def plain_phrases(text, train):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        n, i = n + 1, i + k
    return n


def of(texts):
    data, first, fine = L.normal(texts, LETTER)
    return [data[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], data, first, fine


def test_normal_text_has_letters_and_single_blanks():
    texts = ["Ab  c1Ärger", "", "\u00b2 \u00bd \u2462", " x", "x ", "\u4e2d\u6587, \u0130x", "1", "\U00010428!"]
    got, *_, fine = of(texts)
    assert got == ["ab c \u00e4rger".encode(), b"", b" ", b" x", b"x ", "\u4e2d\u6587 i x".encode(), b" ", "\U00010428 ".encode()]
    assert fine.tolist() == [any(c.isalpha() for c in t) for t in texts]


@pytest.mark.parametrize("lane", [3, 16, 128])
def test_phrases_equal_plain_longest_matches_of_whole_texts(lane):
    rnd = random.Random(lane)
    word = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    samples = {k: of([word("abcd \u00e9", 150), word("abcdef \u4e2d", 150)])[0] for k in ("x", "y")}
    samples["z"] = of([word("\u0430\u0431\u0432 ", 99)])[0]
    parser = L.Parser(samples)
    pieces = [x.decode() for own in samples.values() for x in own]  # phrases over many lanes
    texts = [word("abcd \u00e9z\u4e2d\u0430", rnd.randint(0, 400)) for _ in range(40)] + pieces + [p[5:90] + p[3:] + word("ab", 30) for p in pieces] + ["", " ", "a"]
    parts, data, first, _ = of(texts)
    for t, row in zip(parts, parser.phrases(data, first, lane), strict=True):
        assert [plain_phrases(t, b"\0".join(samples[k])) for k in parser.languages] == row.tolist()


def test_winner_and_score_equal_a_plain_parse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learning = docs.where(~L.is_held_out())
    options = {"sample_docs": 20, "sample_bytes": 4000}
    samples = L.sample(learning, "text", "lang", 20, 4000, L.TOTAL_BYTES)
    names, weights = sorted(samples), {k: np.log2(max(2, sum(map(len, v)))) for k, v in samples.items()}
    assert all(len(v) <= 20 and sum(map(len, v)) <= 4000 for v in samples.values())
    some = docs.where("doc_id % 9 = 1")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(some, learning, **options).select("row.doc_id", "lang_pred", "score").collect()}
    for r in some.collect():
        (text,), *_ = of([r.text or ""])
        cost = sorted((plain_phrases(text, b"\0".join(samples[k])) * weights[k], k) for k in names)
        assert got[r.doc_id] == (cost[0][1], pytest.approx(1 - cost[0][0] / cost[1][0])) if any(c.isalpha() for c in r.text or "") else got[r.doc_id] == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.predict(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double, row string"
    en, fr = "the quick brown fox and the dog of the house", "le renard et le chien de la maison sont ici"
    data = [(i, f"{en} {i}", "en", 0.0, "") for i in range(40)] + [(100 + i, f"{fr} {i}", "fr", 0.0, "") for i in range(40)]
    odd = [(None, en, None, 0.0, ""), (None, en, None, 0.0, ""), (900, None, "en", 0.0, ""), (901, "123 ??", "zz", 0.0, ""), (902, "\u00b2 \u00bd \u2462", "en", 0.0, ""), (903, "", None, 0.0, ""), (904, en * 20000, "en", 0.0, "")]
    rows = L.predict(spark.createDataFrame(data + odd, schema)).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(data) + len(odd) and got[None] == "en" and got[904] == "en" and [got[k] for k in (900, 901, 902, 903)] == ["und"] * 4
    assert all(got[i] == "en" and got[100 + i] == "fr" for i in range(40))
    assert L.predict(spark.createDataFrame([], schema)).collect() == []
    assert {(r.lang_pred, r.score) for r in L.predict(spark.createDataFrame([(1, en, None, 0.0, "")], schema)).collect()} == {("und", 0.0)}
    assert L.accepted(spark.createDataFrame(data + odd, schema)).columns == ["doc_id", "text", "lang", "score", "row"]


def test_all_languages_are_learned_from_whole_distinct_texts(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(None, f"word {'abcdefghij'[i % 10]} number {'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}", "en") for i in range(3000)] + [(7, "mot fran\u00e7ais", "fr")] * 3000
    rows += [(i, "\u0441\u043b\u043e\u0432\u043e " * (900 + i), "ru") for i in range(5)] + [(1, "12 34", "none")]
    got = L.sample(spark.createDataFrame(rows, schema), "text", "lang", 50, 5000, 1 << 20)
    assert set(got) == {"en", "fr", "ru"} and got["fr"] == ["mot fran\u00e7ais".encode()] and 40 <= len(got["en"]) <= 50 and len(set(got["en"])) == len(got["en"])
    assert got["ru"] == [("\u0441\u043b\u043e\u0432\u043e " * 900).encode()]  # all are longer than the share: the shortest, whole
    small = L.sample(spark.createDataFrame(rows, schema), "text", "lang", 50, 5000, 300)
    assert set(small) == {"en", "fr", "ru"} and sum(map(len, small["en"])) <= 100


def test_sampled_texts_with_wrong_labels_do_not_vouch_for_themselves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200")
    wrong = docs.where("lang = 'en'").orderBy("doc_id").limit(25).withColumn("lang", F.lit("de")).withColumn("doc_id", F.col("doc_id") + 5_000_000)
    both = docs.unionByName(wrong)
    drawn = L._drawn(both, "text", "lang", L.SAMPLE_DOCS, L.SAMPLE_BYTES, L.TOTAL_BYTES)
    models = L.consistent(spark, drawn)
    texts = {r.text for r in wrong.collect()}
    normal = {of([t])[0][0] for t in texts}
    sampled = [t for _, t in drawn["de"] if t in normal]
    assert len(sampled) >= 5 and sum(t in m["de"] for m in models for t in sampled) <= 1  # their labels were found out
    for fold, model in enumerate(models):  # and no model holds a text that it judges
        assert not {t for own in model.values() for t in own} & {t for own in drawn.values() for f, t in own if f == fold}
    kept = {r.doc_id for r in L.accepted(both).collect()}
    assert sum(i >= 5_000_000 for i in kept) <= 2 and sum(i < 5_000_000 for i in kept) >= 0.97 * docs.count()


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox and the dog", "en", 1, 2)], ["doc_id", "text", "lang", "a.b", "c`d"])
    assert [tuple(r) for r in L.accepted(rows).collect()] == [(1, "the quick brown fox and the dog", "en", 1, 2)]
