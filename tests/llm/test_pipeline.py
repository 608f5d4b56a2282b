import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from lorebase.llm import language_id, mixing, near_duplicates, quality
from lorebase.llm._spark import saved
from lorebase.llm._tokens import Ids
from pyspark.sql import functions as F

SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, class string, tokens array<int>, size double"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus():
    rnd = random.Random(11)
    spell = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    vocabulary = {"en": [f"th{spell(i)}ing" for i in range(400)], "fr": [f"qu{spell(i)}eux" for i in range(400)]}
    text = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    rows, extra = [], ("r", 1, None, [1], 0.5)
    add = lambda i, t, lang, source: rows.append((i, t, lang, source, None if t is None else len(t), *extra))
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        add(i, text(lang, rnd.randint(25, 70)), lang, ["a", "b", "", None][i % 4])
    shared = text("en", 12)
    for i in range(100, 125):  # a line that too many texts of a source share
        add(i, f"{text('en', 40)}\n{shared} {i}\n\n{text('en', 20)}", "en", "c")
    for i in (200, 3, None, None):
        add(i, rows[7][1].upper(), "en", "a")  # copies of one text, ids repeated and null
    rows.append(rows[5])  # equal rows
    add(5, text("en", 50), "en", "b")  # another text of a repeated id
    add(201, rows[9][1] + " tail", "fr", None)
    for i, t in enumerate([None, "", " \n\t", "too short", "again and again " * 40, "12 34 56 " * 2 + " ".join(map(str, range(1000, 1030)))]):
        add(300 + i, t, "en", "a")
    add(None, text("en", 30), None, None)
    add(400, " ".join(text("en", 1000) for _ in range(30)), "en", "a")  # a long text
    rnd.shuffle(rows)
    return rows


def after_quality(rows):
    """Rows of the kept texts without the lines above the limit, by plain loops."""
    line = lambda x: re.sub("[0-9]+", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(words(x))))
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if words(x):
                held[r[3], line(x)].add(r[1])
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    lose = lambda r, x: words(x) and len(held[r[3], line(x)]) > quality.LINE_LIMIT and min(map(digest, held[r[3], line(x)])) != digest(r[1])
    out = []
    for r in rows:
        w = words(r[1])
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(windows)
        repeated = len({i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(8)})
        lines = (r[1] or "").split("\n")
        gone = sum(len(words(x)) for x in lines if lose(r, x))
        if len(w) < 20 or 100 * repeated > 30 * len(w) or 100 * gone > quality.LOST_PERCENT * len(w):
            continue
        text = "\n".join(x for x in lines if not lose(r, x)) if gone else r[1]
        out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def without_duplicates(rows):
    """One row of each group of near duplicates: the one of the least id, null last, then of the least digest."""
    shingles = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if shingles[i] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g, s in zip(rows, group, shingles, strict=True):
        key = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
        if s and (g not in best or key < best[g][0]):
            best[g] = key, r
    return [r for _, r in best.values()] + [r for r, s in zip(rows, shingles, strict=True) if not s]


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    same = lambda found, want: Counter(map(repr, map(tuple, found.collect()))) == Counter(map(repr, map(tuple, want)))

    cleaned = saved(stages["quality_rules"](spark, frame, str(tmp_path)), "cleaned")
    want = after_quality(rows)
    assert cleaned.columns == frame.columns and same(cleaned, want) and sum(r[1] not in {x[1] for x in rows} for r in want) == 24
    told = saved(stages["language_id"](spark, cleaned, str(tmp_path)), "told")
    want = [r for r in want if any(c.isalpha() for c in r[1])]
    assert told.columns == frame.columns and same(told, want)
    alone = saved(stages["ngram_jaccard_join"](spark, told, str(tmp_path)), "alone")
    want = without_duplicates(want)
    assert alone.columns == frame.columns and same(alone, want) and len([r for r in want if r[0] == 5]) == 2
    mixed = saved(stages["mixing"](spark, alone, str(tmp_path)), "mixed")
    chosen = mixing.mix(alone).where("sampled").select("row.*").collect()
    assert mixed.columns == frame.columns and same(mixed, chosen) and len(chosen) >= 0.7 * len(want) and set(map(repr, map(tuple, chosen))) <= set(map(repr, want))

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Ids(special=True)
    length = Counter()
    for r in pieces:
        length[r.doc_id] += r.length
    own = Counter()
    for r in chosen:
        own[r.doc_id] += len(ids(r.text)) // 4 + 1
    assert length == own
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert sum(n for _, n in p) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[0][0] == 0
    whole = [r for r in chosen if ids(r.text)]
    crcs = {r.ids_crc32 for r in pieces if r.start == 0}
    assert all(zlib.crc32(ids(r.text) + b"\0" * 4) in crcs for r in whole if len(ids(r.text)) // 4 < 2048)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_empty_tables(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, "")
    assert out.collect() == [] and (name == "best_fit_packing" or out.columns == empty.columns)


def test_clean_documents_stay(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    cleaned = saved(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), "cleaned")
    assert {r.doc_id for r in cleaned.collect()} == kept
    told = saved(corpus_pipeline.STAGES[1][1](spark, cleaned, sf_dir), "told")
    assert told.count() >= 0.97 * len(kept)
    alone = corpus_pipeline.STAGES[2][1](spark, told, sf_dir)
    assert {r.doc_id for r in alone.collect()} == {r.doc_id for r in near_duplicates.near_duplicates(told).collect() if r.doc_id == r.component_id}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def test_language_stage_rejects_only_what_is_sure(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(9_000_001, "123 456 ??", "en", "s", 10), (9_000_002, None, "en", "s", 0)], docs.schema))
    kept = {r.doc_id for r in language_id.accepted(odd).collect()}
    assert not kept & {9_000_001, 9_000_002} and len(kept) >= 0.97 * docs.count()
    wrong = docs.where("lang = 'en'").limit(20).withColumn("lang", F.lit("de")).withColumn("doc_id", F.col("doc_id") + 5_000_000)
    assert sum(r.doc_id >= 5_000_000 for r in language_id.accepted(docs.unionByName(wrong)).collect()) <= 10


def test_mixture_stage_learns_topics_from_every_text(spark, monkeypatch):
    fitted, fit = [], mixing.topic_model
    monkeypatch.setattr(mixing, "topic_model", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 11}", "en", f"s{i % 3}", 9) for i in range(2300)], "doc_id long, text string, lang string, source string, n_chars long")
    found = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    assert found.columns == docs.columns and 0.8 * 2300 < found.count() <= 2300
    # a place's idf tells of how many texts it was learned
    places, texts = len(fitted[0]["idf"]), 2300
    share = [round(float((1 + texts) / math.exp(x - 1)) - 1, 2) for x in fitted[0]["idf"]]
    assert places == mixing.TERMS and all(abs(x - round(x)) < 0.05 for x in share) and 2300 <= sum(share) <= 3 * 2300 + 5


def test_language_tables_are_built_in_little_memory():
    import random
    import tracemalloc

    some = random.Random(7)
    texts = ["".join(some.choice("abcdefghijklmnopqrstuvwxyz äöüß") for _ in range(400)).encode() for _ in range(60)]
    symbols = [1 + x for x in b"\0".join(texts)]
    tracemalloc.start()
    language_id.suffix_automaton(symbols)
    states = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tracemalloc.start()
    held = language_id.Automaton(texts).table.nbytes
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < states + 1.5 * held  # not three tables, two of them of twice the width


def test_workers_give_back_what_other_stages_left(spark):
    from lorebase.llm import _spark

    def first(batches):
        _spark.kept(("ids", "x"), lambda: bytearray(1))
        yield from batches

    def second(batches):
        import sys

        for batch in batches:
            if any(isinstance(k, tuple) for k in vars(sys.modules.get("_lorebase_kept", sys))):
                raise ValueError("another stage's data is still held")
            yield batch

    rows = spark.range(8).repartition(1)
    assert rows.mapInArrow(_spark.lean(first, "ids"), "id long").count() == 8
    assert rows.mapInArrow(_spark.lean(second), "id long").count() == 8
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    with _spark.writing(spark):
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) < int(before)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before
