import random
from collections import defaultdict

import numpy as np
import pytest
from lorebase.llm import mixing
from pyspark.sql import functions as F


def test_raking_meets_all_marginals_and_tells_what_is_left():
    rng = np.random.default_rng(1)
    codes = [np.repeat(np.arange(6), 12), np.tile(np.repeat(np.arange(3), 4), 6), np.tile(np.arange(4), 18)]
    mass = rng.integers(1, 1000, 72).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in (6, 3, 4)]
    weight, gap = mixing.rake(mass, codes, targets)
    assert gap < 1e-6
    for code, target in zip(codes, targets, strict=True):
        assert np.bincount(code, weights=mass * weight) / (mass * weight).sum() == pytest.approx(target, abs=1e-6)
    # one marginal repeats another with other targets: they cannot both be met
    _, gap = mixing.rake(mass, [codes[0], codes[0]], [targets[0], rng.dirichlet(np.ones(6))])
    assert gap > 0.01


def plain_mixture(rows, targets, temper, budget, rounds=mixing.ROUNDS):
    """Weights and probabilities by row from (source, lang, topic, tokens), by raking the rows' cells in plain Python."""
    cells = defaultdict(float)
    for *cell, tokens in rows:
        cells[tuple(cell)] += tokens
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    aims = []
    for d, name in enumerate(mixing.CELL):
        share = defaultdict(float)
        for cell, m in cells.items():
            share[cell[d]] += m
        aim = {k: v**temper if v else 0.0 for k, v in share.items()}
        if name in targets:
            told = {k: v for k, v in targets[name].items() if share.get(k)}
            free = sum(v for k, v in aim.items() if k not in told)
            aim = {k: told[k] if k in told else v * max(0, 1 - sum(told.values())) / (free or 1) for k, v in aim.items()}
        aims.append({k: v / sum(aim.values()) for k, v in aim.items()})
    for _ in range(rounds):
        for d, aim in enumerate(aims):
            now = defaultdict(float)
            for cell, m in cells.items():
                now[cell[d]] += m * weight[cell] / total
            weight = {c: w * (aim[c[d]] / now[c[d]] if now[c[d]] else 1) for c, w in weight.items()}
    # the capped cells are those of the largest weights: try each number of them
    order = sorted((c for c in cells if cells[c] and weight[c]), key=lambda c: -weight[c])
    scale = 1 / weight[order[0]]
    if budget is not None:
        for n in range(len(order)):
            scale = (budget * total - sum(cells[c] for c in order[:n])) / sum(weight[c] * cells[c] for c in order[n:])
            if weight[order[n]] * scale <= 1 + 1e-12:
                break
    return [(weight[tuple(c)], min(1.0, weight[tuple(c)] * scale)) for *c, _ in rows]


def corpus(spark, n=600, sources=12, extra=()):
    rnd = random.Random(4)
    themes = {lang: [[f"{t}w{k}" for k in range(40)] + [f"{lang}{t}w{k}" for k in range(20)] for t in range(3)] for lang in ("en", "fr")}
    rows = []
    for i in range(n):
        lang, t = rnd.choice(["en", "en", "en", "fr"]), rnd.randrange(3)
        rows.append((i, " ".join(rnd.choice(themes[lang][t] + [f"{lang}the", f"{lang}of"] * 15) for _ in range(rnd.randint(30, 120))), f"s{rnd.randrange(sources)}", lang, t))
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, source string, lang string, weight int").repartition(3)


ODD = [(None, None, None, None, 0), (9001, "", "", "en", 0), (9001, "", "", "en", 0), (9002, " \n", "s1", None, 0), (9003, "one", "rare", "xx", 0)]


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("targets,budget", [({}, 0.9), ({"source": {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}}, None), ({"lang": {"fr": 0.5, None: 0.1, "zz": 0.2}}, 0.4)])
def test_weights_and_probabilities_equal_a_plain_raking(spark, monkeypatch, local, targets, budget):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    monkeypatch.setattr(mixing.rake, "__defaults__", (3, mixing.CLOSE))
    monkeypatch.setattr(mixing.raked_in_spark, "__defaults__", (3, mixing.CLOSE))
    if not local:
        monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    docs = corpus(spark, 150, 4, ODD)
    found = mixing.mix(docs, targets=targets, budget=budget, topics=3)
    rows = found.withColumn("u", F.shiftrightunsigned(F.xxhash64("row.doc_id", "row.text", F.lit(mixing.SEED)), 11) / float(1 << 53)).collect()
    want = plain_mixture([(r.source, r.lang, r.topic, r.tokens) for r in rows], targets, mixing.TEMPER, budget, 3)
    assert len(rows) == 155
    for r, (weight, probability) in zip(rows, want, strict=True):
        assert r.weight == pytest.approx(weight, rel=1e-6) and r.probability == pytest.approx(probability, rel=1e-5, abs=1e-9)
        assert r.sampled == (r.u < r.probability) and r.tokens == len((r.row.text or "").split()) and (r.topic == "empty") == (r.tokens == 0)


def test_stated_targets_of_many_sources_are_met(spark):
    targets = {"source": {f"s{i}": 0.25 for i in range(4)}}
    rows = mixing.mix(corpus(spark, 400, 4), targets=targets, budget=None, topics=3).collect()
    total = sum(r.tokens * r.probability for r in rows)
    for i in range(4):
        assert sum(r.tokens * r.probability for r in rows if r.source == f"s{i}") / total == pytest.approx(0.25, abs=1e-4)
    assert {r.raking_gap < 1e-3 for r in rows} == {True} and min(r.probability for r in rows) > 0 and not any(r.capped for r in rows)


def test_topics_follow_content_across_languages(spark):
    rows = mixing.mix(corpus(spark), topics=3).collect()
    groups = defaultdict(lambda: defaultdict(int))
    for r in rows:
        groups[r.topic][r.row.weight] += 1
    # a topic is a theme, in both languages
    assert len(groups) == 3 and sum(max(v.values()) for v in groups.values()) >= 0.9 * len(rows)
    model = mixing.topic_model(corpus(spark).select(F.concat(F.lit("="), "lang").alias("lang"), "text"), 3)
    some = rows[0]
    x = np.zeros(mixing.TERMS)
    import pyarrow as pa
    from lorebase.llm._text import chunks, word_hashes

    for w in some.row.text.split():
        ((_, off, data),) = chunks(pa.array([w]))
        x[int(word_hashes(off, data)[0][0] >> np.uint64(52))] += 1
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * model["idf"]
    score = model["centres"] @ (x / np.linalg.norm(x)) - model["means"]["=" + some.lang]
    assert some.topic == f"topic{int(np.argmax(score))}"


def test_decisions_do_not_depend_on_partitions_and_rare_cells_do_not_cut_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rare = spark.createDataFrame([(9_000_001, "1234 5678 90 | | |", "xx", "rare", 18)], docs.schema)
    rows = mixing.mix(docs.unionByName(rare)).collect()
    assert sum(r.tokens * r.probability for r in rows) / sum(r.tokens for r in rows) == pytest.approx(mixing.RETAIN, abs=1e-6)
    assert {r.row.doc_id: r.sampled for r in rows} == {r.row.doc_id: r.sampled for r in mixing.mix(rare.unionByName(docs).repartition(7)).collect()}
    assert [r.sampled for r in rows if r.row.doc_id == 9_000_001] == [True] and sum(r.sampled for r in rows) > 0.8 * len(rows)


def test_edges(spark):
    docs = corpus(spark, 20, 3, [*ODD, (9004, "very long " * 200_000, "s1", "en", 0)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 26 and all(r.probability is not None and 0 <= r.probability <= 1 for r in rows)
    assert len({r.sampled for r in rows if r.row.doc_id == 9001}) == 1 and next(r for r in rows if r.row.doc_id == 9004).tokens == 400_000
    assert {(r.source, r.lang) for r in rows if r.row.doc_id in (None, 9001, 9002)} == {(None, None), ("", "en"), ("s1", None)}
    assert mixing.sampled(docs).columns == docs.columns and mixing.mix(docs.limit(0)).collect() == [] and mixing.sampled(docs.limit(0)).collect() == []


def test_topics_are_fitted_to_every_distinct_text(spark, monkeypatch):
    import pyarrow as pa
    from lorebase.llm._text import chunks, word_hashes

    docs = corpus(spark, 2600)
    docs = docs.unionByName(docs.limit(50)).select(F.concat(F.lit("="), "lang").alias("lang"), "text")
    model = mixing.topic_model(docs, 3)
    texts = sorted({(r.lang, r.text) for r in docs.collect()})
    place = {}
    for w in {w for _, t in texts for w in t.split()}:
        ((_, off, data),) = chunks(pa.array([w]))
        place[w] = int(word_hashes(off, data)[0][0] >> np.uint64(52))
    x = np.zeros((len(texts), mixing.TERMS))
    for i, (_, t) in enumerate(texts):
        for w in t.split():
            x[i, place[w]] += 1
    assert model["idf"] == pytest.approx(np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))) + 1, abs=1e-5)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * model["idf"]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = np.array([lang for lang, _ in texts])
    for name in ("=en", "=fr"):
        mean = x[langs == name].mean(axis=0)
        assert model["means"][name] == pytest.approx(model["centres"] @ mean, abs=1e-5)
        x[langs == name] -= mean
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.argmax(x @ model["centres"].T, axis=1)
    sums = np.stack([x[own == j].sum(axis=0) for j in range(3)])
    assert model["centres"] == pytest.approx(sums / np.linalg.norm(sums, axis=1, keepdims=True), abs=1e-4)
    assert (np.diff(np.bincount(own)) <= 0).all()
    # many languages are taken in blocks, to the same centres
    monkeypatch.setattr(mixing, "MEANS", 1)
    monkeypatch.setattr(mixing, "MOST_SEEN", 5)
    again = mixing.topic_model(docs.repartition(6), 3)
    assert again["centres"] == pytest.approx(model["centres"], abs=1e-5) and sorted(again["means"]) == sorted(model["means"])


def test_folded_passes_give_the_same_topics(spark, monkeypatch):
    rows = spark.createDataFrame([(f"={i % 2}", f"w{i % 5} w{i % 7} x{i} y{i % 3}") for i in range(400)], "lang string, text string").repartition(9)
    direct = mixing.topic_model(rows, 4)
    monkeypatch.setattr(mixing, "DIRECT", 3)
    folded = mixing.topic_model(rows, 4)
    assert (direct["centres"] == folded["centres"]).all() and (direct["idf"] == folded["idf"]).all() and direct["means"].keys() == folded["means"].keys()
