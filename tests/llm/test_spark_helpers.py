import random

import pytest
from lorebase.llm import _spark as S
from lorebase.llm import mixing, near_duplicates, quality, url_filters
from pyspark.sql import functions as F

some = random.Random(2)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_joins_as_a_plain_join_and_deals_hot_keys(spark, how):
    keys = [0] * 3000 + [None] * 900 + list(range(1, 400)) * 2
    left = S.saved(spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "k long, x string").repartition(4), "left")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300)] + [(0, "again"), (None, "never")], "k long, y string")
    got = S.spread(left, right, "k", how)
    plain = left.join(right, "k", how)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    two = S.spread(left.withColumn("j", F.lit("a")), right.withColumn("j", F.lit("a")), ["k", "j"], how)
    assert sorted(map(str, two.drop("j").collect())) == sorted(map(str, plain.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        sizes = [r[0] for r in S.spread(left, right.where("y <> 'again'"), "k", how).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 30 and max(sizes) < 500  # 3,000 rows of one key are not in one task


@pytest.mark.parametrize("most", [0, 1, 7, 60, 500, 10_000])
def test_most_frequent_rows_by_a_cut(spark, most):
    n = [some.choice([0, 1, 1, 1, 2, 3, 900, 1023, 1024, 1025, 5000, 5001, 70_000, 1 << 40]) for _ in range(800)]
    counts = spark.createDataFrame(list(enumerate(n)), "key long, n long")
    got = sorted((r.n for r in S.most_frequent(counts, most).collect()), reverse=True)
    assert len(got) <= most and got == sorted(n, reverse=True)[: len(got)]
    left = sorted(n, reverse=True)[len(got) :]
    if left:  # the next ones would be too many, and none of them is as frequent as those taken
        near = [x for x in left if x >> max(0, x.bit_length() - 10) << max(0, x.bit_length() - 10) == left[0] >> max(0, left[0].bit_length() - 10) << max(0, left[0].bit_length() - 10)]
        assert len(got) + len(near) > most and (not got or got[-1] > left[0])
    plan = S.most_frequent(counts, most)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_columns_of_any_name_pass_every_stage(spark):
    texts = [" ".join(some.choice("the of and fox dog tree house line word".split()) + str(i % 7) for _ in range(60)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t), i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` string")
    for stage in (quality.cleaned, mixing.sampled, near_duplicates.deduplicated):
        out = stage(docs)
        assert out.columns == docs.columns and all(r["a.b"] == r.doc_id and r["c`d"] == "x" for r in out.collect())


def test_longer_hosts_win_between_rules_of_one_length(spark):
    pages = spark.createDataFrame([(1, "http://a.com/aaaaaa"), (2, "http://xx.com/aaaaaa"), (3, None), (4, None)] + [(5, "http://a.com/aaaaaa")] * 300, "page_id long, url string")
    judged = lambda rules: {(r.page_id, r.rule, r.verdict) for r in url_filters.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert judged([("com", "/aaaaa", "allow"), ("a.com", "/aaa", "block")]) == {(1, "a.com/aaa", "block"), (5, "a.com/aaa", "block"), (2, "com/aaaaa", "allow"), (3, None, "allow"), (4, None, "allow")}
    assert judged([("com", "/aaaaaa", "allow"), ("xx.com", "/aaa", "block")]) == {(1, "com/aaaaaa", "allow"), (5, "com/aaaaaa", "allow"), (2, "xx.com/aaa", "block"), (3, None, "allow"), (4, None, "allow")}
