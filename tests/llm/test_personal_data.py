import hashlib
import random
import re

import numpy as np
from lorebase.llm import personal_data as P
from pyspark.sql import functions as F

some = random.Random(11)
#: The base patterns as the contract states them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            fine = {"email": lambda _: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda _, digits=digits: 13 <= len(digits) <= 19 and checked(digits), "phone": lambda _, digits=digits: 9 <= len(digits) <= 15}
            if fine[kind](m[0]):
                out.append((kind, m.start(), m.end()))
    return out


def card(prefix="4", size=16):
    body = prefix + "".join(some.choice("0123456789") for _ in range(size - 1 - len(prefix)))
    return next(body + c for c in "0123456789" if checked(body + c))


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def noise():
    return "".join(some.choice(["a", "Zé", "@", "@x.y", ".", "-", " ", "+", "+1", "(", ")", "0", "255", "7", "1.2.3.4", "4 4", "%", "\n", "١", "_"]) for _ in range(some.randrange(60)))


def test_base_spans_equal_the_patterns():
    for _ in range(3000):
        text = noise()
        assert list(P.base_spans(text)) == plain(text), text
    for text in ("a@b.c@d.e", "x@a@b.co", "1.2.3.4.5.6.7.8", "0001.2.3.0255", "256.1.1.1", "+12", "+1 2", "+1  ", f"{card()} {card()}", "+1 (743) 555-3824 9", "é@x.com", "a@-.-"):
        assert list(P.base_spans(text)) == plain(text), text


def test_scans_are_linear_in_long_texts():
    for text in ("1" * 400_000, "a" * 400_000, "a@" * 100_000, "1." * 200_000, "+1" + "(" * 400_000, "+1 " * 130_000, "1 " * 200_000, "a." * 200_000 + "@", ": " * 200_000, "a:" * 200_000, "[at]" * 100_000, " at a dot" * 40_000):
        P.candidates(text)


def test_checks_and_gazetteers():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112") and all(P.luhn(card(size=n)) for n in range(13, 20))
    assert P._issuer("4111111111111111") and P._issuer("378282246310005") and not P._issuer("9111111111111111") and not P._issuer("5911111111111111")
    assert P._reserved("10.1.2.3") and P._reserved("172.31.0.1") and P._reserved("239.1.1.1") and not P._reserved("172.32.0.1") and not P._reserved("8.8.8.8")
    assert P._calling("447700900123") == "44" and P._calling("17435553824") == "1" and P._calling("351912345678") == "35" and not P._calling("999")[2:]


def test_estimates_recover_reliabilities():
    rng = np.random.default_rng(4)
    real = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.6, 0.5, 0.5, 0.75])
    says = np.where(rng.random((20_000, 8)) < right, real[:, None], ~real[:, None])
    votes = np.where(rng.random((20_000, 8)) < 0.2, 1, np.where(says, 2, 0))
    distinct, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = P.estimated(distinct, counts.astype(float))
    assert abs(found.share - 0.3) < 0.03
    assert np.abs(found.vote[1][:, 2] - 0.8 * right).max() < 0.05 and np.abs(found.vote[0][:, 0] - 0.8 * right).max() < 0.05
    true = np.array([[0.8 * right, 0.2 + 0 * right, 0.8 - 0.8 * right], [0.8 - 0.8 * right, 0.2 + 0 * right, 0.8 * right]]).transpose(0, 2, 1)
    judged = lambda r: ((r.posterior(distinct) > 0.5)[at] == real).mean()
    assert judged(found) > judged(P.Reliabilities(0.3, true)) - 0.003 > 0.95  # as good as with the true reliabilities


def corpus(n=400):
    """Texts with real and false candidates, and what of them is real."""
    out = []
    for i in range(n):
        kind = i % 8
        false = "".join(some.choice("0123456789") for _ in range(16))
        while checked(false):
            false = some.choice("123") + false[1:-1] + some.choice("0123456789")
        two = f"{card()} {card()}"
        phone, ip = f"+1 ({some.randrange(200, 999)}) 555-{some.randrange(1000, 9999)}", ".".join(str(some.randrange(1, 224)) for _ in range(4))
        text = ["ther in {} of".format(two), f"call {phone} {ip} now", f"item {false} in the box", f"ther {card()} that", f"mail me at ann.{i} [at] host{i}.org please", f"nothing to see, version {i}.2", f"und.{i}@mail7.example.com ist", f"le {phone} de"][kind]
        out.append((i, kind, text, two, phone, false))
    return out


def test_what_the_base_misses_is_added_and_decoys_are_not(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[2], "x") for r in rows], "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: r.spans for r in P.detect(docs).collect()}
    assert len(got) == len(rows)
    hit = {k: 0 for k in range(8)}
    for i, kind, text, two, phone, _ in rows:
        spans = [(s.kind, text[s.start : s.end]) for s in got[i]]
        base = [(s.kind, s.start, s.end) for s in got[i] if s.base]
        assert base == plain(text)
        assert all(a.end <= b.start or b.end <= a.start for a in got[i] for b in got[i] if not a.base and a != b)
        added = [(s.kind, text[s.start : s.end]) for s in got[i] if not s.base]
        if kind == 0 and not base:
            hit[0] += added == [("card", x) for x in two.split()]
        elif kind == 1:
            hit[1] += added == [("phone", phone)]
        elif kind == 4:
            hit[4] += [a for a, _ in added] == ["email"]
        else:
            assert not added, (text, added)
            hit[kind] += bool(spans) == (kind not in (2, 5))
    assert hit[1] == hit[4] == 50 and hit[0] >= 40, hit
    text = rows[1][2]
    assert P.redacted(text, [s.asDict() for s in got[1]]) == "call [phone] [ip] now"


def test_query_on_given_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    table = P.query(spark, "/root/testdata/sf0.01").collect()
    assert len(table) == len(docs)
    for r in table:
        base = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in P.KINDS)
        spans = [x for x in r.spans.split(",") if x]
        assert set(listed(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
        order = [(P.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)
        if not re.search("[0-9]", docs[r.doc_id]):
            assert not spans


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a@b.co é +1 555 555 5555 😀 10.0.0.1", 0), (2, "😀" * 10 + "a@b.co", 0), (3, "x" * 200_000 + "@y.zz", 0), (2, "😀" * 10 + "a@b.co", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found long")
    got = P.detect(docs).select("doc_id", P._listed(F.col("spans")).alias("spans")).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, listed(plain(rows[2][1]))), (1, ""), (1, ""), (2, "email:10:16"), (2, "email:10:16"), (3, "email:0:200005")]
    assert P.detect(docs.where("false")).collect() == []


def test_a_bounded_fit_takes_the_least_hashes(spark):
    docs = spark.createDataFrame([(r[0], r[2]) for r in corpus(200)], "doc_id long, text string")
    found = P.saved(P.proposed(docs, "doc_id", "text"), "candidates")
    every, few = P.examples(found, 10_000), P.examples(found, 20)
    assert 15 <= len(few) <= 20 and every[: len(few)] == few and sum(n for *_, n in every) == sum(len(r.found) for r in found.collect())
    assert P.examples(found, 20) == few
