import re

from lorebase.llm import quality

SPACE = re.compile("[\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1}
    repeat = len({i + k for i, x in enumerate(windows) if x in twice for k in range(8)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat


def test_counts_equal_plain_ones(spark):
    texts = [None, "", " \n\t", "a b c", "x " * 7, "x " * 8, "x " * 9, "x " * 40, "a\na\n \n b\n b\nA", "é # 中|<>&*$%\x0b\x0cq", "a b c d e f g h i a b c d e f g h", ("one two three four five six seven eight nine " * 3) + "tail", "  lead trail  ", "w" * 9000 + " " + "z y " * 3000, "\u00a0 \u2003x"]
    rows = [(i, t, "src", 0, "clash") for i, t in enumerate(texts)] + [(None, "a b", None, 1, "q"), (0, None, "", 2, "q"), (0, None, "", 2, "q")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_lines_above_the_limit_deplete_all_but_one(spark):
    spell = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  digits would be normalised
    own = lambda i: " ".join(f"w{spell(i)}x{spell(k)}" for k in range(30))
    shared = " ".join(f"common{k}" for k in range(100))
    rows = [(i, f"{own(i)}\n{shared} page {i}", "a") for i in range(40)]  # digits are normalised
    rows += [(100 + i, f"{own(100 + i)}\n{shared} page 1", "b") for i in range(20)]  # at the limit, not above
    rows += [(200 + i, f"{own(200)}\n{own(201)}", "c") for i in range(90)]  # copies are one text
    rows += [(300 + i, f"{own(300 + i)}\n{own(400 + i)}\n{own(500 + i)}\n{shared} page 2", "a") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(frame).collect() if r.kept}
    assert len([d for d in kept if d < 40]) <= 1 and all(100 + i in kept for i in range(20)) and all(200 + i in kept for i in range(90)) and all(300 + i in kept for i in range(3))
    assert {r.doc_id for r in quality.cleaned(frame).collect()} == kept
    assert quality.judge(frame.limit(0)).collect() == [] and quality.cleaned(frame).columns == frame.columns


def test_kept_texts_lose_the_lines_above_the_limit(spark):
    spell = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    own = lambda i: " ".join(f"w{spell(i)}x{spell(k)}" for k in range(30))
    rows = [(i, f"{own(i)}\n\nRead  more on page {i}\n{own(50 + i)}", "a", i) for i in range(25)]
    rows += [(100 + i, f"{own(100 + i)}\nread more on page 7", "b", i) for i in range(20)]  # at the limit
    got = {r.doc_id: r.text for r in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string, lines int").repartition(3)).collect()}
    whole = {i: t for i, t, *_ in rows}
    assert set(got) == set(whole) and all(got[100 + i] == whole[100 + i] for i in range(20))
    assert sum(got[i] == whole[i] for i in range(25)) == 1  # the keeper
    assert all(got[i] in (whole[i], f"{own(i)}\n\n{own(50 + i)}") for i in range(25))


def test_a_null_source_is_a_host_of_its_own(spark):
    spell = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    line = lambda i: " ".join(f"w{spell(i)}x{spell(k)}" for k in range(9))
    shared = " ".join(f"common{spell(k)}" for k in range(60))
    # 15 texts of no source and 15 of the empty one: neither host has more than LINE_LIMIT
    rows = [(i, f"{line(i)}\n{shared}", None if i % 2 else "") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.kept for r in quality.judge(frame).collect()) and quality.cleaned(frame).count() == 30
    more = spark.createDataFrame([(100 + i, f"{line(100 + i)}\n{shared}", None) for i in range(10)], frame.schema)
    kept = {r.doc_id for r in quality.judge(frame.unionByName(more)).collect() if r.kept}
    assert sum(d % 2 == 1 or d >= 100 for d in kept) == 1 and all(d in kept for d in range(0, 30, 2))


def test_very_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(1, text, "s"), (2, text.replace(" ", "\n"), "s"), (3, "same words " * 60_000, "s")], "doc_id long, text string, source string")).collect()}
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[1].kept) == (120_000, 0, True) and (rows[2].n_dup_lines, rows[2].kept) == (0, True)
    assert (rows[3].n_repeat_words, rows[3].base_failed, rows[3].kept) == (120_000, True, False)
