import datetime
import random
from decimal import ROUND_CEILING, Decimal

import pytest
from lorebase.errors import ConceptError
from lorebase.functions import edit_distance, frontmatter, markdown, paths, sections, yaml_core
from lorebase.operators import prepare
from pyspark.sql import functions as F

some = random.Random(19)


def instants(n):
    """Texts by the rules, with what they mean: date, time, a fraction that counts up to the next millisecond, an offset."""
    out = {}
    for _ in range(n):
        day = datetime.date(1, 1, 1) + datetime.timedelta(days=some.randrange(2, 3_652_000))
        h, m, s = some.randrange(24), some.randrange(60), some.randrange(60)
        fraction = some.choice(["", "." + "".join(some.choice("0123456789") for _ in range(some.randrange(1, 7)))])
        sign, oh, om = some.choice("+-"), some.randrange(24), some.randrange(60)
        offset = some.choice(["Z", f"{sign}{oh:02}:{om:02}"])
        moved = 0 if offset == "Z" else (oh * 60 + om) * (60_000 if sign == "+" else -60_000)
        whole = ((day - datetime.date(1970, 1, 1)).days * 86_400 + h * 3600 + m * 60 + s) * 1000
        out[f"{day.year:04}-{day.month:02}-{day.day:02}T{h:02}:{m:02}:{s:02}{fraction}{offset}"] = whole + int((Decimal("0" + (fraction or ".0")) * 1000).to_integral_value(ROUND_CEILING)) - moved
    return out


def wrong_instants():
    """Texts that break one rule each."""
    plain = "2013-{}-{}T{}:{}:{}{}"
    fine = ["07", "19", "08", "45", "12", "Z"]
    for i, bad in ((0, "13"), (0, "00"), (0, "7"), (1, "32"), (1, "00"), (2, "24"), (2, "8"), (3, "60"), (4, "60"), (5, ""), (5, "z"), (5, "+24:00"), (5, "+05:60"), (5, "+0500"), (5, ".Z"), (5, ".5 Z"), (5, " Z")):
        yield plain.format(*fine[:i], bad, *fine[i + 1 :])
    yield from (f"{y}-02-{d}T01:02:03Z" for y, d in ((1700, 29), (2015, 29), (2100, 29), (2012, 30)))
    yield from ("2013-09-31T01:02:03Z", "2013-07-19", "T01:02:03Z", "2013-07-19 08:45:12Z", "x")


TIMES = instants(60) | {"2400-02-29T12:00:00Z": 13574606400000, "0000-03-01T00:00:00Z": -62162035200000} | dict.fromkeys(wrong_instants())
PATHS = {
    "./identity//guide.md": ("identity/guide.md", None), "../secret.md": (None, "<input>"), "./notes.MD": (None, "notes.MD"), "./nested//index.md": (None, "nested/index.md"),
    "/a.md": (None, "<input>"), "C:x.md": (None, "<input>"), "\\\\host\\a.md": (None, "<input>"), "a/..": (None, "<input>"), "a/../b.md": (None, "<input>"), "a.md/": (None, "<input>"), "a/.": (None, "<input>"), "": (None, "<input>"),
    "a\\b.md": ("a\\b.md", None), ".hidden.md": (".hidden.md", None), "log.md": (None, "log.md"), "x/..y/é.md": ("x/..y/é.md", None),
}
ACTORS = {"human:ann": True, "process:x y": False, "team:x": False, "tool/v1": True, "a/b/c": False, "human:": False, "human:﻿": False, "/x": False, "x/": False}


@pytest.mark.parametrize("text,millis", TIMES.items())
def test_timestamps(text, millis):
    assert frontmatter.epoch_millis(text) == millis


def test_columns_agree_with_values(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", frontmatter.timestamp_millis(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == TIMES
    rows = spark.createDataFrame([(t,) for t in PATHS], "t string").select("t", paths.normalized(F.col("t")).alias("n")).collect()
    assert {r.t: (r.n.path, r.n.error_path) for r in rows} == PATHS
    assert all(r.n.document_id == (r.n.path and r.n.path[:-3]) for r in rows)
    names = ["nested/derived-title", "a/__b--c", "éa", "😀-x", "x", "-"]
    rows = spark.createDataFrame([(t,) for t in names], "t string").select("t", paths.titled(F.col("t")).alias("title")).collect()
    assert {r.t: r.title for r in rows} == {t: paths.fallback_title(t) for t in names} and paths.fallback_title(names[0]) == "Derived title"
    rows = spark.createDataFrame([(t,) for t in ACTORS], "t string").select("t", F.col("t").rlike(frontmatter.ACTOR).alias("a")).collect()
    assert {r.t: r.a for r in rows} == ACTORS == {t: frontmatter.is_actor(t) for t in ACTORS}


@pytest.mark.parametrize("path,found", PATHS.items())
def test_paths(path, found):
    if found[0]:
        assert paths.normalize(path) == found[0]
    else:
        with pytest.raises(ConceptError) as e:
            paths.normalize(path)
        assert (e.value.code, e.value.path, e.value.field) == ("ERR_FIELD", found[1], "path")


@pytest.mark.parametrize("text,found", [("---\na: b\n---\nbody\n", ("a: b", "body\n", 4)), ("---\r\na: b\r\n---\r", ("a: b", "", 3)), ("---\n---\nx", ("", "x", 3)), ("--- \na\n---\n", None), ("---\na: b\n--- \nx", None), ("﻿---\na: b\n---\n", None), ("---\ra: b\r---\r", None), ("a: b", None)])
def test_envelope(text, found):
    assert frontmatter.split(text) == found


def loads(text):
    try:
        yaml_core.load(text)
        return True
    except yaml_core.YamlError:
        return False


def test_yaml_values_and_limits():
    # the core schema: no booleans but true and false, no octal by a leading zero, no times
    core = {"no": "no", "off": "off", "0077": 77, "0o77": 63, "0xBEEF": 48879, "-2.5e-2": -0.025, "-.inf": float("-inf"), "null": None, "True": True, "1999-12-31T08:15:00Z": "1999-12-31T08:15:00Z", "12:45": "12:45", '"q r"': "q r", "!kind 7": 7}
    assert yaml_core.load(f"all: [{', '.join(core)}]") == {"all": list(core.values())}
    assert yaml_core.load("first: &one [p, {q: r}]\nsecond: {again: *one}") == {"first": ["p", {"q": "r"}], "second": {"again": ["p", {"q": "r"}]}}
    for bad in ("loop: &l [*l]", "when: !!timestamp 1999-12-31", "raw: !!binary d29yZA==", 'half: "\\uDC00"', "7: seven", "null: x", "k: p\nk: q", "o: {m: {n: 1, n: 2}}", "p: q\n---\nr: s", "# nothing", "{", "? {a: b}\n: c"):
        assert not loads(bad), bad
    for text, fine in (("x" * (1 << 20), True), ("x" * ((1 << 20) + 1), False), ("[" * 63 + "0" + "]" * 63, True), ("[" * 64 + "0" + "]" * 64, False), (f"[{','.join(['0'] * 99_999)}]", True), (f"[{','.join(['0'] * 100_000)}]", False), (f"[&a {'x' * 1024},{','.join(['*a'] * 8190)}]", True), (f"[&a {'x' * 1024},{','.join(['*a'] * 8191)}]", False)):
        assert loads(text) == fine
    assert not loads("a0: &a0 [x]\n" + "".join(f"a{i}: &a{i} [*a{i - 1}, *a{i - 1}]\n" for i in range(1, 40)))
    assert not loads("a0: &a0 x\n" + "".join(f"a{i}: &a{i} [*a{i - 1}]\n" for i in range(1, 64)))


def fields(yaml):
    found, wrong, *_ = frontmatter.parse(f"---\n{yaml}\n---\nx", "p.md", "P")
    return found, [d["field"] for d in wrong]


@pytest.mark.parametrize("yaml,wrong", [
    ("type: ''", ["type"]), ("title: x", ["type"]), ("type: A\ntitle: 3", ["title"]), ("type: A\ntags: {x: y}", ["tags"]), ("type: A\ntags: [[], red, 2.5, green, true]", ["tags[0]", "tags[2]", "tags[4]"]),
    ("type: A\nsources: [{id: [], resource: ok}, 5, {resource: {}, title: 4}, {resource: s, last_modified: noon, author: nobody, usage_window: {to: late}, usage_count: many}]", ["sources[0].id", "sources[1]", "sources[2].resource", "sources[2].title", "sources[3].author", "sources[3].usage_count", "sources[3].last_modified", "sources[3].usage_window.from", "sources[3].usage_window.to"]),
    ("type: A\nusage_window: 1", ["usage_window"]), ("type: A\ngenerated: {by: x}", ["generated.by"]), ("type: A\ngenerated: {by: 'human:a', at: x}", ["generated.at"]),
    ("type: A\nverified: x", ["verified"]), ("type: A\nverified: [{by: a/b}, 3]", ["verified[0].at", "verified[1]"]), ("type: A\nstatus: Draft", ["status"]), ("type: A\nstale_after: 2026-08-24", ["stale_after"]),
    ("type: Attested Computation", ["runtime"]), ("type: Attested Computation\nruntime: 1", ["runtime"]), ("type: A\nparameters: [{name: n, type: 1, required: yes}]", ["parameters[0].type", "parameters[0].required"]),
    ("type: A\nexecutor: {resource: r, receipt: [a, 1]}", ["executor.receipt[1]"]), ("type: A\nexecutor: {receipt: x}", ["executor.resource", "executor.receipt"]), ("type: A\nattester: {}", ["attester.resource"]),
    ("status: q\ntype: 1\nruntime: 2\ntitle: []", ["type", "title", "status", "runtime"]),
])
def test_diagnostics_and_their_order(yaml, wrong):
    assert fields(yaml)[1] == wrong


def test_defaults_derived_fields_and_trust():
    found, wrong = fields("type: A\nx: {b: [1, é]}\nsources: [{resource: r, id: i, title: t, author: a/b}, {id: lost}]")
    assert wrong == ["sources[1].resource"] and found["source_text"] == "i t a/b r lost" and len(found["sources"]) == 1 and found["extensions"] == '{"x": {"b": [1, "é"]}}'
    assert (found["title"], found["status"], found["trust_tier"], found["staleness_classified"], found["tags"]) == ("P", "stable", "unverified", True, [])
    at = "at: '2026-08-24T10:00:00Z'"
    for given, tier in ((f"[{{by: a/b, {at}}}]", "machine-confirmed"), (f"{{by: 'human:x', {at}}}", "human-reviewed"), ("[]", "unverified"), ("[{by: q}]", None), ("q", None)):
        assert fields(f"type: A\nverified: {given}")[0]["trust_tier"] == tier
    assert fields("type: A\nstale_after: x")[0]["staleness_classified"] is False


def ids(body, title="Document title", line=10):
    return [(s["section_id"], s["heading_path"], s["start_line"], s["end_line"]) for s in sections.sections("d", title, body, line)]


def test_sections():
    assert ids("") == [("d#root", "Document title", 10, 10)]
    assert ids("so far\nso good\n## Ovens\n#### Glaze\nblue\nred\n### Ash\n# Wheels\nspin") == [("d#root", "Document title", 10, 11), ("d#ovens", "Ovens", 12, 12), ("d#ovens-glaze", "Ovens > Glaze", 13, 15), ("d#ovens-ash", "Ovens > Ash", 16, 16), ("d#wheels", "Wheels", 17, 18)]
    assert [i for i, *_ in ids("## Señor?\n## senor\n### Öl & Ruß\n##\n## !!\n- # no\n")] == ["d#sen-or", "d#senor", "d#senor-o-l-ruß", "d#untitled-section", "d#section"]
    for newline in ("\n", "\r\n", "\r"):
        (s,) = sections.sections("d", "t", newline.join(["one", "two", "", "  three "]), 1)
        assert (s["text"], s["start_line"], s["end_line"]) == ("one\ntwo\n\n  three", 1, 4)
    for body, end in (("```\none\n", 5), ("```\none", 5), ("```\none\n```\n", 6)):
        assert ids(body, line=4)[0][2:] == (4, end)


def paragraphs(*sizes):
    return "\n\n".join(" ".join(["word"] * n) for n in sizes)


@pytest.mark.parametrize("sizes,parts", [((100,) * 8, [8]), ((100,) * 7 + (101,), [5, 3]), ((250, 250, 1, 300, 300), [2, 2, 1]), ((300, 300, 249), [1, 2]), ((300, 300, 250), [1, 1, 1]), ((801, 300), [1, 1])])
def test_chunks(sizes, parts):
    found = sections.sections("d", "t", paragraphs(*sizes), 1)
    assert [s["text"].count("\n\n") + 1 for s in found] == parts
    assert [s["section_id"] for s in found] == (["d#root"] if len(parts) == 1 else [f"d#root--part-{k + 1}" for k in range(len(parts))])


@pytest.mark.parametrize("text,plain", [("see [the kiln](/k) or `fire`", "see the kiln or fire"), ("un**believ**able", "unbelievable"), ("_p_ **q** r_s_t __u", "p q r_s_t __u"), ("![img](a 'b') &amp; \\* <b>z</b> <http://x.y>", "img & * z http://x.y"), ("[not a link] ***both***", "[not a link] both"), ("`a``b` ``c`d``", "a``b c`d")])
def test_inline_text(text, plain):
    assert markdown.plain(text) == plain


@pytest.mark.parametrize("body,found", [
    ("a\nb\n===\nc", [(1, 3, 1), (4, 4, 0)]), ("- a\n\n  b\n- c\nlazy\n\nx", [(1, 5, 0), (7, 7, 0)]), ("> q\nlazy\n\n> r", [(1, 2, 0), (4, 4, 0)]), ("    code\n\n    more\nx", [(1, 3, 0), (4, 4, 0)]),
    ("* * *\n- a\n* b", [(1, 1, 0), (2, 2, 0), (3, 3, 0)]), ("<div>\nx\n\ny", [(1, 2, 0), (4, 4, 0)]), ("<!-- a\n\nb -->\ny", [(1, 3, 0), (4, 4, 0)]), ("[a]: /u 'title'\n\n[a]\n---", [(3, 4, 2)]),
    ("> ```\nx", [(1, 1, 0), (2, 2, 0)]), ("p\n2. no list", [(1, 2, 0)]), ("p\n1. list", [(1, 1, 0), (2, 2, 0)]), ("#no\n####### no", [(1, 2, 0)]), ("## x ##", [(1, 1, 2)]), ("~~~\n```\n~~~~\n", [(1, 3, 0)]),
])
def test_root_blocks(body, found):
    assert [(b.first, b.last, b.depth) for b in markdown.blocks(body)] == found


@pytest.mark.parametrize("a,b,prefix,n", [("retrieval", "rertieval", False, 1), ("ca", "abc", False, 3), ("memo", "memory", True, 0), ("mmeo", "memory", True, 1), ("", "abc", False, 3), ("é", "e", False, 1)])
def test_edit_distance(a, b, prefix, n):
    assert edit_distance.distance(a, b, prefix) == n


def test_validation_outcomes(spark):
    rows = [("ok.md", "---\ntype: A\n---\n"), ("half.md", "---\ntype: A\nstatus: x\n---\n"), ("bad.md", "no envelope"), ("untyped.md", "---\ntitle: x\n---\n"), ("../up.md", "")]
    got = {r.path: (r.is_valid, r.is_indexable, [e.field or e.code for e in r.errors]) for r in prepare.validate(spark.createDataFrame(rows, "path string, markdown string")).collect()}
    assert got == {"ok.md": (True, True, []), "half.md": (False, True, ["status"]), "bad.md": (False, False, ["ERR_PARSE"]), "untyped.md": (False, False, ["type"]), "<input>": (False, False, ["path"])}
