"""Personal data in texts by weak supervision: labelers vote on candidate spans, a classifier decides.

Four kinds of spans: email addresses, IP addresses, payment cards and phone numbers. The base patterns find the plain
forms. Wider patterns find candidates beside them: parts of a number that the base pattern took together with its
neighbour and dropped, addresses with letters of any script, written-out or defanged ones, IPv6, phone numbers without a
plus. On every candidate, base span or not, LABELERS vote for (1), against (-1) or not at all (0): the written form
(regular expressions), the checksum or number of digits, gazetteers (top-level domains, issuers of cards, calling codes,
reserved address ranges), key words before and after (context), the characters at the edges, other candidates near by,
and the variety of the digits.

Expectation-maximisation (Dawid and Skene, abstentions being a third vote) estimates for each kind how reliable each
labeler is and how many candidates are real, starting from what is taken to hold (a checksum is seldom wrong). It needs only how often each combination of votes occurs, which Spark counts
over all documents: KINDS x 3^8 rows at the very most come to the driver. The posteriors are soft labels for a logistic
regression on the spans' features (form, checks, digits, edges, hashed neighbouring words); it is fitted to up to
FIT_SPANS distinct combinations of features with their counts, all of them if there are not more, otherwise those with
the least hashes. This bound is the parameter fit_spans, and the only one. A candidate whose probability is THRESHOLD
or more is added, unless it overlaps a base span or an added one that is more probable. Base spans always stay.

Scale: texts are read once, and nothing of them is shuffled but counts of votes and features. Candidates are written once
(a row for each document), so a lost executor costs a re-read. Every scan of a text is linear in its length. Workers get
FEATURES weights.

Cases: a null text is empty, without spans. Rows with equal or null ids are worked on one by one. With no candidates
nothing is fitted or added. Positions are code points, ends exclusive. Empty tables give no rows. Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, saved

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "before", "after", "edges", "company", "variety")
THRESHOLD = 0.5
FIT_SPANS = 20_000
#: Places of hashed features.
FEATURES = 1 << 12
#: Characters around a span in which context and company are looked for.
CONTEXT, COMPANY = 48, 120
#: What is taken to hold before any vote is seen, and the number of spans of each sort that it counts for: how probable
#: the votes (-1, 0, 1) of each labeler are on false and on real spans.
PRIOR_SPANS = 30
_PRIOR = np.array([
    [[0.30, 0.40, 0.30], [0.70, 0.20, 0.10], [0.50, 0.30, 0.20], [0.20, 0.75, 0.05], [0.20, 0.75, 0.05], [0.30, 0.20, 0.50], [0.02, 0.80, 0.18], [0.15, 0.83, 0.02]],
    [[0.05, 0.25, 0.70], [0.02, 0.08, 0.90], [0.10, 0.10, 0.80], [0.03, 0.67, 0.30], [0.03, 0.67, 0.30], [0.03, 0.07, 0.90], [0.02, 0.50, 0.48], [0.02, 0.96, 0.02]],
])

# Names and numbers that the gazetteer labelers know.
_DOMAINS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "online", "site", "shop", "cloud", "email", "tech"}
#: (first digits from, to, lengths) of card issuers.
_ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)), (3528, 3589, (16,)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (62, 62, (16, 17, 18, 19)))
#: Calling codes of one and of two digits; all others have three.
_CALLING_1 = {"1", "7"}
_CALLING_2 = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_CALLING_3 = {"21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "80", "85", "87", "88", "96", "97", "99"}
#: (address, leading bits) of ranges that are nobody's.
_RESERVED = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))
_NEAR = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt", "write", "mailto"},
    "ip": {"ip", "ipv4", "ipv6", "host", "server", "client", "address", "addr", "adresse", "login", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "cc", "tarjeta", "carte", "karte", "kreditkarte"},
    "phone": {"tel", "phone", "telephone", "call", "mobile", "cell", "fax", "teléfono", "téléphone", "telefon", "handy", "whatsapp", "sms", "contact"},
}
_AGAINST = {"version", "v", "release", "build", "order", "invoice", "isbn", "issn", "sku", "serial", "token", "hash", "commit", "checksum", "figure", "section", "licence", "license", "equation", "row", "total"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]++")

_MARK = r"(?:\[ ?{0} ?\]|\( ?{0} ?\)|\{{ ?{0} ?\}})"
#: Wider patterns by kind; each begins at a place that is rare in prose.
_WIDE = {
    "email": [
        re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}} ?{_MARK.format('at')} ?[\w-]{{1,63}}(?: ?(?:{_MARK.format('dot')}|\.) ?[\w-]{{1,63}}){{1,5}}", re.I),
        re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{1,63}){1,5}(?!\w)", re.I),
        re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?@ ?[\w-]{1,63}(?:\.[\w-]{1,63}){1,5}"),
    ],
    "ip": [
        re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9A-Za-z])"),
        re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
        re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    ],
    "card": [re.compile(r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")],
    "phone": [
        re.compile(r"\+[0-9]{1,3}(?:[ -]?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}|(?:\.[0-9]{2,4}){2,4})(?!\.?[0-9])"),
        re.compile(r"(?<![0-9A-Za-z.+-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9A-Za-z])"),
        re.compile(r"(?<![0-9A-Za-z)])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
        re.compile(r"(?<![0-9A-Za-z.+)-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9A-Za-z.-])"),
    ],
}
#: A text without any of these has no candidate.
_ANY = r"[0-9@:]|(?i)[\[({] ?at ?[\])}]| dot "


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within each kind."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            end = domain.end()
        at = text.find("@", at + 1)
    for m in _QUAD.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _NUMBER.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PLUS.finditer(text):
        found = m[0].rstrip(" ().-")
        if len(found) >= 4 and 9 <= len(_digits(found)) <= 15:
            yield "phone", m.start(), m.start() + len(found)


def wide_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the wider patterns."""
    low = text.lower()
    dot, at, colon, mark = " dot " in low, "@" in text, "::" in text or text.count(":") >= 7, re.search(r"[\[({] ?at ?[\])}]", low)
    digit = re.search("[0-9]", text)
    use = {"email": [bool(mark), dot, at], "ip": ["[.]" in text, colon, colon], "card": [digit], "phone": [digit] * 4}
    for kind, patterns in _WIDE.items():
        for pattern, used in zip(patterns, use[kind], strict=True):
            if used:
                for m in pattern.finditer(text):
                    yield kind, m.start(), m.end()


def _issuer(digits: str) -> str:
    for low, high, sizes in _ISSUERS:
        if low <= int(digits[: len(str(low))]) <= high and len(digits) in sizes:
            return f"issuer{low}"
    return ""


def _calling(digits: str) -> str:
    return next((c for n, held in ((1, _CALLING_1), (2, _CALLING_2), (2, _CALLING_3)) if (c := digits[:n]) in held), "")


def _reserved(value: str) -> bool:
    number = 0
    for part in value.split("."):
        number = number * 256 + min(255, int(part))
    for address, bits in _RESERVED:
        low = 0
        for part in address.split("."):
            low = low * 256 + int(part)
        if number >> (32 - bits) == low >> (32 - bits):
            return True
    return False


def _sign(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def _judged(kind: str, value: str) -> tuple[int, int, int, str]:
    """(form, check, gazetteer, what the gazetteer says) of a span's text."""
    digits = _digits(value)
    if kind == "email":
        plain = re.sub(r"(?i) ?[\[({] ?at ?[\])}] ?| ?@ ?| at ", "@", value, count=1)
        plain = re.sub(r"(?i) ?[\[({] ?dot ?[\])}] ?| dot ", ".", plain)
        local, _, domain = plain.partition("@")
        last = domain.rpartition(".")[2].lower()
        known = last in _DOMAINS or (len(last) == 2 and last.isalpha())
        sound = local[:1] not in ".-" and ".." not in plain and not domain.startswith("-")
        return _sign("@" in value and " " not in value, not sound), _sign(sound and 2 <= len(last) <= 24 and last.isalpha(), True), _sign(known, True), "domain" if known else "none"
    if kind == "ip":
        parts = re.split(r"\[?\.\]?", value)
        if len(parts) != 4:
            full = value.count(":") == 7
            return _sign(full, False), _sign(value.count("::") <= 1 and bool(re.search("[0-9]", value)), True), _sign(value.lower().startswith(("2", "fd")), value == "::"), "six"
        plain = ".".join(parts)
        fine = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        bare = not any(len(p) > 1 and p[0] == "0" for p in parts)
        nobody = fine and _reserved(plain)
        return _sign("[" not in value and bare, not bare), _sign(fine, True), _sign(fine and not nobody, True), "reserved" if nobody else "open"
    if kind == "card":
        issuer = _issuer(digits)
        groups = [len(g) for g in re.split("[ .-]", value)]
        tidy = len(groups) == 1 or groups[:3] == [4, 4, 4] or groups == [4, 6, 5]
        return _sign(tidy, True), _sign(luhn(digits), True), _sign(bool(issuer), True), issuer or "none"
    plus = value.startswith(("+", "00"))
    code = _calling(digits[2 * value.startswith("00") :]) if plus else ""
    return _sign(plus or value.startswith("("), False), _sign(9 <= len(digits) <= 15, True), _sign(bool(code), plus), f"code{code}" if plus else "local"


def _edge(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "word" if c.isalnum() or c == "_" else "mark" if c in ".,;:!?()\"'<>" else "sign"


def candidates(text: str) -> list[tuple[str, int, int, bool, int, list[int]]]:
    """(kind, start, end, whether base, votes, features) of every candidate; a span of both sorts is base.

    votes has one digit to the base 3 for each of LABELERS: the vote plus 1, the first labeler's last.
    """
    found = {(k, s, e): True for k, s, e in base_spans(text)}
    for span in wide_spans(text):
        found.setdefault(span, False)
    order, reach = [], dict.fromkeys(KINDS, 0)
    for span in sorted(found, key=lambda x: (x[1], -x[2])):
        if found[span] or span[2] > reach[span[0]]:  # what lies in another span of its kind is no candidate of its own
            order.append(span)
            reach[span[0]] = max(reach[span[0]], span[2])
    out = []
    for n, (kind, start, end) in enumerate(order):
        value = text[start:end]
        form, check, gazetteer, known = _judged(kind, value)
        before, after = (re.findall(r"[\w-]+", t.lower()) for t in (text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]))
        near, far = set(before[-4:]), set(after[:3])
        left, right = _edge(text[start - 1 : start]), _edge(text[end : end + 1])
        beside = [x for x in (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) if x]
        company = any(o[2] <= start and start - o[2] <= COMPANY or o[1] >= end and o[1] - end <= COMPANY for o in beside)
        digits = _digits(value)
        dull = len(digits) >= 8 and (len(set(digits)) <= 2 or digits in "01234567890123456789" or digits in "98765432109876543210")
        votes = (form, check, gazetteer, _sign(bool(near & _NEAR[kind]), bool(near & _AGAINST)), _sign(bool(far & _NEAR[kind]), bool(far & _AGAINST)), _sign(left in ("end", "space", "mark") and right in ("end", "space", "mark"), left == "word" or right == "word"), _sign(company, False), _sign(False, dull))
        shape = re.sub("[^a9]+", "-", re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", value.lower())))[:24]
        told = [f"form{form}", f"check{check}", f"known{known}", f"size{len(digits)}", f"shape{shape}", f"left{left}", f"right{right}", f"near{bool(near & _NEAR[kind])}", f"against{bool(near & _AGAINST)}", f"dull{dull}"]
        told += [f"before{zlib.crc32(before[-1].encode()) % 64}" if before else "first", f"after{zlib.crc32(after[0].encode()) % 64}" if after else "last"]
        out.append((kind, start, end, found[kind, start, end], sum((v + 1) * 3**i for i, v in enumerate(votes)), sorted({zlib.crc32(f"{kind} {t}".encode()) % FEATURES for t in ("", *told)})))
    return out


_CANDIDATE = "array<struct<kind:string,start:long,end:long,base:boolean,votes:int,features:array<int>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def proposed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found): the candidates of every row."""

    def run(batches):
        names = [f.name for f in _ARROW.value_type]
        for batch in batches:
            texts = batch.column(1)
            some = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(texts[i].as_py())] if s else [] for i, s in enumerate(some)]
            yield pa.record_batch([batch.column(0), pa.array(rows, _ARROW)], names=["id", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, found {_CANDIDATE}")


def unpacked(votes: np.ndarray) -> np.ndarray:
    """The votes plus 1 of each labeler, as columns."""
    return votes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


@dataclass
class Reliabilities:
    """Of one kind the share of real spans, and how probable each vote of each labeler is on false and on real ones."""

    share: float
    vote: np.ndarray  # [real, labeler, vote]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """How probable it is that spans with these unpacked votes are real."""
        at = np.arange(votes.shape[1])
        odds = np.log(self.share / (1 - self.share)) + np.log(self.vote[1][at, votes] / self.vote[0][at, votes]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimated(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Reliabilities:
    """Expectation-maximisation over combinations of votes (unpacked) and how often each occurs; starts from what is taken to hold."""
    real = Reliabilities(0.5, _PRIOR).posterior(votes)
    one_hot = votes[:, :, None] == np.arange(3)
    found = None
    for _ in range(rounds):
        weight = np.stack((counts * (1 - real), counts * real))
        table = np.einsum("yn,nlv->ylv", weight, one_hot) + PRIOR_SPANS * _PRIOR
        found = Reliabilities(float((weight[1].sum() + 1) / (counts.sum() + 2)), table / table.sum(axis=2, keepdims=True))
        new = found.posterior(votes)
        if np.abs(new - real).max(initial=0.0) < 1e-9:
            break
        real = new
    return found


def reliabilities(found: DataFrame) -> dict[str, Reliabilities]:
    """Estimates for each kind, from the counts of all combinations of votes."""
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()  # KINDS x 3^8 rows at the most
    out = {}
    for kind in KINDS:
        own = sorted((r.votes, r.n) for r in counted if r.kind == kind)
        if own:
            out[kind] = estimated(unpacked(np.array([v for v, _ in own])), np.array([n for _, n in own], float))
    return out


def examples(found: DataFrame, fit_spans: int) -> list[tuple[str, int, list[int], int]]:
    """(kind, votes, features, count) of the distinct combinations with the least hashes, up to fit_spans."""
    every = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    every = saved(every.withColumn("hash", F.xxhash64("kind", "votes", "features")), "examples")
    n = every.count()
    if n > fit_spans:  # about fit_spans of them, evenly over the hash's range
        every = every.where(F.pmod("hash", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * fit_spans / n)))
    rows = sorted((r.hash % (1 << 30), r.hash, r.kind, r.votes, r.features, r.n) for r in every.collect())  # some 1.2 fit_spans
    return [r[2:] for r in rows[:fit_spans]]


def classifier(rows: list[tuple[str, int, list[int], int]], known: dict[str, Reliabilities], rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the features of a logistic regression on soft labels, each row counting by the log of its count."""
    weights = np.zeros(FEATURES)
    if not rows:
        return weights
    label = np.array([known[kind].posterior(unpacked(np.array([votes])))[0] for kind, votes, _, _ in rows])
    size = np.array([len(f) for _, _, f, _ in rows])
    flat, first = np.concatenate([f for _, _, f, _ in rows]).astype(np.int64), np.concatenate(([0], np.cumsum(size)))[:-1]
    of = np.repeat(np.arange(len(rows)), size)
    count = 1 + np.log(np.array([n for *_, n in rows], float))
    count /= count.sum()
    scale = np.sqrt(np.bincount(flat, weights=count[of], minlength=FEATURES)) + 1e-3  # rare features get as large steps as common ones
    past = np.zeros(FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.add.reduceat(weights[flat], first)))
        slope = np.bincount(flat, weights=(count * (p - label))[of], minlength=FEATURES) + decay * scale * weights / len(rows) ** 0.5
        past = 0.9 * past + slope / scale
        weights = weights - 0.2 * past
    return weights


def decided(found: list[dict], weights: np.ndarray, threshold: float) -> list[dict]:
    """The base spans and those added, by kind as listed and then start, with their probabilities."""
    scored = [{"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"], "score": float(1 / (1 + np.exp(-np.clip(weights[c["features"]].sum(), -500, 500))))} for c in found]
    kept = [c for c in scored if c["base"]]
    taken = sorted((c["start"], c["end"]) for c in kept)
    for c in sorted((c for c in scored if not c["base"] and c["score"] >= threshold), key=lambda c: (-c["score"], c["start"] - c["end"], c["start"], KINDS.index(c["kind"]))):
        if not any(s < c["end"] and c["start"] < e for s, e in taken):
            kept.append(c)
            taken.append((c["start"], c["end"]))
    return sorted(kept, key=lambda c: (KINDS.index(c["kind"]), c["start"]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_spans: int = FIT_SPANS, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end, base, score>>) of every row; reliabilities and weights come from all rows."""
    found = saved(proposed(docs, id_col, text_col), "candidates")
    known = reliabilities(found)
    weights = classifier(examples(found, fit_spans), known)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([decided(c, weights, threshold) for c in batch.column(1).to_pylist()], kind)], names=["id", "spans"])

    out = found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = s["end"]
    return "".join([*out, text[at:]])


def _listed(spans):
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document of documents; the counts are those of base spans."""
    found = detect(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
