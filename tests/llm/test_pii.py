"""Personal data: the strict spans against plain regular expressions, what the trees add by cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from dockpulse.llm import pii, queries

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def passes(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if passes(k, m.group())]


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def read(spans):
    parts = [s.split(":") for s in spans.split(",") if s]
    return [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in parts]


def check(rows, texts):
    """Counts and digests are those of the plain patterns; added spans are in order, inside the text and beside no other."""
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)], r
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        spans = read(r.spans)
        assert spans == sorted(set(spans)) and set(base) <= set(spans)
        added = set(spans) - set(base)
        assert r.n_added == len(added)
        for k, s, e in added:
            assert 0 <= s < e <= len(texts[r.doc_id])
            assert not any(s < y and x < e for c in spans for _, x, y in [c] if c != (k, s, e))


def card(rng, size=16):
    body = "".join(rng.choice("0123456789") for _ in range(size - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def corpus(n=400):
    """Texts with strict spans of all kinds, numbers that fail their checks, and a few spans that only the trees can find."""
    rng, texts = random.Random(2), {}
    for i in range(n):
        words = [rng.choice(["the", "Über", "où", "x", "日本", "and,", "end."]) for _ in range(30)]
        some = [
            f"{rng.choice(['jo', 'Al.B', 'q_w'])}.{i}@mail{i % 9}.example.com",
            f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
            f"{rng.randrange(256, 999)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
            card(rng),
            "-".join(re.findall("....", card(rng))),
            str(int(card(rng)) + rng.randrange(1, 9)),
            f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
            str(rng.randrange(10**6, 10**7)),
            str(rng.randrange(10**9, 10**10)),
        ]
        for s in rng.sample(some, 3):
            words.insert(rng.randrange(1, len(words)), s)
        texts[i] = " ".join(words)
    return texts


ODD = {
    1000: None, 1001: "", 1002: "é" * 5 + "a@b.c", 1003: "x@y.com_z@w.org", 1004: "a@b..c @x.y a@b", 1005: "1.2.3.4.5.6.7.8.9 256.1.1.1 00255.0.0.00001",
    1006: "+1+22 (333) 444-5555 +12 +123456789012345678", 1007: "4111 1111 1111 1111", 1008: "4111-1111 1111-11114111 1111 1111 1111", 1009: "a\x01b@c.d\x01 1\x01.2",
    1010: "a.b" * 40_000 + "@" + "c.d-" * 20_000 + "e", 1011: "7" * 10_000 + " " + "1." * 5_000, 1012: "+1 " * 3000 + "5", 1013: "a@b.cc " * 400,
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    texts = corpus() | ODD
    cards = [card(rng) for _ in range(3)]
    texts |= {2000: f"see {cards[0]} 1234567 there", 2001: f"see {cards[1]} {cards[2]} there", 2002: "call (212) 555-7788 now", 2003: "only 1234567890123456 here", 2004: "nothing 12.5 of 1,000"}
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in texts.items()], "doc_id bigint, text string, uid string, kind int")
    found = pii.scan(frame.repartition(4)).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    return texts, {r.doc_id: r for r in found}


def test_strict_spans_are_those_of_the_plain_patterns(rows):
    texts, found = rows
    check(found.values(), texts)


def test_added_spans(rows):
    texts, found = rows
    span = lambda i, part: (texts[i].index(part), texts[i].index(part) + len(part))
    one, two = texts[2001].split()[1:3]
    assert read(found[2000].spans) == [(2, *span(2000, texts[2000].split()[1]))]
    assert read(found[2001].spans) == [(2, *span(2001, one)), (2, *span(2001, two))]
    assert read(found[2002].spans) == [(3, *span(2002, "(212) 555-7788"))]
    assert found[2003].spans == found[2004].spans == ""


def test_numbers_that_fail_are_left_alone(rows):
    texts, found = rows
    wrong = [s for i, r in found.items() if i < 1000 for k, x, y in set(read(r.spans)) - set(plain(texts[i])) for s in [texts[i][x:y]] if not passes(k, s)]
    assert wrong == []


def test_repeats_and_nulls(spark):
    frame = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc"), (1, None)], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.n_email, r.spans, r.n_added) for r in pii.scan(frame).collect())
    assert found == [(0, 1, "email:0:6", 0), (0, 1, "email:0:6", 0), (1, 0, "", 0)]
    assert pii.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12_pii(spark, sf_dir)
    kinds = dict(found.dtypes)
    assert [kinds[f"n_{k}"] for k in pii.KINDS] == ["bigint"] * 4 and kinds["spans"] == "string"
    found = found.collect()
    assert len(found) == len(texts)
    check(found, texts)


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a@b.cc 1.2.3.4")], "doc_id bigint, text string")
    plan = pii.scan(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_labelled_spans_count(spark, monkeypatch):
    """More spans of one kind and label than any bound on examples there ever was: each is judged once, by trees fitted on the others."""
    seen, plain_thresholds = [], pii.thresholds

    def watched(judged):
        seen.append(sum(r.asDict().get("n", 1.0) for r in judged.where("kind = 1").collect()))
        return plain_thresholds(judged)

    monkeypatch.setattr(pii, "thresholds", watched)
    good = [f"10.{i // 250}.{i % 250}.7" for i in range(3000)]
    bad = [f"999.{i // 250}.{i % 250}.7" for i in range(3000)]
    rows = [(i, f"at {a} not {b} end") for i, (a, b) in enumerate(zip(good, bad))]
    found = pii.scan(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).agg({"n_ip": "sum", "n_added": "sum"}).first()
    assert seen == [6000.0]
    assert found["sum(n_ip)"] == 6000 and found["sum(n_added)"] == 0
