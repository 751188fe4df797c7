from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from dockpulse.llm import licenses

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

TEMPLATES = licenses.TEMPLATES


def bigrams(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return Counter(zip(words, words[1:]))


PLAIN = {name: bigrams(template) for name, template in TEMPLATES.items()}
NAMED = {g: [n for n, b in PLAIN.items() if g in b] for g in set().union(*PLAIN.values())}


def best_runs(text):
    """(-dice, name, start) of each template's best run, by counting every run that has one of its bigrams."""
    words = re.findall("[a-z0-9]+", text.lower())
    pairs = list(zip(words, words[1:]))
    starts = {}
    for at, pair in enumerate(pairs):
        for name in NAMED.get(pair, ()):
            size = sum(PLAIN[name].values())
            starts.setdefault(name, set()).update(range(max(0, at - size + 1), min(at, len(pairs) - size) + 1))
    for name, places in starts.items():
        size = sum(PLAIN[name].values())
        shared, start = min(((-sum((Counter(pairs[s : s + size]) & PLAIN[name]).values()), s) for s in places), default=(0, 0))
        if -shared / size >= 0.8:
            yield shared / size, name, start


def plain(text):
    """License, dice, line, word and number of matches, by all comparisons."""
    found = []
    text = text or ""
    for line, unit in [(-1, text), *enumerate(text.split("\n"))]:
        a = bigrams(unit)
        for name, b in PLAIN.items():
            dice = 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))
            if dice >= 0.8:
                found.append((-dice, name, 0, line, None))
    found += [(away, name, 1, None, start) for away, name, start in best_runs(text)]
    if not found:
        return None, None, None, None, 0
    away, name, _, line, word = min(found)
    return name, -away, line, word, len(found)


def check(r, text):
    name, dice, line, word, n = plain(text)
    assert (r.license, r.line, r.word, r.n_matches) == (name, line, word, n), r.doc_id
    assert r.dice == (dice if dice is None else pytest.approx(dice))


TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "Released under the MIT License.",
    "text\nreleased UNDER the mit licence\nRELEASED under the -- MIT license!!",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    TEMPLATES["MIT-permission"],
    TEMPLATES["MIT-permission"].replace(" ", "\n"),
    TEMPLATES["Apache-2.0-header"][:-100] + "\n" + TEMPLATES["ISC"],
    "prefix " * 30 + "Released under the MIT License.",
    "words that say nothing\n" * 4000 + "This work is licensed under the GNU General Public License, version 3.",
    "under the under the under the",
    "x" * 100_000,
    "Released under the MIT License.\nReleased under the MIT License.",
    "This tool is old. It is released under the MIT License. " + "Ask us first. " * 9,
    "wrapped: this work is\nlicensed under the GNU General\nPublic License, version 3.\n" + "more text here\n" * 20,
    "# " + TEMPLATES["Apache-2.0-header"].replace(" may ", "\n# may ").replace(" you ", " one ") + "\nimport this\n" * 50,
    "code\n" * 30 + TEMPLATES["MIT-text"] + "\ncode" * 30 + TEMPLATES["BSD-2-Clause-text"],
    TEMPLATES["Zlib-text"] * 3,
    "a " + "licensed under " * 5000 + "the Apache License, Version 2.0",
]


def test_matches_are_those_of_all_comparisons(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "y"), (None, "", "z")], "doc_id bigint, text string, license string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        check(r, TEXTS[r.doc_id] if r.doc_id is not None else "")
    assert sum(r.license is not None for r in found) >= 15


def test_embedded_and_wrapped_notices(spark):
    texts = ["Our code is released under the MIT License. Thank you.", "see: licensed\nunder the Apache\nLicense, Version 2.0. Ask\nus."]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.dice, r.line, r.word) for r in found] == [("MIT", 1.0, None, 3), ("Apache-2.0", 1.0, None, 1)]


def test_size_bounds_lose_nothing(spark):
    """Lines cut from and added to templates, around the bounds of the sizes that are compared."""
    texts = []
    for template in TEMPLATES.values():
        words = template.split()
        texts += [" ".join(words[:k]) for k in range(2, len(words), max(1, len(words) // 12))]
        texts += [template + " more" * k for k in range(0, len(words), max(1, len(words) // 12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licenses.scan(docs).collect():
        check(r, texts[r.doc_id])


def test_marks_are_in_every_match():
    """Without the bigrams that have a mark, no template has enough left for a match."""
    known = licenses._known(TEMPLATES)
    words = set(licenses.marks(known, 0.8))
    for _, n, grams in known:
        assert sum(k for g, k in grams.items() if not words & set(g.split(" "))) < n * 0.8 / 1.2


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], "doc_id bigint, text string"), {"short": "one"})


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    frame = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))
    assert differences(frame, licenses.oracle(), sf) == []
    texts = dict(duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    for r in licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        check(r, texts[r.doc_id])


def test_no_python_in_the_plan(spark):
    frame = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())
