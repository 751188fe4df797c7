from __future__ import annotations

import re

import duckdb
import pytest

from dockpulse.llm import quality

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c",
    "a a a a",
    "a b c a b c",
    "x a b c y a b c z a b",
    "line\nline\n line\nline\n\n\nline ",
    "#*$%&|<> é\U0001f600 \xa0 nbsp em",
    "\n".join(["same words in a line"] * 400),
    " ".join(f"w{i}" for i in range(30_000)) + " w0 w1 w2",
    "lone " * 60,
    "x" * 200_000,
    "\ra\x0bb\x0cc\td",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, signals string")


def test_counts(spark):
    rows = {r.doc_id: r for r in quality.judge(frame(spark)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_of_all_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = dict(duckdb.connect().execute(f"select doc_id, text from '{path}'").fetchall())
    for r in quality.judge(spark.read.parquet(path)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])


def test_empty_and_repeated_rows(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    assert quality.keep_good(frame(spark, [])).collect() == []
    good = " ".join(f"word{i % 97}x{i}." for i in range(80))
    docs = spark.createDataFrame([(1, good), (1, good), (None, good)], "doc_id bigint, text string")
    assert [r.doc_id for r in quality.keep_good(docs).collect()].count(1) == 2
    assert quality.keep_good(frame(spark)).columns == ["doc_id", "text", "signals"]


def test_votes_are_weighed():
    """Votes drawn with known accuracies: the fit finds them and the share of good texts, whatever order the patterns have."""
    import random
    from collections import Counter

    rng = random.Random(7)
    names, true = ["a", "b", "c", "d"], [(0.9, 0.99), (0.6, 0.95), (0.8, 0.9), (0.7, 0.97)]
    drawn = Counter()
    for _ in range(40_000):
        good = rng.random() < 0.85
        pattern = []
        for on_bad, on_good in true:
            right = rng.random() < (on_good if good else on_bad)
            pattern.append(0 if rng.random() < 0.2 else (1 if good == right else -1))
        drawn[tuple(pattern)] += 1
    model = quality.fit(sorted(drawn.items()), dict.fromkeys(names, 0.2), rounds=500)
    assert model.good == pytest.approx(0.85, abs=0.02)
    for name, (on_bad, on_good) in zip(names, true):
        bad, good = model.chances[name]
        assert bad[-1] == pytest.approx(on_bad, abs=0.06) and good[1] == pytest.approx(on_good, abs=0.03)


def test_slack_keeps_lone_objections():
    """Junk that one rule finds does not pass as that rule's error because two other rules agree on another kind."""
    patterns = [((1, 1, 1), 900), ((1, -1, -1), 60), ((-1, 1, 1), 40)]
    loose = quality.fit(patterns, dict.fromkeys("abc", 0.5))
    strict = quality.fit(patterns, dict.fromkeys("abc", 0.001))
    assert loose.chances["a"][1][-1] > 0.02 and strict.chances["a"][1][-1] <= 0.001
    assert strict.chances["a"][0][-1] > 0.3


def test_no_texts_have_a_model():
    model = quality.fit([], {"a": 0.01})
    assert 0 < model.good < 1 and model.chances["a"][1][1] > model.chances["a"][0][1]


def test_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.connect().execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels]
    judged = [r for r in rows if not r.base_failed]
    right = [r.kept == (labels[r.doc_id] == 1) for r in judged]
    assert sum(right) >= 0.97 * len(right)
    clean = [r for r in judged if labels[r.doc_id] == 1]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_no_python_in_the_plan(spark):
    plan = quality.signals(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert plan.count("regexp_extract_all(coalesce(text") == 1
