"""The pipeline, stage by stage, against plain Python on the smallest documents."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from test_minhash import plain_groups
from test_mixing import plain_targets, size_of
from test_packing import check_places
from test_quality import plain as plain_counts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after every stage, the documents first."""
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    found.append(docs.collect())
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF_DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = corpus_pipeline.stored(docs, "test-stage")
        found.append(docs.collect())
    return found


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_quality_stage(kept):
    labels = dict(duckdb.connect().execute(f"select doc_id, quality from '{SF_DIR}/labels.parquet'").fetchall())
    stay = {r.doc_id for r in kept[1]}
    for r in kept[0]:
        n, _, _, _, repeats = plain_counts(r.text)
        failed = n < 50 or 100 * repeats > 50 * n
        if failed:
            assert r.doc_id not in stay
        elif r.doc_id in labels:
            assert (r.doc_id in stay) == (labels[r.doc_id] == 1)


def test_exact_stage(kept):
    groups: dict = {}
    for r in kept[1]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept[2]) == sorted(min(g)[1] for g in groups.values())


def test_near_stage(kept):
    groups = plain_groups({r.doc_id: r.text for r in kept[2]})
    assert sorted(r.doc_id for r in kept[3]) == sorted(set(groups.values()))


def test_mixing_stage(kept):
    sizes: dict = {}
    longest: dict = {}
    for r in kept[3]:
        sizes[r.source] = sizes.get(r.source, 0) + size_of(r.text)
        longest[r.source] = max(longest.get(r.source, 0), size_of(r.text))
    taken: dict = {}
    for r in kept[4]:
        taken[r.source] = taken.get(r.source, 0) + size_of(r.text)
    for source, goal in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - goal) <= longest[source] / 2 + 1


def test_packing_stage(kept):
    check_places(kept[5])
    assert sorted(r.doc_id for r in kept[5] if r.piece == 0) == sorted(r.doc_id for r in kept[4])


ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, row string, size int, node string, key string"


def through(spark, docs):
    """The rows after every stage; all but the last return the columns they got."""
    columns, found = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test-stage")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        found.append(docs.collect())
    return found


def test_stages_on_an_empty_table(spark):
    assert through(spark, spark.createDataFrame([], ODD_SCHEMA)) == [[]] * 5


def test_stages_on_nulls_repeats_long_texts_and_clashing_names(spark):
    """The stages one after the other, and each on the odd rows themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    more = lambda i, text, source: (i, text, None, source, None, "x", "y", 1, "n", "k")
    rows = [more(r.doc_id, r.text, r.source) for r in docs]
    long_ = " ".join(f"{w}{i}" for i in range(20_000) for w in ("some", "long", "text."))
    odd = [more(None, None, None), more(None, None, None), more(10_001, "", "a"), more(10_002, " \n", None), more(10_003, long_, "a"), more(None, long_ + " end", None)]
    frame = spark.createDataFrame(rows + odd + rows[:20], ODD_SCHEMA)
    after = through(spark, frame.repartition(4))
    good, one_each = {r.doc_id for r in after[0]}, [r.doc_id for r in after[2]]
    assert {10_001, 10_002} & good == set() and len(one_each) == len(set(one_each))
    assert {r.text for r in after[2]} <= {r[1] for r in rows + odd}
    assert sum(r.text in (long_, long_ + " end") for r in after[2]) <= 1
    check_places(after[4])
    alone = [stage(spark, frame, SF_DIR).collect() for _, stage in corpus_pipeline.STAGES[1:]]
    assert sum(not (r.text or "").split() for r in alone[0]) == 1 == sum(not (r.text or "").split() for r in alone[1])
    assert sum(not (r.text or "").split() for r in alone[2]) == 4
    assert len({r.uid for r in alone[3]}) == len(rows) + len(odd) + 20


def test_run_gives_the_last_stage(spark, kept):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(key, kept[5]))
