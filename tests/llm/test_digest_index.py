from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from dockpulse.llm import digest_index
from dockpulse.llm.digest_index import DigestIndex

ROWS = [
    (1, "a b\tc"),
    (2, "a  b c\n"),
    (3, "abc"),
    (9, "a  bc  "),
    (4, None),
    (5, ""),
    (6, " \x0b\x0c\r"),
    (7, "é x"),
    (8, "éx"),
    (10, "long " * 50_000),
    (11, "same"),
    (11, "same"),
    (None, "same"),
]


def plain(rows):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        group = groups[normal(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1))


def test_groups(spark):
    found = digest_index.exact_duplicates(docs(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == plain(ROWS)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_documents_that_stay(spark):
    kept = digest_index.drop_exact_duplicates(docs(spark))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in plain(ROWS)})


def test_empty(spark):
    assert digest_index.exact_duplicates(docs(spark, [])).collect() == []
    assert digest_index.drop_exact_duplicates(docs(spark, [])).collect() == []


def batch(spark, rows):
    return spark.createDataFrame([(i, i, d.encode(), n) for i, d, n in rows], "uid bigint, doc_id bigint, digest binary, code_points bigint")


def test_the_index_lasts(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=3)
    first = batch(spark, [(1, "x", 3), (2, "x", 5), (3, "y", 1)])
    index.append(first)
    index.append(first)
    again = DigestIndex(spark, path, buckets=3)
    again.append(batch(spark, [(20, "x", 9), (21, "z", 1)]))
    rows = sorted((bytes(r.digest).decode(), r.keep_id, r.code_points) for r in again.rows().collect())
    assert rows == [("x", 2, 5), ("y", 3, 1), ("z", 21, 1)]


def test_anti_join_leaves_the_index_where_it_lies(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.append(batch(spark, [(1, "x", 3)]))
    new = batch(spark, [(2, "x", 3)]).groupBy("digest").count()
    joined = new.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    final = joined._jdf.queryExecution().executedPlan().toString()
    assert final.count("Exchange hashpartitioning(digest") == 1


def test_a_later_batch_keeps_only_new_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    kept = lambda rows, batch_id: sorted(r.doc_id for r in digest_index.exact_duplicates(frame(rows), path, batch_id).collect() if r.kept)
    first = [(1, "one"), (2, "two"), (3, "two")]
    assert kept(first, "a") == [1, 2]
    assert kept(first, "a") == [1, 2]
    assert kept(first, None) == []
    assert kept([(11, "one"), (12, "new")], "b") == [12]
