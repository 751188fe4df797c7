"""The registered queries: SQL where there is some, and the contracts that SQL cannot express."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from dockpulse.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_all_ten_are_registered():
    names = list(contract.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(SQL) <= set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), SQL[name], SF_DIR) == []


COLUMNS = {
    "op2_suffix_tree": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_toxicity": "doc_id severity toxic",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_url_filter": "page_id host path rule verdict",
    "op9_simhash": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_whole_tables(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    key = "page_id" if name == "op8_url_filter" else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    ids = {r[0] for r in duckdb.connect().execute(f"select {key} from '{SF_DIR}/{table}.parquet'").fetchall()}
    assert {r[0] for r in frame.select(key).collect()} == ids
