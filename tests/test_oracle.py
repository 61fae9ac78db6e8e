"""Registered queries against their DuckDB SQL at sf0.001 (a subset; the
full set runs with `python tools/oracle_check.py`)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from prefloom.sources.tables import TABLES, table_path
from tools.oracle_check import digest

SUBSET = [
    "build_pairs", "pair_outcomes", "completion_scores", "rating_quality", "split_exact",
    "chatml_render", "turn_prompts", "encode_pairs", "pad_batches", "parse_annotations",
    "annotation_prompts", "sample_models",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    yield c
    c.close()


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]
