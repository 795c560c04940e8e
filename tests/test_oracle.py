"""Spark queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from strandloom.plans.oracle import ORACLE
from strandloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["bin_stats", "minimizer_pe", "minimizer_skip10", "small_bins_to_n", "qual_nmask", "header_encode", "header_roundtrip", "lz_match_w8", "tree_size", "rebin_target_single", "contig_vote", "match_rle", "signature_diff", "archive_roundtrip_lossless"]


def rows(frame):
    cols = sorted(frame.columns)
    text = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(text(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{FOLDER}/orders.parquet'")
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(ORACLE[name]).df())
