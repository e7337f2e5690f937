"""The registered queries against DuckDB on the smallest tables, and the entry without the corpus operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tickweave.plans.oracle import SQL
from tickweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["raw_parse", "raw_sampled", "as_of_join", "screen_days", "base_ticks", "factor_bap", "factor_rsrs", "factor_amp_slice", "factor_neg_skew", "factor_rigidity", "factor_acc_mom_shipped", "factor_pv_corr_shipped", "cs_ic", "ts_ic_stats", "quantile_stitched", "composite_deciles", "view_pnl"]


def plain(value):
    return None if value is None or value != value else round(float(value), 5) + 0.0 if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con.execute(f"select {', '.join(columns)} from ({SQL[name]})")
    want = sorted((tuple(map(plain, r)) for r in con.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []


def test_registration():
    assert set(SQL) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_without_the_corpus_operators(tmp_path):
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(repo, "tickweave"), tmp_path / "tickweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cs_ic' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
