"""Driver contract: entry runs, every query has oracle SQL, and both agree."""

import duckdb

from conftest import SF_SMALL

import __spark_entry__ as entry_mod
from piisift.plans.catalog import QUERIES as CATALOG
from piisift.plans.oracle import oracle_sql as catalog_sql
from tools.plan_report import facts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(v):
    return repr(v) if isinstance(v, float) else str(v)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "pii_score" in df.columns


def test_every_query_matches_oracle(spark):
    qs, sqls = CATALOG, catalog_sql()
    assert set(qs) == set(sqls) and set(qs) <= set(entry_mod.queries()) and set(sqls) <= set(entry_mod.oracle_sql())
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    duck = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    seen = set()
    for name, fn in qs.items():
        if fn in seen:  # a second name for the same query
            continue
        seen.add(fn)
        df = fn(spark, SF_SMALL)
        if not name.startswith("stream_"):  # no regex work in filters or generators: it would run once more
            assert facts(df._jdf.queryExecution().executedPlan().toString())["regex_in_filter"] == 0, name
        types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sqls[name]}").fetchall()}
        assert {c: duck.get(t, t) for c, t in df.dtypes} == types, name
        cols = sorted(df.columns)
        spark_rows = sorted(tuple(_key(r[c]) for c in cols) for r in df.collect())
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        assert sorted(ocols) == cols, name
        idx = [ocols.index(c) for c in cols]
        oracle_rows = sorted(tuple(_key(r[i]) for i in idx) for r in res.fetchall())
        assert spark_rows == oracle_rows, name
