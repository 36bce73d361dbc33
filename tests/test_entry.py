"""Driver contract smoke tests."""

import __spark_entry__ as E


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert q and set(o) <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and all(1 <= r["rank"] <= 10 and r.n >= 2 and len(r.word) >= 3 for r in rows)
    assert set(df.columns) == {"doc_id", "rank", "word", "n"}
