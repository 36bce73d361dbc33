"""The sequence rewrites take a user's events in order of time, whatever order their ids have."""

import datetime as dt

import duckdb
import pytest

from quire.plans import ORACLES, QUERIES, load_all

#: (id, minute, type): in order of time click, click, error, error, view, signup; the ids run the other way
EVENTS = [(14, 0, "click"), (13, 1, "click"), (9, 2, "error"), (4, 3, "error"), (3, 4, "view"), (2, 5, "signup")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    rows = [(i, dt.datetime(2024, 1, 1, 0, m), 3, kind) for i, m, kind in EVENTS]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{at}/events.parquet")
    load_all()
    return str(at)


@pytest.mark.parametrize("name, number, said, want", [
    ("flow_run_length", "first_seq", "step", ["svc.click×2", "Logger.info", "Logger.error", "svc.view", "db.signup"]),
    ("flow_log_merge", "first_seq", "step", ["svc.click", "svc.click", "log: info, error", "svc.view", "db.signup"]),
    ("flow_early_returns", "seq", "step", ["while (queue6.length)", "return", "for (const item of items4 and a long trailing description that keeps going past the label width limit)", "return"]),
    ("flow_collapse", "seq", "line", ["~ misc", "~ misc", "-> db.buy", "~misc×3 (path/dep)"]),
])
def test_steps_follow_the_time(spark, tables, name, number, said, want):
    got = QUERIES[name](spark, tables)
    assert [r[said] for r in got.orderBy(number).collect()] == want
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
        columns = ", ".join(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())
