"""Registered queries against their SQL in DuckDB, over the whole smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("RISKFLOW_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")

# one of each family; tools/compare.py runs them all
CHECKED = [
    "score_transactions", "score_against_history", "latest_arrived", "accepted_transactions", "payload_round_trip", "poison_reasons",
    "stage_funnel", "list_alerts", "triage_top_reasons", "sliding_alerts", "trend_stats", "outbox_outcomes",
    "metric_increase_extrapolated", "rule_states", "board_tracing", "parsed_logs", "service_graph_p95", "logs_for_traces", "stream_scored",
    "stream_redelivered", "stream_same_transaction", "stream_two_channels", "stream_dead_letters", "stream_poison", "read_back_records",
    "stream_late_kept", "stream_windows_corrected",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_its_sql():
    """All but the training-data operators, some of which SQL can't express."""
    own = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own == {name for name in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", name)}


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([d[0] for d in cur.description], cur.fetchall())


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.count() == 23
