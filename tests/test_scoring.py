"""Rules, trailing counts and scoring against a row-by-row replay."""

import random
from datetime import timedelta
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from riskflow.operators import history, rules
from riskflow.operators.rules import RuleConfig, default_rules, evaluate, score, score_batch

from .conftest import at, table

TX = ("event_id string, transaction_id string, user_id string, occurred_at timestamp, seq long, amount decimal(28,9), "
      "merchant_id string, country string, currency string")


def tx(spark, rows):
    """rows: (user, time, amount, merchant, country); seq follows the list."""
    data = [(f"e{i}", f"t{i}", u, t, i, Decimal(str(a)), m, c, "USD") for i, (u, t, a, m, c) in enumerate(rows)]
    return spark.createDataFrame(data, TX)


def replay(ordered_rows, window=60, reach=1800):
    """Plain Python: every row against all rows before it, whatever their times."""
    seen, out = [], {}
    for user, t, amount, merchant, country, seq in ordered_rows:
        mine = [r for r in seen if r[0] == user]
        prior = sum(1 for r in mine if r[1] > t - timedelta(seconds=window))
        last = max(mine, key=lambda r: (r[1], r[3]), default=None)
        reasons, points = [], 0
        changed = last and last[2] and country and last[2].lower() != country.lower() and last[1] > t - timedelta(seconds=reach)
        for hit, name, weight in (
            (amount > 10000, "HIGH_AMOUNT", 45), (prior + 1 >= 5, "HIGH_VELOCITY", 35),
            (changed, "COUNTRY_CHANGE_IN_SHORT_WINDOW", 30),
            ((merchant or "").upper() in ("MRC-999", "MRC-666", "MRC-404"), "HIGH_RISK_MERCHANT", 25),
        ):
            if hit:
                reasons.append(name)
                points += weight
        out[seq] = (prior, min(100, points), min(100, points) >= 70, reasons)
        seen.append((user, t, country, seq))
    return out


def scored(df):
    return {r.seq: (r.prior_count, r.risk_score, r.fraudulent, r.reasons) for r in df.collect()}


# score and verdict of every combination of the four rules (amount, velocity, country, merchant)
COMBINATIONS = {
    "": (0, False), "M": (25, False), "C": (30, False), "V": (35, False), "A": (45, False), "CM": (55, False),
    "VM": (60, False), "VC": (65, False), "AM": (70, True), "AC": (75, True), "AV": (80, True), "VCM": (90, True),
    "ACM": (100, True), "AVM": (100, True), "AVC": (100, True), "AVCM": (100, True),
}


def test_all_combinations(spark):
    data = []
    for a, v, c, m in product([0, 1], repeat=4):
        name = "".join(n for n, on in zip("AVCM", (a, v, c, m)) if on)
        data.append((name, Decimal("15000" if a else "30"), 4 if v else 1, "BR" if c else "US", "US", at(0), at(300), "MRC-999" if m else "MRC-100"))
    df = spark.createDataFrame(data, "name string, amount decimal(28,9), prior_count long, country string, prev_country string, "
                               "prev_occurred_at timestamp, occurred_at timestamp, merchant_id string")
    got = {r.name: (r.risk_score, r.fraudulent) for r in evaluate(df, default_rules()).collect()}
    assert got == COMBINATIONS


@pytest.mark.parametrize("amount, hit", [("10000.00", False), ("10000.01", True), ("10000.004", True)])
def test_amount_boundary(spark, amount, hit):
    got = score(tx(spark, [("u", at(0), amount, "MRC-1", "US")])).first()
    assert (got.reasons == ["HIGH_AMOUNT"]) is hit


def test_velocity_window_excludes_its_lower_end(spark):
    exact = [("u", at(0), 1, "m", "US"), ("u", at(60), 1, "m", "US")]
    inside = [("v", at(0), 1, "m", "US"), ("v", at(60, -1), 1, "m", "US")]
    got = scored(score(tx(spark, exact + inside)))
    assert (got[1][0], got[3][0]) == (0, 1)


def test_country_window_and_nulls(spark):
    rows = [
        ("a", at(0), 1, "m", "US"), ("a", at(1800), 1, "m", "BR"),  # exactly 30 minutes: outside
        ("b", at(0), 1, "m", "US"), ("b", at(1800, -1), 1, "m", "BR"),
        ("c", at(0), 1, "m", "us"), ("c", at(5), 1, "m", "US"),  # case does not matter
        ("d", at(0), 1, "m", None), ("d", at(5), 1, "m", "US"),
        ("e", at(0), 1, "m", "US"), ("e", at(5), 1, "m", None),
    ]
    got = scored(score(tx(spark, rows)))
    assert [i for i, r in got.items() if r[3]] == [3]


@pytest.mark.parametrize("merchant, hit", [("mrc-999", True), (" MRC-999", False), (None, False), ("MRC-100", False)])
def test_merchant(spark, merchant, hit):
    got = score(tx(spark, [("u", at(0), 1, merchant, "US")])).first()
    assert (got.risk_score == 25) is hit


def random_rows(seed, n=700, grid=5):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        user = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(6)}"
        rows.append((user, at(rnd.randrange(0, 3000) // grid * grid), rnd.choice([20, 15000]),
                     rnd.choice(["mrc-999", "MRC-1", None]), rnd.choice(["US", "us", "BR", None])))
    return rows


@pytest.mark.parametrize("limit", [None, 60])
def test_whole_table_matches_replay(spark, limit):
    rows = random_rows(1)
    numbered = [(*r, i) for i, r in enumerate(rows)]
    want = replay(sorted(numbered, key=lambda r: (r[1], r[5])))
    assert scored(score(tx(spark, rows), limit=limit)) == want


@pytest.mark.parametrize("limit", [None, 60])
def test_batches_match_replay_with_late_events(spark, limit):
    """Batches arrive in any time order: a late event counts stored rows that lie after it."""
    rows = random_rows(2)
    everything = tx(spark, rows).cache()
    got, arrival = {}, []
    edges = [0, 300, 310, 700]
    for lo, hi in zip(edges, edges[1:]):
        new = everything.filter(F.col("seq").between(lo, hi - 1))
        old = everything.filter(F.col("seq") < lo)
        got |= scored(score_batch(new, old, limit=limit))
        arrival += sorted(((*rows[i], i) for i in range(lo, hi)), key=lambda r: (r[1], r[5]))
    assert got == replay(arrival)


def test_batch_without_rows(spark):
    empty = tx(spark, [("u", at(0), 1, "m", "US")]).filter("seq < 0")
    assert score_batch(empty, empty).count() == 0


def test_trailing_count_of_a_dense_key(spark):
    """Thousands of rows of one key inside one window, counted by chunks."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 10).alias("ts"), F.col("id").alias("seq"))
    got = history.trailing_count(df, "k", "ts", "seq", timedelta(microseconds=5000), "n", limit=500)
    assert all(r.n == min(r.seq, 499) for r in got.collect())


def test_expire_keeps_the_cutoff(spark):
    df = tx(spark, [("u", at(0), 1, "m", "US"), ("u", at(10), 1, "m", "US")])
    assert table(history.expire(df, "occurred_at", at(10)), "seq") == [(1,)]


def test_rules_are_extensible_and_configurable(spark):
    df = tx(spark, [("u", at(0), 500, "shop-1", "US"), ("u", at(1), 50, "x", "US")])
    config = RuleConfig(high_amount_threshold=Decimal("100"), high_risk_merchants=("SHOP-1",))
    own = rules.Rule("NIGHT", F.hour("occurred_at") < 6, 40)
    got = score(df, config, [*default_rules(config), own]).orderBy("seq").collect()
    assert [(r.risk_score, r.reasons) for r in got] == [
        (100, ["HIGH_AMOUNT", "HIGH_RISK_MERCHANT", "NIGHT"]), (40, ["NIGHT"])]


def test_listed_merchants_never_multiply_rows(spark):
    df = tx(spark, [("u", at(0), 1, "a", "US"), ("u", at(1), 1, None, "US"), ("u", at(2), 1, "b", "US")])
    listed = spark.createDataFrame([("A",), ("a",), (None,)], "m string")
    assert table(rules.flag_listed(df, "merchant_id", listed, "m"), "seq", "listed") == [(0, True), (1, False), (2, False)]


def test_stored_days_are_pruned_by_utc(spark, tmp_path, monkeypatch):
    """The driver's own time zone must not move the day bound past stored rows."""
    import time

    from riskflow import schemas
    from riskflow.functions.mapping import to_history
    from riskflow.sources import tables

    rows = [("u", at(86_390 + i), 1, "m", "US") for i in range(4)] + [("u", at(86_401), 1, "m", "BR")]
    everything = tx(spark, rows)
    path = str(tmp_path / "h")
    tables.append_history(to_history(everything.filter("seq < 4")), path, tables.Batch("w", 0))
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        stored = tables.read_table(spark, path, schemas.HISTORY)
        done = score_batch(everything.filter("seq = 4"), stored)
        got = done.first()
        assert (got.prior_count, got.reasons) == (4, ["HIGH_VELOCITY", "COUNTRY_CHANGE_IN_SHORT_WINDOW"])
        plan = done._jdf.queryExecution().toString()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert "(day#" in plan and "PushedFilters: [IsNotNull(occurred_at), GreaterThan(occurred_at" in plan
