"""Rules on a stream of samples against the same rules over the whole table."""

import random
from datetime import timedelta

import pytest

from riskflow import schemas
from riskflow.operators import slo
from riskflow.sources import files, tables
from riskflow.streaming import watch

from .conftest import at, table

RULES = [
    slo.SloRule("Grew", dict(name="a"), ">", 2, timedelta(minutes=1), timedelta(0), "warning", by=["series"]),
    slo.SloRule("Ratio", dict(name="a"), "<", 0.8, timedelta(minutes=2), timedelta(seconds=45), "critical", dict(name="b"), ["x"], 0.0001, True),
]
COLUMNS = ["ts", "rule", "severity", "labels", "value", "state"]


def some_samples(seed, steps=60):
    """Two counters of two series each, scraped every 15 s with gaps, restarts and a pause."""
    rng, rows = random.Random(seed), []
    for name in "ab":
        for x in "12":
            value = 0
            for k in range(steps):
                value = 0 if rng.random() < 0.03 else value + rng.choice([0, 0, 1, 3])
                if rng.random() > 0.1 and not 30 <= k < 33:
                    rows.append((at(15 * k + 0.25), name, {"x": x, "le": "1"}, float(value)))
    return sorted(rows, key=lambda r: (r[0], r[1], str(r[2])))


def put(spark, rows, folder):
    spark.createDataFrame(rows, schemas.SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/samples")


def watched(spark, folder, **options):
    watch.watch_rules(files.stream_samples(spark, f"{folder}/samples"), f"{folder}/states", f"{folder}/c", RULES, late_path=f"{folder}/late", **options).awaitTermination()


def found(spark, folder):
    return rounded(tables.read_table(spark, f"{folder}/states", watch.STATES))


def rounded(df):
    return [(*r[:4], round(r[4], 9), r[5]) for r in table(df, *COLUMNS)]


def whole(spark, rows, until):
    states = slo.evaluate_rules(spark.createDataFrame(rows, schemas.SAMPLE), RULES)
    return rounded(states.filter(states.ts <= until))


@pytest.mark.parametrize("cuts", [[], [3, 90, 91, 150]])
def test_any_cut_gives_the_states_of_the_whole(spark, tmp_path, cuts):
    rows = some_samples(1)
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        put(spark, rows[low:high], tmp_path)
        watched(spark, tmp_path)
    want = whole(spark, rows, rows[-1][0])
    assert found(spark, tmp_path) == want and {"firing", "pending", "inactive"} <= {r[5] for r in want}
    assert tables.read_table(spark, f"{tmp_path}/late", schemas.SAMPLE).count() == 0


def test_late_rows_are_kept_apart_and_a_delay_waits_for_them(spark, tmp_path):
    rows = some_samples(2, 30)
    early, held_back, rest = rows[:60], rows[60:64], rows[64:]
    folders = [tmp_path / "now", tmp_path / "waits"]
    for folder, delay in zip(folders, (0, 60)):
        for part in (early + rest[:20], held_back + [(None, "a", {"x": "1"}, 1.0)], rest[20:]):
            put(spark, part, folder)
            watched(spark, folder, delay=timedelta(seconds=delay))
    late = tables.read_table(spark, f"{folders[0]}/late", schemas.SAMPLE)
    assert late.count() == 5
    assert found(spark, folders[0]) == whole(spark, early + rest, rows[-1][0])
    # a delay keeps steps open, but a series still can't go back in time
    waits = tables.read_table(spark, f"{folders[1]}/states", watch.STATES)
    assert waits.count() > 0 and waits.filter(waits.ts > rows[-1][0] - timedelta(seconds=60)).count() == 0
    assert 1 <= tables.read_table(spark, f"{folders[1]}/late", schemas.SAMPLE).count() <= 5


def test_a_repeated_batch_gives_the_same_again(spark, tmp_path):
    rows = some_samples(3, 40)
    parts = [rows[:50], rows[50:100], rows[100:]]
    for part in parts[:2]:
        put(spark, part, tmp_path)
        watched(spark, tmp_path)
    first = found(spark, tmp_path)
    # the second batch was lost after it had written everything but its commit
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    watched(spark, tmp_path)
    assert found(spark, tmp_path) == first
    put(spark, parts[2], tmp_path)
    watched(spark, tmp_path)
    assert found(spark, tmp_path) == whole(spark, rows, rows[-1][0])


def test_nothing_new_closes_nothing(spark, tmp_path):
    rows = some_samples(4, 20)
    put(spark, rows, tmp_path)
    watched(spark, tmp_path)
    before = found(spark, tmp_path)
    put(spark, [(at(10_000), "other", {}, 1.0)], tmp_path)
    watched(spark, tmp_path)
    put(spark, [(rows[-1][0] + timedelta(milliseconds=1), "a", {"x": "9"}, 1.0)], tmp_path)  # newer, but within the closed step's next one
    watched(spark, tmp_path)
    assert found(spark, tmp_path) == before
    assert sorted(p.name for p in (tmp_path / "c" / "carried").iterdir()) == ["0", "1", "2"]
