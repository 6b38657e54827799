"""Late rows: nothing vanishes, closed buckets get corrections."""

from collections import Counter

from riskflow.sources import tables
from riskflow.streaming import late

from .conftest import at, table

EVENT = "event_id string, occurred_at timestamp, seq long"
ALERT = "id string, created_at timestamp"


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def again(folder, name="c"):
    last = max(int(p.name) for p in (folder / name / "commits").iterdir() if p.name.isdigit())
    for file in (f"{last}", f".{last}.crc"):
        (folder / name / "commits" / file).unlink(missing_ok=True)


def deduped(spark, folder):
    source = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
    late.dedup_stream(source, f"{folder}/first", f"{folder}/late", f"{folder}/c").awaitTermination()
    schema = spark.createDataFrame([], EVENT).schema
    read = lambda name: table(tables.read_table(spark, f"{folder}/{name}", schema), "event_id", "seq")
    counts = table(tables.read_table(spark, f"{folder}/first-counts", late.COUNTS), "received", "first", "late")
    return read("first"), read("late"), [sum(c) for c in zip(*counts)]


def test_first_arrivals_copies_and_late_rows_are_all(spark, tmp_path):
    batches = [
        [("a", at(0), 1), ("b", at(20_000), 2), ("a", at(0), 3), (None, at(10), 4)],
        # the watermark is at 16,400: "c" is late, "b" is known, "d" is new, "e" has no time
        [("c", at(16_399), 5), ("b", at(20_000), 6), ("d", at(16_400), 7), ("e", None, 8), ("a", at(0), 9)],
        [("e", None, 10), ("f", at(40_000), 11)],
        [("b", at(20_000), 12), ("f", at(40_001), 13)],
    ]
    for rows in batches:
        put(spark, rows, EVENT, tmp_path)
        first, behind, counts = deduped(spark, tmp_path)
    assert first == sorted([("a", 1), ("b", 2), (None, 4), ("d", 7), ("e", 8), ("f", 11)], key=repr)
    assert behind == [("a", 9), ("b", 12), ("c", 5)]
    copies = 4  # a, b, e and f once more
    assert counts == [13, 6, 3] and counts[0] == counts[1] + counts[2] + copies
    again(tmp_path)
    assert deduped(spark, tmp_path) == (first, behind, counts)


def test_closed_buckets_get_corrections(spark, tmp_path):
    batches = [
        [("1", at(0)), ("2", at(59)), ("3", at(60)), ("4", at(10_000)), ("x", None)],
        [("5", at(30)), ("6", at(6_390)), ("7", at(10_001))],  # 30 is late; the watermark is at 6,400 and 6,390's bucket still open
        [("8", at(20_000)), ("9", at(6_395)), ("10", at(61))],
        [("11", at(9_999)), ("12", at(20_001))],
    ]
    rows = []
    for part in batches:
        rows += part
        put(spark, part, ALERT, tmp_path)
        source = spark.readStream.schema(ALERT).parquet(f"{tmp_path}/in")
        late.window_stream(source, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    path = f"{tmp_path}/out"
    bucket = lambda seconds: at(seconds // 60 * 60).replace(tzinfo=None)
    assert dict(table(late.closed(spark, path))) == {bucket(0): 2, bucket(60): 1, bucket(6_390): 2, bucket(10_000): 2}
    want = Counter(None if t is None else bucket((t - at(0)).total_seconds()) for _, t in rows)
    assert dict(table(late.windows(spark, path), "time", "alerts")) == dict(want)
    fixed, shut = dict(table(late.corrections(spark, path))), dict(table(late.closed(spark, path)))
    assert fixed == {bucket(0): 1, bucket(60): 1, bucket(9_999): 1}
    for time, n in shut.items():
        assert n + fixed.get(time, 0) == want[time]
    states = table(late.closed(spark, path))
    again(tmp_path)
    late.window_stream(spark.readStream.schema(ALERT).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/c").awaitTermination()
    assert table(late.closed(spark, path)) == states


def test_an_empty_stream(spark, tmp_path):
    put(spark, [], ALERT, tmp_path)
    late.window_stream(spark.readStream.schema(ALERT).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert late.windows(spark, f"{tmp_path}/out").count() == 0 and late.closed(spark, f"{tmp_path}/out").count() == 0
