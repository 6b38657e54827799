"""Funnel stages and service graph on streams against the same over whole tables, however the rows come."""

import random
import time

import pytest

from riskflow import schemas, session
from riskflow.operators import delivery, traces
from riskflow.streaming import pairs

from .conftest import at, table

ASKED = "transaction_id string, at timestamp"
ANSWERED = "transaction_id string, at timestamp, fraudulent boolean"
#: Rows that only move the watermark on.
LATER = [("closing", at(1_000_000))]


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def staged(spark, folder, **options):
    ask, answer = (spark.readStream.schema(s).parquet(f"{folder}/{n}") for s, n in ((ASKED, "asked"), (ANSWERED, "answered")))
    pairs.stage_stream(ask, answer, f"{folder}/steps", f"{folder}/c1", pairs.DECISION, **options).awaitTermination()
    raised = spark.readStream.schema(ASKED).parquet(f"{folder}/alerts")
    fraud = answer.filter("fraudulent or transaction_id = 'closing'").select("transaction_id", "at")
    pairs.stage_stream(fraud, raised, f"{folder}/steps", f"{folder}/c2", pairs.ALERT, **options).awaitTermination()


def some_stages(seed):
    rng, asked, answered, alerts = random.Random(seed), [], [], []
    for i in range(120):
        t, fraud = i * 7.5, rng.random() < 0.4
        asked.append((f"t{i}", at(t)))
        if rng.random() < 0.8:
            t += rng.random() * 300
            answered.append((f"t{i}", at(t), fraud))
            if fraud and rng.random() < 0.7:
                alerts.append((f"t{i}", at(t + rng.random() * 500)))
    return asked, answered, alerts


@pytest.mark.parametrize("answers_first", [False, True])
def test_funnel_equals_the_batch_and_names_what_is_stuck(spark, tmp_path, answers_first):
    asked, answered, alerts = some_stages(1)
    answered.append(answered[0])  # an answer that comes twice
    parts = {"asked": (asked, ASKED), "answered": (answered, ANSWERED), "alerts": (alerts, ASKED)}
    for low, high in ((0, 60), (60, 10**6)):
        for name, (rows, schema) in parts.items():
            first = answers_first == (name != "asked")
            put(spark, rows[low:high] if first or low else rows[:30], schema, tmp_path / name)
            if low and not first:
                put(spark, rows[30:60], schema, tmp_path / name)
        staged(spark, tmp_path)
    assert pairs.stuck(spark, f"{tmp_path}/steps").count() == 0  # nobody's time is up
    for name, (_, schema) in parts.items():
        put(spark, [(*LATER[0], False)] if schema == ANSWERED else LATER, schema, tmp_path / name)
    staged(spark, tmp_path)
    tx, decided, raised = (spark.createDataFrame(rows, schema) for rows, schema in parts.values())
    want = table(delivery.stage_funnel(tx, decided, raised))
    got = pairs.funnel(spark, f"{tmp_path}/steps").first()
    assert (got.transactions - 1, got.decided - 1, got.fraud, got.alerted) == want[0][:4]  # one for the closing row
    names, frauds = {r[0] for r in answered}, {r[0] for r in answered if r[2]}
    expected = [("decision", r[0], r[1]) for r in asked if r[0] not in names] + [
        ("alert", r[0], r[1]) for r in answered if r[0] in frauds - {a[0] for a in alerts}]
    found = pairs.stuck(spark, f"{tmp_path}/steps").filter("transaction_id <> 'closing'")
    assert {r[:2] for r in table(found, "stage", "transaction_id")} == {r[:2] for r in expected} and found.count() == len({r[:2] for r in expected})


def test_an_answer_out_of_time_doesnt_count_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    put(spark, [("slow", at(0)), ("quick", at(0)), ("early", at(100)), (None, at(0)), ("untimed", None)], ASKED, tmp_path / "asked")
    put(spark, [("slow", at(601), False), ("quick", at(600), False), ("early", at(41), False), (None, at(0), False)], ANSWERED, tmp_path / "answered")
    put(spark, [], ASKED, tmp_path / "alerts")
    staged(spark, tmp_path)
    put(spark, LATER, ASKED, tmp_path / "asked")
    put(spark, [(*LATER[0], False)], ANSWERED, tmp_path / "answered")
    staged(spark, tmp_path)
    before = table(pairs.stuck(spark, f"{tmp_path}/steps"), "stage", "transaction_id")
    assert before == [("decision", "slow"), ("decision", None)]
    steps = pairs.tables.read_table(spark, f"{tmp_path}/steps", pairs.STEPS)
    rows = table(steps)
    last = max(int(p.name) for p in (tmp_path / "c1" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the last batch was lost before its commit
        (tmp_path / "c1" / "commits" / name).unlink(missing_ok=True)
    staged(spark, tmp_path)
    assert table(pairs.tables.read_table(spark, f"{tmp_path}/steps", pairs.STEPS)) == rows


def test_rows_behind_the_watermark_are_counted_in_the_progress(spark, tmp_path):
    put(spark, [("a", at(50_000))], ASKED, tmp_path / "asked")
    put(spark, [("a", at(50_001), True)], ANSWERED, tmp_path / "answered")
    put(spark, [], ASKED, tmp_path / "alerts")
    staged(spark, tmp_path)
    put(spark, [("old", at(0))], ASKED, tmp_path / "asked")
    ask, answer = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for s, n in ((ASKED, "asked"), (ANSWERED, "answered")))
    run = pairs.stage_stream(ask, answer, f"{tmp_path}/steps", f"{tmp_path}/c1", pairs.DECISION)
    run.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    steps = pairs.tables.read_table(spark, f"{tmp_path}/steps", pairs.STEPS).filter("transaction_id = 'old'")
    assert (dropped, steps.count()) == (1, 0)


def some_spans(seed):
    rng, spans = random.Random(seed), []
    for i in range(60):
        t, bad = i * 2.0, rng.random() < 0.2
        status = "STATUS_CODE_ERROR" if bad else "STATUS_CODE_UNSET"
        if rng.random() < 0.9:
            spans.append((f"r{i // 4}", f"c{i}", None, "tx", "call", "CLIENT", status, at(t), 5.0))
        for n in range(rng.choice([0, 1, 1, 1, 2])):
            spans.append((f"r{i // 4}", f"s{i}-{n}", f"c{i}", rng.choice(["fraud", "alert"]), "answer", "SERVER", "STATUS_CODE_UNSET", at(t + rng.uniform(-3, 3)), 4.0))
    rng.shuffle(spans)
    return spans


def test_service_graph_equals_the_batch_whichever_half_comes_first(spark, tmp_path):
    spans = some_spans(2)
    for part in (spans[:50], spans[50:], [("z", "z", None, "z", "z", "CLIENT", "", at(10**6), 1.0), ("z", "y", "z", "z", "z", "SERVER", "", at(10**6), 1.0)]):
        put(spark, part, schemas.SPAN, tmp_path / "spans")
        source = spark.readStream.schema(schemas.SPAN).parquet(f"{tmp_path}/spans")
        pairs.graph_stream(source, f"{tmp_path}/pairs", f"{tmp_path}/c").awaitTermination()
    whole = traces.service_graph(spark.createDataFrame(spans, schemas.SPAN))
    round_ = lambda df: [(*r[:4], round(r[4], 6), round(r[5], 6)) for r in table(df)]
    assert round_(pairs.graph(spark, f"{tmp_path}/pairs").filter("client <> 'z'")) == round_(whole)
    called, parents = {s[1] for s in spans if s[5] == "CLIENT"}, {s[2] for s in spans if s[5] == "SERVER"}
    alone = sum(1 for s in spans if (s[5] == "CLIENT" and s[1] not in parents) or (s[5] == "SERVER" and s[2] not in called))
    assert alone > 5 and sum(r.expired for r in pairs.expired(spark, f"{tmp_path}/pairs").collect()) == alone
    before = table(pairs.tables.read_table(spark, f"{tmp_path}/pairs", pairs.PAIRS))
    last = max(int(p.name) for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the last batch was lost before its commit
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    pairs.graph_stream(source, f"{tmp_path}/pairs", f"{tmp_path}/c").awaitTermination()
    assert table(pairs.tables.read_table(spark, f"{tmp_path}/pairs", pairs.PAIRS)) == before


def test_halves_wait_in_files_until_the_watermark_has_passed_them(spark, tmp_path):
    day = 86_400
    call = lambda n, t: ("t", n, None, "tx", "call", "CLIENT", "", at(t), 5.0)
    answer = lambda n, t, parent: ("t", n, parent, "fraud", "answer", "SERVER", "", at(t), 4.0)
    parts = [
        [call("a", 0), answer("x", 5, "b"), call("edge", 3600)],
        [answer("y", 10, "a"), call("b", 0), answer("z", 10, "none"), answer("edge2", 11, "edge")],
        [call("c", 3 * day), answer("w", 3 * day + 10, "c"), answer("v", 3 * day + 11, "c")],
        [answer("u", 3 * day + 9, "c"), answer("old", 1, "a"), call("old2", 2)],
        [call("last", 9 * day), answer("last2", 9 * day, "last")],
    ]
    for part in parts:
        put(spark, part, schemas.SPAN, tmp_path / "spans")
        source = spark.readStream.schema(schemas.SPAN).parquet(f"{tmp_path}/spans")
        run = pairs.graph_stream(source, f"{tmp_path}/pairs", f"{tmp_path}/c")
        run.awaitTermination()
        assert not any(p["stateOperators"] for p in run.recentProgress)  # nothing is kept in memory
    rows = pairs.tables.read_table(spark, f"{tmp_path}/pairs", pairs.PAIRS)
    found = sorted((r.parent_span_id, r.client or "", r.server or "") for r in rows.collect())
    assert found == sorted([("a", "tx", "fraud"), ("b", "tx", "fraud"), ("c", "tx", "fraud"), ("c", "tx", "fraud"), ("c", "", "fraud"), ("edge", "tx", ""),
                            ("edge", "", "fraud"), ("none", "", "fraud"), ("last", "tx", "fraud")])
    late = pairs.tables.read_table(spark, f"{tmp_path}/pairs-late", pairs.HALF)
    assert sorted((r.parent_span_id, r.called) for r in late.collect()) == [("a", False), ("old2", True)]
    # the last batch has gone by the watermark of the third day
    assert min(p.name for p in (tmp_path / "c" / "halves").glob("day=*")) > f"day={at(day).date()}"


def sent_files(spark):
    """The shuffle files that lie on this session's disks."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("share", [None, 9])
def test_halves_are_sent_share_after_share_and_what_was_sent_goes(spark, tmp_path, monkeypatch, share):
    if share:
        monkeypatch.setattr(pairs, "SHARE", share)
    spans, before, setting = some_spans(5), sent_files(spark), spark.conf.get(session._DROP_SHUFFLES)
    spans += [("n", None, None, "tx", "call", "CLIENT", "", at(3), 5.0), (None, "q", "q", "fraud", "answer", "SERVER", "", at(3), 4.0)]
    last = [("z", "z", None, "z", "z", "CLIENT", "", at(10**6), 1.0), ("z", "y", "z", "z", "z", "SERVER", "", at(10**6), 1.0)]
    staged = []
    monkeypatch.setattr(pairs.tables, "staged", lambda *parts, f=pairs.tables.staged: staged.append(len(parts)) or f(*parts))
    for part in (spans[::2], spans[1::2], last):
        put(spark, part, schemas.SPAN, tmp_path / "spans")
        source = spark.readStream.schema(schemas.SPAN).parquet(f"{tmp_path}/spans")
        pairs.graph_stream(source, f"{tmp_path}/pairs", f"{tmp_path}/c").awaitTermination()
    late = time.monotonic() + 20
    while sent_files(spark) - before and time.monotonic() < late:
        time.sleep(0.2)
    assert not sent_files(spark) - before
    assert spark.conf.get(session._DROP_SHUFFLES) == setting
    assert len(staged) == (3 if share else 0) and all(n > 3 for n in staged)
    whole = table(traces.service_graph(spark.createDataFrame(spans, schemas.SPAN)))
    found = table(pairs.graph(spark, f"{tmp_path}/pairs").filter("client <> 'z'"))
    assert [r[:4] for r in found] == [r[:4] for r in whole] and [pytest.approx(r[4:]) for r in found] == [r[4:] for r in whole]
    alone = sum(r.expired for r in pairs.expired(spark, f"{tmp_path}/pairs").collect())
    done = {s[1] for s in spans if s[5] == "CLIENT"}, {s[2] for s in spans if s[5] == "SERVER"}
    lone = [s for s in spans if None in s[:2] or (s[1] not in done[1] if s[5] == "CLIENT" else s[2] not in done[0])]
    assert alone == len(lone) > 7
