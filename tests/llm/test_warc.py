"""Archives against the rule, and the index against the bytes."""

import gzip
import hashlib

from pyspark.sql import functions as F

from riskflow.llm import common, warc


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            groups[payload] = min(page_id, groups.get(payload, page_id))
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = groups.get(payload)
        copies = sum((h or "").encode() == payload for _, _, h in rows)
        again = first is not None and copies > 1 and page_id != first
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_pages_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(k, f"http://x/{k}", big) for k in (9, 4, 7, 4)] + [
        (1, None, None), (2, "u\r\nX: y", ""), (3, "http://ü/ ", "short"), (5, "a", "short"), (2**60 + 1, "b", "x" * 99), (2**60 + 3, "b", "x" * 99),
        (None, "c", big), (None, "c", "only without id " * 10), (None, "c", "only without id " * 10), (8, "d", "line\r\n\r\nline" * 20000), (10, "d", "line\r\n\r\nline" * 20000),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write(pages, common.new_folder(spark, "warc"), file_bytes=500)
    assert index.select("path").distinct().count() > 1
    back = warc.read(index, 3).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=repr) == expected(rows)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back if r.record_type == "response")
    for r in index.collect():
        raw = open(common.filesystem(r.path)[1], "rb").read()[r.offset : r.offset + r.length]
        assert warc.parse(gzip.decompress(raw))["page_id"] == r.page_id
    some = index.where(F.col("page_id").isin(4, 8))
    assert sorted(r.page_id for r in warc.read(some, 2, payloads=False).collect()) == [4, 4, 8]


def test_reads_join_neighbours():
    assert warc.ranges([0, 10, 25, 100], [10, 10, 5, 7], gap=5, most=1000) == [(0, 3, 30), (3, 4, 107)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=5, most=20) == [(0, 2, 20), (2, 3, 30)]
    assert warc.ranges([], []) == []


def test_empty_table(spark):
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), common.new_folder(spark, "warc"))
    assert warc.read(index, 2).collect() == []


def test_both_sides_of_the_join_can_be_split(spark, tmp_path, monkeypatch):
    plans, written = {}, warc.common.written

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(warc.common, "written", watched)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        pages = spark.createDataFrame([(k, "u", "x" * 200) for k in range(20)], "page_id long, url string, html string")
        assert warc.write(pages, str(tmp_path / "warc")).count() == 20
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" in plans["warc-index"][1]
    assert "Aggregate" not in plans["warc-index"][1]
