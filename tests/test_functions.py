"""Column functions, validation and mappings on the documented examples."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.functions import labels, mapping, text, validation

from .conftest import at, table


def value(spark, expr, **cols):
    data = [tuple(v for v in cols.values())]
    names = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in cols.items())
    return spark.createDataFrame(data, names).select(expr.alias("x")).first().x


HEX = "a1b2c3d4e5f6789012345678a1b2c3d4"


@pytest.mark.parametrize("raw, want", [(" usd ", "USD"), ("\tus\n", "US"), ("", ""), (None, None)])
def test_normalize_code(spark, raw, want):
    assert value(spark, text.normalize_code("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [(None, "unknown"), ("  ", "unknown"), ("WebHook", "webhook")])
def test_normalize_channel(spark, raw, want):
    assert value(spark, text.normalize_channel("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [
    (f" {HEX.upper()} ", HEX), (f"{HEX[:8]}-{HEX[8:]}", HEX), (HEX[:-1], None), ("g" + HEX[1:], None), (None, None), (" ", None)])
def test_normalize_hex(spark, raw, want):
    assert value(spark, text.normalize_hex("a", 32), a=raw) == want


def test_trace_id_precedence(spark):
    resolve = text.resolve_trace_id("a", "b")
    assert value(spark, resolve, a="event", b="context") == "event"
    assert value(spark, resolve, a="  ", b="context") == "context"
    assert value(spark, resolve, a=None, b=None) is None
    generated = text.resolve_trace_id("a", generate_from="b")
    assert value(spark, generated, a=HEX.upper(), b="x") == HEX
    made = value(spark, generated, a="bad", b="x")
    assert len(made) == 32 and made == value(spark, generated, a=None, b="x")


def test_traceparent(spark):
    span = "1234567890abcdef"
    assert value(spark, text.traceparent("a", "b"), a=HEX, b=span) == f"00-{HEX}-{span}-01"
    assert value(spark, text.traceparent("a", "b", F.lit(False)), a=HEX, b=span) == f"00-{HEX}-{span}-00"
    assert value(spark, text.traceparent("a", "b"), a=HEX, b="short") is None
    assert value(spark, text.traceparent("a", "b"), a=None, b=span) is None


def test_trims_and_errors(spark):
    assert value(spark, text.trim_to_null("a"), a=" \t") is None
    assert value(spark, text.trim_to_null("a"), a=" x ") == "x"
    assert value(spark, text.trim_to_empty("a"), a=None) == ""
    assert value(spark, text.error_text("a", "b"), a="m" * 600, b="E") == "m" * 512
    assert value(spark, text.error_text("a", "b"), a=" ", b="IOException") == "IOException"
    assert value(spark, text.error_text("a", "b"), a=None, b=" ") is None


# the 32-bit hash of a string as Java prints it in hex
@pytest.mark.parametrize("user, want", [("user-1", None), ("", "0"), ("a", "61"), ("polygenelubricants", "80000000")])
def test_user_hash(spark, user, want):
    h = 0
    for ch in user:
        h = (h * 31 + ord(ch)) % (1 << 32)
    assert value(spark, text.user_hash("a"), a=user) == f"{h:x}"
    assert want in (None, f"{h:x}")


def test_unwrap_json(spark):
    assert value(spark, text.unwrap_json("a"), a='{"x":1}') == '{"x":1}'
    assert value(spark, text.unwrap_json("a"), a='"{\\"x\\":1}"') == '{"x":1}'
    assert value(spark, text.unwrap_json("a"), a=None) is None


@pytest.mark.parametrize("parts, want", [
    (["A", "B"], "A,B"), ([], "UNSPECIFIED_RULE"), (None, "UNSPECIFIED_RULE"), ([" "], "UNSPECIFIED_RULE"), (["A", None], "A,null")])
def test_join_reasons(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "a array<string>")
    assert df.select(text.join_reasons("a").alias("x")).first().x == want


@pytest.mark.parametrize("raw, want", [
    ("A,B", ["A", "B"]), (" ", []), (None, []), ("A,,", ["A"]), (",,", []), ("A,,B", ["A", "", "B"]), (" A,B", [" A", "B"])])
def test_split_reasons(spark, raw, want):
    assert value(spark, text.split_reasons("a"), a=raw) == want


def test_severity_and_status(spark):
    got = [value(spark, labels.severity("a"), a=n) for n in (80, 79, 73, 60, 59, 40, 39)]
    assert got == ["critical", "high", "high", "high", "medium", "medium", "low"]
    assert value(spark, labels.severity_color("a"), a=61) == "#f57c00"
    assert [value(spark, labels.status_class("a"), a=n) for n in (201, 404, 503, 302, 0)] == ["2xx", "4xx", "5xx", "other", "other"]


def test_lag_and_event_time(spark):
    df = spark.createDataFrame([(at(0),), (at(20),), (None,)], "t timestamp")
    now = F.lit(at(10))
    assert table(df.select(text.lag_ms("t", now), F.unix_seconds(text.event_time("t", now)) - int(at(0).timestamp()))) == [
        (0, 10), (0, 20), (10000, 0)]


# ------------------------------------------------------------------ requests

REQ = "userId string, amount decimal(28,9), currency string, merchantId string, country string, paymentMethod string"


def errors(spark, *row):
    df = spark.createDataFrame([(row[0], None if row[1] is None else Decimal(row[1]), *row[2:])], REQ)
    return validation.validate_requests(df).first().errors


def test_valid_request(spark):
    assert errors(spark, "user-1", "120.50", "USD", "MRC-101", "US", "CARD") == {}


def test_every_field_bad(spark):
    assert errors(spark, "", "0", "usd", "", "U", None) == {
        "userId": "userId is required", "amount": "amount must be greater than zero",
        "currency": "currency must be ISO-4217 code", "merchantId": "merchantId is required",
        "country": "country must be ISO-3166 alpha-2", "paymentMethod": "paymentMethod is required"}


@pytest.mark.parametrize("row, fields", [
    (("", "-1", "invalid", "", "INVALID", "CARD"), {"userId", "amount", "currency", "merchantId", "country"}),
    (("", "-10", "usd", "", "USA", "CARD"), {"userId", "amount", "currency", "merchantId", "country"}),
    (("u", None, "USD", "m", "US", "CARD"), {"amount"}),
    (("u", "0.01", "USD", "m", "US", "CHEQUE"), {"paymentMethod"}),
    (("u", "0.009", "USD", "m", "US", "CARD"), {"amount"}),
])
def test_rejected_fields(spark, row, fields):
    assert set(errors(spark, *row)) == fields


def test_blank_code_reports_absence(spark):
    got = errors(spark, "u", "1", " ", "m", None, "CARD")
    assert got == {"currency": "currency is required", "country": "country is required"}


def test_split_valid(spark):
    df = spark.createDataFrame([("u", Decimal(1), "USD", "m", "US", "CARD"), ("", Decimal(1), "USD", "m", "US", "CARD")], REQ)
    ok, bad = validation.split_valid(validation.validate_requests(df))
    assert (ok.count(), bad.count(), "errors" in ok.columns) == (1, 1, False)


def test_poison(spark):
    layout = "event_id string, transaction_id string, user_id string, amount decimal(28,9), currency string, merchant_id string, country string"
    good = ["e", "t", "u", Decimal(1), "USD", "m", "US"]
    cases = [(None, None, None), (0, None, "NULL_EVENT_ID"), (2, None, "NULL_USER_ID"), (4, "EURO", "CURRENCY_TOO_LONG"),
             (6, "USA", "COUNTRY_TOO_LONG"), (3, Decimal(10) ** 17, "AMOUNT_OVERFLOW")]
    for place, bad, want in cases:
        row = list(good)
        if place is not None:
            row[place] = bad
        df = spark.createDataFrame([tuple(row)], layout)
        assert df.select(validation.poison_reason(df, validation.TRANSACTION_REQUIRED).alias("x")).first().x == want


def test_request_to_event(spark):
    df = spark.createDataFrame([("r1", "u", Decimal("10000.004"), " usd ", "m", " us ", "CARD", at(5))], f"request_id string, {REQ}, created_at timestamp")
    row, event = mapping.to_transactions(df).first(), mapping.to_created_events(df).first()
    assert (row.currency, row.country, row.amount) == ("USD", "US", Decimal("10000.00"))
    assert (event.transactionId, event.occurredAt.replace(tzinfo=None)) == (row.id, row.created_at.replace(tzinfo=None))
    assert event.amount == Decimal("10000.004") and len(event.traceId) == 32
    assert mapping.to_created_events(df).first() == event  # ids are derived, not drawn


def fraud(spark, *rows):
    return spark.createDataFrame(rows, schemas.FRAUD_EVENT)


def test_fraud_event_to_alert(spark):
    df = fraud(spark, ("evt-1", at(0), "tx-1", "t1", "u", 85, ["HIGH_AMOUNT", "HIGH_RISK_MERCHANT"], "v1.0.0"),
               (None, at(0), "tx-2", " ", "u", 70, [], "v1.0.0"))
    got = {r.transaction_id: r for r in mapping.to_alerts(df, F.lit(at(9))).collect()}
    assert got["tx-1"].reasons == "HIGH_AMOUNT,HIGH_RISK_MERCHANT" and got["tx-1"].source_event_id == "evt-1"
    assert (got["tx-2"].reasons, got["tx-2"].source_event_id, got["tx-2"].trace_id) == ("UNSPECIFIED_RULE", "unknown", None)
    assert mapping.alert_view(mapping.to_alerts(df, F.lit(at(9)))).filter("transaction_id = 'tx-1'").first().reasons == [
        "HIGH_AMOUNT", "HIGH_RISK_MERCHANT"]


def test_notification_content(spark):
    alerts = spark.createDataFrame([("a1", "tx<1>", "u&1", 85, "A , B", at(61), "e", None), ("a2", "t", "u", 45, " ", at(0), "e", None)], schemas.ALERT)
    got = {r.alert_id: r for r in mapping.notification_content(alerts).collect()}
    assert got["a1"].subject == "[FRAUD ALERT] Risk score 85 - User u&1 - Transaction tx<1>"
    assert (got["a1"].severity, got["a1"].transaction_html, got["a1"].user_html) == ("CRITICAL", "tx&lt;1&gt;", "u&amp;1")
    assert got["a1"].detected_at == "2024-01-01 00:01:01 UTC" and got["a1"].reasons_html == ["A", "B"]
    assert (got["a2"].severity, got["a2"].reasons_html) == ("MEDIUM", ["UNSPECIFIED"])
