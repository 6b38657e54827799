"""Every table and event layout, declared once and never inferred."""

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 2)
# events carry the amount as it was sent, before storage rounds it to cents
EVENT_MONEY = T.DecimalType(28, 9)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, TS, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DoubleType(), T.BooleanType()

REQUEST = _schema(
    userId=S, amount=EVENT_MONEY, currency=S, merchantId=S, country=S, paymentMethod=S
)
TRANSACTION = _schema(
    id=S, user_id=S, amount=MONEY, currency=S, merchant_id=S, country=S, payment_method=S, created_at=TS
)
CREATED_EVENT = _schema(
    eventId=S, occurredAt=TS, transactionId=S, traceId=S, userId=S, amount=EVENT_MONEY, currency=S,
    merchantId=S, country=S, paymentMethod=S,
)
FRAUD_EVENT = _schema(
    eventId=S, occurredAt=TS, transactionId=S, traceId=S, userId=S, riskScore=I,
    reasons=T.ArrayType(S), ruleVersion=S,
)
HISTORY = _schema(
    transaction_id=S, event_id=S, user_id=S, amount=MONEY, currency=S, merchant_id=S, country=S,
    occurred_at=TS, seq=L,
)
PROCESSED = _schema(event_id=S, processed_at=TS)
ALERT = _schema(
    id=S, transaction_id=S, user_id=S, risk_score=I, reasons=S, created_at=TS, source_event_id=S, trace_id=S
)
OUTBOX = _schema(
    id=S, event_id=S, topic=S, event_key=S, payload=S, trace_parent=S, baggage=S, status=S, attempts=I,
    next_attempt_at=TS, created_at=TS, published_at=TS, last_error=S,
)
DEAD_LETTER = _schema(topic=S, partition=I, key=S, value=S, error_code=S)
NOTIFICATION = _schema(alert_id=S, channel=S, outcome=S, duration_ms=L)
SAMPLE = _schema(ts=TS, name=S, labels=T.MapType(S, S), value=D)
LOG_LINE = _schema(ts=TS, service=S, line=S)
SPAN = _schema(
    trace_id=S, span_id=S, parent_span_id=S, service=S, name=S, kind=S, status=S, start=TS, duration_ms=D
)
LOG_FIELDS = _schema(
    timestamp=S, level=S, logger_name=S, message=S, traceId=S, spanId=S, event=S, outcome=S, channel=S,
    decision=S, transactionId=S, eventId=S, alertId=S, risk_score=I, duration_ms=D, lag_ms=L,
    error_code=S, error_class=S,
)

# JSON keeps microseconds; the default of the JSON writer stops at milliseconds
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# event field (as sent) -> column (as worked with)
EVENT_COLUMNS = {
    "eventId": "event_id", "occurredAt": "occurred_at", "transactionId": "transaction_id", "traceId": "trace_id",
    "userId": "user_id", "amount": "amount", "currency": "currency", "merchantId": "merchant_id",
    "country": "country", "paymentMethod": "payment_method", "riskScore": "risk_score", "reasons": "reasons",
    "ruleVersion": "rule_version",
}
