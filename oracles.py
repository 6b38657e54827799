"""The same results in plain SQL for DuckDB: one statement per query, over the given tables."""

from __future__ import annotations

from riskflow.plans import samples as M
from riskflow.plans.panels import ACTIONABLE_RULES, SLO_RULES

BASE = 1704067200000000
HOUR = 3600 * 1000000
SQL: dict[str, str] = {}


def at(hours: int, minutes: int = 0) -> int:
    return BASE + (hours * 60 + minutes) * 60 * 1000000


T0, T1 = at(5, 50), at(6, 20)

# ------------------------------------------------------------------ shared tables

TX = f"""transactions AS (
  SELECT event_id AS seq, 'evt-' || event_id AS event_id, 'tx-' || event_id AS transaction_id, 'user-' || user_id AS user_id,
         {BASE} + (epoch_us(ts) - {BASE}) // (CASE WHEN user_id % 2 = 0 THEN 1440 ELSE 60 END) AS us,
         CAST(round(value * 100) AS BIGINT) * 60 AS cents,
         CAST(CAST(CAST(round(value * 100) AS BIGINT) * 60 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,2)) AS amount,
         CASE CAST(json_extract(props, '$.k') AS INT) % 10 WHEN 0 THEN 'MRC-999' WHEN 1 THEN 'mrc-666'
              ELSE 'MRC-' || (100 + CAST(json_extract(props, '$.k') AS INT)) END AS merchant_id,
         ['US','BR','MX','AR','CL','PE'][CAST((user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] AS country,
         ['CARD','TRANSFER','WALLET','CASH'][CAST(event_id % 4 + 1 AS INT)] AS payment_method,
         event_type, substr(sha256('trace:evt-' || event_id), 1, 32) AS trace
  FROM events)"""

SCORED = TX + """, known AS (
  SELECT *,
         count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY user_id, us)
         + row_number() OVER (PARTITION BY user_id, us ORDER BY seq) - 1 AS prior_count,
         lag(country) OVER (PARTITION BY user_id ORDER BY us, seq) AS prev_country,
         lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS prev_us
  FROM transactions), flagged AS (
  SELECT *,
         CASE WHEN amount > 10000.00 THEN 45 ELSE 0 END AS a,
         CASE WHEN prior_count + 1 >= 5 THEN 35 ELSE 0 END AS v,
         CASE WHEN lower(prev_country) <> lower(country) AND prev_us > us - 1800000000 THEN 30 ELSE 0 END AS c,
         CASE WHEN upper(merchant_id) IN ('MRC-999','MRC-666','MRC-404') THEN 25 ELSE 0 END AS m
  FROM known), scored AS (
  SELECT *, CAST(least(100, a + v + c + m) AS INT) AS risk_score, least(100, a + v + c + m) >= 70 AS fraudulent,
         concat_ws(',', CASE WHEN a > 0 THEN 'HIGH_AMOUNT' END, CASE WHEN v > 0 THEN 'HIGH_VELOCITY' END,
                   CASE WHEN c > 0 THEN 'COUNTRY_CHANGE_IN_SHORT_WINDOW' END, CASE WHEN m > 0 THEN 'HIGH_RISK_MERCHANT' END) AS reasons
  FROM flagged)"""

ALERTS = SCORED + """, alerts AS (
  SELECT sha256('alert:' || sha256('fraud:' || event_id)) AS id, transaction_id, user_id, risk_score,
         CASE WHEN reasons = '' THEN 'UNSPECIFIED_RULE' ELSE reasons END AS reasons, us + 1000000 AS created_us,
         sha256('fraud:' || event_id) AS source_event_id, CASE WHEN event_type <> 'error' THEN trace END AS trace_id
  FROM scored WHERE fraudulent)"""

REQUESTS = f"""requests AS (
  SELECT event_id AS request_id,
         CASE WHEN event_type = 'signup' AND k = 2 THEN '  ' ELSE 'user-' || user_id END AS user_id,
         CASE WHEN event_type = 'view' AND k = 3 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) - 500 END AS cents,
         CASE WHEN event_type = 'error' THEN 'usd' WHEN k = 3 THEN '' ELSE 'USD' END AS currency,
         CASE WHEN k = 4 THEN NULL ELSE 'MRC-' || k END AS merchant_id,
         CASE WHEN k = 5 THEN 'USA' ELSE ['US','BR','MX','AR','CL','PE'][CAST((user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] END AS country,
         CASE WHEN k = 6 THEN 'CHEQUE' WHEN k = 7 THEN NULL ELSE 'CARD' END AS payment_method,
         CASE event_type WHEN 'click' THEN 'WebHook' WHEN 'view' THEN ' ' ELSE 'api' END AS channel, epoch_us(ts) AS us
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) % 10 AS k FROM events)), checked AS (
  SELECT *,
         CASE WHEN trim(user_id) = '' THEN 'userId is required' END AS e_user,
         CASE WHEN cents IS NULL THEN 'amount is required' WHEN cents < 1 THEN 'amount must be greater than zero' END AS e_amount,
         CASE WHEN currency = '' THEN 'currency is required' WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'currency must be ISO-4217 code' END AS e_currency,
         CASE WHEN merchant_id IS NULL THEN 'merchantId is required' END AS e_merchant,
         CASE WHEN NOT regexp_full_match(country, '[A-Z]{{2}}') THEN 'country must be ISO-3166 alpha-2' END AS e_country,
         CASE WHEN payment_method IS NULL OR payment_method NOT IN ('CARD','TRANSFER','WALLET','CASH') THEN 'paymentMethod is required' END AS e_method
  FROM requests), accepted AS (
  SELECT * FROM checked WHERE coalesce(e_user, e_amount, e_currency, e_merchant, e_country, e_method) IS NULL)"""

DELIVERIES = TX + """, deliveries AS (
  SELECT * FROM transactions
  UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq) FROM transactions WHERE event_type = 'error')"""

FLAWED = DELIVERIES + """, flawed AS (
  SELECT *, CASE WHEN event_type = 'error' AND cents % 3 = 0 THEN 'NULL_EVENT_ID'
                 WHEN event_type = 'click' AND cents % 3 = 1 THEN 'NULL_COUNTRY'
                 WHEN event_type = 'view' AND cents % 3 = 1 THEN 'CURRENCY_TOO_LONG'
                 WHEN event_type = 'signup' AND cents % 3 = 2 THEN 'AMOUNT_OVERFLOW' END AS error_code
  FROM deliveries)"""

OUTBOX = TX + """, outbox AS (
  SELECT sha256('outbox:' || event_id) AS id, event_id, transaction_id, user_id, cents, event_type,
         CASE WHEN event_type = 'purchase' THEN 'PUBLISHED' ELSE 'PENDING' END AS status,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS attempts,
         us + CASE WHEN event_type = 'error' THEN 2000000 ELSE 0 END AS next_us, us AS created_us,
         CASE WHEN event_type = 'purchase' THEN us + 1000000 END AS published_us,
         CASE WHEN event_type = 'error' THEN 'timeout' END AS last_error,
         CASE WHEN event_type <> 'error' THEN '00-' || trace || '-' || substr(sha256(event_id), 1, 16) || '-01' END AS trace_parent
  FROM transactions)"""

OUTBOX_COLUMNS = """id, event_id, status, CAST(attempts AS INT) AS attempts, next_us, created_us,
  coalesce(published_us, -1) AS published_us, coalesce(last_error, '') AS last_error"""

LOGS = TX + """, logs AS (
  SELECT seq AS line_id, us, CASE WHEN event_type IN ('purchase','click') THEN 'fraud-detection-service'
              WHEN event_type IN ('view','signup') THEN 'alert-service' ELSE 'transaction-service' END AS service,
         NOT (event_type = 'error' AND CAST(right(user_id, 1) AS INT) % 2 = 1) AS json, event_type, transaction_id, event_id, trace,
         CASE event_type WHEN 'purchase' THEN 'fraud_decision_made' WHEN 'click' THEN 'fraud_event_published'
              WHEN 'view' THEN 'notification_result' WHEN 'signup' THEN 'fraud_alert_logged' ELSE 'transaction_outbox_publish_failed' END AS event,
         CASE event_type WHEN 'purchase' THEN 'fraud' WHEN 'view' THEN CASE WHEN cents % 2 = 0 THEN 'failed' ELSE 'success' END
              WHEN 'error' THEN 'failed' ELSE 'success' END AS outcome,
         CAST(cents % 101 AS INT) AS risk_score
  FROM transactions)"""

ITEM = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

SPANS = f"""spans AS (
  SELECT 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
         'transaction-service' AS service, 'POST ' || o_orderpriority AS name, 'SERVER' AS kind,
         CASE WHEN o_orderstatus = 'F' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END AS status,
         epoch_us(o_orderdate) AS start_us, round(o_totalprice) / 100 AS duration_ms
  FROM orders
  UNION ALL
  SELECT 't' || l_orderkey, 'c' || {ITEM}, 'o' || l_orderkey,
         CASE WHEN l_linestatus = 'F' THEN 'transaction-service' ELSE 'fraud-detection-service' END, 'line ' || l_linenumber, 'PRODUCER',
         CASE WHEN l_returnflag = 'R' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END, epoch_us(l_shipdate), l_quantity + 1
  FROM lineitem
  UNION ALL
  SELECT 't' || l_orderkey, 's' || {ITEM}, 'c' || {ITEM},
         CASE WHEN l_linestatus = 'F' THEN 'fraud-detection-service' ELSE 'alert-service' END, 'line ' || l_linenumber, 'CONSUMER',
         CASE WHEN l_returnflag = 'R' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END, epoch_us(l_shipdate), l_quantity
  FROM lineitem)"""

LOAD = """results AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 500 WHEN 'A' THEN 400 ELSE 201 END AS code, CAST(round(l_extendedprice / 10) AS BIGINT) AS ms
  FROM lineitem)"""


def put(name: str, tables: str, select: str) -> None:
    SQL[name] = f"WITH {tables} {select}"


# ------------------------------------------------------------------ scoring

put("score_transactions", SCORED,
    "SELECT event_id, user_id, CAST(prior_count AS BIGINT) AS prior_count, risk_score, fraudulent, reasons FROM scored")
SQL["stream_scored"] = SQL["score_transactions"]
SQL["stream_replayed"] = SQL["score_transactions"]
put("stream_redelivered", SCORED, "SELECT event_id, risk_score, CAST(fraudulent AS BIGINT) AS sent FROM scored")
put("stream_same_transaction", TX, """
  SELECT transaction_id, CASE event_type WHEN 'error' THEN 'DUPLICATE_TRANSACTION,decided' ELSE 'decided' END AS outcomes FROM transactions""")
put("read_back_records", TX, """
  SELECT event_id, user_id, us, cents, merchant_id FROM transactions""")
put("stream_deduplicated", TX, "SELECT event_id, user_id FROM transactions")
put("stream_poison", TX, "SELECT transaction_id, CASE event_type WHEN 'error' THEN 'transactions.created.dlq' ELSE '' END AS topic FROM transactions")
put("velocity_count", SCORED, "SELECT seq, CAST(prior_count AS BIGINT) AS prior_count FROM scored")
put("trailing_ten_minutes", TX, """
  SELECT seq, CAST(count(*) OVER (PARTITION BY country ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY country, us) + row_number() OVER (PARTITION BY country, us ORDER BY seq) - 1 AS BIGINT) AS n
  FROM transactions""")
put("last_transaction", SCORED, "SELECT seq, coalesce(prev_country, '') AS prev_country, coalesce(prev_us, -1) AS prev_us FROM scored")
put("previous_row", TX, """
  SELECT transaction_id, coalesce(lag(transaction_id) OVER (PARTITION BY user_id ORDER BY us, seq), '') AS prev_transaction_id
  FROM transactions""")
put("latest_arrived", f"items AS (SELECT l_suppkey, l_shipdate, l_quantity, {ITEM} AS seq FROM lineitem)", """
  SELECT seq, coalesce(max({d: epoch_us(l_shipdate), s: seq, q: l_quantity})
         OVER (PARTITION BY l_suppkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).q, -1.0) AS prev_quantity FROM items""")
put("score_against_history", SCORED, f"""
  SELECT event_id, CAST(prior_count AS BIGINT) AS prior_count, risk_score, reasons FROM scored WHERE us >= {at(0, 15)}""")
put("listed_merchants", TX, """
  SELECT transaction_id, upper(merchant_id) IN (SELECT 'MRC-' || (s_nationkey + 100) FROM supplier) AS listed FROM transactions""")
put("custom_rules", TX + """, hits AS (
  SELECT event_id, amount > 10000.00 AS a, payment_method = 'CASH' AS p, upper(merchant_id) IN ('MRC-110','MRC-999') AS m FROM transactions)""", """
  SELECT event_id, CAST(least(100, CASE WHEN a THEN 45 ELSE 0 END + CASE WHEN p THEN 50 ELSE 0 END + CASE WHEN m THEN 25 ELSE 0 END) AS INT) AS risk_score,
         CASE WHEN a THEN 45 ELSE 0 END + CASE WHEN p THEN 50 ELSE 0 END + CASE WHEN m THEN 25 ELSE 0 END >= 60 AS fraudulent,
         concat_ws(',', CASE WHEN a THEN 'HIGH_AMOUNT' END, CASE WHEN p THEN 'CASH_PAYMENT' END, CASE WHEN m THEN 'HIGH_RISK_MERCHANT' END) AS reasons
  FROM hits""")
put("fraud_events", SCORED, """
  SELECT sha256('fraud:' || event_id) AS "eventId", us + 1000000 AS us, transaction_id AS "transactionId",
         CASE WHEN event_type <> 'error' THEN trace ELSE '' END AS "traceId", user_id AS "userId", risk_score AS "riskScore", reasons,
         'v1.0.0' AS "ruleVersion" FROM scored WHERE fraudulent""")
put("decisions_by_label", SCORED,
    "SELECT CASE WHEN fraudulent THEN 'fraud' ELSE 'clean' END AS decision, count(*) AS decisions FROM scored GROUP BY 1")
put("rule_hits", SCORED, """
  SELECT rule, count(*) AS hits FROM (SELECT unnest(string_split(reasons, ',')) AS rule FROM scored WHERE reasons <> '') GROUP BY 1""")

# ------------------------------------------------------------------ requests and functions

put("validate_requests", REQUESTS, """
  SELECT request_id, concat_ws('; ', 'amount: ' || e_amount, 'country: ' || e_country, 'currency: ' || e_currency,
         'merchantId: ' || e_merchant, 'paymentMethod: ' || e_method, 'userId: ' || e_user) AS errors FROM checked""")
put("rejected_requests", REQUESTS, " UNION ALL ".join(
    f"SELECT '{field}' AS field, {col} AS message, count(*) AS n FROM checked WHERE {col} IS NOT NULL GROUP BY 2"
    for field, col in (("userId", "e_user"), ("amount", "e_amount"), ("currency", "e_currency"),
                       ("merchantId", "e_merchant"), ("country", "e_country"), ("paymentMethod", "e_method"))))
put("accepted_transactions", REQUESTS, """
  SELECT sha256('transaction:' || request_id) AS id, user_id, cents, currency, merchant_id, country, payment_method, us FROM accepted""")
put("stream_ingested", REQUESTS, "SELECT sha256('transaction:' || request_id) AS id, user_id, cents, currency, country, merchant_id, us FROM accepted")
SQL["stream_two_channels"] = SQL["stream_ingested"]
put("read_back_requests", REQUESTS + ", kept AS (SELECT count(*) AS n FROM accepted)", """
  SELECT * FROM (SELECT 'api' AS channel, true AS accepted, n FROM kept UNION ALL
                 SELECT 'api', false, (SELECT count(*) FROM requests) - n FROM kept) WHERE n > 0""")
put("created_events", REQUESTS, """
  SELECT sha256('event:' || request_id) AS "eventId", us, sha256('transaction:' || request_id) AS "transactionId",
         substr(sha256(request_id::VARCHAR), 1, 32) AS "traceId", user_id AS "userId", cents, currency, merchant_id AS "merchantId", country,
         payment_method AS "paymentMethod" FROM accepted""")
put("normalized_codes", TX, """
  SELECT event_id, country AS code, CASE event_type WHEN 'click' THEN 'webhook' WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'unknown' ELSE event_type END AS channel
  FROM transactions""")
put("trace_ids", TX, """
  SELECT event_id,
         CASE WHEN event_type IN ('error','view') THEN '' ELSE trace END AS hex,
         CASE event_type WHEN 'error' THEN 'context' WHEN 'view' THEN upper(trace) || '0'
              WHEN 'click' THEN ' ' || upper(substr(trace, 1, 8) || '-' || substr(trace, 9, 24)) || chr(9) ELSE upper(trace) END AS resolved,
         CASE WHEN event_type IN ('error','view') THEN substr(sha256(event_id), 1, 32) ELSE trace END AS generated,
         CASE WHEN event_type IN ('error','view','signup') THEN ''
              ELSE '00-' || trace || '-' || substr(sha256(event_id), 1, 16) || CASE WHEN seq % 2 = 0 THEN '-01' ELSE '-00' END END AS traceparent,
         CASE event_type WHEN 'error' THEN 'none' WHEN 'view' THEN upper(trace) || '0'
              WHEN 'click' THEN upper(substr(trace, 1, 8) || '-' || substr(trace, 9, 24)) ELSE upper(trace) END AS trimmed,
         CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN upper(trace) || '0'
              WHEN 'click' THEN upper(substr(trace, 1, 8) || '-' || substr(trace, 9, 24)) ELSE upper(trace) END AS trimmed_empty
  FROM transactions""")
put("user_hash", TX, """
  SELECT user_id, lower(printf('%X', list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(user_id, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
         lambda acc, c: (acc * 31 + c) % 4294967296))) AS user_hash FROM (SELECT DISTINCT user_id FROM transactions)""")
put("payload_round_trip", TX, """
  SELECT event_id AS "eventId", us, user_id AS "userId", cents, CASE WHEN event_type <> 'error' THEN trace ELSE '' END AS "traceId" FROM transactions""")
SQL["error_texts"] = """
  SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND NOT regexp_full_match(text, '[\\x00-\\x20\\s]*') THEN substr(text, 1, 512) ELSE source END AS error FROM documents"""
put("ingest_lag", TX, f"""
  SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE greatest(0, {at(0, 20)} // 1000 - us // 1000) END AS lag_ms,
         CASE WHEN event_type = 'error' THEN {at(0, 20)} ELSE us END AS us FROM transactions""")
put("poison_reasons", FLAWED, "SELECT transaction_id, seq, coalesce(error_code, '') AS error_code FROM flawed")
put("dead_letters", FLAWED, """
  SELECT 'transactions.created.dlq' AS topic, transaction_id AS key, user_id, error_code FROM flawed WHERE error_code IS NOT NULL""")
put("tombstones", TX, """
  SELECT CASE WHEN event_type = 'error' THEN 'EMPTY_EVENT_PAYLOAD' ELSE 'processed' END AS outcome, count(*) AS n FROM transactions GROUP BY 1""")
SEVERITY = "CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END"
COLOR = "CASE WHEN risk_score >= 80 THEN '#d32f2f' WHEN risk_score >= 60 THEN '#f57c00' WHEN risk_score >= 40 THEN '#fbc02d' ELSE '#388e3c' END"
put("severity_labels", SCORED, f"SELECT event_id, {SEVERITY} AS severity, {COLOR} AS color FROM scored")
put("reason_text", SCORED + """, listed AS (
  SELECT event_id, CASE event_type
      WHEN 'view' THEN CASE WHEN reasons = '' THEN 'A,,' ELSE reasons || ',A,,' END
      WHEN 'click' THEN CASE WHEN reasons = '' THEN 'null' ELSE reasons || ',null' END
      ELSE CASE WHEN reasons = '' THEN 'UNSPECIFIED_RULE' ELSE reasons END END AS reasons FROM scored)""", """
  SELECT event_id, reasons, CAST(len(string_split(rtrim(reasons, ','), ',')) AS INT) AS n, replace(rtrim(reasons, ','), ',', '|') AS parts FROM listed""")
put("status_classes", LOAD, """
  SELECT CASE code // 100 WHEN 2 THEN '2xx' WHEN 4 THEN '4xx' WHEN 5 THEN '5xx' ELSE 'other' END AS status_class, count(*) AS n FROM results GROUP BY 1""")

# ------------------------------------------------------------------ delivery

put("first_arrivals", DELIVERIES, "SELECT event_id, min(seq) AS seq, any_value(user_id) AS user_id FROM deliveries GROUP BY 1")
put("not_yet_processed", DELIVERIES, "SELECT event_id, min(seq) AS seq FROM deliveries WHERE event_type <> 'signup' GROUP BY 1")
put("processed_markers", TX, f"SELECT event_id, us FROM transactions WHERE us >= {at(6)}")
put("latest_per_user", TX, """
  SELECT user_id, seq, country, merchant_id FROM transactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, seq DESC) = 1""")
put("late_rows", f"items AS (SELECT {ITEM} AS seq, l_shipdate FROM lineitem)", """
  SELECT seq, coalesce(l_shipdate < max(l_shipdate) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 365 DAYS, false) AS late FROM items""")
put("stage_funnel", SCORED, """
  SELECT count(*) AS transactions, count(*) FILTER (event_type <> 'error') AS decided, count(*) FILTER (fraudulent AND event_type <> 'error') AS fraud,
         count(*) FILTER (fraudulent AND event_type NOT IN ('error', 'view')) AS alerted, count(*) FILTER (event_type <> 'error') / count(*) AS coverage,
         count(*) FILTER (fraudulent AND event_type NOT IN ('error', 'view')) / greatest(1, count(*) FILTER (fraudulent AND event_type <> 'error')) AS conversion,
         count(*) FILTER (fraudulent AND event_type NOT IN ('error', 'view')) / count(*) AS fraud_ratio FROM scored""")
put("attempt_numbers", f"items AS (SELECT l_orderkey, {ITEM} AS item FROM lineitem)",
    "SELECT l_orderkey, item, row_number() OVER (PARTITION BY l_orderkey ORDER BY item) AS attempt FROM items")

# ------------------------------------------------------------------ alerts

put("list_alerts", ALERTS, """
  SELECT id, transaction_id, user_id, risk_score, reasons, created_us, source_event_id, coalesce(trace_id, '') AS trace_id
  FROM alerts ORDER BY created_us DESC, id""")
put("alert_view", ALERTS, "SELECT id, CAST(len(string_split(reasons, ',')) AS INT) AS n, replace(reasons, ',', '|') AS parts FROM alerts")
put("alerts_for_users", ALERTS, """
  SELECT id, user_id, risk_score FROM alerts WHERE user_id IN (SELECT 'user-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
put("fan_out", ALERTS, "SELECT id, position, channel FROM alerts, (VALUES (0, 'log'), (1, 'email')) AS c(position, channel)")
put("notification_content", ALERTS, f"""
  SELECT id AS alert_id, '[FRAUD ALERT] Risk score ' || risk_score || ' - User <' || user_id || '> & co - Transaction ' || transaction_id AS subject,
         upper({SEVERITY}) AS severity, {COLOR} AS color, '&lt;' || user_id || '&gt; &amp; co' AS user_html, risk_score || ' / 100' AS score_text,
         strftime(make_timestamp(created_us), '%Y-%m-%d %H:%M:%S UTC') AS detected_at, replace(reasons, ',', '|') AS reasons_html FROM alerts""")
RANGE = f"WHERE created_us BETWEEN {at(0, 5)} AND {at(6)}"
put("triage_count", ALERTS, f"SELECT count(*) AS value FROM alerts {RANGE}")
put("triage_average", ALERTS, f"SELECT CAST(coalesce(round(CAST(avg(risk_score) AS DECIMAL(18,6)), 2), 0) AS DOUBLE) AS value FROM alerts {RANGE}")
put("triage_critical_share", ALERTS, f"""
  SELECT round(coalesce(sum(CASE WHEN risk_score >= 85 THEN 1 ELSE 0 END) / nullif(count(*), 0), 0), 9) AS value FROM alerts {RANGE}""")
put("triage_timeline", ALERTS, f"SELECT created_us // 60000000 * 60000000 AS us, count(*) AS alerts FROM alerts {RANGE} GROUP BY 1 ORDER BY 1")
put("triage_top_reasons", ALERTS, f"""
  SELECT reason, count(*) AS value FROM (SELECT unnest(regexp_split_to_array(reasons, ',')) AS reason FROM alerts {RANGE})
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
put("triage_latest", ALERTS, """
  SELECT created_us AS us, id AS alert_id, transaction_id, user_id, risk_score, reasons, coalesce(trace_id, '') AS trace_id
  FROM alerts ORDER BY created_us DESC, id LIMIT 200""")
put("alerts_by_severity", ALERTS, f"SELECT {SEVERITY} AS severity, count(*) AS alerts FROM alerts GROUP BY 1")
put("risk_summary", ALERTS, """
  SELECT count(risk_score) AS count, CAST(sum(risk_score) AS BIGINT) AS sum, max(risk_score) AS max, round(avg(risk_score), 6) AS mean FROM alerts""")
put("tumbling_alerts", ALERTS, "SELECT created_us // 60000000 * 60000000 AS us, count(*) AS n FROM alerts GROUP BY 1")
put("sliding_alerts", ALERTS, f"""
  SELECT (created_us // {M.STEP_US} - i) * {M.STEP_US} AS us, count(*) AS n FROM alerts, range(40) AS r(i) GROUP BY 1""")
put("stream_alerts", ALERTS, "SELECT id, transaction_id, user_id, risk_score, reasons, created_us, CAST(1 AS BIGINT) AS sent FROM alerts")
# in the stream the events carry no trace id, and the id of an alert does not depend on it

# ------------------------------------------------------------------ counters and load reports

put("received_by_channel", REQUESTS, """
  SELECT CASE WHEN trim(channel) = '' THEN 'unknown' ELSE lower(channel) END AS channel, count(*) AS received FROM requests GROUP BY 1""")
put("notification_outcomes", ALERTS, """
  SELECT channel, CASE WHEN channel = 'email' AND risk_score >= 90 THEN 'failed' ELSE 'success' END AS outcome, count(*) AS n
  FROM alerts, (VALUES ('log'), ('email')) AS c(channel) GROUP BY 1, 2""")
put("timer_summary", LOAD, """
  SELECT code AS "statusCode", count(*) AS count, CAST(sum(ms) AS BIGINT) AS total, max(ms) AS max, round(avg(ms), 6) AS mean FROM results GROUP BY 1""")
put("dead_letter_counts", FLAWED, """
  SELECT event_type, count(*) AS received, count(*) FILTER (error_code IS NULL) AS reprocessed, count(error_code) AS failed FROM flawed GROUP BY 1""")
put("load_report", LOAD, """
  SELECT count(*) AS requests, count(*) FILTER (code <> 201) AS errors, round(count(*) FILTER (code <> 201) / count(*), 9) AS error_rate,
         (SELECT ms FROM (SELECT ms, row_number() OVER (ORDER BY ms) AS r FROM results) WHERE r = (SELECT CAST(ceil(count(*) * CAST(0.95 AS DECIMAL(3,2))) AS BIGINT) FROM results)) AS p95
  FROM results""")
put("trend_stats", LOAD, """
  SELECT min(ms) AS min, max(ms) AS max, round(avg(ms), 6) AS avg, round(quantile_cont(ms, 0.5), 6) AS med, round(quantile_cont(ms, 0.9), 6) AS p90,
         round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99,
         round(count(*) FILTER (code >= 400) / count(*), 6) AS failed_share, count(*) FILTER (code >= 400) / count(*) < 0.15 AS failed_ok,
         quantile_cont(ms, 0.95) < 3500 AND quantile_cont(ms, 0.99) < 5000 AS latency_ok FROM results""")
put("top_merchants_by_country", TX, """
  SELECT country, upper(merchant_id) AS merchant, count(*) AS n FROM transactions GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, upper(merchant_id)) <= 3""")

# ------------------------------------------------------------------ outbox

put("outbox_enqueue", OUTBOX, """
  SELECT id, event_id, 'transactions.created' AS topic, transaction_id AS event_key, user_id, coalesce(trace_parent, '') AS trace_parent,
         user_id AS baggage, 'PENDING' AS status, CAST(0 AS INT) AS attempts, created_us AS next_us FROM outbox""")
put("outbox_due", OUTBOX, f"SELECT {OUTBOX_COLUMNS} FROM outbox o WHERE status = 'PENDING' AND o.next_us <= {at(5)} ORDER BY o.created_us, id LIMIT 200")
put("outbox_headers", OUTBOX, """
  SELECT id, coalesce(trace_parent, '') AS traceparent, '' AS baggage_header FROM outbox""")
put("outbox_outcomes", OUTBOX + f""", told AS (SELECT id, cents % 3 = 0 AS ok, CASE WHEN cents % 2 = 0 THEN 'IOException' ELSE 'broker down' END AS error
  FROM outbox WHERE status = 'PENDING' AND cents % 3 <> 2), done AS (
  SELECT o.* REPLACE (CASE WHEN ok THEN 'PUBLISHED' ELSE status END AS status, CASE WHEN NOT ok THEN attempts + 1 ELSE attempts END AS attempts,
         CASE WHEN NOT ok THEN {at(5)} + 2000000 ELSE next_us END AS next_us, CASE WHEN ok THEN {at(5)} ELSE published_us END AS published_us,
         CASE WHEN ok THEN NULL WHEN NOT ok THEN error ELSE last_error END AS last_error)
  FROM outbox o LEFT JOIN told USING (id))""", f"SELECT {OUTBOX_COLUMNS} FROM done")
put("outbox_purge", OUTBOX, f"SELECT {OUTBOX_COLUMNS} FROM outbox o WHERE NOT (status = 'PUBLISHED' AND o.published_us < {at(3)})")
put("outbox_backlog", OUTBOX, f"""
  SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts, min(created_us) AS oldest_us,
         round(max(({at(5)} - created_us) / 1e6), 6) AS age FROM outbox GROUP BY 1""")

# ------------------------------------------------------------------ time series


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)


def samples(names: list[str] | None = None) -> str:
    rows = [m for m in M.moves() if names is None or m["name"] in names]
    values = ",\n".join(
        "(" + ", ".join(_literal(v) for v in (m["event_type"], m["name"], m["unit"], m["top"], M.label_text(m["labels"]),
                                             *(m["labels"].get(label) for label in M.LABELS))) + ")"
        for m in rows)
    cols = ", ".join(f'"{label}"' for label in M.LABELS)
    labels = ", ".join(
        f"any_value(CASE WHEN v.\"{label}\" = '*' THEN CAST(user_id % {M.NODES} AS VARCHAR) ELSE CAST(v.\"{label}\" AS VARCHAR) END) AS \"{label}\"" for label in M.LABELS)
    restart = int(M.RESTART.timestamp()) * 1000000 // M.STEP_US
    return f"""moves(event_type, name, unit, top, labels_text, {cols}) AS (VALUES {values}), moved AS (
  SELECT name, replace(labels_text, 'partition=*', 'partition=' || user_id % {M.NODES}) AS text, 'node-' || user_id % {M.NODES} AS instance,
         CAST(ceil(({BASE} + (epoch_us(ts) - {BASE}) // {M.SHRINK}) / {M.STEP_US}.0) AS BIGINT) AS slot,
         sum(CASE unit WHEN 'one' THEN 1000 WHEN 'value' THEN CAST(round(value * 1000) AS BIGINT) ELSE CAST(round(value) AS BIGINT) END) AS step, {labels}
  FROM events JOIN moves v USING (event_type) WHERE top IS NULL OR value <= top GROUP BY 1, 2, 3, 4), samples AS (
  SELECT *, slot * {M.STEP_US} AS us, sum(step) OVER (PARTITION BY name, text, instance, instance = '{M.RESTARTED}' AND slot >= {restart} ORDER BY slot) / 1000.0 AS value,
         name || '{{' || array_to_string(list_sort(string_split(concat_ws(',', nullif(text, ''), 'instance=' || instance), ',')), ',') || '}}' AS series
  FROM moved)"""


def deltas(source: str = "samples", where: str = "true") -> str:
    return f"""deltas AS (
  SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN value < prev THEN value ELSE value - prev END AS delta
  FROM (SELECT *, lag(value) OVER w AS prev, lag(us) OVER w AS prev_us FROM {source} WHERE {where} WINDOW w AS (PARTITION BY series ORDER BY us)))"""


RATE_US, MINUTE = 5 * 60 * 1000000, 60 * 1000000


def summary(t0: int = T0, t1: int = T1, rate_us: int = RATE_US, names: list[str] | None = None) -> str:
    """One row per series, by its own aggregates rather than by the steps the engine takes."""
    start = min(t0, t1 - rate_us, t1 - MINUTE)
    keep = ", ".join(f'any_value("{label}") AS "{label}"' for label in M.LABELS)
    return f"""{samples(names)}, {deltas(where=f'us > {start} AND us <= {t1}')}, summary AS (
  SELECT name, series, any_value(instance) AS instance, {keep},
         sum(delta) FILTER (prev_us > {t0}) AS increase, sum(delta) FILTER (prev_us > {t1 - rate_us}) / {rate_us / 1e6} AS rate,
         max_by(CASE WHEN prev_us > {t1 - MINUTE} THEN delta / ((us - prev_us) / 1e6) ELSE -1 END, us) AS last_rate, max_by(value, us) AS gauge
  FROM deltas GROUP BY 1, 2)"""


def agg(col: str, name: str, by: str = "", where: str = "true", fn: str = "sum", alias: str = "value") -> str:
    """Aggregate of a summary column over the matching series that have it."""
    if col == "irate":
        col, where = "last_rate", f"({where}) AND last_rate >= 0"
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else f"HAVING {fn}({col}) IS NOT NULL"
    return f"SELECT {head}{fn}({col}) AS {alias} FROM summary WHERE name = '{name}' AND ({where}) AND {col} IS NOT NULL {tail}"


def rounded(select: str, labels: str = "") -> str:
    head = f"{labels}, " if labels else ""
    return f"SELECT {head}round(value, 6) AS value FROM ({select})"


put("metric_samples", samples(), "SELECT series, us, round(value, 6) AS value FROM samples")
put("counter_deltas", samples(["fraud_decisions_total"]) + ", " + deltas(),
    "SELECT series, us, round(coalesce(delta, -1.0), 6) AS delta FROM deltas")
put("last_two_samples", samples(["transactions_received_total"]), """
  SELECT series, us, round(value, 6) AS value FROM samples QUALIFY row_number() OVER (PARTITION BY series ORDER BY us DESC) <= 2""")
PUB, WEB = "transaction_events_published_total", "http_server_requests_seconds_count"
put("metric_increase", summary(names=[PUB]), rounded(agg("increase", PUB, "outcome"), "outcome"))
put("metric_increase_extrapolated", f"""{samples([PUB])}, {deltas(where=f'us > {T0} AND us <= {T1}')}, edges AS (
  SELECT series, any_value(outcome) AS outcome, sum(delta) AS grown, (min(us) - {T0}) / 1e6 AS head, ({T1} - max(us)) / 1e6 AS tail,
         (max(us) - min(us)) / 1e6 AS covered, (max(us) - min(us)) / 1e6 / (count(*) - 1) AS gap, min_by(value, us) AS first_value
  FROM deltas GROUP BY 1 HAVING count(*) > 1), stretched AS (
  SELECT *, least(CASE WHEN head >= gap * 1.1 THEN gap / 2 ELSE head END, CASE WHEN grown > 0 THEN covered * first_value / grown ELSE 1e18 END) AS h,
         CASE WHEN tail >= gap * 1.1 THEN gap / 2 ELSE tail END AS t FROM edges)""",
    "SELECT outcome, round(sum(grown * (covered + h + t) / covered), 6) AS value FROM stretched GROUP BY 1")
put("metric_rate", summary(T1 - RATE_US, names=[WEB]), rounded(agg("rate", WEB, "uri, status"), "uri, status"))
put("metric_irate", summary(T1 - MINUTE, rate_us=MINUTE, names=[WEB]), rounded(agg("irate", WEB, "application"), "application"))
put("metric_gauge", summary(T1 - 6 * RATE_US, names=["jvm_memory_used_bytes"]),
    rounded(agg("gauge", "jvm_memory_used_bytes", "application", fn="avg"), "application"))
EVAL = "fraud_evaluation_latency_seconds"


def ratio(num: str, den: str, floor: str | None = "1.0", cap: str | None = None, positive: bool = False, factor: str = "1") -> str:
    base = "b.value" if floor is None else f"greatest(b.value, {floor})"
    value = f"a.value / nullif({base}, 0)"
    if cap:
        value = f"least({value}, {cap})"
    return f"SELECT {value} * {factor} AS value FROM ({num}) a, ({den}) b" + (" WHERE b.value > 0" if positive else "")


put("metric_mean_latency", summary(names=[f"{EVAL}_sum", f"{EVAL}_count"]), f"""
  SELECT application, round(a.value / greatest(b.value, 1) * 1000, 6) AS value
  FROM ({agg('increase', EVAL + '_sum', 'application')}) a JOIN ({agg('increase', EVAL + '_count', 'application')}) b USING (application)""")
put("metric_fraud_ratio", summary(names=["fraud_decisions_total", "fraud_alerts_total"]), rounded(
    ratio(agg("increase", "fraud_alerts_total"), agg("increase", "fraud_decisions_total", where="decision = 'fraud'"), cap="1", positive=True)))


def quantile(buckets: str, q: float, by: str = "") -> str:
    """`buckets` gives le, value and the labels `by`."""
    part = f"PARTITION BY {by}" if by else ""
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
  SELECT {head}min_by(value, le_n) AS value FROM (
    SELECT {head}le_n, n, CASE WHEN n >= {q} * total THEN
        CASE WHEN le_n = 'Infinity'::DOUBLE THEN lower_le
             ELSE lower_le + (le_n - lower_le) * ({q} * total - lower_n) / nullif(n - lower_n, 0) END END AS value FROM (
      SELECT *, max(n) OVER ({part}) AS total, coalesce(lag(le_n) OVER ({part} ORDER BY le_n), 0) AS lower_le,
             coalesce(lag(n) OVER ({part} ORDER BY le_n), 0) AS lower_n FROM (
        SELECT {head}CASE WHEN le = '+Inf' THEN 'Infinity'::DOUBLE ELSE CAST(le AS DOUBLE) END AS le_n, value AS n FROM ({buckets})))) {group}"""


put("metric_p95", summary(names=["http_server_requests_seconds_bucket"]),
    rounded(quantile(agg("increase", "http_server_requests_seconds_bucket", "le, uri"), 0.95, "uri"), "uri"))
END_OFFSET, DONE_OFFSET = "kafka_topic_partition_current_offset", "kafka_consumergroup_current_offset"
LAG = f"""SELECT d.consumergroup, d.topic, greatest(e.gauge - d.gauge, 0) AS gap FROM summary e JOIN summary d USING (topic, partition, instance, job)
  WHERE e.name = '{END_OFFSET}' AND d.name = '{DONE_OFFSET}'"""
put("metric_consumer_lag", summary(names=[END_OFFSET, DONE_OFFSET]),
    f"SELECT consumergroup, topic, round(sum(gap), 6) AS value FROM ({LAG}) GROUP BY 1, 2")
put("metric_label_values", samples([WEB]), "SELECT DISTINCT status AS value FROM samples")
put("metric_match", samples(["fraud_alert_notifications_total", WEB]), """
  SELECT series, count(*) AS n FROM samples WHERE regexp_full_match(coalesce(outcome, ''), 'success|fail.*|')
  AND NOT regexp_full_match(coalesce(status, ''), '4..|5..') AND coalesce(channel, '') <> 'log' GROUP BY 1""")
DLQ_IN = "kafka_dlq_events_received_total"
put("metric_or", summary(names=[PUB, DLQ_IN]), f"""
  SELECT application, round(CASE WHEN a.application IS NOT NULL THEN a.value ELSE b.value END, 6) AS value
  FROM ({agg('increase', PUB, 'application', "outcome = 'failed'")}) a FULL JOIN ({agg('increase', DLQ_IN, 'application')}) b USING (application)""")
put("metric_delta", samples(["fraud_alerts_total"]) + ", totals AS (SELECT us, sum(value) AS total FROM samples GROUP BY 1)", """
  SELECT round(min_by(total, us), 6) AS before, round(max_by(total, us), 6) AS after, round(max_by(total, us) - min_by(total, us), 6) AS delta FROM totals""")
put("metric_reduced", samples(["process_cpu_usage"]), """
  SELECT application, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min FROM samples GROUP BY 1""")


def steps(source: str, range_us: int, by: str = "") -> str:
    """Growth in the trailing range at every step, from the deltas in `source`."""
    head = f", {by}" if by else ""
    return f"""SELECT k{head}, sum(delta) AS value FROM (
    SELECT *, unnest(range(CAST(ceil(us / {M.STEP_US}.0) AS BIGINT), CAST(ceil((prev_us + {range_us}) / {M.STEP_US}.0) AS BIGINT))) AS k
    FROM {source} WHERE delta IS NOT NULL AND prev_us + {range_us} > us) GROUP BY k{head}"""


put("rate_by_step", samples(["fraud_decisions_total"]) + ", " + deltas(),
    f"SELECT k, decision, round(value / 300.0, 6) AS value FROM ({steps('deltas', RATE_US, 'decision')})")
put("reduced_by_step", samples(["fraud_decisions_total"]) + ", " + deltas() + f""", rates AS (
  SELECT k, decision, value / 300.0 AS value FROM ({steps('deltas', RATE_US, 'decision')}))""", """
  SELECT decision, calc, round(value, 6) AS value FROM (
    SELECT decision, 'last' AS calc, max_by(value, k) AS value FROM rates GROUP BY 1 UNION ALL SELECT decision, 'mean', avg(value) FROM rates GROUP BY 1
    UNION ALL SELECT decision, 'max', max(value) FROM rates GROUP BY 1 UNION ALL SELECT decision, 'min', min(value) FROM rates GROUP BY 1
    UNION ALL SELECT decision, 'sum', sum(value) FROM rates GROUP BY 1)""")
put("irate_by_step", samples([WEB]) + ", " + deltas(), f"""
  SELECT k, application, round(sum(value), 6) AS value FROM (
    SELECT application, delta / ((us - prev_us) / 1e6) AS value,
           unnest(range(slot, least(coalesce(next_slot, 4611686018427387904), CAST(ceil((prev_us + {MINUTE}) / {M.STEP_US}.0) AS BIGINT)))) AS k
    FROM (SELECT *, lead(slot) OVER (PARTITION BY series ORDER BY slot) AS next_slot FROM deltas) WHERE delta IS NOT NULL) GROUP BY 1, 2""")
put("gauge_by_step", samples(["jvm_memory_used_bytes"]), f"""
  SELECT k, application, round(avg(value), 6) AS value FROM (
    SELECT application, value, unnest(range(slot, least(coalesce(next_slot, 4611686018427387904), slot + {RATE_US // M.STEP_US}))) AS k
    FROM (SELECT *, lead(slot) OVER (PARTITION BY series ORDER BY slot) AS next_slot FROM samples)) GROUP BY 1, 2""")
put("mean_latency_by_step", samples([f"{EVAL}_sum", f"{EVAL}_count"]) + ", " + deltas(), f"""
  SELECT k, application, round(a.value / greatest(b.value, 1) * 1000, 6) AS value
  FROM ({steps(f"(SELECT * FROM deltas WHERE name = '{EVAL}_sum')", RATE_US, 'application')}) a
  JOIN ({steps(f"(SELECT * FROM deltas WHERE name = '{EVAL}_count')", RATE_US, 'application')}) b USING (k, application)""")
put("quantile_by_step", samples(["http_server_requests_seconds_bucket"]) + ", " + deltas() + f", buckets AS ({steps('deltas', RATE_US, 'le, uri')})",
    "SELECT k, uri, round(value, 6) AS value FROM (" + quantile("SELECT * FROM buckets", 0.95, "k, uri")
    + ") JOIN (SELECT k, uri FROM buckets GROUP BY 1, 2 HAVING count(*) > 1 AND max(value) FILTER (le = '+Inf') > 0) USING (k, uri)")
put("top_series_by_step", samples([WEB]) + ", " + deltas(), f"""
  SELECT k, uri, value FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, uri) AS place
    FROM (SELECT k, uri, round(value / 300.0, 6) AS value FROM ({steps('deltas', RATE_US, 'uri')}))) WHERE place <= 2""")
CONSUMED = "fraud_events_consumed_total"
put("stage_gap_by_step", samples([PUB, CONSUMED]) + ", " + deltas(), f"""
  SELECT k * {M.STEP_US} AS us, round((a.value - b.value) / 300.0, 6) AS value
  FROM ({steps(f"(SELECT * FROM deltas WHERE name = '{PUB}' AND outcome = 'success')", RATE_US)}) a
  JOIN ({steps(f"(SELECT * FROM deltas WHERE name = '{CONSUMED}')", RATE_US)}) b USING (k)""")


def rule_states(t0: int, t1: int) -> tuple[str, str]:
    """(tables, name of the final one): the eight rules with a denominator floor of 0.0001."""
    m1, m5, m10, m15 = (m * MINUTE for m in (1, 5, 10, 15))
    parts = []

    def source(reach: int, where: str) -> str:
        # only the samples a rule reaches from the evaluated steps count
        return f"""(SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN value < prev THEN value ELSE value - prev END AS delta
          FROM (SELECT *, lag(value) OVER w AS prev, lag(us) OVER w AS prev_us FROM samples WHERE us > {t0 - reach} AND us <= {t1} AND {where}
          WINDOW w AS (PARTITION BY series ORDER BY us)))"""

    def growth(rule, severity, name, range_us, by, labels, hold=0):
        parts.append(f"""SELECT '{rule}' AS rule, '{severity}' AS severity, {labels} AS labels, k, value, value > 0 AS breach, {hold} AS hold
          FROM ({steps(source(range_us, f"name = '{name}'"), range_us, by)})""")

    def share(rule, severity, num, den, range_us, by, breach, hold, positive=False):
        seconds, on = range_us / 1e6, f"k, {by}" if by else "k"
        labels = f"'{by}=' || {by}" if by else "''"
        reach = m5 if range_us == m5 else m10
        inner = f"""SELECT {on}, a.value / {seconds} / greatest(b.value / {seconds}, 0.0001) AS value
          FROM ({steps(source(reach, num), range_us, by)}) a JOIN ({steps(source(reach, den), range_us, by)}) b USING ({on})
          {'WHERE b.value > 0' if positive else ''}"""
        parts.append(f"SELECT '{rule}' AS rule, '{severity}' AS severity, {labels} AS labels, k, value, value {breach} AS breach, {hold} AS hold FROM ({inner})")

    def called(name):
        return f"name = '{name}'"

    growth("FraudAlertDetected", "warning", "fraud_alerts_total", m1, "series", "series")
    share("FraudPipelineCoverageSLOViolation", "critical", called("fraud_decisions_total"), called(PUB) + " AND outcome = 'success'", m5, "",
          "< 0.95", m10, True)
    share("FraudToAlertConversionSLOViolation", "critical", called("fraud_alerts_total"), called("fraud_decisions_total") + " AND decision = 'fraud'",
          m10, "", "< 0.98", m15)
    notified = called("fraud_alert_notifications_total")
    share("NotificationFailureRateHigh", "warning", notified + " AND outcome = 'failed'", notified, m10, "application", "> 0.05", m10)
    for rule, base, limit in (("FraudEvaluationLatencyHigh", EVAL, 0.25), ("AlertNotificationLatencyHigh", "fraud_alert_notification_latency_seconds", 1.5)):
        share(rule, "warning", called(base + "_sum"), called(base + "_count"), m10, "application", f"> {limit}", m10)
    growth("KafkaDlqTrafficDetected", "warning", DLQ_IN, m5, "application", "'application=' || application")
    growth("KafkaDlqReprocessFailed", "critical", "kafka_dlq_events_failed_total", m5, "application", "'application=' || application")
    first, last = -(-t0 // M.STEP_US), t1 // M.STEP_US
    tables = f"""evaluated AS ({' UNION ALL '.join(parts)}), inside AS (SELECT * FROM evaluated WHERE k BETWEEN {first} AND {last}), runs AS (
      SELECT *, k - row_number() OVER (PARTITION BY rule, labels, breach ORDER BY k) AS run FROM inside), states AS (
      SELECT k * {M.STEP_US} AS us, rule, severity, labels, value, CASE WHEN NOT breach THEN 'inactive'
             WHEN (k - min(k) OVER (PARTITION BY rule, labels, breach, run)) * {M.STEP_US} >= hold THEN 'firing' ELSE 'pending' END AS state FROM runs)"""
    return tables, "states"


from riskflow.plans.queries import _RULE_METRICS  # noqa: E402

put("rule_states", samples(_RULE_METRICS) + ", " + rule_states(at(0), at(12))[0],
    "SELECT us, rule, severity, labels, round(value, 9) AS value, state FROM states")

put("stream_rule_states", samples(_RULE_METRICS) + ", " + rule_states(at(0), at(12))[0],
    f"""SELECT us, rule, severity, labels, round(value, 9) AS value, state, (SELECT count(*) FROM samples WHERE us > {at(6, 6)} AND us <= {at(6, 7)}) AS late
    FROM states WHERE us <= (SELECT max(us) FROM samples)""")

# ------------------------------------------------------------------ dashboards


def board(panels: dict[str, tuple[str, str]], extra: str = "") -> str:
    """`panels` maps a panel to (labels, select)."""
    rows = []
    for name, (labels, select) in panels.items():
        text = " || ',' || ".join(f"'{c}=' || coalesce({c}, '')" for c in labels.split(", ")) if labels else "''"
        rows.append(f"SELECT '{name}' AS panel, {text} AS labels, round(CAST(value AS DOUBLE), 6) AS value FROM ({select})")
    return f"WITH {summary()}{extra} " + " UNION ALL ".join(rows)


TXS, FRD, ALR = "application = 'transaction-service'", "application = 'fraud-detection-service'", "application = 'alert-service'"
OK = "outcome = 'success'"
PATHS = "uri IN ('/api/v1/transactions', '/api/v1/webhooks/transactions')"
BAD_STATUS = "regexp_full_match(status, '4..|5..')"
DETECTED = "fraud_events_published_total"
NLAT = "fraud_alert_notification_latency_seconds"
PLAT = "transaction_event_publish_latency_seconds"


def gap(col: str, a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"SELECT a.value - b.value AS value FROM ({agg(col, a[0], where=a[1])}) a, ({agg(col, b[0], where=b[1])}) b"


_names = ", ".join(f"'{r}'" for r in SLO_RULES)
_actionable = ", ".join(f"'{r}'" for r in ACTIONABLE_RULES)
SQL["board_alerting"] = board({
    "fraud_alerts": ("", agg("increase", "fraud_alerts_total", where=ALR)),
    "slo_rules": ("", f"SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS value FROM states WHERE state = 'firing' AND us = {T1} AND rule IN ({_names})"),
    "transactions": ("", agg("increase", "transactions_received_total", where=TXS)),
    "fraud_ratio": ("", ratio(agg("increase", "fraud_alerts_total", where=ALR), agg("increase", "transactions_received_total", where=TXS))),
    "alert_rate_per_minute": ("", f"SELECT value * 60 AS value FROM ({agg('rate', 'fraud_alerts_total', where=ALR)})"),
    "average_risk_score": ("", ratio(agg("rate", "fraud_alert_risk_score_sum", where=ALR), agg("rate", "fraud_alert_risk_score_count", where=ALR), positive=True)),
    "decision_coverage": ("", ratio(agg("increase", "fraud_decisions_total", where=FRD), agg("increase", PUB, where=f"{TXS} AND {OK}"), positive=True)),
    "fraud_to_alert_conversion": ("", ratio(agg("increase", "fraud_alerts_total", where=ALR),
                                           agg("increase", "fraud_decisions_total", where=f"{FRD} AND decision = 'fraud'"), cap="1", positive=True)),
    "evaluation_latency": ("", ratio(agg("increase", EVAL + "_sum", where=FRD), agg("increase", EVAL + "_count", where=FRD), positive=True)),
    "notification_latency": ("", ratio(agg("increase", NLAT + "_sum", where=ALR), agg("increase", NLAT + "_count", where=ALR), positive=True)),
    "notification_outcomes": ("channel, outcome", agg("rate", "fraud_alert_notifications_total", "channel, outcome", ALR)),
    "actionable_alerts": ("rule, severity, labels", f"SELECT rule, severity, labels, 1.0 AS value FROM states WHERE state = 'firing' AND us = {T1} AND rule IN ({_actionable})"),
    "top_rules": ("rule", agg("increase", "fraud_rule_hits_total", "rule", FRD) + " ORDER BY value DESC, rule LIMIT 10"),
}, ", " + rule_states(T0, T1)[0])
SPR, EXP = "job = 'spring-services'", "job = 'kafka-exporter'"
CPU = """SELECT u.application, u.instance, u.gauge AS u, c.gauge AS c FROM summary u JOIN summary c USING (instance, job, application)
  WHERE u.name = 'process_cpu_usage' AND c.name = 'system_cpu_count' AND u.job = 'spring-services'"""
SQL["board_capacity"] = board({
    "total_consumer_lag": ("", f"SELECT sum(gap) AS value FROM ({LAG})"),
    "postgres_up": ("", agg("gauge", "pg_up")),
    "kafka_exporter_up": ("", agg("gauge", "up", where=EXP)),
    "instances_up": ("", agg("gauge", "up", where=SPR)),
    "stage_published": ("", agg("rate", PUB, where=f"{TXS} AND {OK}")),
    "stage_consumed": ("", agg("rate", CONSUMED, where=FRD)),
    "stage_detected": ("", agg("rate", DETECTED, where=f"{FRD} AND {OK}")),
    "stage_alerted": ("", agg("rate", "fraud_alerts_total", where=ALR)),
    "backlog_before_scoring": ("", gap("rate", (PUB, f"{TXS} AND {OK}"), (CONSUMED, FRD))),
    "backlog_before_alerting": ("", gap("rate", (DETECTED, f"{FRD} AND {OK}"), ("fraud_alerts_total", ALR))),
    "consumer_lag_by_group": ("consumergroup, topic", f"SELECT consumergroup, topic, sum(gap) AS value FROM ({LAG}) GROUP BY 1, 2"),
    "busiest_partitions": ("topic, partition", agg("rate", END_OFFSET, "topic, partition") + " ORDER BY value DESC, topic, partition LIMIT 12"),
    "pool_active": ("application", agg("gauge", "hikaricp_connections_active", "application")),
    "pool_pending": ("application", agg("gauge", "hikaricp_connections_pending", "application")),
    "pool_max": ("application", agg("gauge", "hikaricp_connections_max", "application")),
    "commits": ("datname", agg("rate", "pg_stat_database_xact_commit", "datname")),
    "rollbacks": ("datname", agg("rate", "pg_stat_database_xact_rollback", "datname")),
    "deadlocks": ("datname", agg("rate", "pg_stat_database_deadlocks", "datname")),
    "cpu_percent": ("application, instance", f"SELECT application, instance, 100 * avg(u / nullif(c, 0)) AS value FROM ({CPU}) GROUP BY 1, 2"),
    "heap": ("application", agg("gauge", "jvm_memory_used_bytes", "application", f"{SPR} AND area = 'heap'")),
    "cpu_cores": ("application", f"SELECT application, sum(u * c) AS value FROM ({CPU}) GROUP BY 1"),
})
DLQ = {part: f"kafka_dlq_events_{part}_total" for part in ("received", "reprocessed", "failed")}
SQL["board_messaging"] = board({
    "created_publish_success": ("", ratio(agg("rate", PUB, where=OK), agg("rate", PUB))),
    "detected_publish_success": ("", ratio(agg("rate", DETECTED, where=OK), agg("rate", DETECTED))),
    "dlq_recovery": ("", ratio(agg("increase", DLQ["reprocessed"]), agg("increase", DLQ["received"]))),
    "dlq_failures": ("", agg("increase", DLQ["failed"])),
    "published_rate": ("application", agg("rate", PUB, "application", OK)),
    "consumed_rate": ("application", agg("rate", CONSUMED, "application")),
    "detected_rate": ("application", agg("rate", DETECTED, "application", OK)),
    "alerted_rate": ("application", agg("rate", "fraud_alerts_total", "application")),
    "consumed_per_published": ("", ratio(agg("rate", CONSUMED), agg("rate", PUB, where=OK))),
    "alerted_per_detected": ("", ratio(agg("rate", "fraud_alerts_total"), agg("rate", DETECTED, where=OK))),
    "dlq_health": ("", f"SELECT 1 - value AS value FROM ({ratio(agg('rate', DLQ['failed']), agg('rate', DLQ['received']))})"),
    **{f"dlq_{p}_rate": ("application", agg("rate", name, "application")) for p, name in DLQ.items()},
    "publish_latency_ms": ("", ratio(agg("rate", PLAT + "_sum"), agg("rate", PLAT + "_count"), factor="1000")),
    "evaluation_latency_ms": ("", ratio(agg("rate", EVAL + "_sum"), agg("rate", EVAL + "_count"), factor="1000")),
    "created_outcomes": ("outcome", agg("increase", PUB, "outcome")),
    "detected_outcomes": ("outcome", agg("increase", DETECTED, "outcome")),
    "producer_records": ("application", agg("rate", "kafka_producer_record_send_total", "application")),
    "consumer_records": ("application", agg("rate", "kafka_consumer_records_consumed_total", "application")),
    **{f"dlq_{p}_total": ("application", agg("increase", name, "application")) for p, name in DLQ.items()},
})
HTTP = "http_server_requests_seconds"
SQL["board_overview"] = board({
    "instances_up": ("", agg("gauge", "up", where=SPR)),
    "api_throughput": ("uri", agg("rate", WEB, "uri", f"{TXS} AND {PATHS}")),
    "http_p95_ms": ("", f"SELECT 1000 * value AS value FROM ({quantile(agg('rate', HTTP + '_bucket', 'le'), 0.95)})"),
    "heap": ("application", agg("gauge", "jvm_memory_used_bytes", "application", "area = 'heap'")),
    "errors_by_status": ("status", agg("increase", WEB, "status", f"{TXS} AND {PATHS} AND {BAD_STATUS}")),
    "decisions": ("decision", agg("rate", "fraud_decisions_total", "decision")),
    "fraud_share": ("", ratio(agg("increase", "fraud_decisions_total", where="decision = 'fraud'"), agg("increase", "fraud_decisions_total"))),
    **{f"dlq_{p}_rate": ("application", agg("rate", name, "application")) for p, name in DLQ.items()},
    "dlq_failure_ratio": ("", ratio(agg("increase", DLQ["failed"]), agg("increase", DLQ["received"]))),
    "api_error_ratio": ("", ratio(agg("increase", WEB, where=f"{TXS} AND {PATHS} AND {BAD_STATUS}"), agg("increase", WEB, where=f"{TXS} AND {PATHS}"))),
})
LIVE = {"ingest": (WEB, f"{SPR} AND {TXS} AND {PATHS}"), "published": (PUB, f"{SPR} AND {TXS} AND {OK}"), "consumed": (CONSUMED, f"{SPR} AND {FRD}"),
        "detected": (DETECTED, f"{SPR} AND {FRD} AND {OK}"), "alerted": ("fraud_alerts_total", f"{SPR} AND {ALR}")}
SQL["board_throughput"] = board({
    **{f"{s}_now": ("", agg("irate", LIVE[s][0], where=LIVE[s][1])) for s in ("ingest", "published", "consumed", "alerted")},
    **{f"{s}_line": ("", agg("irate", name, where=where)) for s, (name, where) in LIVE.items()},
    "gap_before_scoring": ("", gap("irate", LIVE["published"], LIVE["consumed"])),
    "gap_before_alerting": ("", gap("irate", LIVE["detected"], LIVE["alerted"])),
})
CALLS, SLAT = "traces_spanmetrics_calls_total", "traces_spanmetrics_latency"
FAILED = "status_code = 'STATUS_CODE_ERROR'"
EDGE = "traces_service_graph_request_server_seconds_bucket"
SQL["board_tracing"] = board({
    "spans": ("", agg("increase", CALLS)),
    "error_spans": ("", agg("increase", CALLS, where=FAILED)),
    "mean_duration": ("", ratio(agg("rate", SLAT + "_sum"), agg("rate", SLAT + "_count"), floor=None)),
    "span_rate": ("service", agg("rate", CALLS, "service")),
    "error_rate": ("service", agg("rate", CALLS, "service", FAILED)),
    "p95_duration": ("service", quantile(agg("rate", SLAT + "_bucket", "le, service"), 0.95, "service")),
    "p50_duration": ("service", quantile(agg("rate", SLAT + "_bucket", "le, service"), 0.5, "service")),
    "edge_rate": ("client, server", agg("rate", "traces_service_graph_request_total", "client, server")),
    "edge_p95": ("client, server", quantile(agg("rate", EDGE, "le, client, server"), 0.95, "client, server")),
    "top_operations": ("service, span_name, span_kind",
                       agg("rate", CALLS, "service, span_name, span_kind") + " ORDER BY value DESC, service, span_name, span_kind LIMIT 15"),
})

# ------------------------------------------------------------------ logs and traces

put("parsed_logs", LOGS, """
  SELECT us, service, CASE WHEN NOT json THEN '' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN json THEN trace ELSE '' END AS "traceId",
         CASE WHEN json THEN event ELSE '' END AS event, CASE WHEN json THEN outcome ELSE '' END AS outcome,
         CASE WHEN json THEN CAST(risk_score AS VARCHAR) ELSE '' END AS risk_score FROM logs""")
put("labelled_logs", LOGS, """
  SELECT us, service, CASE WHEN NOT json THEN '' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN json THEN 'app.Logger' ELSE '' END AS logger,
         CASE WHEN json THEN trace ELSE '' END AS trace_id, CASE WHEN json THEN substr(sha256(event_id), 1, 16) ELSE '' END AS span_id FROM logs""")
put("failed_events", LOGS, "SELECT us, service, event FROM logs WHERE json AND regexp_full_match(event, '.*failed|transaction_event_retry')")
put("alert_logs", LOGS, """
  SELECT us, event, outcome FROM logs WHERE json AND service = 'alert-service' AND event IN ('fraud_alert_logged','notification_result')""")
put("high_fraud_logs", LOGS, """
  SELECT us, transaction_id AS "transactionId", risk_score FROM logs WHERE json AND event = 'fraud_decision_made' AND risk_score >= 80""")
put("failed_mail_logs", LOGS, """
  SELECT us, transaction_id AS "transactionId" FROM logs WHERE json AND event = 'notification_result' AND outcome = 'failed'""")
put("log_trace_ids", LOGS, "SELECT line_id, CASE WHEN json THEN trace ELSE '' END AS trace_id FROM logs")
put("event_outcomes", LOGS, """
  SELECT service, CASE WHEN json THEN event ELSE '' END AS event, CASE WHEN json THEN outcome ELSE '' END AS outcome, count(*) AS n FROM logs GROUP BY 1, 2, 3""")
put("log_services", LOGS, "SELECT DISTINCT service FROM logs")
BOUNDS = ", ".join(f"('{b:g}', {b})" for b in (0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256, 0.512, 1.02, 2.05, 4.1))
BOUNDS = f"bounds(le, top) AS (VALUES {BOUNDS}, ('+Inf', 1e300))"


def histogram(source: str, by: str, seconds: str) -> str:
    return f"""SELECT {by}, le, calls, latency_sum, CAST(n AS DOUBLE) AS value FROM (
    SELECT {by}, le, count(*) FILTER ({seconds} <= top) AS n, count(*) AS calls, sum({seconds}) AS latency_sum FROM {source}, bounds GROUP BY {by}, le)"""


put("span_metrics", f"{SPANS}, {BOUNDS}", f"""
  SELECT service, name, kind, status, calls, round(latency_sum, 4) AS latency_sum, le, value
  FROM ({histogram('spans', 'service, name, kind, status', 'duration_ms / 1000')})""")
put("span_p95", f"{SPANS}, {BOUNDS}", rounded(quantile(histogram("spans", "service", "duration_ms / 1000"), 0.95, "service"), "service"))
EDGES = SPANS + """, edges AS (
  SELECT c.service AS client, s.service AS server, c.duration_ms / 1000 AS cs, s.duration_ms / 1000 AS ss,
         c.status = 'STATUS_CODE_ERROR' OR s.status = 'STATUS_CODE_ERROR' AS bad
  FROM spans c JOIN spans s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
  WHERE c.kind IN ('CLIENT','PRODUCER') AND s.kind IN ('SERVER','CONSUMER'))"""
put("service_graph", EDGES, """
  SELECT client, server, count(*) AS requests, count(*) FILTER (bad) AS failed, round(sum(cs), 4) AS client_seconds, round(sum(ss), 4) AS server_seconds
  FROM edges GROUP BY 1, 2""")
put("service_graph_p95", f"{EDGES}, {BOUNDS}", rounded(quantile(histogram("edges", "client, server", "ss"), 0.95, "client, server"), "client, server"))
put("logs_for_traces", SPANS + f""", lines AS (
  SELECT {ITEM} AS line_id, CASE WHEN l_returnflag = 'N' THEN 'transaction-service' ELSE 'fraud-detection-service' END AS service, 't' || l_orderkey AS trace_id,
         epoch_us(l_shipdate) AS us FROM lineitem)""", f"""
  SELECT line_id, l.service, count(*) AS spans FROM lines l JOIN spans s ON l.trace_id = s.trace_id AND l.service = s.service
  WHERE l.us BETWEEN s.start_us - {20 * 24 * HOUR} AND s.start_us + CAST(round(s.duration_ms * 1000) AS BIGINT) + {20 * 24 * HOUR} GROUP BY 1, 2""")
put("stream_funnel", SCORED, """
  SELECT 'decision' AS stage, transaction_id, event_type <> 'error' AS answered FROM scored
  UNION ALL SELECT 'alert', transaction_id, event_type <> 'view' FROM scored WHERE fraudulent AND event_type <> 'error'""")
put("stream_service_graph", SPANS, """
  SELECT c.service AS client, s.service AS server, count(*) AS requests, count(*) FILTER (c.status = 'STATUS_CODE_ERROR' OR s.status = 'STATUS_CODE_ERROR') AS failed,
         round(sum(c.duration_ms / 1000), 4) AS client_seconds, round(sum(s.duration_ms / 1000), 4) AS server_seconds
  FROM spans c JOIN spans s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
  WHERE c.kind IN ('CLIENT','PRODUCER') AND s.kind IN ('SERVER','CONSUMER') AND s.name <> 'line 7' GROUP BY 1, 2
  UNION ALL SELECT service, '', count(*), 0, 0.0, 0.0 FROM spans WHERE kind = 'PRODUCER' AND name = 'line 7' GROUP BY 1""")
# the watermark that the first part leaves, in whole milliseconds, one hour behind
PARTS = TX + f""", edge AS (SELECT max(us) // 1000 * 1000 - {HOUR} AS edge FROM transactions WHERE seq % 3 <> 0),
  again AS (SELECT * FROM transactions, edge WHERE seq % 3 = 0 OR event_type = 'error')"""
put("stream_late_kept", PARTS, """
  SELECT event_id, 'first' AS outcome FROM transactions, edge WHERE seq % 3 <> 0 OR us >= edge
  UNION ALL SELECT event_id, 'late' FROM again WHERE us < edge""")
put("stream_windows_corrected", PARTS + """, rows AS (
  SELECT us // 60000000 * 60000000 AS us, edge, 0 AS part FROM transactions, edge WHERE seq % 3 <> 0
  UNION ALL SELECT us // 60000000 * 60000000, edge, 1 FROM again)""", """
  SELECT us, count(*) AS alerts, CAST(count(*) FILTER (part = 1 AND us + 60000000 <= edge) AS BIGINT) AS late,
         CAST(count(*) FILTER (part = 0 AND us + 60000000 <= edge) AS BIGINT) AS closed FROM rows GROUP BY 1""")
put("stream_dead_letters", TX, """
  SELECT CASE event_type WHEN 'error' THEN 'NULL_EVENT_ID' WHEN 'signup' THEN 'EMPTY_EVENT_PAYLOAD' ELSE 'reprocessed' END AS outcome, count(*) AS n
  FROM transactions GROUP BY 1""")
put("read_back_samples", samples(["fraud_alerts_total"]), "SELECT us, name, instance, round(CAST(value AS DOUBLE), 6) AS value FROM samples")

# ------------------------------------------------------------------ ledgers, replays and stored ids


def passes(seconds: tuple[int, ...]) -> str:
    """The outbox after passes that many seconds after five: a third of the events is refused until the third attempt."""
    steps = ["o0 AS (SELECT * FROM outbox)"]
    for k, s in enumerate(seconds):
        due, bad = f"status = 'PENDING' AND next_us <= {at(5) + s * 1000000}", "(cents % 3 = 0 AND attempts < 2)"
        steps.append(f"""o{k + 1} AS (SELECT * REPLACE (
  CASE WHEN {due} AND NOT {bad} THEN 'PUBLISHED' ELSE status END AS status, CASE WHEN {due} AND {bad} THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN {due} AND {bad} THEN {at(5) + (s + 2) * 1000000} ELSE next_us END AS next_us,
  CASE WHEN {due} AND NOT {bad} THEN {at(5) + s * 1000000} ELSE published_us END AS published_us,
  CASE WHEN {due} THEN CASE WHEN {bad} THEN CASE WHEN cents % 2 = 0 THEN 'OSError' ELSE 'broker down' END END ELSE last_error END AS last_error) FROM o{k})""")
    return ", ".join(steps)


put("outbox_relayed", OUTBOX + ", " + passes((0, 1, 2, 4, 6)), f"SELECT {OUTBOX_COLUMNS} FROM o5")
put("alerts_of_one_user", ALERTS, """
  SELECT id, user_id, risk_score, created_us FROM alerts
  WHERE user_id = (SELECT user_id FROM alerts GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)""")
put("alerts_delivered", ALERTS, """
  SELECT id AS alert_id, channel, CASE WHEN channel = 'email' AND risk_score >= 90 THEN 'failed' ELSE 'success' END AS outcome,
         CAST(CASE WHEN channel = 'log' OR risk_score < 70 THEN 1 WHEN risk_score >= 90 THEN 3 ELSE 2 END AS INT) AS attempt
  FROM alerts, (VALUES ('log'), ('email')) AS c(channel)""")
SQL["stream_replayed_twice"] = SQL["score_transactions"]
put("stream_repeated_after_compaction", SCORED, """
  SELECT event_id, user_id, CAST(prior_count AS BIGINT) AS prior_count, risk_score, fraudulent, CAST(1 AS BIGINT) AS stored, CAST(0 AS INT) AS letters FROM scored""")
put("stored_ids", TX, "SELECT transaction_id AS id FROM transactions WHERE event_type = 'purchase'")
SQL["read_back_logs"] = SQL["parsed_logs"]
put("read_back_spans", SPANS, """
  SELECT trace_id, span_id, coalesce(parent_span_id, '') AS parent, service, name, kind, status, start_us AS us, round(duration_ms, 6) AS ms FROM spans""")
