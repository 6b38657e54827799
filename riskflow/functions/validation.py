"""Checks on incoming requests and on events that cannot be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank

# Accepted payment methods, code patterns and the message of each check.
PAYMENT_METHODS = ("CARD", "TRANSFER", "WALLET", "CASH")
CURRENCY_PATTERN = r"\A[A-Z]{3}\z"
COUNTRY_PATTERN = r"\A[A-Z]{2}\z"
MIN_AMOUNT = "0.01"
USER_REQUIRED = "userId is required"
AMOUNT_REQUIRED = "amount is required"
AMOUNT_TOO_SMALL = "amount must be greater than zero"
CURRENCY_REQUIRED = "currency is required"
CURRENCY_INVALID = "currency must be ISO-4217 code"
MERCHANT_REQUIRED = "merchantId is required"
COUNTRY_REQUIRED = "country is required"
COUNTRY_INVALID = "country must be ISO-3166 alpha-2"
PAYMENT_REQUIRED = "paymentMethod is required"


def matches(value: Column, pattern: str) -> Column:
    """A null passes: absence is reported by the check for presence."""
    return F.coalesce(value.rlike(pattern), F.lit(True))


def at_least(value: Column, smallest: str) -> Column:
    return F.coalesce(value >= F.lit(smallest).cast("decimal(28,9)"), F.lit(True))


def validate_requests(df: DataFrame) -> DataFrame:
    """Add `errors`, a map from field to message with one entry per field that fails."""
    user, amount, currency = F.col("userId"), F.col("amount"), F.col("currency")
    merchant, country, method = F.col("merchantId"), F.col("country"), F.col("paymentMethod")
    messages = {
        "userId": F.when(is_blank(user), USER_REQUIRED),
        "amount": F.when(amount.isNull(), AMOUNT_REQUIRED).when(~at_least(amount, MIN_AMOUNT), AMOUNT_TOO_SMALL),
        "currency": F.when(is_blank(currency), CURRENCY_REQUIRED).when(
            ~matches(currency, CURRENCY_PATTERN), CURRENCY_INVALID
        ),
        "merchantId": F.when(is_blank(merchant), MERCHANT_REQUIRED),
        "country": F.when(is_blank(country), COUNTRY_REQUIRED).when(
            ~matches(country, COUNTRY_PATTERN), COUNTRY_INVALID
        ),
        "paymentMethod": F.when(
            ~F.coalesce(method.isin(*PAYMENT_METHODS), F.lit(False)), PAYMENT_REQUIRED
        ),
    }
    entries = F.array(*(F.struct(F.lit(name).alias("key"), text.alias("value")) for name, text in messages.items()))
    failed = F.filter(entries, lambda e: e["value"].isNotNull())
    return df.withColumn("errors", F.map_from_entries(failed))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted without the errors column, rejected with it)."""
    ok = F.size("errors") == 0
    return df.filter(ok).drop("errors"), df.filter(~ok)


def poison_reason(df: DataFrame, required: tuple[str, ...], amount: str | None = "amount") -> Column:
    """Why an event can never be stored, or null: a missing id or field, a code too long for its
    column, or an amount that overflows 19 digits with 2 decimals."""
    reason = F.when(F.col("event_id").isNull(), "NULL_EVENT_ID")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"NULL_{name.upper()}")
    for name, length in (("currency", 3), ("country", 2)):
        if name in df.columns:
            reason = reason.when(F.length(name) > length, f"{name.upper()}_TOO_LONG")
    if "reasons" in df.columns:
        reason = reason.when(F.length(F.array_join("reasons", ",", "null")) > 2000, "REASONS_TOO_LONG")
    if amount and amount in df.columns:
        overflow = F.abs(F.round(F.col(amount), 2)) >= F.lit("100000000000000000").cast("decimal(28,9)")
        reason = reason.when(overflow, "AMOUNT_OVERFLOW")
    return reason


TRANSACTION_REQUIRED = ("transaction_id", "user_id", "amount", "currency", "merchant_id", "country")
FRAUD_REQUIRED = ("transaction_id", "user_id", "risk_score")


def drop_tombstones(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records with a payload, records without). On the main stream the second part is passed over and
    counted; on a dead-letter stream it counts as failed."""
    return df.filter(F.col(value).isNotNull()), df.filter(F.col(value).isNull())
