"""String normalisation, identifiers and payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything up to and including the space counts as blank at the ends; Spark's own trim takes spaces only.
_ENDS = r"\A[\x00-\x20]+|[\x00-\x20]+\z"
_BLANK = r"\A[\x00-\x20\s]*\z"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_blank(value: Column | str) -> Column:
    """True for null and empty text, and for text of white space and control characters only."""
    c = _col(value)
    return c.isNull() | c.rlike(_BLANK)


def not_blank(value: Column | str) -> Column:
    return ~is_blank(value)


def strip(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), _ENDS, "")


def normalize_code(value: Column | str) -> Column:
    """Currency and country codes: trimmed and upper case."""
    return F.upper(strip(value))


def normalize_channel(value: Column | str) -> Column:
    c = _col(value)
    return F.when(is_blank(c), F.lit("unknown")).otherwise(F.lower(c))


def normalize_hex(value: Column | str, length: int) -> Column:
    """Lower-case hex of exactly `length` digits (dashes dropped), or null."""
    c = F.replace(F.lower(strip(value)), F.lit("-"), F.lit(""))
    return F.when(c.rlike(f"\\A[0-9a-f]{{{length}}}\\z"), c)


def generated_hex(source: Column | str, length: int) -> Column:
    """A stable stand-in for a random hex id: the same source always gives the same id."""
    return F.substring(F.sha2(_col(source).cast("string"), 256), 1, length)


def resolve_trace_id(*candidates: Column | str, generate_from: Column | str | None = None) -> Column:
    """The first candidate that is not blank; with `generate_from`, the first valid 32-digit hex id,
    or one generated from that column."""
    cols = [_col(c) for c in candidates]
    if generate_from is None:
        return F.coalesce(*(F.when(not_blank(c), c) for c in cols), F.lit(None).cast("string"))
    return F.coalesce(*(normalize_hex(c, 32) for c in cols), generated_hex(generate_from, 32))


def traceparent(trace: Column | str, span: Column | str, sampled: Column | None = None) -> Column:
    """W3C trace header, or null when either id is missing or malformed. Unknown sampling counts as sampled."""
    trace_id, span_id = normalize_hex(trace, 32), normalize_hex(span, 16)
    flags = F.lit("01") if sampled is None else F.when(~sampled, F.lit("00")).otherwise(F.lit("01"))
    return F.when(
        trace_id.isNotNull() & span_id.isNotNull(), F.concat_ws("-", F.lit("00"), trace_id, span_id, flags)
    )


def trim_to_null(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def trim_to_empty(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit(""))


MAX_ERROR_CHARS = 512


def error_text(message: Column | str, error_class: Column | str) -> Column:
    """What is stored about a failure: the message, or the class name when there is none; 512 characters."""
    text = F.when(is_blank(message), _col(error_class)).otherwise(_col(message))
    return F.when(not_blank(text), F.substring(text, 1, MAX_ERROR_CHARS))


def user_hash(value: Column | str) -> Column:
    """Pseudonym of a user id: hex of the 32-bit polynomial hash (base 31) of its characters."""
    codes = F.transform(F.split(_col(value), ""), lambda ch: F.ascii(ch).cast("long"))
    digest = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    return F.lower(F.hex(digest))


def unwrap_json(value: Column | str) -> Column:
    """A payload that was encoded twice (a JSON string holding JSON) is unwrapped once."""
    c = _col(value)
    inner = F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")
    return F.when(c.rlike(r'^\s*"'), inner).otherwise(c)


def escape_html(value: Column | str) -> Column:
    c = F.coalesce(_col(value), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


UNSPECIFIED_RULE = "UNSPECIFIED_RULE"
MAX_REASON_CHARS = 2000


def join_reasons(reasons: Column | str) -> Column:
    """Reason names joined by commas; nothing to join gives the fallback name."""
    text = F.array_join(_col(reasons), ",", "null")
    return F.when(is_blank(text), F.lit(UNSPECIFIED_RULE)).otherwise(text)


def split_reasons(value: Column | str) -> Column:
    """The reverse: blank text is no reason, and empty reasons at the end are dropped."""
    kept = F.regexp_replace(_col(value), ",+$", "")
    return F.when(is_blank(value) | (kept == ""), F.array().cast("array<string>")).otherwise(F.split(kept, ","))


def event_time(value: Column | str, now: Column | None = None) -> Column:
    return F.coalesce(_col(value), F.current_timestamp() if now is None else now)


def lag_ms(occurred: Column | str, now: Column) -> Column:
    """Milliseconds from the event to `now`; never negative, 0 when the event has no time."""
    late = F.unix_millis(now) - F.unix_millis(_col(occurred))
    return F.coalesce(F.greatest(late, F.lit(0).cast("long")), F.lit(0).cast("long"))
