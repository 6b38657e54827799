"""Labels derived from numbers: severity, colour, status class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest score of each severity, its colour, and the share threshold used in triage.
SEVERITIES = ((80, "critical", "#d32f2f"), (60, "high", "#f57c00"), (40, "medium", "#fbc02d"))
LOWEST = ("low", "#388e3c")
TRIAGE_CRITICAL_SCORE = 85


def _banded(score: Column | str, place: int) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    out = None
    for band in SEVERITIES:
        out = F.when(c >= band[0], band[place]) if out is None else out.when(c >= band[0], band[place])
    return out.otherwise(LOWEST[place - 1])


def severity(score: Column | str) -> Column:
    return _banded(score, 1)


def severity_color(score: Column | str) -> Column:
    return _banded(score, 2)


def status_class(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    known = F.floor(c / 100)
    return F.when(known.isin(2, 4, 5), F.concat(known.cast("string"), F.lit("xx"))).otherwise("other")
