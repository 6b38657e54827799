"""SQL for DuckDB, where it can express an operator."""

from __future__ import annotations

from riskflow.llm import collocations, decontamination, negatives, sharding, warc

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op7_sharding": sharding.sql(),
    "op8_decontamination": decontamination.SQL,
    "op11_collocations": collocations.sql(),
    "op13_negatives": negatives.SQL,
}
