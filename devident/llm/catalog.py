"""The corpus operators as named queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from devident.llm.queries import (
    decontamination, filter_audit, language, line_dedup, packing, pii, quality_rules, simhash, spelling, substring_dedup, toxicity,
    url_rules, wordpiece,
)

_MODULES = (
    toxicity, substring_dedup, decontamination, language, line_dedup, pii, simhash, packing, quality_rules, wordpiece,
    url_rules, filter_audit, spelling,
)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.SQL for m in _MODULES if m.SQL is not None}
