"""Training-data operators. Nothing outside this subpackage imports it; importing it imports every module, so that one whose requirements are missing shows at once."""

from __future__ import annotations

from . import grouped_split, langid, leakage, lookalike, packing, personal, sampling, split_overlap

MODULES = (sampling, lookalike, grouped_split, split_overlap, langid, packing, leakage, personal)


def queries() -> dict:
    """All pN_ queries of the subpackage."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
