"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import bwt_merge, decontaminate, fm_index, language, near_dedup, pii, pitman_yor, quality_gam, quality_rules, sentencepiece_codec

MODULES = (quality_rules, pitman_yor, near_dedup, decontaminate, pii, quality_gam, language, sentencepiece_codec, fm_index, bwt_merge)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
