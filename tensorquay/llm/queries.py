"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, url_filter
from .license_scan import op5_licenses
from .mixing import ORACLE_MIX_SOURCES, op2_mix_sources
from .ngram_join import op3_ngram_jaccard
from .pu_quality import op6_pu_quality
from .quality_rules import op10_quality_rules
from .secret_scan import op4_secrets
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op9_simhash
from .token_counts import op8_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_pu_quality": op6_pu_quality,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": ORACLE_MIX_SOURCES,
    "op7_url_filter": url_filter.oracle_sql(),
    "op10_quality_rules": oracles.quality_rules_sql(),
}
