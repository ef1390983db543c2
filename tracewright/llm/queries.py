"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .binary_output import op10_token_output
from .decontaminate import op4_decontamination
from .ngram_join import op3_ngram_join
from .packing import op9_packing
from .pii import op7_pii
from .quality import op1_quality, quality_base
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op5_toxicity
from .url_filter import op6_url_filter, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_ngram_join, op4_decontamination, op5_toxicity, op6_url_filter, op7_pii, op8_suffix_dedup, op9_packing, op10_token_output, quality_base, url_rules)}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracles.OP2, "op3_ngram_join": oracles.OP3, "op8_suffix_dedup": oracles.OP8, "quality_base": oracles.QUALITY_BASE, "url_rules": oracles.URL_RULES}
