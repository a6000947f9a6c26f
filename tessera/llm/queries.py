"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontam, exact_dedup
from tessera.llm.bpe import op9_bpe
from tessera.llm.chat import op4_chat_format
from tessera.llm.decontam import op10_decontamination
from tessera.llm.exact_dedup import op5_exact_dedup
from tessera.llm.html_extract import op6_html_extraction
from tessera.llm.pii import op7_pii_pseudonyms
from tessera.llm.quality import op1_quality
from tessera.llm.secrets import op3_secrets
from tessera.llm.simhash import op2_simhash
from tessera.llm.tokenbin import op8_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_secrets, op4_chat_format, op5_exact_dedup, op6_html_extraction, op7_pii_pseudonyms, op8_token_files, op9_bpe, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op10_decontamination": decontam.ORACLE}
