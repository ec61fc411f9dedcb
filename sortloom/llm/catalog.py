"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from sortloom.llm import decontaminate, languages, licenses, neardup, personal, quality, secrets, sentencepieces, substrings, urls
from sortloom.llm.common import one_line


def queries() -> dict[str, Callable]:
    return {
        "op1_contamination": decontaminate.op1_contamination,
        "op2_secrets": secrets.op2_secrets,
        "op3_personal_data": personal.op3_personal_data,
        "op4_url_rules": urls.op4_url_rules,
        "op5_language": languages.op5_language,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_near_duplicates": neardup.op9_near_duplicates,
        "pipeline": corpus_pipeline.run,
        "op10_repeated_passages": substrings.op10_repeated_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_rules": one_line(urls.ORACLE), "op9_near_duplicates": one_line(neardup.ORACLE), "op10_repeated_passages": one_line(substrings.ORACLE)}
