"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact, language, licenses, mixing, quality, secrets, simhash, substrings, urls

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_language": language.op5_language,
    "op6_mix": mixing.op6_mix,
    "op7_exact": exact.op7_exact,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_urls": urls.op9_urls,
    "op10_licenses": licenses.op10_licenses,
}
ORACLE = {
    "op1_substrings": substrings.ORACLE,
    "op3_quality": quality.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_urls": urls.ORACLE,
}
