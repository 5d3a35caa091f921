"""The training-data operators' queries and SQL oracles."""

from __future__ import annotations

from varloom.llm import chat_format, decontaminate, fingerprints, html_text, jaccard_join, mixing, secrets, substrings, toxicity, url_rules


def queries():
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_substrings": substrings.op4_substrings,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_secrets": secrets.op6_secrets,
        "op7_html_text": html_text.op7_html_text,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_rules": url_rules.op9_url_rules,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    }


def oracle_sql():
    return {"op1_chat_format": chat_format.SQL, "op4_substrings": substrings.SQL, "op5_mix_sources": mixing.SQL, "op9_url_rules": url_rules.SQL, "op10_jaccard_join": jaccard_join.SQL}
