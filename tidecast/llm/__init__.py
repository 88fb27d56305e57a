"""Operators for large-scale training-data pipelines. Nothing else in the library imports this."""

from tidecast.llm import adaptive_scan, bpe, decontaminate, embeddings, html, interaction, langid, lexical, linededup, lmscore, neardup, secrets, toxicity

_QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_langid": langid.op3_langid,
    "op4_html": html.op4_html,
    "op5_secrets": secrets.op5_secrets,
    "op6_neardup": neardup.op6_neardup,
    "op7_bpe": bpe.op7_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_lmscore": lmscore.op10_lmscore,
    "op11_filter_audit": interaction.op11_filter_audit,
    "op12_lexical": lexical.op12_lexical,
    "op13_nearest": adaptive_scan.op13_nearest,
}

_ORACLES: dict[str, str] = {
    "op1_linededup": linededup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_neardup": neardup.ORACLE,
    "op9_embeddings": embeddings.ORACLE,
    "op11_filter_audit": interaction.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_nearest": adaptive_scan.ORACLE,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
