"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, html, merkle, mixing, near_dedup, order_minhash, packing, periodic, pii, quality_model, quality_rules, toxicity, urls

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_pii": pii.op2_pii,
    "op3_html": html.op3_html,
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_urls": urls.op10_urls,
    "op11_merkle": merkle.op11_merkle,
    "op13_packing": packing.op13_packing,
    "op12_periodic_runs": periodic.op12_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
