"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from usagemill.llm import byte_codec, cotrain, hard_negatives, langid, packing, piece_codec, pii, quality_rules, secrets, simhash, topk, url_filter, whitening
from usagemill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_pii": pii.op2_pii,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_classifier": cotrain.op4_quality_classifier,
    "op5_piece_codec": piece_codec.op5_piece_codec,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language_id": langid.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_topk": topk.op10_topk,
    "op11_byte_codec": byte_codec.op11_byte_codec,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}
