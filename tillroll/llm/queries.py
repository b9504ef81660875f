"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from tillroll.llm import chat, licenses, minhash, mixing, pieces, pii, quality, repair, repeats, rollup, rule_ensemble, topk, whitening

JOBS = {
    "op1_topk": topk.op1_topk,
    "op2_licenses": licenses.op2_licenses,
    "op3_minhash": minhash.op3_minhash,
    "op4_rollup": rollup.op4_rollup,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_pieces": pieces.op7_pieces,
    "op8_chat": chat.op8_chat,
    "op9_pii": pii.op9_pii,
    "op10_repeats": repeats.op10_repeats,
    "op11_repair": repair.op11_repair,
    "op12_classifier": rule_ensemble.op12_classifier,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE = {
    "op1_topk": topk.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op4_rollup": rollup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_repair": repair.ORACLE,
}
