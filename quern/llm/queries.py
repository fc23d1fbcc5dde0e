"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from quern.llm import bpe, chat, html, jaccard, mixing, quality, secrets, shards, topk, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_shards": shards.op2_shards,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_chat": chat.op5_chat,
    "op6_mixing": mixing.op6_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_topk": topk.op9_topk,
    "op10_html": html.op10_html,
}
ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
