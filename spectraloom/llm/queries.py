"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import html_text, jaccard, lm, media, mixing, order_minhash, packing, quality, secrets, tokens

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_secrets": secrets.op2_secrets,
    "op3_tokens": tokens.op3_tokens,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_order_minhash": order_minhash.op8_order_minhash,
    "op9_media": media.op9_media,
    "op10_lm_scores": lm.op10_lm_scores,
}

ORACLES = {
    "op1_packing": packing.SQL,
    "op2_secrets": secrets.oracle(),
    "op4_jaccard_join": jaccard.SQL,
    "op7_mixing": mixing.SQL,
}
