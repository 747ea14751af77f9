"""The registered queries of the training-data operators. Only the license scan has an SQL equivalent:
trained models, tokenizers and hashed signatures are tested against plain Python instead."""

from __future__ import annotations

from . import ann, bpe, fingerprints, language, licenses, neardup, packing, quality, secrets, toxicity

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_fingerprints": fingerprints.query,
    "op3_toxicity": toxicity.query,
    "op4_ann": ann.query,
    "op5_packing": packing.query,
    "op6_neardup": neardup.query,
    "op7_quality": quality.query,
    "op8_language": language.query,
    "op9_licenses": licenses.query,
    "op10_bpe": bpe.query,
}
ORACLES: dict[str, str] = {"op9_licenses": licenses.ORACLE_SQL}
