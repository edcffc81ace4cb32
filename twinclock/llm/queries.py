"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op12_divergence
from .langid import op8_langid
from .leaks import op7_leaks
from .lines import SQL as LINES_SQL
from .lines import op3_lines
from .merkle import SQL as MERKLE_SQL
from .merkle import op13_manifest
from .mixing import BASE_SQL, op1_mixing, unigram_base
from .pii import op6_pii
from .secrets import op4_secrets
from .simhash import op2_simhash
from .suffixes import op9_suffixes
from .topk import op10_topk
from .toxicity import op11_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_lines": op3_lines,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_leaks": op7_leaks,
    "op8_langid": op8_langid,
    "op9_suffixes": op9_suffixes,
    "op10_topk": op10_topk,
    "op11_toxicity": op11_toxicity,
    "op12_divergence": op12_divergence,
    "op13_manifest": op13_manifest,
    "unigram_base": unigram_base,
}

SQL: dict[str, str] = {"op3_lines": LINES_SQL, "unigram_base": BASE_SQL, "op12_divergence": DIVERGENCE_SQL, "op13_manifest": MERKLE_SQL}
