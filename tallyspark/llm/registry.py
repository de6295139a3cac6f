"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op1_neighbours
from .decontaminate import op6_decontaminate
from .fingerprint import OP11_SQL, op11_fingerprint
from .html_extract import op2_html_extract
from .licences import op10_license_scan
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import OP9_SQL, op9_ngram_join
from .ppm import op8_lm_score
from .quality import op3_quality
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op7_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_html_extract": op2_html_extract,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_lm_score": op8_lm_score,
    "op9_ngram_join": op9_ngram_join,
    "op10_license_scan": op10_license_scan,
    "op11_fingerprint": op11_fingerprint,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op4_mixing": OP4_SQL, "op9_ngram_join": OP9_SQL, "op11_fingerprint": OP11_SQL, "op12_merkle": OP12_SQL}
