"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .fingerprints import op2_fingerprints
from .html_extract import op4_html_extract
from .mixing import OP13_SQL, op13_mixing
from .packing import op9_packing
from .quality import op8_quality
from .sharding import op10_sharding
from .simhash import op7_simhash
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op3_toxicity

QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, OP1_SQL),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_html_extract": (op4_html_extract, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_simhash": (op7_simhash, None),
    "op8_quality": (op8_quality, None),
    "op9_packing": (op9_packing, None),
    "op10_sharding": (op10_sharding, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_fill_in_middle": (op12_fill_in_middle, OP12_SQL),
    "op13_mixing": (op13_mixing, OP13_SQL),
}
