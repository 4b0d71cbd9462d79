"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from mosaiq.llm.filter_audit import OP11_SQL, op11_filter_audit
from mosaiq.llm.line_dedup import OP8_SQL, op8_line_dedup
from mosaiq.llm.lz_fingerprint import op12_lz_fingerprint
from mosaiq.llm.mixing import OP1_SQL, op1_mixing
from mosaiq.llm.ngram_join import op3_ngram_join
from mosaiq.llm.ogg import op5_ogg
from mosaiq.llm.packing import op9_packing
from mosaiq.llm.sharding import op10_sharding
from mosaiq.llm.suffix_dedup import op2_suffix_dedup
from mosaiq.llm.token_files import op4_token_files
from mosaiq.llm.toxicity import op6_toxicity
from mosaiq.llm.vector_codes import OP13_SQL, op13_vector_codes
from mosaiq.llm.vector_dedup import OP7_SQL, op7_vector_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_files": op4_token_files,
    "op5_ogg": op5_ogg,
    "op6_toxicity": op6_toxicity,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_lz_fingerprint": op12_lz_fingerprint,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {"op1_mixing": OP1_SQL, "op7_vector_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_vector_codes": OP13_SQL}
