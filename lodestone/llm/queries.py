"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op13_bpe
from .codes import OP12_SQL, op12_vector_codes
from .embeddings import OP5_SQL, op5_embeddings
from .media import op4_media
from .mixing import OP10_SQL, op10_mixing
from .neardup import OP8_SQL, op8_minhash
from .packing import op9_packing
from .quality import op2_quality
from .secrets import OP1_SQL, op1_secret_scan
from .sharding import op6_sharding
from .spelling import OP11_SQL, op11_spelling
from .suffixes import op3_suffix_dedup
from .urls import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_media": op4_media,
    "op5_embeddings": op5_embeddings,
    "op6_sharding": op6_sharding,
    "op7_url_filters": op7_url_filters,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe": op13_bpe,
}
ORACLES: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op5_embeddings": OP5_SQL, "op7_url_filters": OP7_SQL, "op8_minhash": OP8_SQL, "op10_mixing": OP10_SQL, "op11_spelling": OP11_SQL, "op12_vector_codes": OP12_SQL}
