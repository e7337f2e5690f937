"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from tickweave.llm.langid import op6_language_id
from tickweave.llm.media import op5_media_columns
from tickweave.llm.mixing import op7_mixing
from tickweave.llm.packing import op4_best_fit_packing
from tickweave.llm.pii import op2_pii
from tickweave.llm.quality import op13_quality
from tickweave.llm.secrets import op9_secret_scans
from tickweave.llm.sharding import op3_sharding
from tickweave.llm.simhash import op10_simhash_dedup
from tickweave.llm.structure import OP12_SQL, op12_structure_repair
from tickweave.llm.topk import OP8_SQL, op8_top_k
from tickweave.llm.url_filters import OP1_SQL, op1_url_filters
from tickweave.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_media_columns": op5_media_columns,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_top_k": op8_top_k,
    "op9_secret_scans": op9_secret_scans,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_structure_repair": op12_structure_repair,
    "op13_quality": op13_quality,
}
SQL = {"op1_url_filters": OP1_SQL, "op8_top_k": OP8_SQL, "op12_structure_repair": OP12_SQL}
