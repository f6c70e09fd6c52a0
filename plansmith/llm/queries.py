"""The subpackage's queries and their SQL."""

from __future__ import annotations

from plansmith.llm.chat_format import OP5_SQL, op5_chat_format
from plansmith.llm.cover_tree import OP8_SQL, op8_cover_tree
from plansmith.llm.decontaminate import OP4_SQL, op4_decontamination
from plansmith.llm.language_id import op3_language_id
from plansmith.llm.lm_scoring import op1_lm_scoring
from plansmith.llm.ngram_join import op9_ngram_join
from plansmith.llm.packing import op2_best_fit_packing
from plansmith.llm.suffix_dedup import op10_suffix_dedup
from plansmith.llm.token_counts import op6_token_counts
from plansmith.llm.token_files import op7_token_files

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_best_fit_packing, op3_language_id, op4_decontamination, op5_chat_format, op6_token_counts, op7_token_files, op8_cover_tree, op9_ngram_join, op10_suffix_dedup)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op5_chat_format": OP5_SQL, "op8_cover_tree": OP8_SQL}
