"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import op8_decontaminate
from .embedding_dedup import op7_embedding_dedup
from .language_id import op2_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .minhash_dedup import op1_minhash_dedup
from .oracles import OP1_SQL, OP7_SQL, OP8_SQL, OP9_SQL
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_chat_format": OP10_SQL,
}
