"""Queries and DuckDB SQL of the corpus operators, for the repository's entry point."""

from __future__ import annotations

from starloom.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from starloom.llm.language_id import op8_language_id
from starloom.llm.license_scan import op10_license_scan
from starloom.llm.line_dedup import OP4_SQL, op4_line_dedup
from starloom.llm.minhash_dedup import OP7_SQL, op7_minhash_dedup
from starloom.llm.mixture import OP5_SQL, op5_mixture
from starloom.llm.pivot_index import OP2_SQL, op2_topk_search
from starloom.llm.sentencepiece_stream import op9_sentencepiece
from starloom.llm.token_store import op1_token_store
from starloom.llm.url_filter import OP6_SQL, op6_url_filter


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store,
        "op2_topk_search": op2_topk_search,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_mixture": op5_mixture,
        "op6_url_filter": op6_url_filter,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_language_id": op8_language_id,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": OP2_SQL,
        "op3_embedding_dedup": OP3_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_mixture": OP5_SQL,
        "op6_url_filter": OP6_SQL,
        "op7_minhash_dedup": OP7_SQL,
    }
