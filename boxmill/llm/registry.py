"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxmill.llm.chat_format import OP5_SQL, op5_chat_format
from boxmill.llm.decontamination import op10_benchmark_decontamination
from boxmill.llm.embedding_dedup import op3_embedding_near_dedup
from boxmill.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from boxmill.llm.html_extract import op8_html_extraction
from boxmill.llm.lang_id import op4_language_id
from boxmill.llm.line_dedup import OP6_SQL, op6_line_dedup
from boxmill.llm.mixing import op7_source_mixing
from boxmill.llm.near_dedup import op2_minhash_near_dedup
from boxmill.llm.oracles import OP2_SQL, OP3_SQL
from boxmill.llm.secret_scan import op13_secret_scan
from boxmill.llm.token_count import op9_token_counts
from boxmill.llm.token_packing import op1_token_packing
from boxmill.llm.turn_repair import OP12_SQL, op12_turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_packing": op1_token_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_turn_repair": op12_turn_repair,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": OP2_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
}
