"""The queries of the training-data operators and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chat, embeddings, licences, minhash, mixing, pieces, quality, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_licences": licences.op2_licences,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op7_chat_format": chat.op7_chat_format,
    "op8_mixing": mixing.op8_mixing,
    "op9_near_vectors": embeddings.op9_near_vectors,
    "op10_pieces": pieces.op10_pieces,
}

SQL: dict[str, str] = {
    "op1_quality": quality.SQL,
    "op3_url_filter": url_filter.SQL,
    "op5_warc": warc.SQL,
    "op6_near_duplicates": minhash.SQL,
    "op7_chat_format": chat.SQL,
    "op8_mixing": mixing.SQL,
    "op9_near_vectors": embeddings.SQL,
}
