"""The queries ``opN_<name>`` over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, near_dups, neighbours, pieces, token_counts, toxicity, url_filter, warc
from .common import scratch_path, table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: 5 nearest of each vector whose id 50 divides; odd rows as ``neighbours`` says."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every page; odd rows as ``url_filter`` says."""
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every document; odd rows as ``pieces`` says."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.load(pieces.model_file()))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; odd rows as ``token_counts`` says."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.tokenizer_file("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, read back from archives; odd rows as ``warc`` says."""
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).drop("payload", "url")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation, read back from the formatted text; odd rows as ``chat`` says."""
    return chat.read_back(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; odd rows as ``toxicity`` says."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; odd rows as ``near_dups`` says."""
    return near_dups.judge(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; odd rows as ``html_extract`` says."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, matched_bytes, edits, place`` of every match; odd rows as ``decontaminate`` says."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_url_filter, op3_sentencepiece, op4_token_counts, op5_warc, op6_chat_format, op7_toxicity, op8_near_dups, op9_html_extract, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE, "op6_chat_format": chat.ORACLE}
