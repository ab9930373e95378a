"""The registered queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import cross_split, encode, format_dups, leakage, mixing, residue, splitting, truncation
from veritrace.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_audits(table(spark, sf_dir, "audit_result"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(table(spark, sf_dir, "audit_result"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_pairs(table(spark, sf_dir, "source_item"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_classes(table(spark, sf_dir, "source_item"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, sf_dir, "source_item"))


def p3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "source_item"), table(spark, sf_dir, "mix_target"))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_shares(table(spark, sf_dir, "source_item"), table(spark, sf_dir, "mix_target"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "rl_item"), table(spark, sf_dir, "split_limit"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(table(spark, sf_dir, "rl_item"), table(spark, sf_dir, "split_limit"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_report(table(spark, sf_dir, "rl_item"), table(spark, sf_dir, "split_limit"), table(spark, sf_dir, "prompt_truncation"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.superfluous_pairs(table(spark, sf_dir, "source_item"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.distinct_records(table(spark, sf_dir, "source_item"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passage"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passage"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passage"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_report(table(spark, sf_dir, "documents"))


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.validation(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_classes, p2_report, p3_mixture, p3_shares, p4_found, p4_pieces, p4_report, p5_found, p5_records, p6_ids, p7_found, p7_spans, p7_items, p8_found, p8_report, p8_validation)}


_WINDOWS = r"""
(select distinct {id}, array_to_string(ws[i : i + 11], ' ') as k from (
    select {id}, ws, unnest(range(1, len(ws) - 10)) as i from (select {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from {table} where text is not null) where len(ws) >= 12))
"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that have a form short of the operator itself; the others are tested against brute force."""
    windows = r"(select {id}, i, array_to_string(ws[i : i + 11], ' ') as k from (select {id}, ws, unnest(range(1, len(ws) - 10)) as i from (select {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from (select distinct {id}, text from {table}) where text is not null) where len(ws) >= 12))"
    runs = (
        f"with m as (select distinct d.doc_id, e.item_id, d.i, d.i - e.i as diagonal from {windows.format(id='doc_id', table='documents')} d join {windows.format(id='item_id', table='eval_passage')} e on d.k = e.k), "
        "g as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as island from m), r as (select item_id, doc_id, count(*) + 11 as words from g group by item_id, doc_id, diagonal, island) "
    )
    return {
        "p7_items": runs + r"select p.item_id, p.n as n_words, coalesce(x.n_docs, 0) as n_docs, coalesce(x.longest, 0)::int as longest, coalesce(x.longest >= p.n, false) as whole from (select item_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0)::int as n from eval_passage) p "
        "left join (select item_id, count(distinct doc_id) as n_docs, max(words) as longest from r group by 1) x on p.item_id = x.item_id",
        "p4_found": "select distinct rl_id from rl_item r join (select trim(source) as source, min(max_chars) as most from split_limit where max_chars >= 1 group by 1) l on trim(r.source) = l.source "
        "where coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0) > most",
        "p7_found": f"select distinct d.doc_id, e.item_id from {_WINDOWS.format(id='doc_id', table='documents')} d join {_WINDOWS.format(id='item_id', table='eval_passage')} e on d.k = e.k",
    }
