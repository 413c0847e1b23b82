"""The registered queries of the corpus operators and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontam, html, lm, phrases, pii, quality, rankbpe, ranked, simhash, substrings, urls, warc
from tidelog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm(spark: SparkSession, directory: str) -> DataFrame:
    return lm.scored(table(spark, directory, "documents"))


def op2_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.op2(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op3_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontam.op3(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op4_warc(spark: SparkSession, directory: str) -> DataFrame:
    return warc.op4(table(spark, directory, "pages"))


def op5_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.op5(table(spark, directory, "documents"))


def op8_html(spark: SparkSession, directory: str) -> DataFrame:
    return html.op8(table(spark, directory, "pages"))


def op9_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(table(spark, directory, "documents"))


def op6_substrings(spark: SparkSession, directory: str) -> DataFrame:
    return substrings.op6(table(spark, directory, "documents"))


def op7_urls(spark: SparkSession, directory: str) -> DataFrame:
    return urls.op7(table(spark, directory, "pages"))


def op10_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.found(table(spark, directory, "documents"))


def op11_rankbpe(spark: SparkSession, directory: str) -> DataFrame:
    return rankbpe.digests(table(spark, directory, "documents"))


def op12_ranked(spark: SparkSession, directory: str) -> DataFrame:
    return ranked.search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op13_phrases(spark: SparkSession, directory: str) -> DataFrame:
    return phrases.collocations(table(spark, directory, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lm": op1_lm,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_urls": op7_urls,
    "op8_html": op8_html,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_rankbpe": op11_rankbpe,
    "op12_ranked": op12_ranked,
    "op13_phrases": op13_phrases,
}
SQL = {"op4_warc": warc.OP4_SQL, "op7_urls": urls.OP7_SQL, "op12_ranked": ranked.OP12_SQL, "op13_phrases": phrases.OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
