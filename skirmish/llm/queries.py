"""The queries of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skirmish.llm import urls
from skirmish.llm.common import table
from skirmish.llm.decontaminate import found_items
from skirmish.llm.licences import licence_paragraphs
from skirmish.llm.packing import pack
from skirmish.llm.pii import personal_data
from skirmish.llm.quality import quality
from skirmish.llm.repair import repair_report
from skirmish.llm.repeats import repeat_report
from skirmish.llm.simhash import near_duplicates
from skirmish.llm.spelling import spelling_groups
from skirmish.llm.token_counts import count_tokens
from skirmish.llm.token_files import token_digests
from skirmish.llm.tool_calls import calls_of, link_calls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.tracked(pages))


SQL["op1_url_filter"] = urls.SQL


@_query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_paragraphs(table(spark, sf_dir, "documents"))


@_query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of(table(spark, sf_dir, "conversations")))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@_query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@_query
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


@_query
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
