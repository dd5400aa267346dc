"""A training corpus from documents, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelathe.llm import common, exact_dedup, language_id, ngram_join, packing, queries, source_mix


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language (no letters, no codeword near enough) go."""
    return language_id.recognised(docs, queries.language_model(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, width=5, percent=75)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them."""
    return source_mix.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *queries.tokenizer_files(), window=1024, end=0)


_WORKED: list[str] = []


def _stage(name: str, function):
    """The stage, which first deletes the working tables of the stages before it, whose results are written by then. What docs
    still reads stays."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.discard(spark, _WORKED, docs)
        _WORKED.clear()
        begin = len(common.MADE)
        out = function(spark, docs, sf_dir)
        _WORKED.extend(common.MADE[begin:])
        return out

    stage.__name__, stage.__doc__ = function.__name__, function.__doc__
    return name, stage


STAGES = [_stage("language_id", identify_languages), _stage("exact_dedup", drop_copies), _stage("ngram_jaccard_join", drop_near_copies), _stage("source_mix", mix), _stage("packing", pack)]
#: Classifiers, draws and token ids have no SQL; a test holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
