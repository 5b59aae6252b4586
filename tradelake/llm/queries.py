"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_mixing")
def op1_mixing(spark, sf_dir):
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


@register("op2_token_files")
def op2_token_files(spark, sf_dir):
    import public_tokenizers

    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import document_counts

    return document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op4_simhash")
def op4_simhash(spark, sf_dir):
    from .simhash import simhash_digest

    return simhash_digest(table(spark, sf_dir, "documents"))


@register("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op6_sql() -> str:
    from .line_dedup import ORACLE_SQL

    return ORACLE_SQL


@register("op6_line_dedup", _op6_sql())
def op6_line_dedup(spark, sf_dir):
    from .line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    from .secret_scan import oracle_sql

    return oracle_sql()


@register("op7_secret_scan", _op7_sql())
def op7_secret_scan(spark, sf_dir):
    from .secret_scan import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


@register("op8_neighbours")
def op8_neighbours(spark, sf_dir):
    from .neighbours import neighbour_digest

    return neighbour_digest(table(spark, sf_dir, "embeddings"))


@register("op9_quality")
def op9_quality(spark, sf_dir):
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@register("op10_language")
def op10_language(spark, sf_dir):
    from . import lang_id

    docs = table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.train(docs))


@register("op11_alignment")
def op11_alignment(spark, sf_dir):
    import public_tokenizers

    from .alignment import alignment_digest

    return alignment_digest(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def _op12_sql() -> str:
    from .ngram_join import ORACLE_SQL

    return ORACLE_SQL


@register("op12_ngram_join", _op12_sql())
def op12_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_digest

    return ngram_digest(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    from .filter_audit import ORACLE_SQL

    return ORACLE_SQL


@register("op13_filter_audit", _op13_sql())
def op13_filter_audit(spark, sf_dir):
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
