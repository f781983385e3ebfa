"""A training corpus from `documents`: language, near copies, benchmark passages, personal data, tokens.

Every stage takes null ids, empty and very long texts, and rows that repeat, each row on its own but where the stage is
about copies. All but the last return the columns of `docs` as they are named there, further ones too; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import bpe, decontaminate, language, near_copies, pii
from offerlake.llm.common import unused, written


def apart(docs: DataFrame, names: tuple[str, ...], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `use` keeps of `docs`, with the columns of `docs`: those that are called like columns that it adds have other
    names meanwhile."""
    hidden = [c for c in docs.columns if c in names]
    other = dict(zip(hidden, unused(docs, *[f"kept_{c}" for c in hidden]), strict=True))
    out = use(docs.withColumnsRenamed(other)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in other.items()}).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a determinable language (null, empty, or without a letter) go; a missing lang becomes the predicted one.

    Of languages with equal shares the first in the alphabet counts. If no row has a lang, there is none to learn, and all go.
    """
    model = language.train(language.training_rows(docs))

    def kept(rows: DataFrame) -> DataFrame:
        named = language.identify(rows, model).where(F.col("lang_pred") != language.UNDETERMINED)
        return named.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return apart(docs, ("lang_pred", "lang_score", "lang_spans"), kept)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the first by id, a null id last; of rows that repeat, any one.

    Texts without words (null, empty) are no copies of each other and stay.
    """
    return near_copies.without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none and stay, and so do all without items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return apart(docs, ("contaminated", "regions"), lambda rows: decontaminate.find_contamination(rows, items).where(~F.col("contaminated")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes placeholders; n_chars follows the text. Null texts stay null, with a null n_chars.

    Spans that overlap become one placeholder, named after the first by start, then by kind.
    """
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their digests and those of the decoded text; a null text is empty and has no ids."""
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), bpe.byte_bpe_path())
    return out.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", bpe_encoding),
]

# SQL can't express the learned stages and the tokenizer; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each one's rows are written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
