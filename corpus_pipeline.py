"""The corpus pipeline: five filtering and encoding stages over ``documents``, each stored before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import decontamination, outliers, parity_join, secrets, sentence_pieces
from framewise.llm.queries import piece_model
from framewise.llm.storage import folders_made, remove, shared_folder, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the stage before, whose result is stored once the next stage is called.
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, which first deletes the intermediate tables that the stage before it left in the shared folder."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        with folders_made() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or lie beyond the robust distance."""
    verdicts = outliers.quality_verdicts(docs)
    return outliers.kept_documents(docs, verdicts)


@tidy
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies (five-word shingles, 0.8)."""
    return parity_join.first_of_each(docs, parity_join.jaccard_components(docs, shingle=5, num=8, den=10))


@tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a twentieth of their words or more in benchmark windows; cut such windows out of the others."""
    return decontamination.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask what the forest takes for secrets; every document stays."""
    return secrets.mask_secrets(docs, secrets.scan(docs, path="source"))


@tidy
def sentence_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the SentencePiece ids of what is left of each document."""
    return sentence_pieces.encode_texts(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentence_piece_ids", sentence_piece_ids),
]

#: SQL can express neither the robust distance nor the encoding; a test holds run() against documents of known fate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
