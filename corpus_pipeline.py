"""Corpus pipeline: language filter, near-duplicate removal, benchmark decontamination, source mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns the frame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lonja.llm import decontam, langid, mixing, simhash, token_files
from lonja.llm.queries import BYTE_BPE
from lonja.llm.store import Scratch
from lonja.llm.tables import table

#: Texts that resemble no learned language this much are rejected; prose of a learned language scores 0.4 and more.
LEAST_SCORE = 0.2
PROFILE_SIZE = 400


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and resembles a language of the training folds."""
    profiles = langid.learn_profiles(docs.where(~langid.is_held_out() & docs["doc_id"].isNotNull()), PROFILE_SIZE)
    return langid.accept(docs, profiles, LEAST_SCORE, PROFILE_SIZE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    return simhash.keep_one(docs, Scratch(spark, "pipeline-simhash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item with up to a tenth of its characters edited."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to weights 1, 2, 3, repeating; a document taken several times stands several times."""
    return mixing.mixed_rows(docs, Scratch(spark, "pipeline-mixing"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-ID files and returns each document's place, length and checksum as read from them."""
    path = Scratch(spark, "pipeline-tokens").path("ids")
    token_files.write_token_files(docs, path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_files.token_digest(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Fingerprints, profiles and tokens are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
