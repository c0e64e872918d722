"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``.  ``run`` writes every stage's result to the shared folder and
reads it again, so a lost executor repeats part of one stage at most.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are treated as the
operator of the stage says: quality judges null text as empty; of near copies (null, empty and
wordless texts among them) the smallest id stays, rows without an id all stay; pseudonyms leave null
text null; the mixture takes repeated rows alike; packing gives null text its end id.

SQL can express none of these stages (trained models, XXH64 fingerprints, a Feistel network on
personal data, a tokenizer's vocabulary), so ORACLE_SQL is None and tests hold the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.alike import one_of_each
from fathomline.llm.common import delete_folder, materialise, read_table, scratch, work_dir
from fathomline.llm.mixing import take_mixture
from fathomline.llm.packing import pack_documents
from fathomline.llm.pii import pseudonymise
from fathomline.llm.quality import fit_quality, keep_good
from fathomline.llm.queries import pseudonym_key

#: Shares of the mixture; clean documents are used whole, and junk has gone before.
MIXTURE = {"clean": 0.97, "toxic": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    return keep_good(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies (five-word shingles 0.8 alike)."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format."""
    return pseudonymise(docs, pseudonym_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mixture's rates say: clean ones once, toxic ones thinned."""
    return take_mixture(docs, read_table(spark, sf_dir, "labels"), weights=MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; a row a piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written is deleted once the next one has its result."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = work_dir(spark, name)
        with scratch(spark, f"{name}-scratch"):
            docs = materialise(stage(spark, docs, sf_dir), folder)
        if before:
            delete_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
