"""A corpus from raw documents to packed sequences: language, copies, near copies, personal data, packing.

Every stage takes all that the one before it kept. `run` writes each stage's documents as Parquet
and rereads them. A stage's result must be written before the next stage starts, which deletes the
tables that led to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import common, exact, language, near, packing, pii
from trailmark.session import materialize, ship_package

#: Tables behind the result of the stage that ran last.
_left: list[str] = []


def _stage(function):
    """`function` after the tables of the stage before are deleted: its result is written by then."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(ship_package(spark), _left)
        before = len(common.WRITTEN)
        result = function(spark, docs, sf_dir)
        _left[:] = common.WRITTEN[before:]
        return result

    run.__doc__ = function.__doc__
    return run


STAGES = [
    ("language", _stage(language.keep_identified)),
    ("exact_dedup", _stage(exact.keep_last_copy)),
    ("near_dedup", _stage(near.keep_one_of_group)),
    ("pii", _stage(pii.redacted)),
    ("packing", _stage(packing.packed_stage)),
]

#: Trained profiles, trees and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`."""
    docs = common.table(ship_package(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
