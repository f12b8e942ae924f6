"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination,
mixing to target weights and token-id output, each stage on all its predecessor kept.

The last stage returns doc_id, start, n_tokens and ids_crc32 of every document it wrote; the
copies that mixing emits share their document's id and are adjacent in the output.

Defined results
---------------
* Null and empty texts fail the base quality rule (no words) and go in the first stage; null languages and sources are
  a stratum and a source of their own; a document with a null id is near no other one and is kept if it is good.
* Ties: of a group of near copies the smallest id stays, with every row that has it; repeated rows are judged alike in
  each stage, and mixing takes each of them as often as it takes the document.
* Without labels only the base rule rejects; without benchmark items nothing is contaminated.
* Columns beyond those of ``documents`` are carried along and clash with no helper column.
* An empty table passes through all stages and writes no shard: the result is empty, with its columns.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, mixing, near_dedup, quality_rules, token_ids
from gridloom.llm.runtime import discard, materialise, noted, ship

def _unread(spark: SparkSession, paths: list[str], result: DataFrame) -> list[str]:
    """Delete the stored tables that ``result`` does not read; returns the others."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in result.inputFiles()}
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    for path in set(paths) - set(kept):
        discard(spark, path)
    return kept


def _stage(run):
    """A stage that removes what it has stored for itself, but for what its result still reads: a result that was
    returned stays readable, whatever runs after it."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        with noted() as paths:
            out = run(spark, docs, sf_dir)
        _unread(spark, paths, out)
        return out

    return wrapped


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the risk-controlled rules."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_dedup.keep_first(docs)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to their source's target."""
    return mixing.mix(docs)


@_stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, read back as one row per document."""
    return token_ids.read_digests(token_ids.write_shards(docs))


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
    ("token-id output", encode_stage),
]

#: quality cutoffs are certified by an exact test on labels, beyond SQL; the tests use a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input.  Runs share nothing:
    what a run has stored goes when the run itself needs it no more, except for what its result reads."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        held = _unread(spark, [*held, *paths], docs)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _unread(spark, held, out)
    return out
