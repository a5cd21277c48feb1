"""The operators over their whole tables, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import (alignment, contamination, extract, idfile, licences, neighbours, oracles, pieces, quality, ranking, repeats,
                            sharding, simhash, wordbpe)
from pulseframe.llm.common import table
from pulseframe.session import stage_root

def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op6_licences": oracles.licences_sql(), "op7_repeats": oracles.REPEATS_SQL,
                           "op11_shards": sharding.sharding_sql(), "op13_ranked": ranking.SEARCH_SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark, sf_dir):
    return wordbpe.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_id_files(spark, sf_dir):
    path = f"{stage_root(spark)}/id-files-{uuid.uuid4().hex}"
    idfile.write_frames(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return idfile.read_frames(spark, path)


@query
def op9_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op10_quality(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op2_main_text(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


@query
def op4_pieces(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op5_contamination(spark, sf_dir):
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_repeats(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query
def op11_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = f"{stage_root(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path)
    return sharding.digests(sharding.read_shards(spark, path, docs))


@query
def op12_alignment(spark, sf_dir):
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_ranked(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark, sf_dir):
    from corpus_pipeline import run
    return run(spark, sf_dir)
