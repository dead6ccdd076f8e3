"""Queries of the problems tagged llm, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, subjects, tokens
from tessera.llm import name_variants as nv
from tessera.llm import near_duplicates as nd
from tessera.llm import similar_vectors as sv
from tessera.scale import materialize
from tessera.sources.tables import table

#: Problem 2 is stated with three words, 0.5 and fifteen words.
P2 = {"shingle": 3, "threshold": 0.5, "min_words": 15}

#: Problem 1 asks for pairs of at least this similarity.
P1_LEAST = 0.87


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = sv.most_similar(table(spark, d, "memories"), least=P1_LEAST)
    return near.select(F.least("id", "other").alias("memory_id_a"), F.greatest("id", "other").alias("memory_id_b")).distinct()


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar memories of every memory whose id is divisible by 20, among all."""
    m = table(spark, d, "memories")
    return sv.search(m, m.where("id % 20 = 0"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = nd.near_duplicate_links(table(spark, d, "memories"), **P2)
    return nd.expand_pairs(links, members).select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    links, members = nd.near_duplicate_links(table(spark, d, "memories"), **P2)
    return nd.near_duplicate_groups(links, members)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    same = nv.name_variants(table(spark, d, "entities"), table(spark, d, "name_forms"), table(spark, d, "entity_aliases"))
    return nv.variant_pairs(same).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.with_tokens(table(spark, d, "documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_packed(spark, d))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.with_tokens(table(spark, d, "documents"), keep=("source",))
    sized = materialize(sized.withColumn("source", mixing.source_form(F.col("source"))))
    rated = mixing.rates(sized, table(spark, d, "mix_targets"))
    return mixing.mix(sized, rated), rated


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, d))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"), table(spark, d, "subject_areas"))


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p6_packed": p6_packed, "p6_report": p6_report, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_composition": p8_composition}

_PAIRS = r"""
WITH RECURSIVE m AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM memories),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS h FROM m WHERE len(w) >= 15),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2),
j AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.5 * (na.n + nb.n - c))
"""

_NEAREST = r"""
WITH m AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM memories
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT x.id, y.id AS other, list_cosine_similarity(x.v, y.v) AS sim FROM m x JOIN m y ON x.id <> y.id),
r AS (SELECT id, other, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS k FROM s WHERE sim >= 0.87)
SELECT DISTINCT least(id, other) AS memory_id_a, greatest(id, other) AS memory_id_b FROM r WHERE k <= 10
"""

SQL = {"p1_found": _NEAREST, "p2_found": _PAIRS + "SELECT a AS memory_id_a, b AS memory_id_b FROM j"}
