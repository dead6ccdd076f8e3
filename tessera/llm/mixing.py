"""Sources mixed to target weights by systematic sampling.

Each document's expected copies (the rate of its source) are summed up along the source, one random
offset is added, and a copy is emitted for every integer that the sum crosses. The sums are taken along
the documents' sizes, so the sample is spread evenly over short and long documents and the tokens come
out close to their targets. Sums run over ordered chunks, so a source may hold any part of the rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.scale import materialize, prefix_sums


def source_form(c: Column) -> Column:
    """Source names without regard to case, outer spaces and how the words are joined."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-_\s]+", "-")


def _filled(limits: list[tuple[float, float]], total: float) -> float:
    """The scale x at which min(limit, share * x), summed over (limit, share), gives ``total`` (or all there is)."""
    got, share = 0.0, sum(s for _, s in limits)
    for limit, s in sorted(limits, key=lambda p: p[0] / p[1]):
        if got + share * limit / s >= total:
            break
        got, share = got + limit, share - s
    return (total - got) / share if share > 1e-12 else float("inf")


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, *, exact: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate): a row for each target source.

    rate is the expected copies of each document. The mixture has ``total_tokens``; without it, as many
    tokens as the documents of the target sources have. A source that cannot reach its share within
    its repeats gives all of them, and the others make up for it in proportion to their targets;
    :func:`shares` tells what was reached. With ``exact`` the total is lowered until every source has
    exactly its share, so that the scarcest one sets the size. Targets without documents, without share or
    with null fields have rate 0 and leave their part to the others. ``targets`` is a table of settings, a
    row for each source, and is read by the driver.
    """
    t = targets.select(source_form(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source IS NOT NULL")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    j = materialize(t.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))))
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = j.where(live).select((F.col("max_repeats") * F.col("tokens")).cast("double").alias("limit"), F.col("target_share").cast("double").alias("s"), "tokens").collect()
    total = float(sum(r["tokens"] for r in rows) if total_tokens is None else total_tokens)
    scale = _filled([(r["limit"], r["s"]) for r in rows], total) if rows else 0.0
    if exact and rows:
        scale = min(total / sum(r["s"] for r in rows), *(r["limit"] / r["s"] for r in rows))
    wanted = F.least(F.col("max_repeats") * F.col("tokens"), F.col("target_share") * F.lit(scale))
    return j.withColumn("rate", F.when(live, wanted / F.col("tokens")).otherwise(0.0))


def mix(sized: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copy): one row for each copy that is taken, copies counted from 1.

    ``sized`` has doc_id, source and n_tokens. Documents of other sources and without source are not
    taken. ``rated`` (see :func:`rates`) is a table of the targets and is joined by broadcast.
    """
    offset = random.Random(seed).random()
    d = sized.join(F.broadcast(rated.where("rate > 0").select("source", "rate")), "source")
    d = prefix_sums(d, ["source"], ["n_tokens", "doc_id"], {"q": F.lit(1).cast("bigint")})
    # every document of a source expects the same number of copies: the sum is rank x rate, without drift
    upto = lambda q: F.floor(q * F.col("rate") + F.lit(offset))
    copies = (upto(F.col("q")) - upto(F.col("q") - 1)).cast("int")
    return d.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shares(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats, max_repeats, rate)."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("copy") == 1, 1)).alias("documents"), F.max("copy").alias("most_repeats"))
    got = rated.select("source", "target_share", "max_repeats", "rate").join(got, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    # a row for each source of the targets
    return got.withColumn("all", F.sum("tokens").over(Window.partitionBy())).select("source", "target_share", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).alias("actual_share"), "tokens", "documents", "most_repeats", "max_repeats", "rate")
