"""Operator 7: mixing sources to target weights by Sainte-Lague apportionment, in SQL functions.

Sizes are counted in words.  Every source's target is its share by weight of ``share`` times all
words, stopped at ``epochs`` times its size, the excess going to the others by weight.  Targets
become blocks of ``block`` words: seats go to the sources by highest quotients target / (2 s + 1).
A source lies in shards of about ``shard`` words, dealt by a hash of doc_id, so that a hot source
is many groups; its seats go to its shards the same way.  Within a shard, documents stand in
seeded order, end to end, and blocks are taken from a seeded start, round and round: a quota
over the shard's size takes every document once and goes on.

Defined results: a null text has size 0 and is taken 0 times; the null source stands last;
repeated rows are documents of their own, at neighbouring places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights in order of the sources, repeated.
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    pattern = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("stop", epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("stop") / F.col("weight"))
    # Sources stop in the order of stop / weight.  With those before a source stopped, the level of
    # the others follows; a source stops if its own ratio is not above that level.
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))).over(every).getField("level")
    return leveled.select("source", "source_size", F.least(F.coalesce(final * F.col("weight"), F.col("stop")), F.col("stop")).alias("target"))


def seats(parties: DataFrame, by: list[str], votes: str, total: Column | str) -> DataFrame:
    """``parties`` with ``quota``: Sainte-Lague seats of ``total`` (a column, the same within ``by``).

    All but about one seat for each party are certain: a divisor half a seat for each party too
    large gives no party more than its due, and one as much too small gives none less.  Only the
    quotients between the two are ranked.
    """
    mine = Window.partitionBy(*by)
    n, sum_votes = F.count(F.lit(1)).over(mine), F.sum(votes).over(mine)
    total = F.col(total) if isinstance(total, str) else total
    bounded = parties.withColumn("__total", total).withColumn("__n", n.cast("double")).withColumn("__sum", sum_votes)
    share = F.when(F.col("__sum") > 0, F.col(votes) / F.col("__sum")).otherwise(0.0)
    low = F.greatest(F.lit(0.0), F.floor(share * (F.col("__total") - F.col("__n") / 2 - 1) + 0.5)).cast("long")
    high = F.ceil(share * (F.col("__total") + F.col("__n") / 2 + 1) + 0.5).cast("long")
    bounded = bounded.withColumn("__low", low).withColumn("__high", F.greatest(high, low))
    bounded = bounded.withColumn("__open", F.col("__total") - F.sum("__low").over(mine))
    keys = [c for c in parties.columns]
    tried = bounded.withColumn("__s", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))))
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.col(votes) / (2 * F.col("__s") + 1)), *[F.asc_nulls_last(k) for k in keys if k not in by], "__s")
    won = tried.withColumn("__won", (F.col("__s").isNotNull() & (F.row_number().over(order) <= F.col("__open"))).cast("long"))
    return won.groupBy(*keys).agg((F.first("__low") + F.sum("__won")).alias("quota"))


def hashed(column: Column, seed: str) -> Column:
    """60 bits of a digest that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, block: int = 16, shard: int = 1 << 21, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_word, part_words) of every row of ``docs``.

    Of ``taken``, whole multiples of ``size`` are whole copies; the rest is ``part_words`` words from
    word ``first_word`` (0-based) on, going on at the start where they pass the end.
    """
    rows = common.materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hashed(F.col("doc_id"), seed).alias("order")), "sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    all_blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = seats(aims, [], "target", all_blocks).withColumn("shards", F.ceil((F.col("source_size") + 1) / shard).cast("int"))
    quotas = common.materialize(quotas, "quotas")

    same = F.col("source").eqNullSafe(F.col("of"))
    dealt = rows.join(quotas.withColumnRenamed("source", "of"), same).drop("of")
    dealt = dealt.withColumn("shard", (F.col("order") % F.col("shards")).cast("int"))
    shards = dealt.groupBy("source", "source_size", "quota", "shard").agg(F.sum("size").cast("double").alias("shard_size"))
    shards = seats(shards.withColumnRenamed("quota", "source_quota"), ["source", "source_size", "source_quota"], "shard_size", "source_quota")
    length = F.col("shard_size").cast("long")
    take = F.least(F.col("quota") * block, epochs * length)
    shards = shards.select(F.col("source").alias("of"), F.col("shard").alias("in_shard"), length.alias("shard_size"), take.alias("take"), F.when(length > 0, hashed(F.concat_ws(":", "source", "shard"), f"{seed}-start") % length).otherwise(0).alias("start"))

    placed = dealt.join(shards, same & (F.col("shard") == F.col("in_shard")))
    order = Window.partitionBy("source", "shard").orderBy("order", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.pmod(F.sum("size").over(order) - F.col("size") - F.col("start"), F.greatest(F.col("shard_size"), F.lit(1)))
    placed = placed.withColumn("at", at)
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long")
    # ``at`` counts from the start; a document that the start lies in has its head at the very end.
    left = F.col("take") - whole * F.col("shard_size")
    tail = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("shard_size"))  # words that stand at the start
    first = F.least(left, tail)
    second = F.greatest(F.lit(0), F.least(left - F.col("at"), F.col("size") - tail))
    placed = placed.withColumn("part", (first + second).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + F.col("part")).alias("taken"), F.when((first > 0) & (F.col("size") > tail), F.col("size") - tail).otherwise(0).cast("long").alias("first_word"), F.col("part").alias("part_words"))
