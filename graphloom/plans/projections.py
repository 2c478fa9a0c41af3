"""The test tables seen as symbols, edges and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G's nodes: parts as symbols; names repeat on purpose.  Every eighth is a class, brands own the others."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 8 == 0, "class").otherwise("function")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.concat_ws(" ", "p_name", "p_type").alias("signature"), F.lower("p_type").alias("language"),
        F.col("p_type").alias("file"), F.col("p_size").alias("line_start"), (F.col("p_size") + 2).alias("line_end"), (F.col("p_size") * 10).alias("byte_start"), (F.col("p_size") * 10 + 29).alias("byte_end"),
        F.lit(None).cast("string").alias("container"), F.col("p_brand").alias("owner"), F.lit(None).cast("string").alias("doc"),
    )


def part_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from an order's line to its next: (src, dst, order, line)."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("s"), F.lead("l_partkey").over(order).alias("d"))
    return steps.where("d is not null and d <> s").select(F.col("s").cast("string").alias("src"), F.col("d").cast("string").alias("dst"), F.col("l_orderkey").alias("order"), "line")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G's distinct edges."""
    return part_sites(spark, sf_dir).select("src", "dst").distinct()


def call_edges(spark: SparkSession, sf_dir: str, bound: bool = False) -> DataFrame:
    """B: each step as a call site: the target's name, and on even lines its brand as qualifier."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("dst"), "p_name", "p_brand")
    sites = part_sites(spark, sf_dir).distinct().join(parts, "dst")
    return sites.select(
        F.concat_ws(":", "order", "line", "src", "dst").alias("edge_id"), F.lit("calls").alias("kind"), F.col("src").alias("from_id"), F.col("p_name").alias("to_name"),
        (F.col("dst") if bound else F.lit(None).cast("string")).alias("to_id"), F.lit("heuristic").alias("confidence"), F.when(F.col("line") % 2 == 0, F.col("p_brand")).alias("qualifier"), F.lit(0).alias("alternatives"), "line",
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: (src, dst) nations by orders from supplier to customer nation; the two strongest of each, itself left out."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    pairs = line.join(supplier, "l_suppkey").join(orders, "l_orderkey").join(customer, "c_custkey").where("src <> dst").groupBy("src", "dst").count()
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))
    return pairs.withColumn("rn", best).where("rn <= 2").select("src", "dst")


def whole_seconds(rows: DataFrame, ts: str) -> Column:
    """Whole seconds since 1970, rounded down.  A time without a zone counts as UTC, whatever the session's zone, as in SQL."""
    if rows.schema[ts].dataType != TimestampNTZType():
        return F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.unix_date(F.col(ts).cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def sessions(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    """E: a user's events with no gap over ``hours`` (user_id, session, lo, hi, events)."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    mine = Window.partitionBy("user_id").orderBy("t", "event_id")
    new = F.coalesce((F.col("t") - F.lag("t").over(mine) > hours * 3600).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("events"))


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a Python file (path, language, content) that imports the next one's class and calls it."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    total = rows.agg(F.count("*").alias("all"))  # one row
    after = rows.crossJoin(F.broadcast(total)).select(F.pmod(F.col("k") - 1, F.col("all")).alias("k"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    lines = [
        '"""Supplier %1$d."""', "from pkg%3$d.sup%2$d import Sup%2$d", "", "", "class Sup%1$d:", '    """Orders of supplier %1$d."""', "", "    def total(self, x):", "        return self.part(x)", "",
        "    def part(self, x):", "        return x", "", "", "def run%1$d(x):", "    other = Sup%2$d()", "    return other.total(x)", "",
    ]
    return rows.join(after, "k").select(F.format_string("pkg%d/sup%d.py", "n", "k").alias("path"), F.lit("python").alias("language"), F.format_string("\n".join(lines), "k", "k2", "n2").alias("content"))
