"""Texts are compared by hash and length, and travel only where they are shown."""

import random

from pyspark.sql import functions as F

from trawl.functions.text import WHITE, strip
from trawl.operators import graph
from trawl.plans import graph_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strip_takes_unicode_white_space(spark):
    rows = spark.range(1, 0x3100).filter("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    rows = rows.select(F.concat("c", F.lit("a b"), "c", F.lit(" \n")).alias("x")).select(strip(F.col("x")).alias("y"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("z"))
    assert rows.count() > 12000 and rows.filter("y <> z").count() == 0 and len(WHITE) == 25


def test_injection_reads_no_text(spark):
    for name in ("e10_graph_injection", "e10_graph_injection_capped", "e15_context_counters"):
        text = plan(graph_queries.QUERIES[name](spark, SF))
        assert "content#" not in text and "text#" not in text, name


def test_chosen_by_length_as_by_text(spark):
    rng = random.Random(8)
    kinds = list(graph.PRIORITY)
    anchors = spark.createDataFrame([(f"a{i}", f"c{i}", rng.choice(["T", " ", "", None]), rng.choice(["A/B", " ", None]), rng.choice(["", None, "x" * rng.randrange(4200)])) for i in range(300)], "anchor_key string, chunk_id string, title string, heading_path string, content string")
    related = spark.createDataFrame([(f"a{i}", f"n{p}", rng.choice(kinds), rng.choice(["", None, " same", "same\n", "漢" * rng.randrange(2200), "y" * rng.randrange(4200)]), p) for i in range(300) for p in range(rng.randrange(6))], "anchor_key string, chunk_id string, relation string, content string, place int")
    whole = graph.expand_context(anchors, related).withColumn("n", F.length("context"))
    light = graph.choose_supplements(graph.with_trimmed(anchors).drop("content"), graph.with_trimmed(related).drop("content"))
    assert whole.filter("supplements > 0 AND n > 4096").count() == 0
    rows = lambda df: sorted(map(tuple, df.select("anchor_key", "supplements", "duplicates").collect()))
    assert rows(whole) == rows(light)
