"""Counts inside a row: as a loop's, and no shuffle for postings and embeddings."""

import random
from collections import Counter

from pyspark.sql import functions as F

from trawl.operators.keyword import counted, postings
from trawl.plans.indexing import hash_embedding


def test_counted_equals_a_loop(spark):
    rng = random.Random(8)
    lists = [[], ["a"], ["b", "a", "b"], *[[rng.choice("abcé漢") * rng.randrange(1, 3) for _ in range(rng.randrange(60))] for _ in range(20)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").select("i", counted(F.col("t")).alias("x")).collect()
    assert {r.i: {x.value: x.n for x in r.x} for r in rows} == {i: dict(Counter(t)) for i, t in enumerate(lists)}
    assert all(len(r.x) == len(set(lists[r.i])) for r in rows)


def test_postings_and_embeddings_shuffle_nothing(spark):
    rows = spark.createDataFrame([("k", "v2", "c1", "a b a"), ("k", "v2", "c2", "--")], "kb_id string, index_version string, chunk_id string, content string")
    found = postings(rows, content="content")
    assert {(r.chunk_id, r.term, r.dl, r.tf) for r in found.collect()} == {("c1", "a", 3, 2), ("c1", "b", 3, 1)}
    embedded = hash_embedding(rows.withColumn("embed_text", F.col("content")))
    held = {r.chunk_id: r.embedding for r in embedded.collect()}
    assert held["c2"] is None and abs(sum(x * x for x in held["c1"]) - 1) < 1e-6
    for df in (found, embedded):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_contents_stay_where_they_lie(spark):
    """References of chunks are found before they are joined, so no text is shuffled."""
    from trawl.operators import graph

    chunks = spark.createDataFrame(
        [("t", "k", "v2", "c1", "d1", "> 参见：Part 1", None, "s", 0, "Top/Part 1"), ("t", "k", "v2", "c2", "d1", "plain", None, "r", 1, "Top")],
        "tenant_id string, kb_id string, index_version string, chunk_id string, document_id string, content string, reference_texts array<string>, section_id string, order_index int, heading_path string",
    )
    documents = spark.createDataFrame([("d1", "Guide", 1)], "document_id string, title string, status int")
    resolved = graph.resolve_references(chunks, documents)
    assert [(r.source_chunk_id, r.candidates, r.target_chunk_id) for r in resolved.collect()] == [("c1", 1, "c1")]
    plan = resolved._jdf.queryExecution().sparkPlan()
    joins = [line for line in plan.treeString().split("\n") if "Join" in line]
    assert joins
    nodes, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            nodes.append([node.output().apply(i).name() for i in range(node.output().size())])
    assert nodes and not any("content" in names for names in nodes)
