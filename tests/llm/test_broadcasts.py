"""Tables that Spark sizes too low must not be broadcast: the driver would have to hold them."""

import random

import pytest

from trawl.llm import jaccard, op3_simhash, op6_mixing, op7_lines

SCHEMA = "doc_id long, text string, source string"


def broadcasts(df):
    """The parts of a plan, as first made, that are broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            stop = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:stop])


@pytest.fixture
def planned(spark, monkeypatch):
    """What is broadcast in the tables that operators store, under Spark's own threshold."""
    seen = {}
    for module in (jaccard, op3_simhash, op6_mixing, op7_lines):
        store = module.stored

        def spy(df, name, *args, store=store, **options):
            seen.setdefault(name, []).extend(broadcasts(df))
            return store(df, name, *args, **options)

        monkeypatch.setattr(module, "stored", spy)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    yield seen
    spark.conf.set(key, before)


def test_exploded_rows_and_texts_are_not_broadcast(spark, planned):
    rng, rows = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(160)]
        other = [*words[:40], "x", *words[41:100], "y", *words[101:]]
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(other), "a")]
    kept = op3_simhash.keep_one(spark.createDataFrame(rows, SCHEMA), shingle=5, radius=5, similar=True)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))
    assert not [planned[name] for name in ("buckets", "prefixes", "pairs", "wanted") if planned[name]]
    assert planned["words"] is not None  # texts were compared, and joined to their pairs among the edges
    assert not [part for part in planned["edges"] if "Generate" in part or "text#" in part]


def test_lines_of_documents_are_not_broadcast(spark, planned):
    rows = [(k, "\n".join(["same"] * 20_000 + [f"own {k} {j}" for j in range(2000)]), "a") for k in range(12)]
    found = op7_lines.drop_lines(spark.createDataFrame(rows, SCHEMA))
    assert not [part for part in broadcasts(found) if "Generate" in part]
    assert sorted((r.text.count("\n"), r.n_dropped) for r in found.collect()) == [(1999, 20_000)] * 12


def test_documents_are_not_broadcast_to_be_mixed(spark, planned):
    rows = [(k, f"a b c {k}", f"s{k % 3}") for k in range(60)]
    op6_mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not [part for part in planned["copies"] if "doc_id" in part]
