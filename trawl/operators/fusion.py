"""Branch normal form, reciprocal rank fusion, candidate filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import low_information, squeeze
from trawl.sources.shared import stored

KEY = ["query_id", "kb_id", "chunk_id"]
MAX_KBS = 5
# The request presets.
PROFILES = [
    # profile, mode, vector_k, bm25_k, top_k, rewrite, rerank
    ("speed", "vector", 10, 0, 5, False, False),
    ("balanced", "hybrid", 10, 10, 5, False, False),
    ("quality", "hybrid", 20, 20, 5, True, True),
]


def normal_branch(hits: DataFrame, branch: str) -> DataFrame:
    """One row per chunk; its rank is the place of its first appearance (``pos``)."""
    first = Window.partitionBy(*KEY).orderBy("pos")
    one = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    other = "bm25" if branch == "vector" else "vector"
    return one.withColumns({f"{branch}_rank": F.col("pos"), f"{branch}_score": F.col("score"), f"{other}_rank": F.lit(None).cast("int"), f"{other}_score": F.lit(None).cast("double"), "retrieval_source": F.lit(branch)}).drop("pos", "score")


def fuse(vector: DataFrame, bm25: DataFrame, k: int = 60, top_n: int | None = None) -> DataFrame:
    """Σ 1 / (k + rank) over both branches, first non-blank field wins (vector first)."""
    if k < 1:
        raise ValueError("k must be positive")
    v, b = normal_branch(vector, "vector"), normal_branch(bm25, "bm25")
    fields = [c for c in v.columns if c not in {*KEY, "vector_rank", "vector_score", "bm25_rank", "bm25_score", "retrieval_source"} and c in b.columns]
    v = v.select(*KEY, "vector_rank", "vector_score", *[F.col(c).alias(f"_v_{c}") for c in fields])
    b = b.select(*KEY, "bm25_rank", "bm25_score", *[F.col(c).alias(f"_b_{c}") for c in fields])
    share = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    both = F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull()
    rows = v.join(b, KEY, "full_outer").withColumns(
        {
            "score": share("vector_rank") + share("bm25_rank"),
            "retrieval_source": F.when(both, "hybrid").when(F.col("vector_rank").isNotNull(), "vector").otherwise("bm25"),
            **{c: F.coalesce(F.nullif(F.col(f"_v_{c}"), F.lit("")), F.nullif(F.col(f"_b_{c}"), F.lit(""))) for c in fields},
        }
    )
    rows = rows.drop(*[f"_{x}_{c}" for x in "vb" for c in fields])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(both.cast("int")), F.least("vector_rank", "bm25_rank"), "kb_id", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if top_n is None else rows.filter(F.col("rank") <= top_n)


def shared_branch(hits: DataFrame) -> DataFrame:
    """A keyword branch that queries of one kind share: ``hits`` has ``kind`` for query_id. Its
    normal form by kind, with the place of each chunk in it."""
    rows = normal_branch(hits.withColumnRenamed("kind", "query_id"), "bm25")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("bm25_rank"))
    return rows.withColumn("place", place).withColumnRenamed("query_id", "kind").select("kind", *KEY[1:], "document_id", "bm25_rank", "bm25_score", "place")


def _met(vector: DataFrame, kinds: DataFrame, shared: DataFrame) -> DataFrame:
    """The vector branch's chunks that stand in the shared one too."""
    return vector.select(*KEY).distinct().join(kinds, "query_id").join(shared, ["kind", *KEY[1:]]).select(*KEY, "document_id", "bm25_rank", "bm25_score", "place")


def _head(vector: DataFrame, kinds: DataFrame, shared: DataFrame, met: DataFrame, upto: DataFrame, k: int) -> DataFrame:
    """``fuse`` over both branches, of the shared one only chunks that the vector branch holds
    and those of ranks up to ``upto`` (query_id, upto)."""
    first = shared.join(kinds.join(upto, "query_id"), "kind").filter("bm25_rank <= upto").select(met.columns).join(met.select(KEY), KEY, "left_anti")
    rows = met.unionByName(first).select(*KEY, "document_id", F.col("bm25_rank").alias("pos"), F.col("bm25_score").alias("score"))
    return fuse(vector, rows, k)


def fuse_window(vector: DataFrame, kinds: DataFrame, shared: DataFrame, limits: DataFrame, k: int = 60) -> DataFrame:
    """The rows of ``fuse`` up to a query's ``upto`` (query_id, upto), where the
    keyword branch is shared by kind (query_id, kind). Of its chunks the n-th has n - 1 chunks
    before it whatever the other branch holds, so only the first ones are given to queries;
    ranks may skip places, so the first ``upto`` places are asked for."""
    first = shared.join(limits.join(kinds, "query_id"), "kind").filter("place <= upto").select("query_id", "bm25_rank", "upto").groupBy("query_id").agg(F.max("bm25_rank").alias("upto"))
    met = _met(vector, kinds, shared)
    rows = _head(vector, kinds, shared, met, first, k)
    return rows.join(limits, "query_id").filter("rank <= upto").drop("upto")


def fuse_shared(vector: DataFrame, kinds: DataFrame, shared: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank) of ``fuse`` where the keyword branch is
    shared by kind (query_id, kind).

    A chunk of the shared branch alone, of a rank beyond the vector branch's last, stands behind
    all of that branch; its rank follows from its place and from how many chunks before it both
    branches hold. So these rows are made where the shared branch lies and are never shuffled.
    """
    met = _met(vector, kinds, shared)
    ends = vector.groupBy("query_id").agg(F.max("pos").alias("upto"), F.countDistinct(*KEY[1:]).cast("int").alias("n"))
    both = met.groupBy("query_id").agg(F.sort_array(F.collect_list("place")).alias("both"))
    asked = stored(kinds.join(ends, "query_id", "left").join(both, "query_id", "left").select(
        "query_id", "kind", F.coalesce("upto", F.lit(0)).alias("upto"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("both", F.array().cast("array<int>")).alias("both")), "kinds")
    head = _head(vector, kinds, shared, met, asked.select("query_id", "upto"), k).select(*KEY, "score", "rank")
    rest = shared.join(asked, "kind").filter((F.col("bm25_rank") > F.col("upto")) & ~F.array_contains("both", F.col("place")))
    before = F.size(F.filter("both", lambda x: x < F.col("place")))
    return head.unionByName(rest.select(*KEY, (1.0 / (k + F.col("bm25_rank"))).alias("score"), (F.col("n") + F.col("place") - before).alias("rank")))


def degrade_shared(vector: DataFrame, kinds: DataFrame, shared: DataFrame, status: DataFrame, k: int = 60) -> DataFrame:
    """As ``degrade``, where the keyword branch is shared by kind (query_id, kind)."""
    some = lambda rows, flag: rows.join(status.filter(flag).select("query_id"), "query_id", "left_semi")
    fused = fuse_shared(some(vector, "vector_ok AND bm25_ok"), some(kinds, "vector_ok AND bm25_ok"), shared, k).withColumn("fusion", F.lit("rrf"))
    none = vector.filter("false").select(*KEY, "document_id", "pos", "score")
    alone = degrade(vector, none, status.filter("vector_ok AND NOT bm25_ok"), k)
    rest = shared.join(stored(some(kinds, "bm25_ok AND NOT vector_ok"), "kinds"), "kind").select(*KEY, F.col("bm25_score").alias("score"), F.col("place").alias("rank"), F.lit("bm25").alias("fusion"))
    return fused.unionByName(alone).unionByName(rest)


def degrade(vector: DataFrame, bm25: DataFrame, status: DataFrame, k: int = 60) -> DataFrame:
    """By ``status`` (query_id, vector_ok, bm25_ok) fuse both branches, or pass the one
    that is left through with its own scores; queries with neither are ``failed``."""
    both = status.filter("vector_ok AND bm25_ok").select("query_id")
    fused = fuse(vector.join(both, "query_id", "left_semi"), bm25.join(both, "query_id", "left_semi"), k).select(*KEY, "score", "rank", F.lit("rrf").alias("fusion"))
    one = []
    for name, rows, flag in (("vector", vector, "vector_ok AND NOT bm25_ok"), ("bm25", bm25, "bm25_ok AND NOT vector_ok")):
        kept = normal_branch(rows.join(status.filter(flag).select("query_id"), "query_id", "left_semi"), name)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(f"{name}_rank"))
        one.append(kept.select(*KEY, F.col(f"{name}_score").alias("score"), place.alias("rank"), F.lit(name).alias("fusion")))
    return fused.unionByName(one[0]).unionByName(one[1])


def scope_violations(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits with missing ids or outside their query's (kb, version, tenant) scope."""
    known = scope.select("query_id", "kb_id", "index_version", "tenant_id").distinct()
    outside = hits.join(known, ["query_id", "kb_id", "index_version", "tenant_id"], "left_anti")
    blank = hits.filter("chunk_id IS NULL OR chunk_id = '' OR document_id IS NULL OR document_id = ''")
    return outside.unionByName(blank).distinct()


def filter_candidates(hits: DataFrame) -> DataFrame:
    """Keeps or drops each candidate of a query in order of ``rank``, with the reason.

    A dropped row must not count as seen, so a window is not enough: each query's candidates
    (at most a few dozen) are folded in order.
    """
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), "kb_id", "chunk_id",
        F.concat_ws("\x01", "kb_id", "chunk_id").alias("identity"),
        F.concat_ws("\x01", "kb_id", squeeze(F.col("content"))).alias("text"),
        F.when(F.col("index_version") == "v1", F.lit(None)).when(F.col("chunk_type") == "reference_pointer", "reference_pointer").when(low_information(F.col("content")), "low_information").cast("string").alias("own"),
        (F.coalesce(F.col("index_version"), F.lit("")) != "v1").alias("checked"),
    )
    groups = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ids"), none.alias("texts"), F.array().cast("array<struct<rank:int,kb_id:string,chunk_id:string,reason:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        reason = F.when(F.array_contains(s.ids, x.identity), "duplicate_chunk_id").when(x.own.isNotNull(), x.own).when(x.checked & F.array_contains(s.texts, x.text), "duplicate_content")
        kept = reason.isNull()
        return F.struct(
            F.when(kept, F.concat(s.ids, F.array(x.identity))).otherwise(s.ids).alias("ids"),
            F.when(kept, F.concat(s.texts, F.array(x.text))).otherwise(s.texts).alias("texts"),
            F.concat(s.out, F.array(F.struct(x.rank.alias("rank"), x.kb_id.alias("kb_id"), x.chunk_id.alias("chunk_id"), reason.cast("string").alias("reason")))).alias("out"),
        )

    return groups.select("query_id", F.explode(F.aggregate("items", start, step, lambda s: s.out)).alias("x")).select("query_id", "x.*")


def filter_reasons(decided: DataFrame) -> DataFrame:
    """Counts before and after the filter, and a map of reasons."""
    by = decided.groupBy("query_id", "reason").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    return by.groupBy("query_id").agg(
        F.sum("n").alias("before"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("after"), F.map_from_entries(pairs).alias("reasons")
    )


def empty_reasons(queries: DataFrame, scope: DataFrame, hits: DataFrame, indexed: DataFrame) -> DataFrame:
    """Queries without hits, and whether their scope has any indexed chunk (kb_id, n)."""
    silent = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    held = silent.join(scope.select("query_id", "kb_id").distinct(), "query_id", "left").join(indexed, "kb_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return held.select("query_id", F.when(F.col("n") == 0, "no_indexed_chunks").otherwise("no_chunks_matched").alias("empty_reason"))


def source_distribution(scope: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per knowledge base in scope, zeros included."""
    own = scope.select("query_id", "kb_id").distinct()
    return own.join(hits.select("query_id", "kb_id", "chunk_id"), ["query_id", "kb_id"], "left").groupBy("query_id", "kb_id").agg(F.count("chunk_id").alias("n"))


def load_knowledge_bases(requests: DataFrame, kbs: DataFrame, most: int = MAX_KBS) -> tuple[DataFrame, DataFrame]:
    """Requested bases in requested order, and problems (missing or too many)."""
    wanted = requests.select("query_id", "tenant_id", F.posexplode("kb_ids").alias("pos", "kb_id"))
    loaded = wanted.join(kbs, ["tenant_id", "kb_id"])
    missing = wanted.join(kbs.select("tenant_id", "kb_id"), ["tenant_id", "kb_id"], "left_anti").select("query_id", "kb_id", F.lit("knowledge_base_not_found").alias("problem"))
    many = requests.filter(F.size("kb_ids") > most).select("query_id", F.lit(None).cast("string").alias("kb_id"), F.lit("too_many_knowledge_bases").alias("problem"))
    return loaded, missing.unionByName(many)


def expand_profiles(queries: DataFrame) -> DataFrame:
    """Request settings from the query's profile; ``custom`` keeps its own values."""
    spark = queries.sparkSession
    presets = spark.createDataFrame(PROFILES, "profile string, p_mode string, p_vector_k int, p_bm25_k int, p_top_k int, p_rewrite boolean, p_rerank boolean")
    rows = queries.join(F.broadcast(presets), "profile", "left")
    named = ["mode", "vector_k", "bm25_k", "top_k", "rewrite", "rerank"]
    return rows.select("query_id", "profile", *[(F.coalesce(F.col(f"p_{c}"), F.col(c)) if c in queries.columns else F.col(f"p_{c}")).alias(c) for c in named])


def base_window(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """At most max(top_k, 20) base rows of a query, 20 where it is reranked."""
    return hits.join(limits.select("query_id", "top_k", "rerank"), "query_id").filter(F.col("rank") <= F.when(F.col("rerank"), 20).otherwise(F.greatest("top_k", F.lit(20))))
