"""Counts, quotas and lifecycle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plan limits (qps, daily, bases, bases per query, documents per base, processing).
PLANS = [
    ("free", 3, 500, 1, 1, 30, 1),
    ("standard", 10, 5000, 5, 3, 200, 2),
    ("pro", 50, 100000, 50, 5, 5000, 10),
]
PLAN_SCHEMA = "plan string, qps int, daily int, max_kb int, max_kb_per_query int, max_docs int, max_processing int"
# What a plan may use.
FEATURES = {"free": (["speed"], False, False, False), "standard": (["speed", "balanced"], True, False, True), "pro": (["speed", "balanced", "quality", "custom"], True, True, True)}
SUCCESS, FAILED, PROCESSING = 1, 2, 3
READY = ("ready", "active", "archived")


def tree(kbs: DataFrame, documents: DataFrame, chunks: DataFrame, name: str | None = None) -> DataFrame:
    """Bases with their documents and each document's chunk count, nested and in order."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    docs = documents.join(counts, "document_id", "left").select("kb_id", F.struct("created_at", "document_id", "title", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    nested = docs.groupBy("kb_id").agg(F.sort_array(F.collect_list("x")).alias("documents"))
    rows = kbs if name is None else kbs.filter(F.col("name").ilike(f"%{name}%"))
    return rows.join(nested, "kb_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(nested.schema["documents"].dataType)))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def indexed_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks per base whose document is indexed."""
    return counts_by(chunks.join(documents.filter(F.col("status") == SUCCESS).select("document_id"), "document_id", "left_semi"), "kb_id")


def quota_violations(tenants: DataFrame, documents: DataFrame) -> DataFrame:
    """(tenant_id, kb_id, quota, used, most) wherever use has reached the plan's limit."""
    plans = F.broadcast(tenants.sparkSession.createDataFrame(PLANS, PLAN_SCHEMA))
    rows = tenants.join(plans, "plan").join(documents.select("tenant_id", "kb_id", "status"), "tenant_id")
    per_kb = rows.groupBy("tenant_id", "kb_id").agg(F.count(F.lit(1)).alias("used"), F.first("max_docs").alias("most")).select("tenant_id", "kb_id", F.lit("documents").alias("quota"), "used", "most")
    own = rows.groupBy("tenant_id").agg(F.countDistinct("kb_id").alias("kbs"), F.count_if(F.col("status") == PROCESSING).alias("busy"), F.first("max_kb").alias("max_kb"), F.first("max_processing").alias("max_busy"))
    none = F.lit(None).cast("string").alias("kb_id")
    kbs = own.select("tenant_id", none, F.lit("knowledge_bases").alias("quota"), F.col("kbs").alias("used"), F.col("max_kb").alias("most"))
    busy = own.select("tenant_id", none, F.lit("processing").alias("quota"), F.col("busy").alias("used"), F.col("max_busy").alias("most"))
    return per_kb.unionByName(kbs).unionByName(busy).filter("used >= most")


def feature_violations(requests: DataFrame) -> DataFrame:
    """I4: requests (query_id, plan, profile, mode, rerank, rewrite, n_kb) beyond their plan."""
    spark = requests.sparkSession
    rows = [(p, *f) for p, f in FEATURES.items()]
    plans = spark.createDataFrame(rows, "plan string, profiles array<string>, hybrid_ok boolean, rerank_ok boolean, rewrite_ok boolean").join(spark.createDataFrame(PLANS, PLAN_SCHEMA).select("plan", "max_kb_per_query"), "plan")
    r = requests.join(F.broadcast(plans), "plan")
    rules = [
        F.when(~F.array_contains("profiles", F.col("profile")), "profile"),
        F.when((F.col("mode") == "hybrid") & ~F.col("hybrid_ok"), "hybrid"),
        F.when(F.col("rerank") & ~F.col("rerank_ok"), "rerank"),
        F.when(F.col("rewrite") & ~F.col("rewrite_ok"), "rewrite"),
        F.when(F.col("n_kb") > F.col("max_kb_per_query"), "knowledge_bases_per_query"),
    ]
    return r.select("query_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def without(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks that are left after deletes by document, or by document and version."""
    rows = chunks
    if "index_version" in gone.columns:
        rows = rows.join(gone.filter("index_version IS NOT NULL").select("document_id", "index_version"), ["document_id", "index_version"], "left_anti")
        gone = gone.filter("index_version IS NULL")
    return rows.join(gone.select("document_id"), "document_id", "left_anti")


def lookup(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks by (tenant_id, kb_id, index_version, chunk_id)."""
    on = ["tenant_id", "kb_id", "index_version", "chunk_id"]
    return chunks.join(keys.select(on), on, "left_semi")


def backfill_version(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing versions become v1; and the counts that prove it (before, after, missing)."""
    filled = rows.fillna({"index_version": "v1"})
    return filled, rows.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("index_version").isNull()).alias("missing")).crossJoin(filled.agg(F.count(F.lit(1)).alias("after"), F.count_if(F.col("index_version").isNull()).alias("left")))


def next_status(documents: DataFrame, produced: DataFrame, errors: DataFrame) -> DataFrame:
    """C4: processing documents become successes, or failures with a message of at most 2000."""
    rows = documents.filter(F.col("status") == PROCESSING).select("document_id").join(produced.select("document_id", "n"), "document_id", "left").join(errors.select("document_id", "message"), "document_id", "left")
    failed = F.col("message").isNotNull() | (F.coalesce("n", F.lit(0)) == 0)
    text = F.substring(F.coalesce("message", F.lit("document has no content to index")), 1, 2000)
    return rows.select("document_id", F.when(failed, FAILED).otherwise(SUCCESS).alias("status"), F.when(failed, text).alias("error_message"))


def activate(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested version of a base becomes active if it is ready or active already; the
    base's other active versions become ready."""
    ok = versions.filter(F.col("status").isin("ready", "active")).join(requests.select("kb_id", F.col("version")), ["kb_id", "version"], "left_semi").select("kb_id", F.col("version").alias("_new"))
    rows = versions.join(ok, "kb_id", "left")
    status = F.when(F.col("version") == F.col("_new"), "active").when(F.col("_new").isNotNull() & (F.col("status") == "active"), "ready").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_new")


def version_conflicts(versions: DataFrame) -> DataFrame:
    """Bases with more than one active version."""
    return versions.filter("status = 'active'").groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def list_versions(versions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Versions, newest first within a base, with their documents and chunks."""
    held = chunks.groupBy("kb_id", F.col("index_version").alias("version")).agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    order = Window.partitionBy("kb_id").orderBy(F.desc("created_at"), F.desc("version"))
    rows = versions.join(held, ["kb_id", "version"], "left").fillna(0, ["documents", "chunks"])
    return rows.withColumn("place", F.row_number().over(order))


def purge_versions(versions: DataFrame, chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that are left, and requests that are refused (active or unknown versions)."""
    known = requests.join(versions.select("kb_id", "version", "status"), ["kb_id", "version"], "left")
    refused = known.filter("status IS NULL OR status = 'active'").select("kb_id", "version", F.when(F.col("status").isNull(), "unknown").otherwise("active").alias("reason"))
    gone = known.filter("status <> 'active'").select("kb_id", F.col("version").alias("index_version"))
    return chunks.join(gone, ["kb_id", "index_version"], "left_anti"), refused


def resolve_version(requests: DataFrame, kbs: DataFrame, versions: DataFrame) -> DataFrame:
    """Requested, else active, else v1; only a requested version must exist and be usable."""
    rows = requests.join(kbs.select("kb_id", "active_index_version"), "kb_id", "left").join(versions.select("kb_id", F.col("version").alias("requested_version"), "status"), ["kb_id", "requested_version"], "left")
    return rows.select("query_id", "kb_id", F.coalesce("requested_version", "active_index_version", F.lit("v1")).alias("index_version"), (F.col("requested_version").isNull() | F.coalesce(F.col("status").isin(*READY), F.lit(False))).alias("usable"))


def select_for_reindex(documents: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The given documents in order, or all successes by (created_at, document_id) of a base;
    and the given ids that do not belong."""
    if wanted is None:
        order = Window.partitionBy("kb_id").orderBy("created_at", "document_id")
        return documents.filter(F.col("status") == SUCCESS).select("kb_id", "document_id", F.row_number().over(order).alias("place")), documents.limit(0).select("kb_id", "document_id")
    first = wanted.groupBy("kb_id", "document_id").agg(F.min("pos").alias("pos"))
    own = documents.select("kb_id", "document_id")
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy("pos"))
    return first.join(own, ["kb_id", "document_id"], "left_semi").select("kb_id", "document_id", place.alias("place")), first.join(own, ["kb_id", "document_id"], "left_anti").select("kb_id", "document_id")


def delete_refusals(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """C11: bases that may not be deleted: a document is processing, or a version is building."""
    busy = documents.groupBy("kb_id").agg(F.bool_or(F.col("status") == PROCESSING).alias("busy"))
    building = versions.groupBy("kb_id").agg(F.bool_or(F.col("status") == "building").alias("building"))
    rows = requests.join(busy, "kb_id", "left").join(building, "kb_id", "left")
    return rows.filter("busy OR building").select("kb_id", F.when(F.col("busy"), "processing").otherwise("building").alias("reason"))


def cascade(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """C11: rows of a child table that outlive the deleted bases."""
    return rows.join(deleted.select("kb_id"), "kb_id", "left_anti")


def writable(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests on bases of which no version is building."""
    return requests.join(versions.filter("status = 'building'").select("kb_id").distinct(), "kb_id", "left_anti")


def reindex_eligible(documents: DataFrame) -> DataFrame:
    """Successes and failures go back to processing, with the error cleared."""
    return documents.filter(F.col("status").isin(SUCCESS, FAILED)).withColumns({"status": F.lit(PROCESSING), "error_message": F.lit(None).cast("string")})


def document_detail(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """C14: documents with their chunk count and whether they may be deleted."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.join(n, "document_id", "left").select("document_id", "title", "status", F.coalesce("n", F.lit(0)).alias("n"), (F.col("status") != PROCESSING).alias("deletable"))


def bad_dimension(chunks: DataFrame, dimension: int) -> Column:
    """Embeddings that are missing or of another length."""
    return F.col("embedding").isNull() | (F.size("embedding") != dimension)
