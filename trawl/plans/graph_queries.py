"""Graph and context queries (E) over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import graph
from trawl.plans import tables as t
from trawl.sources.shared import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_C = t.sql("graph_chunks")
_OK = f"(SELECT * FROM {_C} WHERE document_id NOT LIKE '%3')"
_LINK, _QUOTE, _SECTION = r"\[[^\]]+\]\(([^)#]+)(?:#([^)]+))?\)", r"《([^》]+)》([^。；;，,\n]*)", r'(?:关联规则|参见|见)[：:]?\s*[“"]?([^”"\n]+)'
# A chunk has its link as reference, or else what its content's lines say.
_LINES = f"(SELECT chunk_id, tenant_id, kb_id, index_version, trim(unnest(string_split(content, chr(10)))) AS line FROM {_OK} WHERE link IS NULL)"
_REFS = f"""(SELECT DISTINCT tenant_id, kb_id, index_version, chunk_id AS source_chunk_id, reference_text,
  CASE WHEN regexp_matches(reference_text, '{_LINK}') THEN lower(regexp_replace(regexp_replace(regexp_extract(reference_text, '{_LINK}', 1), '^.*/', ''), '(?i)\\.(md|markdown)$', ''))
       WHEN regexp_matches(reference_text, '{_QUOTE}') THEN lower(trim(regexp_extract(reference_text, '{_QUOTE}', 1))) END AS t,
  lower(nullif(trim(CASE WHEN regexp_matches(reference_text, '{_LINK}') THEN regexp_extract(reference_text, '{_LINK}', 2)
       WHEN regexp_matches(reference_text, '{_QUOTE}') THEN regexp_extract(reference_text, '{_QUOTE}', 2) ELSE regexp_extract(reference_text, '{_SECTION}', 1) END), '')) AS h
  FROM (SELECT chunk_id, tenant_id, kb_id, index_version, link AS reference_text FROM {_OK} WHERE link IS NOT NULL
        UNION ALL SELECT chunk_id, tenant_id, kb_id, index_version, ltrim(line, '> ') FROM {_LINES}
        WHERE regexp_matches(line, '{_QUOTE}') OR regexp_matches(line, '{_LINK}') OR regexp_matches(line, '{_SECTION}')))"""
# The first chunk of each section of a document; with a title alone, the only document's first chunk.
_HEADS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY order_index, chunk_id) AS n, row_number() OVER (PARTITION BY document_id ORDER BY order_index, chunk_id) AS m FROM {_OK}) WHERE n = 1)"
_CAND = f"""(SELECT r.source_chunk_id, r.reference_text, r.tenant_id, r.kb_id, r.index_version, c.chunk_id AS target_chunk_id FROM {_REFS} r JOIN {_HEADS} c
  ON r.tenant_id = c.tenant_id AND r.kb_id = c.kb_id AND r.index_version = c.index_version
  AND (r.t IS NULL OR r.t = lower(c.title)) AND (r.h IS NULL OR lower(c.heading_path) LIKE '%' || r.h) AND (r.h IS NOT NULL OR r.t IS NULL OR c.m = 1))"""
_RESOLVED = f"""(SELECT r.*, coalesce(n, 0) AS candidates, target_chunk_id FROM {_REFS} r LEFT JOIN
  (SELECT source_chunk_id, reference_text, count(*) AS n, min(target_chunk_id) AS target_chunk_id FROM {_CAND} GROUP BY ALL) c USING (source_chunk_id, reference_text))"""
_EDGES = f"(SELECT DISTINCT tenant_id, kb_id, index_version, source_chunk_id, target_chunk_id FROM {_RESOLVED} WHERE candidates = 1 AND source_chunk_id <> target_chunk_id)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_relations(graph.resolve_references(*t.graph(spark, d)))


@query("e2_reference_targets", f"SELECT source_chunk_id, reference_text, t, h FROM {_REFS}")
def e2(spark, d):
    chunks, documents = t.graph(spark, d)
    found = graph.references(chunks.join(documents.filter("status = 1"), "document_id", "left_semi"))
    return found.select("source_chunk_id", "reference_text", F.nullif("t", F.lit("")).alias("t"), F.nullif("h", F.lit("")).alias("h"))


@query("e1_reference_texts", f"SELECT DISTINCT chunk_id, ltrim(line, '> ') AS reference_text FROM {_LINES} WHERE regexp_matches(line, '{_QUOTE}') OR regexp_matches(line, '{_SECTION}')")
def e1(spark, d):
    chunks, documents = t.graph(spark, d)
    rows = chunks.filter("link IS NULL").join(documents.filter("status = 1"), "document_id", "left_semi")
    return rows.select("chunk_id", F.explode(graph.extract_references(F.col("content"))).alias("reference_text"))


@query("e3_reference_matches", f"SELECT source_chunk_id, reference_text, candidates FROM {_RESOLVED}")
def e3(spark, d):
    return graph.resolve_references(*t.graph(spark, d)).select("source_chunk_id", "reference_text", "candidates")


@query("e4_relations", f"SELECT source_chunk_id, target_chunk_id FROM {_EDGES}")
def e4(spark, d):
    return edges(spark, d).select("source_chunk_id", "target_chunk_id")


@query("e5_unresolved", f"SELECT DISTINCT source_chunk_id, reference_text, candidates AS candidate_count FROM {_RESOLVED} WHERE candidates <> 1 OR source_chunk_id = target_chunk_id")
def e5(spark, d):
    return graph.unresolved_references(graph.resolve_references(*t.graph(spark, d))).select("source_chunk_id", "reference_text", "candidate_count")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return t.graph(spark, d)[0].withColumn("anchor_key", F.col("chunk_id"))


# Per anchor at most three references; parents as of the anchor; neighbours of prose anchors.
_E6 = f"""(SELECT * FROM (SELECT e.source_chunk_id AS anchor_key, c.chunk_id, c.order_index, 'reference' AS relation, 0 AS p, row_number() OVER (PARTITION BY e.source_chunk_id ORDER BY c.order_index, c.chunk_id) AS n
  FROM {_EDGES} e JOIN {_C} c ON c.chunk_id = e.target_chunk_id) WHERE n <= 3)"""
_E7 = f"""(SELECT a.chunk_id AS anchor_key, c.chunk_id, c.order_index, 'parent_section' AS relation, 1 AS p FROM {_C} a ASOF JOIN {_C} c
  ON a.tenant_id = c.tenant_id AND a.kb_id = c.kb_id AND a.index_version = c.index_version AND a.document_id = c.document_id AND a.parent_section_id = c.section_id AND a.order_index > c.order_index)"""
_E8 = f"""(SELECT a.chunk_id AS anchor_key, c.chunk_id, c.order_index, CASE WHEN c.order_index < a.order_index THEN 'previous' ELSE 'next' END AS relation, CASE WHEN c.order_index < a.order_index THEN 2 ELSE 3 END AS p
  FROM {_C} a JOIN {_C} c ON a.document_id = c.document_id AND a.section_id = c.section_id AND abs(a.order_index - c.order_index) = 1 AND a.kb_id = c.kb_id AND a.tenant_id = c.tenant_id AND a.index_version = c.index_version WHERE a.chunk_type = 'prose')"""
_E9 = f"""(SELECT *, row_number() OVER (PARTITION BY anchor_key ORDER BY p, order_index, chunk_id) AS place FROM
  (SELECT anchor_key, chunk_id, order_index, relation, p FROM {_E6} UNION ALL SELECT * FROM {_E7} UNION ALL SELECT * FROM {_E8}))"""


@query("e6_reference_neighbours", f"SELECT anchor_key, chunk_id FROM {_E6}")
def e6(spark, d):
    return graph.reference_neighbours(anchors(spark, d), t.graph(spark, d)[0], edges(spark, d)).select("anchor_key", "chunk_id")


@query("e7_parent_asof", f"SELECT anchor_key, chunk_id, order_index FROM {_E7}")
def e7(spark, d):
    return graph.parents(anchors(spark, d), t.graph(spark, d)[0]).select("anchor_key", "chunk_id", "order_index")


@query("e8_section_neighbours", f"SELECT anchor_key, chunk_id, relation FROM {_E8}")
def e8(spark, d):
    return graph.section_neighbours(anchors(spark, d), t.graph(spark, d)[0]).select("anchor_key", "chunk_id", "relation")


def related(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    return graph.stored_relations(anchors(spark, d), t.graph(spark, d)[0] if chunks is None else chunks, t.adjacency(spark, d))


@query("e9_relations_in_order", f"SELECT anchor_key, chunk_id, relation, place FROM {_E9}")
def e9(spark, d):
    # Every chunk is an anchor of its own name, so the stored rows are the answer.
    return t.adjacency(spark, d).select(F.col("anchor").alias("anchor_key"), "chunk_id", "relation", "place")


#: Every chunk as a seed: a query for each base and 120 documents in turn, so queries grow with
#: the table and each has few seeds, as retrieval would hand over.
_QID = "concat_ws(':', tenant_id, kb_id, CAST(floor(doc_id / 120) AS BIGINT))"
_SEEDS = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id * 31 % 101, doc_id) AS rank FROM (SELECT {_QID} AS query_id, chunk_id, kb_id, doc_id FROM {_C}))"


def first_seeds(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    rows = (anchors(spark, d) if chunks is None else chunks.withColumn("anchor_key", F.col("chunk_id"))).withColumn("query_id", F.expr(_QID))
    return rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY doc_id * 31 % 101, doc_id)"))


@query("e10_graph_injection")
def e10(spark, d):
    return graph.inject(first_seeds(spark, d), related(spark, d))


@query("e10_graph_injection_capped")
def e10_capped(spark, d):
    chunks = stored(graph.with_same(t.graph(spark, d)[0]).drop("reference_texts", "link"), "same")
    return graph.inject(first_seeds(spark, d, chunks), related(spark, d, chunks), cap=10)


_INJ = f"(SELECT s.query_id, s.kb_id, s.rank, s.chunk_id AS anchor_chunk_id, e.chunk_id, e.relation, e.p FROM {_SEEDS} s JOIN {_E9} e ON e.anchor_key = s.chunk_id WHERE s.rank <= 10)"


def _plain_injection(spark, d):
    rows = first_seeds(spark, d).filter("rank <= 10").select("query_id", "rank", "anchor_key")
    found = rows.join(related(spark, d), "anchor_key")
    return found.select("query_id", "kb_id", "rank", F.col("anchor_key").alias("anchor_chunk_id"), "chunk_id", "relation")


@query("e11_merge_injected", f"SELECT query_id, kb_id, chunk_id, 'seed' AS origin FROM {_SEEDS} UNION ALL SELECT i.query_id, i.kb_id, i.chunk_id, 'graph' FROM {_INJ} i LEFT JOIN {_SEEDS} s ON s.query_id = i.query_id AND s.kb_id = i.kb_id AND s.chunk_id = i.chunk_id WHERE s.chunk_id IS NULL")
def e11(spark, d):
    return graph.merge_injected(first_seeds(spark, d), _plain_injection(spark, d))


@query("e12_graph_quota", f"""WITH i AS (SELECT i.* FROM {_INJ} i LEFT JOIN {_SEEDS} s ON s.query_id = i.query_id AND s.kb_id = i.kb_id AND s.chunk_id = i.chunk_id WHERE s.chunk_id IS NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id, anchor_chunk_id ORDER BY rank, p, kb_id, chunk_id) AS k FROM i),
q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, p, kb_id, chunk_id) AS z FROM a WHERE k = 1),
n AS (SELECT query_id, count(*) AS taken FROM q WHERE z <= 4 GROUP BY query_id),
d AS (SELECT s.* FROM {_SEEDS} s LEFT JOIN n ON n.query_id = s.query_id WHERE s.rank <= 20 - coalesce(taken, 0)),
l AS (SELECT query_id, max(rank) AS last FROM d GROUP BY query_id)
SELECT query_id, kb_id, chunk_id, rank, 'seed' AS origin FROM d UNION ALL SELECT q.query_id, q.kb_id, q.chunk_id, coalesce(last, 0) + z, 'graph' FROM q LEFT JOIN l ON l.query_id = q.query_id WHERE z <= 4""")
def e12(spark, d):
    return graph.graph_quota(first_seeds(spark, d), _plain_injection(spark, d), 20).select("query_id", "kb_id", "chunk_id", "rank", "origin")


@query("e13_context_expansion")
def e13(spark, d):
    chunks = graph.with_trimmed(t.graph(spark, d)[0])
    rows = chunks.withColumn("anchor_key", F.col("chunk_id")).filter("index_version <> 'v1'").select("anchor_key", "chunk_id", "title", "heading_path", "content", "trimmed", "chars")
    found = graph.expand_context(rows, related(spark, d, graph.short_texts(chunks)))
    return found.select("chunk_id", "context", F.array_join("context_ids", ",").alias("context_ids"), "supplements", "duplicates")


@query("e15_context_counters")
def e15(spark, d):
    chunks = stored(graph.with_trimmed(t.graph(spark, d)[0]).drop("content", "reference_texts", "link"), "trimmed")
    rows = first_seeds(spark, d, chunks).filter("index_version <> 'v1'").select("query_id", "anchor_key", "chunk_id", "title", "heading_path", "trimmed", "chars")
    return graph.context_counters(graph.choose_supplements(rows, related(spark, d, chunks)))
