"""BM25 keyword search over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import let
from trawl.operators.vector import ranked
from trawl.sources.shared import stored

K1, B = 1.2, 0.75
_CJK = "㐀-鿿"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; CJK runs give their bigrams (or the one sign)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}&&[^{_CJK}]]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{_CJK}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(words, pairs)


def counted(values: Column) -> Column:
    """The distinct values of an array, in order, each with its count: (value, n). A row's values
    are counted where the row is, so nothing is shuffled."""
    none = lambda x: F.filter(F.transform(x, lambda v: F.struct(v.alias("value"), F.lit(0).alias("n"))), lambda _: F.lit(False))

    def runs(x: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1))
        run = lambda at: F.transform(at, lambda a, j: F.struct(F.get(x, a).alias("value"), (F.coalesce(F.get(at, j + 1), F.size(x)) - a).alias("n")))
        return F.when(F.size(x) == 0, none(x)).otherwise(let(F.filter(F.sequence(F.lit(0), F.size(x) - 1), first), run))

    return let(F.sort_array(values), runs)


_CHUNK = ["kb_id", "index_version", "chunk_id"]


def _fields(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row for each chunk and named field, with its tokens ``t``; texts are read once."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), tokens(F.col(column)).alias("t")) for name, column in fields.items()])
    return chunks.select(*_CHUNK, F.explode(each).alias("x")).select(*_CHUNK, "x.field", "x.t").filter(F.size("t") > 0)


def postings(chunks: DataFrame, terms: DataFrame | None = None, **fields: str) -> DataFrame:
    """(kb_id, index_version, chunk_id, field, term, tf, dl) for the named text fields.

    With ``terms`` (term) only postings of these are given: what a search without a stored index
    needs.
    """
    rows = _fields(chunks, fields).select(*_CHUNK, "field", F.size("t").alias("dl"), F.explode(counted(F.col("t"))).alias("x"))
    rows = rows.select(*_CHUNK, "field", F.col("x.value").alias("term"), "dl", F.col("x.n").cast("long").alias("tf"))
    return rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi").select(rows.columns)


def statistics(chunks: DataFrame, by_base: bool = False, **fields: str) -> DataFrame:
    """What BM25 must know of the whole index, (field, n, avgdl), in one pass over the chunks;
    ``by_base`` gives (kb_id, index_version, field, n, total), which is stored beside the
    postings and summed up by ``whole_index``."""
    rows = _fields(chunks, fields).groupBy("kb_id", "index_version", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("total"))
    return rows if by_base else whole_index(rows)


def whole_index(by_base: DataFrame) -> DataFrame:
    """(field, n, avgdl) from statistics by base."""
    return by_base.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))


def _best(hits: DataFrame, k: int, boosts: dict[str, float] | None) -> DataFrame:
    """The k best chunks of each query, from shares of scores (query_id, chunk, field, part)."""
    by_field = hits.groupBy("query_id", *_CHUNK, "field").agg(F.sum("part").alias("part"))
    weight = F.lit(1.0)
    for field, boost in (boosts or {}).items():
        weight = F.when(F.col("field") == field, boost).otherwise(weight)
    best = by_field.groupBy("query_id", *_CHUNK).agg(F.max(weight * F.col("part")).alias("score"))
    best = best.withColumn("score", F.round("score", 9))  # equal terms in another order are a tie
    return ranked(best, k, F.desc("score"), F.asc("kb_id"), F.asc("chunk_id"))


def bm25_top_k(queries: DataFrame, scope: DataFrame, index: DataFrame, k: int, boosts: dict[str, float] | None = None, fields: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query (query_id, query_text) within its scope.

    Statistics are those of the whole index, not of the scope (``fields`` are the stored ones,
    else they are derived from the postings); a chunk's score is that of its best field after
    boosts; ties go to the smaller kb_id and chunk_id. A query's terms meet its bases first, so
    a posting is joined only with the queries that ask for its term in its base.
    """
    if k < 1:
        return queries.select("query_id").filter("false").crossJoin(index.select(*_CHUNK).limit(0)).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    terms = query_terms(queries)
    if fields is None:
        fields = index.select(*_CHUNK, "field", "dl").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    own = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # One row per field and query term: a bounded build side.
    stats = df.join(fields, "field").select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    wanted = scope.select("query_id", "kb_id", "index_version").distinct().join(terms, "query_id").join(stats, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = own.join(wanted, ["kb_id", "index_version", "field", "term"]).select("query_id", *_CHUNK, "field", part.alias("part"))
    return _best(hits, k, boosts)


@dataclass
class TextIndex:
    """A6, stored: ``rows`` (kb_id, index_version, chunk_id, field, dl, terms: each value and its
    n), one for a chunk and field, and ``fields`` (kb_id, index_version, field, n, total)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def write_rows(chunks: DataFrame, path: str, **fields: str) -> TextIndex:
    """Writes the index of the named text fields of ``chunks`` under ``path``. Each text is cut
    and counted where it is read; nothing is shuffled but sums by base."""
    _fields(chunks, fields).select(*_CHUNK, "field", F.size("t").alias("dl"), counted(F.col("t")).alias("terms")).write.parquet(f"{path}/rows")
    index = TextIndex(chunks.sparkSession, path)
    sums = index.table("rows").groupBy("kb_id", "index_version", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    sums.write.parquet(f"{path}/fields")
    return index


def stored_top_k(queries: DataFrame, scope: DataFrame, index: TextIndex, k: int, boosts: dict[str, float] | None = None) -> DataFrame:
    """As ``bm25_top_k``, from the stored index, itself stored.

    What the queries ask for (a row for a query, base, field and term) is written first, so Spark
    knows that it is small and brings it to the chunks: of postings only those asked for are
    counted, and a chunk leaves its task as one score for a query and field.
    """
    posted = index.table("rows").select(*_CHUNK, "field", "dl", F.explode("terms").alias("x")).select(*_CHUNK, "field", "dl", F.col("x.value").alias("term"), F.col("x.n").alias("tf"))
    terms = stored(query_terms(queries), "terms")
    df = posted.join(terms.select("term").distinct(), "term", "left_semi").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = df.join(whole_index(index.table("fields")), "field").select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    wanted = stored(scope.select("query_id", "kb_id", "index_version").distinct().join(terms, "query_id").join(stats, "term"), "wanted")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = posted.join(wanted, ["kb_id", "index_version", "field", "term"]).select("query_id", *_CHUNK, "field", part.alias("part"))
    return stored(_best(hits, k, boosts), "hits")
