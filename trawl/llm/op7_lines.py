"""Line dedup with levelled sorted runs of line hashes.

One scan of the texts stores each document's line hashes. Documents then arrive in batches. A
batch counts in how many of its documents each hash occurs, anti-joins the run of hashes that
are already known as frequent, and adds what is left as a sorted run of level 0. Whenever
``FANOUT`` runs of a level stand, they are compacted into one run of the next level; hashes
that reach ``min_docs`` there move to the frequent run. A last compaction over all levels
leaves the frequent hashes, and each document loses its lines that have one of them.

Everything is DataFrame functions. Hashes are two XXH64 values of different seeds (128 bits).

Defined cases: null or empty text is one empty line, which stays; a key of fewer than
``min_chars`` code points is never dropped; each row is a document of its own, with repeated
or null doc_id too (a row's hits are those of its id and text, so equal rows lose equal lines);
texts and lines of any length are hashed whole; an empty table gives no rows; other columns of
any name pass through unchanged, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import LOWER, UPPER, keyed, stored, table

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
_H = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(keys: Column, min_chars: int) -> Column:
    """A struct of two hashes for each key, null for keys that are too short to count."""
    hashed = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, hashed(k)))


def hashed_documents(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """A row per document: _id, _th, batch, all line hashes, and the distinct ones if fewer."""
    rows = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("_id", "_th", F.pmod(F.xxhash64("_th", "_id"), F.lit(batches)).alias("batch"), F.transform(lines_of(F.col("row.text")), line_key).alias("keys"))
    rows = rows.withColumn("distinct_keys", F.array_distinct("keys"))
    some = F.when(F.size("distinct_keys") < F.size("keys"), _hashes(F.col("distinct_keys"), min_chars))
    return rows.select("_id", "_th", "batch", _hashes(F.col("keys"), min_chars).alias("hs"), some.alias("ds"))


class Levels:
    """Sorted runs of (h1, h2, n) by level, and the run of hashes that are frequent."""

    def __init__(self, min_docs: int, fanout: int):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: dict[int, list[DataFrame]] = {}
        self.frequent: list[DataFrame] = []

    def add(self, counts: DataFrame) -> None:
        for run in self.frequent:
            counts = counts.join(run.hint("merge"), _H, "left_anti")
        self.levels.setdefault(0, []).append(stored(counts.sortWithinPartitions(_H), "run-0"))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._compact(self.levels.pop(level), level + 1)
            level += 1

    def _compact(self, runs: list[DataFrame], level: int) -> None:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        merged = merged.groupBy(_H).agg(F.sum("n").alias("n"))
        whole = stored(merged.sortWithinPartitions(_H), f"run-{level}")
        self.frequent.append(whole.filter(F.col("n") >= self.min_docs).select(_H))
        self.levels.setdefault(level, []).append(whole.filter(F.col("n") < self.min_docs))

    def close(self) -> DataFrame:
        runs = [run for level in sorted(self.levels) for run in self.levels[level]]
        if len(runs) > 1 or not self.frequent:
            self.levels = {}
            self._compact(runs, 99)
        out = self.frequent[0]
        for run in self.frequent[1:]:
            out = out.unionByName(run)
        return out


def frequent_hashes(hashed: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    levels = Levels(min_docs, fanout)
    for b in range(batches):
        lines = hashed.filter(F.col("batch") == b).select(F.explode(F.coalesce("ds", "hs")).alias("h")).filter("h IS NOT NULL")
        levels.add(lines.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n")))
    return levels.close()


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` replaced by the kept lines, and n_lines and n_dropped added."""
    hashed = stored(hashed_documents(docs, min_chars, batches), "line-hashes", ("batch",))
    frequent = frequent_hashes(hashed, min_docs, batches, fanout)
    lines = hashed.select("_id", "_th", F.posexplode("hs").alias("pos", "h")).filter("h IS NOT NULL").select("_id", "_th", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    # Lines that a document repeats are stored in few bytes, by which Spark would size them.
    hits = lines.hint("merge").join(frequent, _H).groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("_pos"))
    rows = keyed(docs).join(hits, ["_id", "_th"], "left").withColumn("_lines", lines_of(F.col("row.text")))
    # The kept stretches between dropped positions; _lines is used twice, so it is split once.
    cuts = F.zip_with(F.concat(F.array(F.lit(-1)), "_pos"), F.concat("_pos", F.array(F.size("_lines"))), lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n")))
    kept = F.flatten(F.transform(F.filter(cuts, lambda g: g.n > 0), lambda g: F.slice(F.col("_lines"), g.at, g.n)))
    text = F.when(F.col("_pos").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_pos"), F.lit(0)).cast("long")}
    others = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return rows.select(*others, *[v.alias(k) for k, v in counts.items()])


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT k.r, k.pos, k.line, f.key IS NOT NULL AS hit FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g ON d.r = g.r
"""
