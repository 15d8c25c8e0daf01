"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's target
divided by its size. Documents are put in order within their source, the expected copies are
summed up along that order, one random offset per source is added, and a document is emitted
once for each integer that its stretch of the sum crosses. The order goes by size class (an
eighth of a power of two), so every stretch of the sum meets all sizes in turn and the words
taken stay near the target. A source is cut into cells of one size class and one salt, cells
are numbered from their counts, and rows are numbered within their cell: no window holds more
than a cell, however large its source is.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of
all sizes; none goes above twice its own size, and the excess is shared again by weight. That
is min(cap, level * weight) with one level for all, found from running sums over the sources.

Defined cases: null text has size 0; a source whose documents all have size 0 has target 0
and emits none of them; a null source is a source of its own; rows with equal doc_id are
sampled each on its own; sizes are of whole texts; ties of size go by doc_id (null first),
then by a hash of the text; an empty table gives no rows; other columns of any name pass
through, and rows that differ in these alone take their copies in order of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import SPACES, attach, keyed, n_words, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 0
SALT_DIGITS = 4  # hex digits: up to 65,536 cells of a source and size class
STRETCH = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    sources = sources.withColumn("most", F.col("source_size") * cap)
    # Ascending by the level at which a source reaches its cap.
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    sources = sources.withColumns(
        {
            "level": F.col("most") / F.col("w"),
            "below": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "above": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "budget": F.sum("source_size").over(all_rows) * share,
        }
    )
    sources = sources.withColumn("full", F.col("below") + F.col("level") * F.col("above") <= F.col("budget"))
    held = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(all_rows)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_rows)
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("budget") - held) / open_w * F.col("w"))
    return sources.select("source", "source_size", target.alias("target"))


def copies_of(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, _id, _th, source, size, source_size, target, copies.

    Rows alike in all that matters here are one row with a count until they are placed, so
    neither a repeated document nor a null id makes a large window.
    """
    rows = keyed(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))).select("_id", "_th", "row.*")
    name = F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.md5(F.coalesce("text", F.lit(""))))
    salt = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), name)), 1, SALT_DIGITS), 16, 10).cast("int")
    small = rows.select("doc_id", "_id", "_th", "source", n_words(F.col("text")).alias("size"), salt.alias("_salt"))
    kinds = small.groupBy(small.columns).agg(F.count(F.lit(1)).alias("n"))
    binary = F.bin(F.col("size") + 8)
    kinds = stored(kinds.withColumns({"_class": F.length(binary) * 8 + F.conv(F.substring(binary, 2, 3), 2, 10).cast("int"), "_s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))}), "sizes")
    targets = source_targets(kinds.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    cells = kinds.groupBy("_s", "_class", "_salt").agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_class", F.coalesce(F.sum("n").over(earlier("_s", "_class", "_salt")), F.lit(0)))
    classes = cells.groupBy("_s", "_class").agg(F.sum("n").alias("m"))
    classes = classes.select("_s", "_class", F.coalesce(F.sum("m").over(earlier("_s", "_class")), F.lit(0)).alias("in_source"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_s"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    bases = cells.join(classes, ["_s", "_class"]).join(targets, "_s").select("_s", "_class", "_salt", (F.col("in_class") + F.col("in_source")).alias("base"), "source_size", "target", rate.alias("rate"), offset.alias("u"))
    within = Window.partitionBy("_s", "_class", "_salt").orderBy("size", "doc_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).hint("merge").join(bases, ["_s", "_class", "_salt"])
    # Rows alike, in stretches of STRETCH: no array holds more.
    placed = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
    placed = placed.withColumn("_row", F.explode(F.sequence(F.col("_from"), F.least(F.col("n"), F.col("_from") + STRETCH) - 1)))
    rank = F.col("base") + F.col("before") + F.col("_row")
    crossed = F.floor((rank + 1) * F.col("rate") + F.col("u")) - F.floor(rank * F.col("rate") + F.col("u"))
    return placed.select("doc_id", "_id", "_th", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    chosen = stored(copies_of(docs, **options).filter("copies > 0").select("_id", "_th", "copies"), "copies")
    return attach(docs, chosen).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_of(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^{SPACES}]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most FROM s),
v AS (SELECT *, most / w AS level,
        coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
        (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM w),
f AS (SELECT *, below + level * above <= budget AS is_full FROM v),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE
        (budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () * w END AS target FROM f),
o AS (SELECT d.*, t.source_size, t.target, length(bin(size + 8)) * 8 + ('0b' || substr(bin(size + 8), 2, 3))::INT AS class,
        ('0x' || substr(md5('{SEED}' || coalesce(':' || doc_id, md5(coalesce(text, '')))), 1, {SALT_DIGITS}))::INT AS salt,
        ('0x' || substr(md5('{SEED}/' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        (row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id) - 1)::BIGINT AS k FROM o)
SELECT doc_id, size, source_size, target, (size * (floor((k + 1) * rate + u) - floor(k * rate + u)))::BIGINT AS taken FROM r
"""
