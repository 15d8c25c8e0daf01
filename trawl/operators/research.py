"""Fusion over several queries of one run, and evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import folded, normal_query, squeeze

KEY = ["kb_id", "index_version", "chunk_id"]
# Limits of a run, of an evidence pool and of a pack.
CANDIDATES = 24
POOL, TOP, CONTEXT, BASE = 20, 10, 4, 6
ITEMS, PACK_CHARS, ASPECT_CHARS, BLOCK_CHARS, ANSWER_CHARS = 8, 12_000, 100, 1000, 4000
# What ends a run, the strongest first.
STOPS = {"timeout": 7, "budget": 6, "degraded": 5, "complete": 4, "duplicate": 3, "no_new_chunks": 2, "max_rounds": 1}


def task_candidates(hits: DataFrame, contexts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """H1: a task's candidates: each hit, then its context rows, then the snapshot, each chunk once.

    ``hits`` and ``snapshot`` have pos; ``contexts`` has the hit's pos and its own place.
    """
    cols = ["task_id", *KEY, "document_id", "content"]
    rows = hits.filter("document_id IS NOT NULL").select(*cols, F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("place")).alias("at"), F.col("source"))
    rows = rows.unionByName(contexts.filter("relation <> 'anchor'").select(*cols, F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), F.col("place").cast("long").alias("place")).alias("at"), F.concat(F.lit("context:"), "relation").alias("source")))
    rows = rows.unionByName(snapshot.filter("document_id IS NOT NULL").select(*cols, F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("place")).alias("at"), F.col("source")))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", *KEY).orderBy("at"))).filter("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("at"))).drop("_n", "at")


def _canonical(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    rows = candidates.join(tasks.filter("error IS NULL").select("run_id", "task_id", "task_no", "aspect_ids"), "task_id")
    rows = rows.withColumns({"norm": folded(F.col("content")), "at": F.struct("task_no", "rank"), "own": F.struct(*KEY)})
    first = Window.partitionBy("run_id", "kb_id", "index_version", "norm").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("key", F.when(F.col("norm") == "", F.col("own")).otherwise(F.first("own").over(first)))


def merge_tasks(tasks: DataFrame, candidates: DataFrame, k: int = 60) -> DataFrame:
    """H2: candidates of all tasks of a run by reciprocal rank; equal texts of one base count as
    one, a task adds to a chunk's score once, and what it came from is kept in order."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = _canonical(tasks, candidates)
    per_task = rows.groupBy("run_id", "key", "task_id", "task_no").agg(F.min("rank").alias("rank"), F.min("at").alias("at"), F.first("aspect_ids").alias("aspect_ids"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "task_id", "aspect_ids")))
    merged = per_task.groupBy("run_id", "key").agg(F.sort_array(F.collect_list(F.struct("task_no", "rank"))).alias("shares"), F.min("rank").alias("best_rank"), F.min("at").alias("at"), in_order.alias("x"))
    score = F.aggregate("shares", F.lit(0.0), lambda s, x: s + 1.0 / (k + x["rank"]))
    return merged.select("run_id", "key", F.col("key.*"), score.alias("score"), "best_rank", "at", F.transform("x", lambda y: y.task_id).alias("task_ids"), F.array_distinct(F.flatten(F.transform("x", lambda y: y.aspect_ids))).alias("aspect_ids"))


def select_candidates(tasks: DataFrame, candidates: DataFrame, k: int = 60, most: int = CANDIDATES) -> DataFrame:
    """H3: the best of each aspect, two slots for each aspect, then what serves several aspects,
    then the best scores; at most ``most`` of a run, numbered C1, C2, ..."""
    merged = merge_tasks(tasks, candidates, k)
    rows = _canonical(tasks, candidates).select("run_id", "key", "at", "rank", F.posexplode("aspect_ids").alias("no", "aspect"))
    aspects = rows.groupBy("run_id", "aspect").agg(F.min(F.struct("at", "no")).alias("seen"))
    slots = rows.withColumn("slot", F.row_number().over(Window.partitionBy("run_id", "aspect").orderBy("rank", "key", "at")) - 1).filter("slot < 2").join(aspects, ["run_id", "aspect"])
    place = lambda phase, a, b, c: F.struct(F.lit(phase).alias("phase"), a.cast("double").alias("a"), b.alias("b"), c.cast("double").alias("c"))
    zero = F.lit(0.0)
    none = F.lit(None).cast(aspects.schema["seen"].dataType)
    by_slot = slots.filter("slot = 0").select("run_id", "key", place(0, zero, F.col("seen"), zero).alias("p")).unionByName(slots.select("run_id", "key", place(1, F.col("slot"), F.col("seen"), zero).alias("p")))
    shared = merged.filter(F.size("aspect_ids") > 1).select("run_id", "key", F.struct(F.lit(2).alias("phase"), (-F.size("aspect_ids")).cast("double").alias("a"), none.alias("b"), (-F.col("score")).alias("c")).alias("p"))
    rest = merged.select("run_id", "key", F.struct(F.lit(3).alias("phase"), (-F.col("score")).alias("a"), none.alias("b"), zero.alias("c")).alias("p"))
    best = by_slot.unionByName(shared).unionByName(rest).groupBy("run_id", "key").agg(F.min("p").alias("p"))
    order = Window.partitionBy("run_id").orderBy("p.phase", "p.a", "p.b", "p.c", "at")
    out = best.join(merged, ["run_id", "key"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return out.select("run_id", *KEY, "score", "best_rank", "task_ids", "aspect_ids", "place", F.concat(F.lit("C"), "place").alias("candidate_id"))


_ITEM = "struct<pos:bigint,chunk_id:string,text:string,source:string>"


def _fold(items: Column, start: Column, most: Column | None = None) -> Column:
    """Takes items that are new by id and by text, in order, up to ``most`` and the pool's size."""

    def step(s: Column, x: Column) -> Column:
        twin = F.array_contains(s.ids, x.chunk_id) | ((x.text != "") & F.array_contains(s.texts, x.text))
        take = ~twin & (s.n < (F.lit(1 << 30) if most is None else most)) & (F.size(s.out) < s.room)
        return F.struct(
            F.when(take, F.concat(s.ids, F.array(x.chunk_id))).otherwise(s.ids).alias("ids"),
            F.when(take & (x.text != ""), F.concat(s.texts, F.array(x.text))).otherwise(s.texts).alias("texts"),
            F.when(take, F.concat(s.out, F.array(x))).otherwise(s.out).alias("out"),
            F.when(take, s.n + 1).otherwise(s.n).alias("n"), s.room.alias("room"),
        )

    return F.aggregate(items, start, step, lambda s: F.struct(s.ids.alias("ids"), s.texts.alias("texts"), s.out.alias("out"), F.lit(0).alias("n"), s.room.alias("room")))


def _empty(room: int) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("ids"), none.alias("texts"), F.array().cast(f"array<{_ITEM}>").alias("out"), F.lit(0).alias("n"), F.lit(room).alias("room"))


def evidence_pool(rows: DataFrame) -> DataFrame:
    """H4: at most 20 candidates of a query: 10 top, 4 context and 6 base ones, then refilled.

    ``rows`` has query_id, part (top, context, base), pos, chunk_id, content and source; a base
    row that is a top row is left out. A row that was taken before does not use up a slot.
    """
    tops = rows.filter("part = 'top'").select("query_id", "chunk_id").distinct().withColumn("_top", F.lit(True))
    rows = rows.join(tops, ["query_id", "chunk_id"], "left").filter("part <> 'base' OR _top IS NULL")
    # A repeated id and text is never taken twice, so only its first row goes into the arrays.
    first = F.min(F.struct(F.col("pos").cast("long").alias("pos"), F.col("source"))).alias("x")
    rows = rows.groupBy("query_id", "part", "chunk_id", squeeze(F.col("content")).alias("text")).agg(first)
    item = F.struct(F.col("x.pos").alias("pos"), F.col("chunk_id"), F.col("text"), F.col("x.source").alias("source"))
    lists = rows.groupBy("query_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, item))).cast(f"array<{_ITEM}>").alias(p) for p in ("top", "context", "base")])
    lists = lists.select("query_id", *[_fold(F.col(p), _empty(1 << 30)).out.alias(p) for p in ("top", "context", "base")])
    state = _empty(POOL)
    for part, most in (("top", TOP), ("context", CONTEXT), ("base", BASE), ("top", None), ("context", None), ("base", None)):
        state = _fold(F.col(part), state, None if most is None else F.lit(most))
    return lists.select("query_id", F.posexplode(state.out).alias("idx", "x")).select("query_id", "idx", "x.chunk_id", "x.source")


def selection_problems(selections: DataFrame, pools: DataFrame, items: int = ITEMS) -> DataFrame:
    """H5: (query_id, rule) over (query_id, aspect_no, aspect, idx, role); idx is null for an
    aspect without evidence; ``pools`` has query_id and n."""
    rows = selections.join(pools.select("query_id", "n"), "query_id", "left").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("query_id", "aspect_no", "idx")))
    twice = F.col("_same") > 1
    text = F.trim(F.coalesce("aspect", F.lit("")))
    rules = F.array(
        F.when((text == "") | (F.length(text) > ASPECT_CHARS), "invalid_aspect"),
        F.when(F.col("idx").isNotNull() & ((F.col("idx") < 0) | (F.col("idx") >= F.coalesce("n", F.lit(0)))), "index_out_of_range"),
        F.when(F.col("idx").isNotNull() & twice, "duplicate_index"),
        F.when(F.col("idx").isNotNull() & ~F.coalesce(F.col("role").isin("core", "supporting"), F.lit(False)), "invalid_role"),
    )
    found = rows.select("query_id", F.explode(F.array_compact(rules)).alias("rule"))
    many = rows.groupBy("query_id").agg(F.countDistinct("idx").alias("k")).filter(F.col("k") > items).select("query_id", F.lit("too_many_items").alias("rule"))
    return found.unionByName(many).distinct()


def pack_items(selected: DataFrame, chunks: DataFrame, budget: int = PACK_CHARS) -> DataFrame:
    """H6: selected chunks (query_id, place, chunk keys) with their stored text, in order, as
    evidence E1, E2, ...; one that does not fit the character budget is passed over."""
    rows = selected.join(chunks.select("tenant_id", *KEY, "content"), ["tenant_id", *KEY])
    item = F.struct(F.col("place").cast("long").alias("place"), F.col("chunk_id"), F.length(F.coalesce("content", F.lit(""))).alias("n"))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<place:bigint,chunk_id:string,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s.used + x.n <= budget
        return F.struct(F.when(fits, s.used + x.n).otherwise(s.used).alias("used"), F.when(fits, F.concat(s.out, F.array(x))).otherwise(s.out).alias("out"))

    out = lists.select("query_id", F.posexplode(F.aggregate("items", start, step, lambda s: s.out)).alias("no", "x"))
    return out.select("query_id", "x.place", "x.chunk_id", F.col("x.n").alias("chars"), F.concat(F.lit("E"), F.col("no") + 1).alias("evidence_id"))


def missing_chunks(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """H6: selected chunks that the store does not have in their scope."""
    return selected.join(chunks, ["tenant_id", *KEY], "left_anti")


def pack_status(aspects: DataFrame, references: DataFrame) -> DataFrame:
    """H6, H7: per query covered and missing aspects and the status over all planned aspects
    (query_id, aspect_no, aspect); ``references`` are (query_id, aspect_no, role) that fit."""
    core = references.groupBy("query_id", "aspect_no").agg(F.max((F.col("role") == "core").cast("int")).alias("core"))
    rows = aspects.join(core, ["query_id", "aspect_no"], "left").withColumn("covered", F.coalesce("core", F.lit(0)) == 1)
    missing = F.transform(F.sort_array(F.collect_list(F.when(~F.col("covered"), F.struct("aspect_no", "aspect")))), lambda a: a.aspect)
    out = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("aspects"), F.count_if("covered").alias("covered"), missing.alias("missing"))
    return out.withColumn("status", F.when(F.col("covered") == F.col("aspects"), "complete").when(F.col("covered") == 0, "missing").otherwise("partial"))


def plan_problems(aspects: DataFrame, queries: DataFrame) -> DataFrame:
    """H8: (run_id, rule): repeated aspects or queries, indexes out of range, uncovered aspects.

    ``aspects`` has (run_id, aspect_no from 0, aspect), ``queries`` (run_id, query, aspect_nos).
    """
    repeated = lambda rows, column, rule: rows.groupBy("run_id", column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id", F.lit(rule).alias("rule"))
    used = queries.select("run_id", F.explode("aspect_nos").alias("aspect_no"))
    known = aspects.select("run_id", "aspect_no")
    parts = [
        repeated(aspects.withColumn("a", squeeze(F.col("aspect"))), "a", "duplicate_aspect"),
        repeated(queries.withColumn("q", normal_query(F.col("query"))), "q", "duplicate_query"),
        used.join(known, ["run_id", "aspect_no"], "left_anti").select("run_id", F.lit("aspect_out_of_range").alias("rule")),
        known.join(used, ["run_id", "aspect_no"], "left_anti").select("run_id", F.lit("uncovered_aspect").alias("rule")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def next_queries(proposed: DataFrame, visited: DataFrame, missing: DataFrame) -> DataFrame:
    """H9: proposals (run_id, pos, query, aspect_ids) that are new in normal form and aim only at
    missing aspects (run_id, aspect_ids)."""
    rows = proposed.withColumn("norm", normal_query(F.col("query"))).filter("norm <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "norm").orderBy("pos"))).filter("_n = 1").drop("_n")
    rows = rows.join(visited.select("run_id", normal_query(F.col("query")).alias("norm")), ["run_id", "norm"], "left_anti")
    rows = rows.join(missing.select("run_id", F.col("aspect_ids").alias("_m")), "run_id")
    return rows.filter((F.size("aspect_ids") > 0) & (F.size(F.array_except("aspect_ids", "_m")) == 0)).drop("norm", "_m")


def new_chunk_counts(tasks: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """How many chunks each task, in order, brought that no earlier one had."""
    rows = candidates.join(tasks.select("run_id", "task_id", "task_no"), "task_id")
    first = rows.groupBy("run_id", *KEY).agg(F.min_by("task_id", "task_no").alias("task_id")).join(existing.select("run_id", *KEY), ["run_id", *KEY], "left_anti")
    counts = first.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("n"))
    return tasks.select("run_id", "task_id").join(counts, ["run_id", "task_id"], "left").fillna(0, ["n"])


def citation_rate(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence items whose document, title and text equal the stored chunk's."""
    stored = chunks.select(*KEY, F.col("document_id").alias("_d"), F.col("title").alias("_t"), F.col("content").alias("_c"), F.lit(True).alias("_found"))
    same = F.coalesce(F.col("_found") & F.col("document_id").eqNullSafe(F.col("_d")) & F.col("title").eqNullSafe(F.col("_t")) & F.col("content").eqNullSafe(F.col("_c")), F.lit(False))
    rows = items.join(stored, KEY, "left").withColumn("ok", same)
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("verified"), F.avg(F.col("ok").cast("double")).alias("rate"))


def render_answers(blocks: DataFrame) -> DataFrame:
    """Blocks (query_id, no, text, evidence_ids) as text with their citations."""
    cited = F.concat("text", F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), ""))
    rows = blocks.withColumn("line", cited)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x.line), "\n\n").alias("answer"))


def answer_problems(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, rule) over blocks (query_id, no, text, supported, evidence_idx)."""
    rows = blocks.join(evidence.select("query_id", F.col("idx").alias("_known")), "query_id", "left")
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    idx = F.coalesce("evidence_idx", F.array().cast("array<int>"))
    rules = F.array(
        F.when(~n.between(1, BLOCK_CHARS), "block_length"),
        F.when(F.size(F.array_distinct(idx)) < F.size(idx), "duplicate_evidence"),
        F.when(F.size(F.array_except(idx, F.coalesce("_known", F.array().cast("array<int>")))) > 0, "unknown_evidence"),
        F.when(F.col("supported") & (F.size(idx) == 0), "unsupported_claim"),
        F.when(~F.col("supported") & (F.size(idx) > 0), "insufficient_with_evidence"),
    )
    found = rows.select("query_id", F.explode(F.array_compact(rules)).alias("rule"))
    total = rows.groupBy("query_id").agg(F.sum(n).alias("n")).filter(F.col("n") > ANSWER_CHARS).select("query_id", F.lit("answer_length").alias("rule"))
    return found.unionByName(total).distinct()


def stop_reasons(conditions: DataFrame) -> DataFrame:
    """The strongest of the conditions (run_id, reason) that were met."""
    strength = F.element_at(F.create_map(*[F.lit(v) for kv in STOPS.items() for v in kv]), F.col("reason"))
    return conditions.groupBy("run_id").agg(F.max_by("reason", strength).alias("reason"))
