"""Evaluation over tables of cases, runs, scores and traces."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import increase, strip

QUALITY = ["context_recall", "context_precision"]
#: Fixed value: names of keys whose values are secret.
SECRET = r"api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token"
REDACTED = "[REDACTED]"


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def prepare_cases(cases: DataFrame, default_kb: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases with a ground truth, ids ``case_<n>`` where missing (n counts all cases of the
    dataset from 1), and how many were left out."""
    full = strip(F.coalesce("ground_truth", F.lit(""))) != ""
    rows = cases.withColumns({"id": F.coalesce(F.nullif(strip(F.col("id")), F.lit("")), F.concat(F.lit("case_"), F.col("pos") + 1)), "kb_id": F.coalesce("kb_id", F.lit(default_kb))})
    return rows.filter(full), cases.agg(F.count_if(~full).alias("skipped"))


def dataset_violations(cases: DataFrame, aliases: DataFrame, suites: DataFrame, kinds: list[str]) -> DataFrame:
    """(rule, location) over cases (id, question, case_type, kb_alias, suite)."""
    rule = lambda rows, name: rows.select(F.lit(name).alias("rule"), F.coalesce("id", F.lit("?")).alias("location"))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    parts = [
        rule(cases.filter(blank("id") | blank("question")), "required_text"),
        rule(cases.filter(~F.coalesce("id", F.lit("")).rlike("^[A-Za-z0-9_-]+$")), "id_pattern"),
        rule(cases.filter(~F.coalesce(F.col("case_type").isin(kinds), F.lit(False))), "case_type"),
        rule(cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_id"),
        rule(cases.join(aliases.select("kb_alias"), "kb_alias", "left_anti"), "unknown_kb_alias"),
        rule(cases.join(suites.select("suite"), "suite", "left_anti"), "unknown_suite"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def suite_counts(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Case types of a suite whose number differs from the wanted one (case_type, wanted)."""
    have = cases.groupBy("case_type").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(have, "case_type", "full_outer").fillna(0, ["n", "wanted"]).filter("n <> wanted")


def normalize_contexts(contexts: DataFrame) -> DataFrame:
    """A case's contexts with their used text, without blank and repeated ones, ranked anew."""
    text = F.when((F.col("index_version") != "v1") & (strip(F.coalesce("expanded", F.lit(""))) != ""), F.col("expanded")).otherwise(F.col("content"))
    rows = contexts.withColumn("text", strip(F.coalesce(text, F.lit("")))).filter("text <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "text").orderBy("rank"))).filter("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")))


def config_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """I8: (case_id, setting, expected, actual) where they differ; a null expected version is free."""
    rows = expected.join(actual, ["case_id", "setting"], "full_outer")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("actual")) & ~((F.col("setting") == "index_version") & F.col("expected").isNull()))


def degradations(metadata: DataFrame, stages: list[str]) -> DataFrame:
    """A row per stage of a case that was degraded, with its reason."""
    items = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_degraded").alias("degraded"), F.col(f"{s}_error").alias("reason")) for s in stages])
    return metadata.select("case_id", F.explode(items).alias("x")).filter("x.degraded").select("case_id", "x.stage", "x.reason")


def group_metrics(rows: DataFrame) -> DataFrame:
    """Per group counts, mean quality with coverage, latency and model calls.

    Warm-up rows never count; failed ones only as failures. Percentiles are exact and linear.
    """
    formal = rows.filter(~F.coalesce("warmup", F.lit(False)))
    ok = F.col("error").isNull()
    used = lambda c: F.when(ok, finite(F.col(c).cast("double")))
    quality = [f(used(m)).alias(f"{m}{suffix}") for m in QUALITY for f, suffix in ((F.avg, ""), (F.count, "_coverage"))]
    latency, calls = used("latency_ms"), used("application_model_calls")
    return formal.groupBy("group").agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(ok).alias("successful_cases"), F.count_if(~ok).alias("failed_cases"), *quality,
        F.count(latency).alias("latency_count"), F.avg(latency).alias("mean_latency_ms"), F.percentile(latency, 0.5).alias("p50_latency_ms"), F.percentile(latency, 0.95).alias("p95_latency_ms"), F.max(latency).alias("max_latency_ms"),
        F.count(calls).alias("calls_count"), F.avg(calls).alias("mean_calls"), F.count_if(ok & (F.size("mismatches") > 0)).alias("mismatched"), F.count_if(ok & (F.size("degraded") > 0)).alias("degraded"),
    )


def compare(metrics: DataFrame, primary: str = "context_recall", least: float = 0.02, guard: str = "context_precision", guard_least: float = -0.02, p95_most: float = 0.3, calls_most: float = 1.0, failed_most: int = 0) -> DataFrame:
    """Candidate against baseline, per experiment: deltas, checks and the verdict."""
    numbers = [c for c in metrics.columns if c not in ("experiment", "group")]
    side = lambda g: metrics.filter(F.col("group") == g).select("experiment", *[F.col(c).alias(f"{g[0]}_{c}") for c in numbers])
    rows = side("baseline").join(side("candidate"), "experiment")
    delta = lambda c: F.col(f"c_{c}") - F.col(f"b_{c}")
    rows = rows.withColumns({"recall_delta": delta("context_recall"), "precision_delta": delta("context_precision"), "p95_ratio": increase(F.col("c_p95_latency_ms"), F.col("b_p95_latency_ms")), "calls_delta": delta("mean_calls")})
    whole = F.col("c_case_count") == F.col("b_case_count")
    for g in "bc":
        whole = whole & (F.col(f"{g}_failed_cases") <= failed_most) & (F.col(f"{g}_mismatched") == 0) & (F.col(f"{g}_degraded") == 0)
        for c in ("context_recall_coverage", "context_precision_coverage", "latency_count", "calls_count"):
            whole = whole & (F.col(f"{g}_{c}") == F.col(f"{g}_successful_cases"))
    own, other = (F.col(f"{m.removeprefix('context_')}_delta") for m in (primary, guard))
    worse = (own <= -least) if least > 0 else (own < 0)
    checks = {
        "complete": whole,
        "primary_negative": F.coalesce(worse, F.lit(False)),
        "guard_passed": F.coalesce(other >= guard_least, F.lit(False)),
        "primary_passed": F.coalesce(own >= least, F.lit(False)),
        "positive": F.coalesce(own > 0, F.lit(False)) | F.coalesce(other > 0, F.lit(False)),
        "cost_passed": F.coalesce(F.col("p95_ratio") <= p95_most, F.lit(False)) & F.coalesce(F.col("calls_delta") <= calls_most, F.lit(False)),
    }
    rows = rows.withColumns(checks)
    verdict = F.when(~F.col("complete"), "evaluation_failed").when(F.col("primary_negative") | ~F.col("guard_passed"), "negative").when(~F.col("primary_passed") | ~F.col("positive"), "no_clear_benefit").when(~F.col("cost_passed"), "effective_high_cost").otherwise("effective")
    return rows.select("experiment", "recall_delta", "precision_delta", "p95_ratio", "calls_delta", *checks, verdict.alias("verdict"))


def evidence_diagnostics(rows: DataFrame) -> DataFrame:
    """Per group means, traceability and tokens of evidence runs."""
    total = F.sum("verified_total")
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("case_count"), F.avg("evidence_count").alias("mean_count"), F.avg("evidence_chars").alias("mean_chars"), total.alias("total_items"), F.sum("verified").alias("verified_items"),
        F.try_divide(F.sum("verified"), total).alias("rate"), F.sum("input_tokens").alias("input_tokens"), F.avg("input_tokens").alias("mean_input_tokens"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """How often each value of a column, or of its arrays, occurs in a group."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    return rows.select("group", value.alias("value")).filter("value IS NOT NULL AND value <> ''").groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))


def feedback_cases(scores: DataFrame, traces: DataFrame, most: float = 3.0, name: str = "user_feedback", since: str | None = None, kb_id: str | None = None) -> DataFrame:
    """Low scores with their trace as cases to label; ids ``lf_`` and 12 characters of
    the trace, with _2, _3, ... where they collide (in order of pos)."""
    low = scores.filter((F.col("name") == name) & (F.col("value") < most) & F.col("trace_id").isNotNull())
    if since is not None:
        low = low.filter(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    rows = low.join(traces, "trace_id").filter(strip(F.coalesce("query", F.lit(""))) != "")
    has = F.size(F.coalesce("kb_ids", F.array().cast("array<string>"))) > 0
    if kb_id is not None:
        rows = rows.filter(~has | F.array_contains("kb_ids", kb_id)).withColumn("kb_ids", F.when(has, F.col("kb_ids")).otherwise(F.array(F.lit(kb_id))))
    else:
        rows = rows.filter(has)
    base = F.concat(F.lit("lf_"), F.substring("trace_id", 1, 12))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("pos"))
    rows = rows.withColumn("_base", base).withColumn("_n", n)
    return rows.select(F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), "_n")).alias("id"), strip(F.col("query")).alias("question"), "kb_ids", "trace_id", "value", "comment", "log_id")


def merge_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """By trimmed question; a ground truth is never overwritten, an old id stays, source
    maps are merged (the new one wins)."""
    key = lambda d: d.withColumn("_q", strip(F.col("question")))
    a, b = key(existing).alias("a"), key(new).alias("b")
    rows = a.join(b, F.col("a._q") == F.col("b._q"), "full_outer")
    keep = F.col("a._q").isNotNull() & (F.col("b._q").isNull() | (strip(F.coalesce("a.ground_truth", F.lit(""))) != ""))
    source = F.when(F.col("a.source").isNotNull() & F.col("b.source").isNotNull(), F.map_concat(F.map_filter("a.source", lambda k, _: ~F.map_contains_key(F.col("b.source"), k)), "b.source")).otherwise(F.coalesce("b.source", "a.source"))
    return rows.select(
        F.coalesce("a.id", "b.id").alias("id"), F.when(keep, F.col("a.question")).otherwise(F.col("b.question")).alias("question"),
        F.coalesce("a.ground_truth", F.lit("")).alias("ground_truth"), F.when(keep, F.col("a.source")).otherwise(source).alias("source"),
    )


def dataset_scope(cases: DataFrame) -> DataFrame:
    """I16: per dataset the one base that all cases have as their only one, else blank."""
    single = F.size("kb_ids") == 1
    kb = F.when(single, F.element_at("kb_ids", 1))
    return cases.groupBy("dataset").agg(F.when(F.bool_and(single) & (F.countDistinct(kb) == 1), F.max(kb)).otherwise("").alias("kb_id"))


def slice_quality(cases: DataFrame, column: str, least: int = 3) -> DataFrame:
    """Quality by case type or by tag, for values of at least ``least`` cases."""
    value = F.explode(column) if cases.schema[column].dataType.typeName() == "array" else F.col(column)
    rows = cases.select(value.alias("value"), *QUALITY).filter("value IS NOT NULL AND value <> ''")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *[F.avg(finite(F.col(m))).alias(m) for m in QUALITY]).filter(F.col("n") >= least)


def case_changes(baseline: DataFrame, candidate: DataFrame, metric: str = "context_recall", n: int = 3) -> DataFrame:
    """The n most improved and n most regressed cases."""
    rows = baseline.select("case_id", F.col(metric).alias("before")).join(candidate.select("case_id", F.col(metric).alias("after")), "case_id").withColumn("delta", F.col("after") - F.col("before")).filter("delta IS NOT NULL")
    up = rows.filter("delta > 0").orderBy(F.desc("delta"), "case_id").limit(n).withColumn("change", F.lit("improved"))
    down = rows.filter("delta < 0").orderBy("delta", "case_id").limit(n).withColumn("change", F.lit("regressed"))
    return up.unionByName(down)


def ndcg(contexts: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """nDCG with binary relevance: a context's document and heading hold an expected one."""
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\.md$", ""))
    wanted = cases.select("case_id", F.transform("expected_documents", bare).alias("docs"), F.transform("expected_headings", lambda h: F.lower(h)).alias("heads")).filter("size(docs) > 0 OR size(heads) > 0")
    rows = wanted.join(contexts.filter(F.col("rank") <= k), "case_id", "left").withColumns({"d": bare(F.col("document")), "h": F.lower(F.coalesce("heading", F.lit("")))})
    gain = ((F.size("docs") == 0) | F.exists("docs", lambda x: F.col("d").contains(x))) & ((F.size("heads") == 0) | F.exists("heads", lambda x: F.col("h").contains(x)))
    ideal_n = F.least(F.lit(k), F.greatest(F.size("docs"), F.size("heads"), F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1), ideal_n), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = rows.withColumns({"gain": F.when(gain & F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0), "ideal": ideal})
    return rows.groupBy("case_id").agg((F.sum("gain") / F.first("ideal")).alias("ndcg"))


def low_recall(rows: DataFrame, most: float = 0.5) -> DataFrame:
    """Cases of low recall, with the group's averages beside them."""
    means = rows.groupBy("group").agg(*[F.avg(finite(F.col(m))).alias(f"mean_{m}") for m in QUALITY])
    return rows.filter(F.col("context_recall") <= most).select("group", "case_id", "context_recall").join(means, "group")


def pending_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Successful cases that lack a score of some metric."""
    whole = scores.filter(" AND ".join(f"{m} IS NOT NULL" for m in QUALITY)).select("case_id")
    return rows.filter("error IS NULL").join(whole, "case_id", "left_anti")


def resume_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores over old ones."""
    n = new.select("case_id", *[F.col(m).alias(f"_{m}") for m in QUALITY], F.lit(True).alias("_new"))
    rows = old.join(n, "case_id", "full_outer")
    return rows.select("case_id", *[F.when(F.col("_new"), F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in QUALITY])


def diff_paths(left: DataFrame, right: DataFrame, declared: DataFrame) -> DataFrame:
    """Settings (run_id, path, value) that differ, against the declared ones (run_id, path):
    ``undeclared`` differences and ``unused`` declarations."""
    rows = left.select("run_id", "path", F.col("value").alias("l"), F.lit(1).alias("hl")).join(right.select("run_id", "path", F.col("value").alias("r"), F.lit(1).alias("hr")), ["run_id", "path"], "full_outer")
    differ = rows.filter(~F.col("l").eqNullSafe(F.col("r")) | ~F.col("hl").eqNullSafe(F.col("hr"))).select("run_id", "path")
    said = declared.select("run_id", "path")
    return differ.exceptAll(said).withColumn("problem", F.lit("undeclared")).unionByName(said.exceptAll(differ).withColumn("problem", F.lit("unused")))


def flatten_settings(settings: DataFrame, schema: str) -> DataFrame:
    """JSON settings as (run_id, path, value) for the leaves of a struct schema."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    def leaves(kind, path):
        for f in kind.fields:
            here = [*path, f.name]
            yield from leaves(f.dataType, here) if isinstance(f.dataType, StructType) else [here]

    kind = _parse_datatype_string(schema)
    rows = settings.select("run_id", F.from_json("settings", kind).alias("s"))
    items = [F.struct(F.lit(".".join(p)).alias("path"), F.col("s." + ".".join(p)).cast("string").alias("value")) for p in leaves(kind, [])]
    return rows.select("run_id", F.explode(F.array(*items)).alias("x")).select("run_id", "x.*")


def fingerprints(candidates: DataFrame) -> DataFrame:
    """SHA-256 of a case's candidates in canonical JSON (ordered by position)."""
    item = F.struct("pos", "chunk_id", "content")
    return candidates.groupBy("group", "case_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(item))), 256).alias("fingerprint"))


def manifest(rows: DataFrame) -> DataFrame:
    """Rows, failures and different configurations of each group."""
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.countDistinct("config").alias("configs"))


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    secret = re.compile(SECRET, re.IGNORECASE)

    def clean(value):
        todo = [value]  # containers still to be cleaned, in place: depth costs no stack
        while todo:
            inner = todo.pop()
            for key, item in list(inner.items() if isinstance(inner, dict) else enumerate(inner)):
                if isinstance(inner, dict) and secret.search(key):
                    inner[key] = REDACTED
                elif isinstance(item, (dict, list)):
                    todo.append(item)
        return value

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return REDACTED if secret.search(text) else text
        return json.dumps(clean(value), ensure_ascii=False) if isinstance(value, (dict, list)) else text

    return texts.map(one)


def redact(text: Column) -> Column:
    """JSON text in which the values of secret-named keys are replaced, at any depth.

    Other text stays as it is; what is no JSON but names a secret is replaced as a whole.
    """
    return _redacted(text)


def context_scores(contexts: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """Deterministic recall and precision: expected documents that were found, and the mean
    over relevant ranks of the share of relevant contexts up to there. Not a judge's score."""
    wanted = cases.select("case_id", "expected_documents")
    rows = contexts.filter(F.col("rank") <= k).join(wanted, "case_id")
    hit = F.exists("expected_documents", lambda x: x == F.col("document"))
    upto = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hit", hit).withColumn("p", F.sum(F.col("hit").cast("int")).over(upto) / F.col("rank"))
    found = rows.groupBy("case_id").agg(F.avg(F.when(F.col("hit"), F.col("p"))).alias("precision"), F.collect_set(F.when(F.col("hit"), F.col("document"))).alias("found"))
    out = wanted.join(found, "case_id", "left")
    return out.select("case_id", F.coalesce(F.size("found"), F.lit(0)).alias("n"), F.try_divide(F.coalesce(F.size("found"), F.lit(0)), F.size("expected_documents")).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))
