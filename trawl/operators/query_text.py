"""Query text: synonyms, rewrites, normal form and validation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import full_lines, let, normal_query, strip

__all__ = ["clean_rewrite", "expand_synonyms", "normal_query", "pipeline", "request_query_problem", "search_query_problem", "settings_violations"]

# What a search query may not hold.
UNSAFE = r"(?i)(?:https?://|\b(?:select|insert|update|delete|drop|alter)\b|(?:^|\s)(?:curl|wget|powershell|cmd|bash|sh)(?:\s|$)|(?:调用|使用).{0,8}(?:浏览器|工具|shell|终端))"


class Synonyms:
    """The synonym groups of one base as an automaton: a query's matching groups come from one
    walk over its text, however many terms there are."""

    def __init__(self, groups: list[dict]):
        import ahocorasick

        self.expand = []
        by_term: dict[str, list[int]] = {}
        for group in groups:
            terms, expand = group["terms"], group["expand"]
            if terms is None or expand is None:
                continue
            for term in {t.strip().casefold() for t in terms if t is not None} - {""}:
                by_term.setdefault(term, []).append(len(self.expand))
            self.expand.append([x.strip() for x in expand if x is not None and x.strip()])
        self.automaton = ahocorasick.Automaton()
        for term, numbers in by_term.items():
            self.automaton.add_word(term, numbers)
        if by_term:
            self.automaton.make_automaton()
        self.empty = not by_term

    def added(self, query: str | None) -> tuple[bool, list[str]]:
        """Whether a group matches, and the expansions of all that do, in order of groups and
        without repeats."""
        if query is None or self.empty:
            return False, []
        hit = sorted({n for _, numbers in self.automaton.iter(query.casefold()) for n in numbers})
        first: dict[str, str] = {}
        for n in hit:
            for value in self.expand[n]:
                first.setdefault(value.casefold(), value)
        return bool(hit), list(first.values())


#: Automata that a worker keeps.
KEPT = 64


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Synonyms] = {}
    for batch in batches:
        base, ids, texts, groups = batch.columns
        applied, added = [], []
        for i, (kb, text) in enumerate(zip(base.to_pylist(), texts.to_pylist(), strict=True)):
            if kb not in kept:
                if len(kept) >= KEPT:
                    kept.pop(next(iter(kept)))
                kept[kb] = Synonyms(groups[i].as_py())
            found = kept[kb].added(text)
            applied.append(found[0])
            added.append(found[1])
        yield pa.RecordBatch.from_arrays([ids, pa.array(applied, pa.bool_()), pa.array(added, pa.list_(pa.string()))], names=["query_id", "applied", "added"])


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """G1: adds the expansions of each matching synonym group (kb_id, pos, terms, expand), in
    order and without repeats, to the query text.

    Terms are stripped and compared without case anywhere in the query; blank terms match
    nothing, blank expansions add nothing. ``applied`` tells whether a group matched. A base's
    groups are its settings, so few enough to travel with its queries.
    """
    groups = synonyms.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("pos", "terms", "expand"))).alias("groups"))
    rows = queries.select("kb_id", F.col("query_id"), "query_text").join(groups, "kb_id").sortWithinPartitions("kb_id")
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("applied", T.BooleanType()), T.StructField("added", T.ArrayType(T.StringType()))])
    found = rows.mapInArrow(_expand, kind)
    out = queries.join(found, "query_id", "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    return out.withColumn("search_text", F.when(F.size("added") > 0, F.concat_ws(" ", "query_text", "added")).otherwise(F.col("query_text")))


def settings_violations(settings: DataFrame) -> DataFrame:
    """(kb_id, rule) for synonym settings (JSON text) that are not lists of non-blank text."""
    parsed = settings.select("kb_id", F.posexplode_outer(F.from_json("settings", "synonyms array<struct<terms:array<string>,expand:array<string>>>").synonyms).alias("pos", "g"))
    rules = [F.when(F.col(f"g.{k}").isNull() | (F.size(f"g.{k}") == 0) | F.exists(f"g.{k}", lambda x: x.isNull() | (strip(x) == "")), k) for k in ("terms", "expand")]
    return parsed.filter("pos IS NOT NULL").select("kb_id", "pos", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


#: Keys under which a model may give its rewrite, in order.
REWRITE_KEYS = ["query", "rewritten_query", "text", "content", "rewrite"]
#: Objects inside each other's text that are unwrapped.
NESTED = 3


def _unfenced(text: Column) -> Column:
    """Stripped, and without a code fence around it and the word json behind its mark."""
    inner = strip(F.substring(text, F.lit(4), F.length(text) - 6))
    inner = F.when(F.lower(F.substring(inner, 1, 4)) == "json", strip(F.substring(inner, F.lit(5), F.length(inner)))).otherwise(inner)
    return F.when((F.length(text) >= 6) & text.startswith("```") & text.endswith("```"), inner).otherwise(text)


def _unwrapped(text: Column, depth: int) -> Column:
    def opened(bare: Column) -> Column:
        value = F.try_parse_json(bare)
        kind = F.schema_of_variant(value)
        held = lambda key: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))
        found = F.coalesce(*map(held, REWRITE_KEYS), F.lit(""))
        return F.when(kind.startswith("OBJECT"), _unwrapped(found, depth - 1) if depth else found).when(kind == "STRING", strip(F.try_variant_get(value, "$", "string"))).otherwise(bare)

    return let(_unfenced(strip(text)), opened)


def clean_rewrite(output: Column, cut: int = 30) -> Column:
    """A model's answer out of its fence, JSON object (the first text under one of
    ``REWRITE_KEYS``; an object with none gives nothing) or JSON string: its first line that is
    not blank, cut to 30 characters; null where nothing is left."""
    first = lambda x: F.coalesce(F.when(x.contains("\n"), F.try_element_at(full_lines(x), F.lit(1))).otherwise(x), F.lit(""))
    return F.nullif(F.substring(let(_unwrapped(output, NESTED), first), 1, cut), F.lit(""))


def pipeline(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Raw, effective (rewritten if there is a usable rewrite) and whether it was rewritten."""
    rows = queries.join(rewrites.select("query_id", "output"), "query_id", "left")
    clean = clean_rewrite(F.col("output"))
    return rows.select(*[F.col(c) for c in queries.columns], F.col("query_text").alias("raw"), F.coalesce(clean, "query_text").alias("effective"), clean.isNotNull().alias("rewritten"))


def search_query_problem(text: Column) -> Column:
    """``length`` unless 1 to 300 characters, ``unsafe`` for commands, SQL and links."""
    q = strip(F.coalesce(text, F.lit("")))
    return F.when((q == "") | (F.length(q) > 300), "length").when(q.rlike(UNSAFE), "unsafe")


def request_query_problem(text: Column, most: int = 2000) -> Column:
    """``blank`` or ``too_long``."""
    q = strip(F.coalesce(text, F.lit("")))
    return F.when(q == "", "blank").when(F.length(q) > most, "too_long")
