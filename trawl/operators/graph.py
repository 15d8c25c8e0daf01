"""Chunk graph: references, relations, injection and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import LINK, MARKERS, QUOTED_TITLE, REFERENCES_LABEL, HEADING_LABEL, SECTION_MARK, TITLE_LABEL, full_lines, has_marker, low_information, squeeze, strip, strip_long
from trawl.sources.shared import stored

SCOPE = ["tenant_id", "kb_id", "index_version"]
# Order of relations, and limits of the walk and the context.
PRIORITY = {"reference": 0, "parent_section": 1, "previous": 2, "next": 3}
SEEDS, PER_SEED, TOTAL = 10, 3, 30
SUPPLEMENTS, CONTEXT_CHARS = 3, 4096


def extract_references(content: Column) -> Column:
    """Lines that quote a document title, hold a link or a section marker, distinct."""
    hits = F.filter(full_lines(content), lambda x: x.rlike(QUOTED_TITLE) | x.rlike(LINK) | (x.rlike(SECTION_MARK) & x.rlike(MARKERS)))
    found = F.array_distinct(F.transform(hits, lambda x: F.regexp_replace(x, r"^[> ]+", "")))
    # Each of the patterns has fixed characters: text without all of them is not cut into lines.
    some = content.contains("《") | content.contains("](") | has_marker(content)
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def _bare_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(strip(title), r"(?i)\.(md|markdown)$", ""))


def parse_reference(text: Column) -> Column:
    """(title, heading) of a reference; a link goes before a title, a title before a section."""
    file = F.regexp_extract(F.replace(F.regexp_extract(text, LINK, 1), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    link = F.struct(F.regexp_replace(file, r"(?i)\.(md|markdown)$", "").alias("title"), F.nullif(F.regexp_extract(text, LINK, 2), F.lit("")).alias("heading"))
    quoted = F.struct(strip(F.regexp_extract(text, QUOTED_TITLE, 1)).alias("title"), F.nullif(F.regexp_replace(F.regexp_extract(text, QUOTED_TITLE, 2), r'^[ "“”‘’章节]+|[ "“”‘’章节]+$', ""), F.lit("")).alias("heading"))
    section = F.struct(F.lit(None).cast("string").alias("title"), F.nullif(strip(F.regexp_extract(text, SECTION_MARK, 1)), F.lit("")).alias("heading"))
    return F.when(text.rlike(LINK), link).when(text.rlike(QUOTED_TITLE), quoted).otherwise(section)


def _own_references() -> Column:
    return F.when(F.size(F.coalesce("reference_texts", F.array().cast("array<string>"))) > 0, F.col("reference_texts")).otherwise(extract_references(F.col("content")))


def references(chunks: DataFrame) -> DataFrame:
    """A row per reference of a chunk: its own list, or what its content says where that is empty.

    ``t`` and ``h`` are the target's title and heading in lower case, empty where there is none.
    """
    rows = chunks.select(*SCOPE, F.col("chunk_id").alias("source_chunk_id"), F.posexplode(_own_references()).alias("pos", "reference_text"))
    return rows.withColumn("target", parse_reference(F.col("reference_text"))).select("*", F.coalesce(_bare_title(F.col("target.title")), F.lit("")).alias("t"), F.coalesce(F.lower(strip(F.col("target.heading"))), F.lit("")).alias("h")).drop("target")


def match_targets(refs: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """How many candidate chunks each reference has, and the least of them.

    References are matched once per distinct (title, heading). With a title the join is an equi
    join; a bare heading is looked up among the suffixes of heading paths, an equi join too.
    """
    titled = documents.filter("status = 1").select("document_id", _bare_title(F.col("title")).alias("t"))
    rows = chunks.join(titled, "document_id").select(*SCOPE, "document_id", "chunk_id", "section_id", "order_index", "t", F.lower(F.coalesce("heading_path", F.lit(""))).alias("path"))
    place = [F.col("order_index").asc_nulls_last(), F.col("chunk_id")]
    heads = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*SCOPE, "document_id", "section_id").orderBy(*place))).filter("_n = 1").drop("_n")
    firsts = rows.groupBy(*SCOPE, "t").agg(F.countDistinct("document_id").alias("docs"), F.min(F.struct(F.col("order_index").isNull().alias("last"), "order_index", "chunk_id")).alias("x")).filter("docs = 1").select(*SCOPE, "t", F.col("x.chunk_id").alias("chunk_id"))
    wanted = refs.select(*SCOPE, "t", "h").distinct()
    has_t, has_h = F.col("t") != "", F.col("h") != ""
    one = wanted.filter(has_t & ~has_h).join(firsts, [*SCOPE, "t"])
    many = wanted.filter(has_t & ~has_h).join(firsts.select(*SCOPE, "t"), [*SCOPE, "t"], "left_anti").join(heads.select(*SCOPE, "t", "chunk_id"), [*SCOPE, "t"])
    # The first chunk of a section whose path ends with the heading; all its chunks share the path.
    both = wanted.filter(has_t & has_h).join(heads.select(*SCOPE, "t", "path", "chunk_id"), [*SCOPE, "t"]).filter(F.col("path").endswith(F.col("h")))
    # A bare heading meets only the ends of paths that are as long as some wanted heading of its
    # scope: a path gives as many keys as there are such lengths.
    bare = wanted.filter(~has_t & has_h)
    sizes = bare.select(*SCOPE, F.length("h").alias("size")).groupBy(SCOPE).agg(F.collect_set("size").alias("sizes"))
    ends = heads.join(sizes, SCOPE).select(*SCOPE, "chunk_id", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    only_h = bare.join(ends.select(*SCOPE, "chunk_id", F.expr("right(path, size)").alias("h")), [*SCOPE, "h"])
    cols = [*SCOPE, "t", "h", "chunk_id"]
    out = one.select(cols)
    for part in (many, both, only_h):
        out = out.unionByName(part.select(cols))
    found = out.groupBy(*SCOPE, "t", "h").agg(F.count(F.lit(1)).alias("candidates"), F.min("chunk_id").alias("target_chunk_id"))
    # A reference that names nothing has all heads of its scope as candidates: only counted.
    free = wanted.filter(~has_t & ~has_h).join(heads.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("candidates"), F.min("chunk_id").alias("target_chunk_id")), SCOPE)
    return found.unionByName(free.select(found.columns))


def resolve_references(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each reference with the number of its candidates and one of them."""
    # Texts are read where they lie: only chunks that refer to something travel, without content.
    said = chunks.select(*SCOPE, "chunk_id", "document_id", _own_references().alias("reference_texts"), F.lit(None).cast("string").alias("content")).filter(F.size("reference_texts") > 0)
    # Found once: both the search for targets and the result read them.
    refs = stored(references(said.join(documents.filter("status = 1").select("document_id"), "document_id", "left_semi")), "references")
    key = [*SCOPE, "t", "h"]
    found = match_targets(refs, chunks, documents)
    return refs.join(found, key, "left").select(*refs.columns, F.coalesce("candidates", F.lit(0)).alias("candidates"), "target_chunk_id")


def build_relations(resolved: DataFrame) -> DataFrame:
    """Edges of references with exactly one candidate that is not the source, once each."""
    edges = resolved.filter("candidates = 1 AND source_chunk_id <> target_chunk_id")
    first = Window.partitionBy(*SCOPE, "source_chunk_id", "target_chunk_id").orderBy("pos")
    return edges.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*SCOPE, "source_chunk_id", "target_chunk_id", F.lit("reference").alias("relation_type"), "reference_text")


def unresolved_references(resolved: DataFrame) -> DataFrame:
    """E5: distinct references without exactly one other candidate, and how many they have."""
    return resolved.filter("candidates <> 1 OR source_chunk_id = target_chunk_id").select(*SCOPE, "source_chunk_id", "reference_text", F.col("candidates").alias("candidate_count")).distinct()


def _neighbour(anchors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = anchors.select("anchor_key", *SCOPE, F.col("document_id").alias("a_doc"), F.col("chunk_id").alias("a_chunk"), F.col("section_id").alias("a_section"), F.col("parent_section_id").alias("a_parent"), F.col("order_index").alias("a_order"), F.col("chunk_type").alias("a_type"))
    c = chunks.select(*SCOPE, "document_id", "chunk_id", "section_id", "order_index", "content", "title", "heading_path", "chunk_type")
    return a, c


def reference_neighbours(anchors: DataFrame, chunks: DataFrame, edges: DataFrame, limit: int = PER_SEED) -> DataFrame:
    """Targets of an anchor's reference edges in order of position, at most ``limit``."""
    a, c = _neighbour(anchors, chunks)
    own = a.select("anchor_key", *SCOPE, F.col("a_chunk").alias("source_chunk_id")).join(edges.filter("relation_type = 'reference'").select(*SCOPE, "source_chunk_id", F.col("target_chunk_id").alias("chunk_id")), [*SCOPE, "source_chunk_id"])
    rows = own.drop("source_chunk_id").join(c, [*SCOPE, "chunk_id"])
    order = Window.partitionBy("anchor_key").orderBy(F.col("order_index").asc_nulls_last(), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n").withColumn("relation", F.lit("reference"))


def parents(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """As-of join: the last chunk of the anchor's parent section that lies before the anchor."""
    a, c = _neighbour(anchors, chunks)
    # Sections' chunks and the anchors that ask for them in one order: the last chunk so far is
    # the answer, and contents are joined to it afterwards.
    place = [*SCOPE, "document_id", "section_id"]
    held = c.select(*place, F.col("order_index").alias("at"), F.lit(1).alias("late"), F.lit(None).cast(a.schema["anchor_key"].dataType).alias("anchor_key"), "chunk_id").filter("at IS NOT NULL AND section_id IS NOT NULL")
    asked = a.select(*SCOPE, F.col("a_doc").alias("document_id"), F.col("a_parent").alias("section_id"), F.col("a_order").alias("at"), F.lit(0).alias("late"), "anchor_key", F.lit(None).cast("string").alias("chunk_id")).filter("at IS NOT NULL AND section_id IS NOT NULL")
    order = Window.partitionBy(place).orderBy("at", "late", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(order)).filter("late = 0 AND chunk_id IS NOT NULL")
    best = found.select(*SCOPE, "anchor_key", "chunk_id").join(c, [*SCOPE, "chunk_id"])
    return best.select("anchor_key", *c.columns).withColumn("relation", F.lit("parent_section"))


def section_neighbours(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks just before and after a prose anchor in its section."""
    a, c = _neighbour(anchors, chunks)
    a = a.filter("a_type = 'prose' AND a_section IS NOT NULL").withColumn("step", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("order_index", F.col("a_order") + F.col("step"))
    rows = a.withColumnsRenamed({"a_doc": "document_id", "a_section": "section_id"}).join(c, [*SCOPE, "document_id", "section_id", "order_index"])
    return rows.select("anchor_key", *c.columns, F.when(F.col("step") < 0, "previous").otherwise("next").alias("relation"))


def relations(anchors: DataFrame, chunks: DataFrame, edges: DataFrame, limit: int = PER_SEED) -> DataFrame:
    """All relations of each anchor (anchor_key and a chunk's columns), with ``place``."""
    rows = reference_neighbours(anchors, chunks, edges, limit).unionByName(parents(anchors, chunks)).unionByName(section_neighbours(anchors, chunks))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relation"))
    rows = rows.withColumn("priority", priority)
    order = Window.partitionBy("anchor_key").orderBy("priority", F.col("order_index").asc_nulls_last(), "chunk_id")
    return rows.withColumn("place", F.row_number().over(order))


def adjacency(chunks: DataFrame, edges: DataFrame, limit: int = PER_SEED) -> DataFrame:
    """E9 for every chunk, to be stored with a version: a row for each neighbour of ``anchor``."""
    anchors = chunks.withColumn("anchor_key", F.struct(*SCOPE, "chunk_id", "document_id"))
    rows = relations(anchors, chunks, edges, limit)
    return rows.select(*[F.col(f"anchor_key.{c}").alias(c) for c in SCOPE], F.col("anchor_key.chunk_id").alias("anchor"), F.col("anchor_key.document_id").alias("anchor_document"), "chunk_id", "document_id", "relation", "order_index", "place")


def stored_relations(anchors: DataFrame, chunks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """E9 from a stored ``adjacency``: as ``relations``, by one join to the anchors' neighbours
    and one to these neighbours' rows."""
    a = anchors.select("anchor_key", *SCOPE, F.col("chunk_id").alias("anchor"))
    found = a.join(adjacent.select(*SCOPE, "anchor", "chunk_id", "relation", "place"), [*SCOPE, "anchor"]).drop("anchor")
    own = [x for x in ("content", "same", "poor", "trimmed", "chars") if x in chunks.columns]
    c = chunks.select(*SCOPE, "document_id", "chunk_id", "section_id", "order_index", *own, "title", "heading_path", "chunk_type")
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relation"))
    return found.join(c, [*SCOPE, "chunk_id"]).select("anchor_key", *c.columns, "relation", priority.alias("priority"), "place")


def with_same(chunks: DataFrame) -> DataFrame:
    """What a capped E10 asks of a text, in place of it: ``same``, equal for equal texts, and
    ``poor``. Made where the texts lie, so that none of them has to travel."""
    poor = (F.col("chunk_type") == "reference_pointer") | low_information(F.col("content"))
    return chunks.withColumns({"same": F.sha2(squeeze(F.col("content")), 256), "poor": F.coalesce(poor, F.lit(False))}).drop("content")


def with_trimmed(chunks: DataFrame) -> DataFrame:
    """What E13 asks of a text before it takes it: ``trimmed``, equal for texts that are equal
    but for white space at their ends, and its length ``chars``."""
    content = F.coalesce("content", F.lit(""))
    return chunks.withColumns({"trimmed": F.sha2(strip_long(content), 256), "chars": F.length(content)})


def short_texts(chunks: DataFrame) -> DataFrame:
    """Without the texts that are too long for any context and so can be no supplement."""
    return chunks.withColumn("content", F.when(F.col("chars") <= CONTEXT_CHARS, F.col("content")))


def inject(seeds: DataFrame, related: DataFrame, cap: int | None = None) -> DataFrame:
    """Graph candidates of each query from its first 10 seeds.

    ``seeds`` has query_id, rank, kb_id, chunk_id, index_version, anchor_key and content;
    ``related`` comes from ``relations``. The walk depends on its own history, so each query's
    bounded list (10 seeds of at most 6 relations) is folded in order. With ``cap`` known
    text, pointers and low information are skipped too; without it no text is read. Both may
    have gone through ``with_same``.
    """
    if cap is not None:
        seeds, related = (x if "same" in x.columns else with_same(x if "chunk_type" in x.columns else x.withColumn("chunk_type", F.lit(""))) for x in (seeds, related))
    pair = lambda column: F.concat_ws("\x01", "kb_id", column)
    texts = F.array().cast("array<string>") if cap is None else F.collect_set(pair("same"))
    known = seeds.groupBy("query_id").agg(F.collect_set(pair("chunk_id")).alias("ids"), (F.first(texts) if cap is None else texts).alias("texts"), F.count(F.lit(1)).cast("int").alias("n"))
    walk = seeds.filter((F.col("rank") <= SEEDS) & (F.col("index_version") != "v1")).select("query_id", "rank", "anchor_key", F.col("chunk_id").alias("anchor_chunk_id"))
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("place").cast("int").alias("place"), "anchor_chunk_id", "kb_id", "chunk_id", "relation",
        pair("chunk_id").alias("identity"), *([] if cap is None else [pair("same").alias("text"), F.col("poor")]),
    )
    lists = walk.join(related, "anchor_key").groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out_type = "array<struct<rank:int,place:int,anchor_chunk_id:string,kb_id:string,chunk_id:string,relation:string>>"
    limit = F.greatest(F.lit(0), TOTAL - F.col("n")) if cap is None else F.lit(cap)
    start = F.struct(F.col("ids").alias("ids"), F.col("texts").alias("texts"), F.lit(0).alias("seed"), F.lit(0).alias("own"), F.lit(0).alias("total"), F.array().cast(out_type).alias("out"))

    def step(s: Column, x: Column) -> Column:
        own = F.when(s.seed == x.rank, s.own).otherwise(F.lit(0))
        skip = F.array_contains(s.ids, x.identity)
        if cap is not None:
            skip = skip | F.array_contains(s.texts, x.text) | x.poor
        take = ~skip & (s.total < F.col("most")) & (own < PER_SEED)
        return F.struct(
            F.when(take, F.concat(s.ids, F.array(x.identity))).otherwise(s.ids).alias("ids"),
            (s.texts if cap is None else F.when(take, F.concat(s.texts, F.array(x.text))).otherwise(s.texts)).alias("texts"),
            x.rank.alias("seed"),
            F.when(take, own + 1).otherwise(own).alias("own"),
            F.when(take, s.total + 1).otherwise(s.total).alias("total"),
            F.when(take, F.concat(s.out, F.array(F.struct(x.rank.alias("rank"), x.place.alias("place"), x.anchor_chunk_id.alias("anchor_chunk_id"), x.kb_id.alias("kb_id"), x.chunk_id.alias("chunk_id"), x.relation.alias("relation"))))).otherwise(s.out).alias("out"),
        )

    rows = lists.join(known, "query_id").withColumn("most", limit.cast("int"))
    found = rows.select("query_id", F.posexplode(F.aggregate("items", start, step, lambda s: s.out)).alias("pos", "x"))
    return found.select("query_id", "pos", "x.*")


def merge_injected(seeds: DataFrame, injected: DataFrame) -> DataFrame:
    """Seeds, and injected rows whose chunk is no seed."""
    key = ["query_id", "kb_id", "chunk_id"]
    new = injected.join(seeds.select(key), key, "left_anti")
    return seeds.select(*key, F.lit("seed").alias("origin")).unionByName(new.select(*key, F.lit("graph").alias("origin")))


def graph_quota(seeds: DataFrame, injected: DataFrame, top_k: int) -> DataFrame:
    """Without rerank, up to min(10, top_k // 5) injected rows, one per anchor, replace the
    tail of the direct hits."""
    quota = min(10, top_k // 5)
    key = ["query_id", "kb_id", "chunk_id"]
    direct = seeds.select(*key, "rank")
    if top_k <= 0 or not quota:
        return direct.filter(F.col("rank") <= top_k).withColumn("origin", F.lit("seed"))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relation"))
    rows = injected.join(direct.select(key), key, "left_anti").withColumn("priority", priority)
    order = ["rank", "priority", "kb_id", "chunk_id"]
    rows = rows.withColumn("_a", F.row_number().over(Window.partitionBy("query_id", "kb_id", "anchor_chunk_id").orderBy(*order))).filter("_a = 1")
    rows = rows.withColumn("_q", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_q") <= quota)
    taken = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("taken"))
    kept = direct.join(taken, "query_id", "left").filter(F.col("rank") <= top_k - F.coalesce("taken", F.lit(0)))
    tail = rows.join(kept.groupBy("query_id").agg(F.max("rank").alias("last")), "query_id", "left").select(*key, (F.coalesce("last", F.lit(0)) + F.col("_q")).alias("rank"), F.lit("graph").alias("origin"))
    return kept.select(*key, "rank", F.lit("seed").alias("origin")).unionByName(tail)


def choose_supplements(anchors: DataFrame, related: DataFrame) -> DataFrame:
    """The anchors with ``kept`` (at most 3 distinct supplements whose composed text stays
    within 4096 characters; the first that would not fit ends the list) and ``duplicates``.

    Nothing but equality and length of texts decides, see ``with_trimmed``; ``content`` of the
    supplements comes along where ``related`` has it.
    """
    content = [F.coalesce("content", F.lit("")).alias("content")] if "content" in related.columns else []
    item = F.struct(F.col("place").cast("int").alias("place"), "chunk_id", "relation", "trimmed", "chars", *content)
    lists = related.groupBy("anchor_key").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = anchors.join(lists, "anchor_key", "left")
    none = F.array().cast(lists.schema["items"].dataType)
    start = F.struct(F.array(F.col("chunk_id")).alias("ids"), F.array(F.col("trimmed")).alias("texts"), none.alias("kept"), F.lit(0).alias("duplicates"))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s.kept) >= SUPPLEMENTS
        twin = F.array_contains(s.ids, x.chunk_id) | F.array_contains(s.texts, x.trimmed)
        take = ~full & ~twin
        return F.struct(
            F.when(take, F.concat(s.ids, F.array(x.chunk_id))).otherwise(s.ids).alias("ids"),
            F.when(take, F.concat(s.texts, F.array(x.trimmed))).otherwise(s.texts).alias("texts"),
            F.when(take, F.concat(s.kept, F.array(x))).otherwise(s.kept).alias("kept"),
            F.when(~full & twin, s.duplicates + 1).otherwise(s.duplicates).alias("duplicates"),
        )

    rows = rows.withColumn("_s", F.aggregate(F.coalesce("items", none), start, step)).drop("items")
    # The length of a composed text: each part and each supplement adds itself and a blank line,
    # the last has none after it; the first reference adds its label and a line end.
    line = lambda label, x: F.when(strip(x) != "", len(label) + F.length(strip(x)) + 2).otherwise(0)
    alone = F.coalesce(line(TITLE_LABEL, F.col("title")), F.lit(0)) + F.coalesce(line(HEADING_LABEL, F.col("heading_path")), F.lit(0)) + F.when(F.col("chars") > 0, F.col("chars") + 2).otherwise(0)

    def total(n: int) -> Column:
        some = F.slice(F.col("_s.kept"), 1, n)
        own = F.aggregate(some, F.lit(0), lambda s, x: s + F.when((x.relation == "reference") | (x.chars > 0), x.chars + 2).otherwise(0))
        return alone + own + F.when(F.exists(some, lambda x: x.relation == "reference"), len(REFERENCES_LABEL) + 1).otherwise(0) - 2

    fits = lambda n: (F.size("_s.kept") >= n) & (total(n) <= CONTEXT_CHARS)
    used = F.when(fits(1), F.when(fits(2), F.when(fits(3), 3).otherwise(2)).otherwise(1)).otherwise(0)
    return rows.withColumn("supplements", used).withColumn("kept", F.slice(F.col("_s.kept"), F.lit(1), F.col("supplements"))).withColumn("duplicates", F.col("_s.duplicates")).drop("_s")


def expand_context(anchors: DataFrame, related: DataFrame) -> DataFrame:
    """Each anchor with its supplements in one text, ``context``. Counts per anchor."""
    asked, found = (x if "trimmed" in x.columns else with_trimmed(x) for x in (anchors, related))
    rows = choose_supplements(asked, short_texts(found))
    context = compose_context(F.col("title"), F.col("heading_path"), F.col("content"), F.col("kept"))
    ids = F.concat(F.array("chunk_id"), F.transform("kept", lambda x: x.chunk_id))
    return rows.select(*anchors.columns, context.alias("context"), ids.alias("context_ids"), "supplements", "duplicates")


def compose_context(title: Column, heading_path: Column, content: Column, supplements: Column) -> Column:
    """Title, heading, parents, previous, the anchor, next, then references."""
    part = lambda relation: F.array_join(F.transform(F.filter(supplements, lambda x: (x.relation == relation) & (x.content != "")), lambda x: x.content), "\n\n")
    full = lambda x: F.nullif(x, F.lit(""))
    head = F.when(strip(title) != "", F.concat(F.lit(TITLE_LABEL), strip(title)))
    path = F.when(strip(heading_path) != "", F.concat(F.lit(HEADING_LABEL), strip(heading_path)))
    refs = F.when(F.exists(supplements, lambda x: x.relation == "reference"), F.concat(F.lit(REFERENCES_LABEL + "\n"), F.array_join(F.transform(F.filter(supplements, lambda x: x.relation == "reference"), lambda x: x.content), "\n\n")))
    return F.concat_ws("\n\n", head, path, full(part("parent_section")), full(part("previous")), full(F.coalesce(content, F.lit(""))), full(part("next")), refs)


def context_counters(expanded: DataFrame) -> DataFrame:
    """Expanded anchors, supplements and dropped duplicates of each query."""
    return expanded.groupBy("query_id").agg(F.count_if(F.col("supplements") > 0).alias("expanded"), F.sum("supplements").alias("supplements"), F.sum("duplicates").alias("duplicates"))
