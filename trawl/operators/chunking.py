"""Splitting of documents into chunks.

Plain text goes through windows in Arrow batches. Line structure comes from windows over a document's lines; what depends on its own history
(the character window, packing, coalescing) is a fold over one section's or one document's
units, which are bounded by the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import FENCE, TABLE_LABEL, WHITE, chunk_type, heading_level, heading_title, let, is_blank, lines, low_information, parent_path, pointer_only, reference_texts, section_id, squeeze, strip, strip_long, table_row, table_separator

SIZE, OVERLAP, TABLE_ROWS = 800, 100, 10
_STRINGS = "array<string>"


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap between 0 and size - 1")


def _last_before(text: Column, mark: str, low: Column, high: Column) -> Column:
    """Start (from 0) of the last ``mark`` that lies in text[low:high], or -1."""
    part = F.substring(text, low + 1, high - low)
    return let(F.locate(mark[::-1], F.reverse(part)), lambda at: F.when(at == 0, -1).otherwise(high - at - len(mark) + 1))


def window_pieces(text: Column, size: Column | int = SIZE, overlap: Column | int = OVERLAP) -> Column:
    """B1: character windows cut at the last blank line, line end or space of their upper half.

    ``text`` must be normalised (see ``normal_text``). A piece equal to the one before is
    skipped. One step of the fold is one window.
    """
    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    n = F.length(text)
    least = F.greatest(F.greatest(F.floor(size / 2), F.lit(1)) - overlap, F.lit(1))
    steps = F.greatest((n / least).cast("int") + 2, F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(_STRINGS).alias("out"))

    def cut(s: Column, target: Column) -> Column:
        low = s.at + F.greatest(F.floor(size / 2), F.lit(1)).cast("int")
        high = F.least(target + 1, n)
        best = F.greatest(*[_last_before(text, m, s.at + 1, high) for m in ("\n\n", "\n", " ")])
        return F.when(target < n, let(best, lambda x: F.when(x >= low, x).otherwise(target))).otherwise(target).cast("int")

    def move(s: Column, end: Column, piece: Column) -> Column:
        keep = (piece != "") & ~(piece.eqNullSafe(F.try_element_at(s.out, F.lit(-1))))
        return F.struct(
            F.greatest(end - overlap, s.at + 1).cast("int").alias("at"),
            (end >= n).alias("done"),
            F.when(keep, F.concat(s.out, F.array(piece))).otherwise(s.out).alias("out"),
        )

    def step(s: Column, _: Column) -> Column:
        go = let(cut(s, F.least(s.at + size, n)), lambda end: let(strip(F.substring(text, s.at + 1, end - s.at)), lambda piece: move(s, end, piece)))
        return F.when(s.done, s).otherwise(go)

    folded = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s.out)
    return F.when(text == "", F.array().cast(_STRINGS)).when(n <= size, F.array(text)).otherwise(folded)


def normal_text(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))


def windows(text: str, size: int, overlap: int) -> list[str]:
    """B1 for one text, in time linear in it: a window goes as far as a space or line end within
    its upper half lets it, or its whole size."""
    fit = re.compile(rf"(?s).{{{max(size // 2, 1)},{size}}}(?=[\n ])")
    pieces, at = [], 0
    while at + size < len(text):
        found = fit.match(text, at)
        end = found.end() if found else at + size
        pieces.append(text[at:end].strip())
        at = max(end - overlap, at + 1)
    pieces.append(text[at:].strip())
    return [p for p in pieces if p]


def plain_pieces(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """B1 over a table: ``pieces`` in place of ``content``, the other columns as they are. Equal
    neighbours are one piece. A document stays one row, so nothing has to be shuffled for it."""
    check_sizes(size, overlap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts in a worker's memory together
                part, pieces = batch.slice(at, 256), []
                for text in part.column(part.num_columns - 1).to_pylist():
                    whole = text.replace("\r\n", "\n").replace("\r", "\n").strip() if text else ""
                    pieces.append([p for p, _ in groupby(windows(whole, size, overlap))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pieces, pa.list_(pa.string()))], names=[*part.schema.names[:-1], "pieces"])

    rows = documents.select(*[c for c in documents.columns if c != "content"], F.col("content").cast("string"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("pieces", T.ArrayType(T.StringType()))]))


def split_plain(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """B1 over a table: (document_id, pos, piece). Equal neighbours are one piece."""
    return plain_pieces(documents.select("document_id", "content"), size, overlap).select("document_id", F.posexplode("pieces").alias("pos", "piece"))


def _dealt(documents: DataFrame) -> DataFrame:
    """Documents by id over so many tasks that each holds a small part: what follows keeps a
    task's lines in memory and takes long for few bytes, which Spark, merging small partitions
    by their bytes, cannot know. A given number is kept, and all windows and groups below lie
    within a document, so nothing is shuffled after it."""
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return documents.select("document_id", "content").repartition(tasks, "document_id")


def scan_lines(documents: DataFrame, deepest: int = 6) -> DataFrame:
    """Lines with fence state, section number and heading path.

    Lines of only ``---`` outside fences go; headings to level ``deepest`` outside fences open
    sections; ``path`` holds the titles of the headings that are open.
    """
    rows = documents.filter(~is_blank(F.coalesce("content", F.lit("")))).select("document_id", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    order = Window.partitionBy("document_id").orderBy("pos")
    past, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_fence", F.col("line").rlike(FENCE)).withColumn("level0", heading_level(F.col("line")))
    # A fence mark that would be a heading cannot occur: the patterns exclude each other.
    rows = rows.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(past), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("level", F.when(~F.col("in_fence") & (F.col("level0") <= deepest), F.col("level0")))
    rows = rows.filter(F.col("in_fence") | (strip_long(F.col("line")) != "---")).withColumn("line", F.rtrim(F.col("line"), F.lit(WHITE)))
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    title = heading_title(F.col("line"))
    parts = []
    for k in range(1, deepest + 1):
        last = F.last(F.when(F.col("level") <= k, F.struct(F.col("level").alias("level"), title.alias("title"))), ignorenulls=True).over(upto)
        parts.append(F.when(last.level == k, last.title))
    return rows.withColumn("path", F.array_compact(F.array(*parts))).drop("level0")


def mark_blocks(scanned: DataFrame) -> DataFrame:
    """Table blocks and text units.

    A table is a run of at least two pipe rows outside fences. Elsewhere blank lines end a unit,
    and a fence with what it holds is a unit of its own that is never cut.
    """
    order = Window.partitionBy("document_id", "section").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.lag(c, 1).over(order)
    rows = scanned.withColumn("_row", ~F.col("in_fence") & table_row(F.col("line")))
    rows = rows.withColumn("_run", F.sum((~F.col("_row").eqNullSafe(before("_row"))).cast("int")).over(upto))
    rows = rows.withColumn("is_table", F.col("_row") & (F.count(F.lit(1)).over(Window.partitionBy("document_id", "section", "_run")) >= 2))
    rows = rows.withColumn("atomic", F.col("in_fence") | F.col("is_fence"))
    rows = rows.withColumn("blank", ~F.col("atomic") & is_blank(F.col("line")))
    opens = F.col("is_fence") & ~F.col("in_fence")
    change = before("is_table").isNull() | ~F.col("is_table").eqNullSafe(before("is_table")) | opens | F.col("blank") | (F.col("atomic") != before("atomic"))
    rows = rows.withColumn("unit", F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(upto))
    # A text block is what lies between tables; packing does not reach over a table.
    return rows.withColumn("block", F.sum((~F.col("is_table").eqNullSafe(before("is_table"))).cast("int")).over(upto)).drop("_row", "_run")


def _path_text(path: Column) -> Column:
    return F.nullif(F.array_join(path, "/"), F.lit(""))


def _table_parts(r: Column, size: int, most: int) -> Column:
    """A table's stripped lines as one text if it fits, else groups of data rows under a header line."""
    whole = F.array_join(r, "\n")
    has_rule = table_separator(F.element_at(r, 2))
    data = F.slice(r, F.when(has_rule, 3).otherwise(2), F.size(r))
    header = F.concat(F.lit(TABLE_LABEL), strip(F.regexp_replace(F.element_at(r, 1), r"^\||\|$", "")))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(data) - 1) / most).cast("int")), lambda g: F.concat_ws("\n", header, F.slice(data, g * most + 1, F.lit(most))))
    return F.when((F.length(whole) <= size) | (F.size(data) == 0), F.array(whole)).otherwise(groups)


def _lines_in_order() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line)


def split_tables(blocks: DataFrame, size: int = SIZE, most: int = TABLE_ROWS) -> DataFrame:
    """The pieces of each table."""
    rows = blocks.filter("is_table").groupBy("document_id", "section", "block").agg(F.min("pos").alias("pos"), F.first("path").alias("path"), F.transform(_lines_in_order(), strip).alias("r"))
    return rows.select("document_id", "section", "pos", _path_text(F.col("path")).alias("heading_path"), F.lit("table").alias("kind"), F.posexplode(_table_parts(F.col("r"), size, most)).alias("part", "text"))


def _join(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("\n\n"), b)


def _is_heading(text: Column) -> Column:
    bare = strip(text)
    return ~bare.contains("\n") & heading_title(bare).isNotNull()


def _prefixed(prefix: Column, body: Column, size: int, overlap: int) -> Column:
    """The body in windows that leave room for the prefix, which the first one gets."""
    room = size - F.length(prefix) - 2

    def fit(text: Column) -> Column:
        pieces = window_pieces(text, F.greatest(room, F.lit(1)), F.least(F.lit(overlap), F.greatest(room - 1, F.lit(0))))
        headed = let(pieces, lambda p: F.when(F.size(p) == 0, F.array(prefix)).otherwise(F.concat(F.array(_join(prefix, F.element_at(p, 1))), F.slice(p, F.lit(2), F.size(p)))))
        return F.when(room <= 0, F.concat(F.array(prefix), window_pieces(text, size, overlap))).otherwise(headed)

    return let(strip(body), fit)


def _long(text: Column, size: int, overlap: int) -> Column:
    """A text over the size; a heading of level 1 or 2 on its first line stays in front."""
    head = F.substring_index(text, "\n", 1)
    body = F.substring(text, F.length(head) + 2, F.length(text))
    headed = F.coalesce(heading_level(head) <= 2, F.lit(False))
    whole = headed & (strip(body) == "")
    plain = let(strip(text), lambda x: window_pieces(x, size, overlap))
    return F.when(whole, F.array(text)).when(headed, _prefixed(head, body, size, overlap)).otherwise(plain)


def _packed(units: Column, size: int, overlap: int) -> Column:
    """Greedy packing of a text block's units into chunks of at most ``size`` characters."""
    none = F.array().cast(_STRINGS)
    start = F.struct(F.lit("").alias("now"), none.alias("out"))

    def state(now: Column, out: Column) -> Column:
        return F.struct(now.alias("now"), out.alias("out"))

    def place(s: Column, u: Column, joined: Column) -> Column:
        flushed = F.when(s.now != "", F.concat(s.out, F.array(s.now))).otherwise(s.out)
        fits = F.length(joined) <= size
        solo = F.when(fits, joined).otherwise(u.text)
        kept = F.when(fits | (s.now == ""), s.out).otherwise(flushed)
        atomic = F.when(F.length(solo) > size, state(F.lit(""), F.concat(kept, F.array(solo)))).otherwise(state(solo, kept))
        room = size - F.length(u.text) - 2
        tail = F.when((room > 0) & (F.lit(overlap) > 0), _join(F.substring(s.now, -F.least(F.lit(overlap), room, F.length(s.now)), F.length(s.now)), u.text)).otherwise(u.text)
        return (
            F.when(u.atomic, atomic)
            .when((s.now != "") & ~fits & _is_heading(s.now), state(F.lit(""), F.concat(s.out, _prefixed(s.now, u.text, size, overlap))))
            .when(F.length(u.text) > size, state(F.lit(""), F.concat(flushed, _long(u.text, size, overlap))))
            .when(fits, state(joined, s.out))
            .otherwise(state(tail, flushed))
        )

    def step(s: Column, u: Column) -> Column:
        return let(F.when(s.now == "", u.text).otherwise(_join(s.now, u.text)), lambda joined: place(s, u, joined))

    return F.aggregate(units, start, step, lambda s: F.when(s.now != "", F.concat(s.out, F.array(s.now))).otherwise(s.out))


def block_pieces(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, table_rows: int = TABLE_ROWS) -> DataFrame:
    """The pieces of every block, of tables and of text, from one reading of the lines."""
    units = blocks.filter("NOT blank").groupBy("document_id", "section", "block", "unit").agg(
        F.min("pos").alias("pos"), F.first("path").alias("path"), F.first("atomic").alias("atomic"), F.first("is_table").alias("is_table"), _lines_in_order().alias("lines")
    ).withColumn("text", F.when(~F.col("is_table"), strip(F.array_join("lines", "\n"))))
    # A table is one unit of a block of its own.
    units = units.filter("is_table OR text <> ''").withColumn("lines", F.when(F.col("is_table"), F.transform("lines", strip)))
    rows = units.groupBy("document_id", "section", "block").agg(
        F.min("pos").alias("pos"), F.first("path").alias("path"), F.first("is_table").alias("is_table"), F.first("lines").alias("lines"), F.sort_array(F.collect_list(F.struct("pos", "atomic", "text"))).alias("units")
    )
    parts = F.when(F.col("is_table"), _table_parts(F.col("lines"), size, table_rows)).otherwise(_packed(F.col("units"), size, overlap))
    return rows.select("document_id", "section", "pos", _path_text(F.col("path")).alias("heading_path"), F.when(F.col("is_table"), "table").otherwise("section").alias("kind"), F.posexplode(parts).alias("part", "text"))


def split_structured(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, table_rows: int = TABLE_ROWS, deepest: int = 2) -> DataFrame:
    """Pieces of Markdown text by heading and table, in order (document_id, ord)."""
    check_sizes(size, overlap)
    pieces = block_pieces(mark_blocks(scan_lines(_dealt(documents), deepest)), size, overlap, table_rows)
    order = Window.partitionBy("document_id").orderBy("pos", "part")
    table_part = F.when(F.col("kind") == "table", F.col("part") + 1)
    return pieces.filter(~is_blank(F.col("text"))).select("document_id", (F.row_number().over(order) - 1).alias("ord"), "heading_path", "kind", table_part.alias("table_part"), "text")


def drop_repeated(pieces: DataFrame) -> DataFrame:
    """Without low information, and the first of equal texts of a section."""
    heading = F.regexp_extract(F.coalesce("heading_path", F.lit("")), r"([^/]*)$", 1)
    rows = pieces.filter(~low_information(F.col("text"), heading))
    first = Window.partitionBy("document_id", "heading_path", "_norm").orderBy("ord")
    return rows.withColumn("_norm", squeeze(F.col("text"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_norm")


def coalesce_pieces(pieces: DataFrame, size: int = SIZE, version: str = "v2") -> DataFrame:
    """Neighbours of a section merge while they fit, pointers join what
    stands before them in the section or wait for what comes next."""
    item = F.struct("ord", F.coalesce("heading_path", F.lit("")).alias("path"), "text", pointer_only(F.col("text")).alias("pointer"), chunk_type(F.col("text"), F.col("kind")).alias("type"), F.col("kind").alias("kind"), F.coalesce("table_part", F.lit(0)).alias("table_part"), reference_texts(F.col("text")).alias("refs"))
    rows = drop_repeated(pieces).groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = "struct<path:string,text:string,type:string,table_part:int,refs:array<string>>"
    start = F.struct(F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS)).alias("held"), F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))

    def chunk(path: Column, text: Column, type_: Column, part: Column, refs: Column) -> Column:
        return F.struct(path.alias("path"), text.alias("text"), type_.alias("type"), part.alias("table_part"), refs.alias("refs"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(s.last.path == x.path, F.lit(False))
        waiting = F.try_element_at(s.held, x.path)
        pointed = chunk(s.last.path, _join(s.last.text, x.text), s.last.type, s.last.table_part, F.array_distinct(F.concat(s.last.refs, x.refs)))
        held_text = F.when(waiting.isNull(), x.text).otherwise(_join(waiting, x.text))
        others = F.map_filter(s.held, lambda k, _: k != x.path)
        text = F.when(waiting.isNull(), x.text).otherwise(_join(x.text, waiting))
        fits = same & (F.length(_join(s.last.text, text)) <= size)
        # References and kind are read again from the text that a pointer has been added to.
        refs, type_ = F.when(waiting.isNull(), x.refs).otherwise(reference_texts(text)), F.when(waiting.isNull(), x.type).otherwise(chunk_type(text, x.kind))
        raw = F.when(x.kind == "table", "table").otherwise("section")
        merged = chunk(s.last.path, _join(s.last.text, text), F.when(s.last.type == raw, s.last.type).otherwise("prose"), s.last.table_part, F.concat(s.last.refs, refs))
        new = chunk(x.path, text, type_, x.table_part, refs)
        closed = F.when(s.last.isNull(), s.out).otherwise(F.concat(s.out, F.array(s.last)))
        state = lambda held, last, out: F.struct(held.alias("held"), last.alias("last"), out.alias("out"))
        return (
            F.when(x.pointer & same, state(s.held, pointed, s.out))
            .when(x.pointer, state(F.map_concat(others, F.create_map(x.path, held_text)), s.last, s.out))
            .when(fits, state(others, merged, s.out))
            .otherwise(state(others, new, closed))
        )

    done = F.aggregate("items", start, step, lambda s: F.when(s.last.isNull(), s.out).otherwise(F.concat(s.out, F.array(s.last))))
    out = rows.select("document_id", F.posexplode(done).alias("order_index", "x")).select("document_id", "order_index", F.nullif("x.path", F.lit("")).alias("heading_path"), F.col("x.text").alias("text"), F.col("x.type").alias("chunk_type"), F.nullif("x.table_part", F.lit(0)).alias("table_part"), F.col("x.refs").alias("reference_texts"))
    v, own = F.lit(version), F.col("document_id")
    if isinstance(out.schema["document_id"].dataType, T.StructType):  # with what it carries, see split_documents
        own = own.document_id
    above = parent_path(F.col("heading_path"))
    return out.withColumns({"section_id": section_id(own, v, F.col("heading_path")), "parent_section_id": F.when(above.isNotNull(), section_id(own, v, above)), "heading_level": F.size(F.split("heading_path", "/"))})


def split_contextual(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, table_rows: int = TABLE_ROWS, version: str = "v2") -> DataFrame:
    """Index-ready pieces of Markdown text."""
    return coalesce_pieces(split_structured(documents, size, overlap, table_rows, 6), size, version)


def split_documents(documents: DataFrame, version: str = "v2", size: int = SIZE, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """By version and source type; v2 plain text has one root section and no low pieces.

    The columns in ``carry`` come along with each document, so that its pieces need no join.
    """
    marked = F.col("source_type") == "markdown"
    plain = plain_pieces(documents.filter(~marked | F.col("source_type").isNull()).select("document_id", *carry, "content"), size, overlap)
    text = documents.filter(marked).select(F.struct("document_id", *carry).alias("document_id") if carry else "document_id", "content")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["order_index", "text", "heading_path", "chunk_type", "section_id", "parent_section_id"]
    if version == "v1":
        pieces = split_structured(text, size, overlap).select("document_id", F.col("ord").alias("order_index"), "text", "heading_path", F.col("kind").alias("chunk_type"), none("string").alias("section_id"), none("string").alias("parent_section_id"))
        kept, kind, section = F.col("pieces"), "section", none("string")
    else:
        pieces = split_contextual(text, size, overlap, version=version)
        # Low pieces go before the others get their numbers, inside the document's row.
        kept, kind, section = F.filter("pieces", lambda p: ~low_information(p)), "prose", section_id(F.col("document_id"), F.lit(version), none("string"))
    plain = plain.select("document_id", *carry, F.posexplode(kept).alias("order_index", "text"), none("string").alias("heading_path"), F.lit(kind).alias("chunk_type"), none("string").alias("parent_section_id"))
    plain = plain.withColumn("section_id", section)
    ids = ["document_id.document_id", *[f"document_id.{c}" for c in carry]] if carry else ["document_id"]
    return pieces.select(*ids, *columns).unionByName(plain.select("document_id", *carry, *columns))
