"""Chunking: results worked out by hand for small texts, and what must hold for any text."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.functions.text import TABLE_LABEL
from trawl.operators import chunking

DOCUMENT = "document_id string, title string, content string, source_type string"


def one(spark, text):
    return spark.createDataFrame([("d", "t", text, "markdown")], DOCUMENT)


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, 10), (10, 11), (10, -1)])
def test_bad_sizes(spark, size, overlap):
    with pytest.raises(ValueError, match="overlap"):
        chunking.split_plain(one(spark, "text"), size, overlap)


def test_windows_by_hand(spark):
    cases = [
        ("  \r\n ", 10, 3, []),
        (None, 10, 3, []),
        ("short", 10, 3, ["short"]),
        ("0123456789abcdefghij", 10, 3, ["0123456789", "789abcdefg", "efghij"]),  # nowhere to cut
        ("aaaa bbbb cccc dddd", 10, 3, ["aaaa bbbb", "bbb cccc", "ccc dddd"]),  # at spaces
        ("one two\n\nthree four five", 12, 2, ["one two", "o\n\nthree", "ee four five"]),  # at the blank line
        ("xx xx xx xx xx xx", 5, 2, ["xx xx"]),  # equal neighbours are one
    ]
    docs = spark.createDataFrame([(str(i), "t", c[0], "text") for i, c in enumerate(cases)], DOCUMENT)
    for i, (_, size, overlap, want) in enumerate(cases):
        rows = chunking.split_plain(docs.filter(f"document_id = '{i}'"), size, overlap).orderBy("pos").collect()
        assert [r.piece for r in rows] == want, i


def structured(spark, text, size=60, overlap=10, rows=2, deepest=2):
    found = chunking.split_structured(one(spark, text), size, overlap, rows, deepest).orderBy("ord").collect()
    return [(r.heading_path, r.kind, r.table_part, r.text) for r in found]


def test_headings_by_hand(spark):
    text = "intro line\n# One\nalpha\n## Two\nbeta\n### Three\ngamma\n# Four ##\n---\ndelta"
    assert structured(spark, text) == [
        (None, "section", None, "intro line"),
        ("One", "section", None, "# One\nalpha"),
        ("One/Two", "section", None, "## Two\nbeta\n### Three\ngamma"),
        ("Four", "section", None, "# Four ##\ndelta"),
    ]
    paths = [p for p, *_ in structured(spark, text, deepest=6)]
    assert paths == [None, "One", "One/Two", "One/Two/Three", "Four"]


def test_a_fence_stays_whole(spark):
    assert structured(spark, "# One\n```\n# not a heading\n\nx = 1\n```\nafter") == [("One", "section", None, "# One\n\n```\n# not a heading\n\nx = 1\n```\n\nafter")]
    code = "```\n" + "x = 1\n" * 20 + "```"
    assert [t for *_, t in structured(spark, f"before\n{code}\nafter", size=40)] == ["before", code, "after"]


def test_tables_by_hand(spark):
    text = "## T\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\ntail"
    assert structured(spark, text, size=30) == [
        ("T", "section", None, "## T"),
        ("T", "table", 1, f"{TABLE_LABEL}a | b\n| 1 | 2 |\n| 3 | 4 |"),
        ("T", "table", 2, f"{TABLE_LABEL}a | b\n| 5 | 6 |"),
        ("T", "section", None, "tail"),
    ]
    whole = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert structured(spark, whole) == [(None, "table", 1, whole)]
    assert structured(spark, "| only one row |") == [(None, "section", None, "| only one row |")]


def test_packing_by_hand(spark):
    three = "first paragraph here.\n\nsecond paragraph here.\n\nthird paragraph here."
    assert [t for *_, t in structured(spark, three, size=50)] == ["first paragraph here.\n\nsecond paragraph here.", "raph here.\n\nthird paragraph here."]
    words = " ".join(f"w{i:03}" for i in range(20))
    long = [t for *_, t in structured(spark, f"# Long heading\n\n{words}", size=40)]
    assert long[0] == "# Long heading\n\nw000 w001 w002 w003 w004" and not any("heading" in t for t in long[1:])
    assert all(len(t) <= 40 for t in long) and set(words.split()) <= set(" ".join(long).split())


def contextual(spark, text, size=60):
    found = chunking.split_contextual(one(spark, text), size, 10, 2).orderBy("order_index").collect()
    assert [r.order_index for r in found] == list(range(len(found)))
    return [(r.heading_path, r.text, r.chunk_type, r.reference_texts) for r in found]


def test_pointers_by_hand(spark):
    assert contextual(spark, "# A\nfirst text\n\n> 参见：Part 2\n\n# B\n> 见：[x](y.md)\n\nsecond text") == [
        ("A", "# A\nfirst text\n\n> 参见：Part 2", "prose", ["参见：Part 2"]),
        ("B", "# B\n> 见：[x](y.md)\n\nsecond text", "prose", ["见：[x](y.md)"]),
    ]
    # A pointer that nothing in its section follows or precedes is dropped.
    assert contextual(spark, "# A\ntext of A\n# B\n> 参见：Part 2\n# C\ntext of C") == [("A", "# A\ntext of A", "prose", []), ("C", "# C\ntext of C", "prose", [])]


def test_kinds_by_hand(spark):
    assert contextual(spark, "# A\n| h |x|\n| --- | --- |\n| 1 | 2 |\n\nplain") == [("A", "| h |x|\n| --- | --- |\n| 1 | 2 |\n\nplain", "prose", [])]
    assert [k for _, _, k, _ in contextual(spark, "- a\n- b\n# C\n```\ncode\n```\n# T\n| h |x|\n| --- | --- |\n| 1 | 2 |")] == ["list", "code", "table"]
    assert contextual(spark, "# Only a heading\n\n---\n\n***") == []
    # The same text twice in a section counts once, in another section again.
    assert [(p, t) for p, t, *_ in contextual(spark, "x y\n| a | b |\n| 1 | 2 |\nx  y\n# B\nx y", size=12)] == [(None, "x y"), (None, f"{TABLE_LABEL}a | b\n| 1 | 2 |"), ("B", "# B\nx y")]


def random_text(rng):
    """Numbered words, so that nothing can be lost unseen."""
    number = iter(range(10**6))
    words = lambda n: " ".join(f"w{next(number)}" for _ in range(rng.randrange(1, n)))
    parts = {
        "heading": lambda: "#" * rng.randrange(1, 5) + " " + words(4),
        "text": lambda: words(40),
        "lines": lambda: "\n".join(words(9) for _ in range(rng.randrange(1, 5))),
        "fence": lambda: "```\n" + "\n".join(rng.choice(["# " + words(3), words(6), ""]) for _ in range(rng.randrange(6))) + "\n```",
        "table": lambda: "| " + words(3) + " | x |\n| --- | --- |\n" + "\n".join(f"| {words(4)} | y |" for _ in range(rng.randrange(1, 9))),
        "rule": lambda: "---",
    }
    return "\n\n".join(parts[rng.choice(sorted(parts))]() for _ in range(rng.randrange(1, 20)))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(11)
    return spark.createDataFrame([(f"d{i}", "t", random_text(rng), "markdown") for i in range(60)], DOCUMENT).cache()


def numbers(text):
    return [int(w[1:]) for w in text.replace("|", " ").replace(TABLE_LABEL, " ").split() if w[0] == "w"]


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (800, 100)])
def test_windows_keep_all_text_in_order(documents, size, overlap):
    rows = chunking.split_plain(documents, size, overlap).orderBy("pos").collect()
    for d in documents.collect():
        pieces = [r.piece for r in rows if r.document_id == d.document_id]
        at = 0
        for p in pieces:  # each begins within the one before, or where only white space lies between
            begin = d.content.index(p, max(0, at - overlap - 1))
            assert not d.content[at:begin].strip() and 0 < len(p) <= size and p == p.strip()
            at = begin + len(p)
        assert not d.content[at:].strip()


@pytest.mark.parametrize(("size", "overlap", "rows", "deepest"), [(60, 15, 3, 2), (60, 0, 3, 6), (800, 100, 10, 2)])
def test_structure_keeps_all_text(documents, size, overlap, rows, deepest):
    found = chunking.split_structured(documents, size, overlap, rows, deepest).orderBy("ord").collect()
    for d in documents.collect():
        pieces = [r for r in found if r.document_id == d.document_id]
        seen = [n for r in pieces for n in numbers(r.text)]
        firsts = list(dict.fromkeys(seen))
        # A window may cut a word only where no space lies in its upper half: not with such words.
        assert set(numbers(d.content)) <= set(seen) and firsts == sorted(firsts)
        for r in pieces:
            assert r.text.strip() and (overlap or r.text.count("```") % 2 == 0)  # an overlap may begin inside a fence
            if r.kind == "table":
                assert r.text.startswith(TABLE_LABEL) or (r.table_part == 1 and len(r.text) <= size)
                assert len(r.text.split("\n")) <= max(rows + 1, 2 if len(r.text) > size else 99)
            elif "```" not in r.text:
                assert len(r.text) <= size


def test_contextual_pieces_fit_and_keep_order(documents):
    found = chunking.split_contextual(documents, 200, 15, 3).orderBy("order_index").collect()
    for d in documents.collect():
        pieces = [r for r in found if r.document_id == d.document_id]
        firsts = list(dict.fromkeys(n for r in pieces for n in numbers(r.text)))
        assert firsts == sorted(firsts)
        for r in pieces:
            assert "```" in r.text or r.chunk_type == "table" or TABLE_LABEL in r.text or len(r.text) <= 200
            assert r.section_id.startswith("section-") and (r.parent_section_id is None) == ("/" not in (r.heading_path or ""))
            assert (r.heading_path or "").count("/") + 1 == r.heading_level or r.heading_path is None
        assert len({(r.heading_path, " ".join(r.text.split())) for r in pieces}) == len(pieces)


def test_routing(spark, documents):
    both = documents.limit(20).unionByName(documents.limit(20).selectExpr("concat('x', document_id) AS document_id", "title", "content", "CAST(NULL AS string) AS source_type"))
    assert set(chunking.split_documents(both, "v1").columns) == set(chunking.split_documents(both, "v2").columns)
    kinds = {r.chunk_type for r in chunking.split_documents(both, "v2").filter("document_id LIKE 'x%'").collect()}
    assert kinds == {"prose"}


def test_documents_are_made_once_and_dealt_over_many_tasks(spark, documents):
    """Both kinds of pieces come from one reading, and small bytes do not draw tasks together."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = chunking.split_contextual(documents.mapInArrow(counted, documents.schema))
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    before = seen.value
    found.write.format("noop").mode("overwrite").save()
    assert seen.value - before == documents.count()


def test_pieces_carry_columns_of_their_document(spark, documents):
    both = documents.unionByName(documents.selectExpr("concat('x', document_id) AS document_id", "title", "concat('one\n\n---\n\n', content) AS content", "'text' AS source_type"))
    both = both.selectExpr("*", "concat('of ', document_id) AS owner")
    plain = ["document_id", "order_index", "text", "heading_path", "chunk_type", "section_id", "parent_section_id"]
    rows = lambda df, *c: sorted(map(str, df.select(*plain, *c).collect()))
    carried = chunking.split_documents(both, carry=("owner",))
    assert rows(carried, "owner") == rows(chunking.split_documents(both).join(both.select("document_id", "owner"), "document_id"), "owner")
    assert carried.join(carried.groupBy("document_id").count(), "document_id").filter("order_index >= count").count() == 0


def test_low_information_by_hand(spark):
    from trawl.functions.text import low_information

    low = ["", " \n\t", None, "---", "-_*~`|\n--", "é ü", "|é|\n|---|", "| a | b |\n|---|:---:|", "# Lone heading", "\n ## Lone ##\n", "#"]
    rich = ["a", "漢", "| a |\n| b |", "# Head\ntext", "a # b", "| a |\n|---|\n| 1 |", "x\n|---|"]
    rows = spark.createDataFrame([(t, t in low) for t in low + rich], "t string, y boolean").select("t", "y", low_information(F.col("t")).alias("got")).collect()
    assert [r.t for r in rows if r.y != r.got] == []
