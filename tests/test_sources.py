from pyspark.sql import functions as F

from trawl.plans import indexing
from trawl.sources import files, html
from trawl.streaming import jobs

PAGE = """<html><head><title>t</title></head><body><h2>A <b>bold</b> head</h2><p>One<br>two <a href="/x">link</a> <code>c d</code><p>Three <i></i>&amp; four
<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x<li>y</ol><pre>  raw
 text</pre><blockquote><p>q</p><p>r</p></blockquote><table><tr><th>h|1<th>h2</tr><tr><td>v</td></tr></table><img alt="i" src="s.png"><script>x</script></body>"""


def test_html_to_markdown():
    want = "## A **bold** head\n\nOne two [link](/x) `c d`\n\nThree & four\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n```\n  raw\n text\n```\n\n> q\n> \n> r\n\n| h\\|1 | h2 |\n| --- | --- |\n| v |  |\n\n![i](s.png)"
    assert html.markdown(PAGE) == want
    assert html.markdown("") == "" and html.markdown("<p>open <b>both") == "open **both**"
    assert html.table_cells("| a | b \\| c |  |") == ["a", "b | c", ""]


def test_parser_errors_are_rows(spark):
    def parse(text):
        if "bad" in text:
            raise ValueError("no")
        return text

    rows = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", None)], "id string, html string")
    got = {r.id: (r.content, r.error) for r in html.parsed(rows, parse).collect()}
    assert got == {"a": ("ok", None), "b": (None, "ValueError: no"), "c": (None, None)}


def test_files(spark, tmp_path):
    for name, data in {"a note.md": b"# x", "b.TXT": b"y", "c.exe": b"z", "d.md": b"", "e.html": b"w" * 50}.items():
        (tmp_path / name).write_bytes(data)
    good, bad = files.scan_files(spark, f"file://{tmp_path}", 20)
    assert {(r.name, r.source_type, r.title) for r in good.collect()} == {("a note.md", "markdown", "a note"), ("b.TXT", "text", "b")}
    assert {(r.name, r.reason) for r in bad.collect()} == {("c.exe", "unsupported_type"), ("e.html", "too_large")}
    assert {r.t for r in good.select(files.decode(F.col("content")).alias("t")).collect()} == {"# x", "y"}


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"name": "n", "kb_id": "k",\n "cases": [{"id": "a", "question": "q"}, {"question": "r"}]}')
    got = files.read_dataset(spark, f"{tmp_path}/d.json", "id: string, question: string")
    assert [(r.pos, r.id, r.question) for r in got.collect()] == [(0, "a", "q"), (1, None, "r")]
    files.write_lines(got, f"{tmp_path}/out")
    assert files.read_lines(spark, f"{tmp_path}/out", "pos int, question string").count() == 2


DOC = "document_id string, tenant_id string, kb_id string, title string, source_type string, content string, status int, updated_at int"


def documents(spark, rows):
    return spark.createDataFrame([(i, "t", kb, "T", kind, text, status, at) for i, kb, kind, text, status, at in rows], DOC)


def test_index_with_status(spark):
    rows = documents(spark, [("a", "k", "markdown", "# H\n\nbody text", 3, 1), ("b", "k", "text", " ", 3, 1), ("c", "k", "text", "done", 1, 1), ("d", "k", "text", "broken", 3, 1)])
    chunks, status = indexing.index_with_status(rows, spark.createDataFrame([("d", "x" * 3000)], "document_id string, message string"))
    got = chunks.collect()
    assert [(r.document_id, r.content, r.heading_path) for r in got] == [("a", "# H\n\nbody text", "H")]
    assert got[0].retrieval_text == "文档：T\n章节：H\n正文：# H\n\nbody text" and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-5
    assert {(r.document_id, r.status, len(r.error_message or "")) for r in status.collect()} == {("a", 1, 0), ("b", 2, 32), ("d", 2, 2000)}


def test_embedder_is_checked(spark):
    import pytest

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, embed_text string")
    good = indexing.embed_with(rows, lambda texts: [[float(len(t))] * 3 for t in texts], 3)
    assert [list(r.embedding) for r in good.collect()] == [[1.0] * 3] * 2
    with pytest.raises(Exception, match="dimension"):
        indexing.embed_with(rows, lambda texts: [[1.0]] * len(texts), 3).collect()


def test_index_stream_replays_and_updates(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: jobs.index_stream(spark.readStream.schema(DOC).parquet(source), path, f"{path}/checkpoint").awaitTermination()
    documents(spark, [("a", "k", "text", "old", 3, 1), ("b", "k", "text", "stays", 3, 1)]).write.parquet(source)
    stream()
    documents(spark, [("a", "k", "text", "older", 3, 2), ("a", "k", "text", "newest", 3, 3)]).write.mode("append").parquet(source)
    stream()
    # A row that comes late, one that deletes, and one that yields nothing.
    documents(spark, [("a", "k", "text", "too late", 3, 2), ("b", "k", "text", None, 3, 5), ("c", "k", "text", " ", 3, 1), ("d", "k", "text", "more", 3, 1)]).write.mode("append").parquet(source)
    stream()
    current = lambda at: sorted(r.content for r in jobs.current_chunks(spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/documents")).collect())
    assert current(path) == ["more", "newest"]
    statuses = {(r.document_id, r.status, r.message) for r in spark.read.parquet(f"{path}/documents/batch=2").collect()}
    assert statuses == {("a", "INDEXED", None), ("b", "DELETED", None), ("c", "FAILED", "no chunks"), ("d", "INDEXED", None)}
    jobs.compact_index(spark, path, f"{path}-2")
    assert current(f"{path}-2") == ["more", "newest"]


def test_late_events_are_dropped(spark, tmp_path):
    source = f"file://{tmp_path}/e"
    save = lambda rows: spark.createDataFrame(rows, "tenant_id int, t string").selectExpr("tenant_id", "CAST(t AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(source)
    save([(1, "2024-01-01 00:00:00.1"), (1, "2024-01-01 00:00:00.9"), (1, "2024-01-01 00:00:10")])
    counts = jobs.request_counts(spark.readStream.schema("tenant_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source))
    run = lambda: counts.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    save([(1, "2024-01-01 00:00:00.5"), (1, "2024-01-01 00:00:30")])
    run()
    got = {(r.start.second, r.n) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert (0, 2) in got and (0, 1) not in got


def test_feedback(spark):
    rows = spark.createDataFrame([("x", "t", "l", 2, "", 1), ("x", "t", "l", 5, "", 2), ("x", "t", "other", 1, "", 3), ("x", "t", "l", 6, "", 4)], "trace_id string, tenant_id string, log_id string, score int, comment string, ts int")
    traces = spark.createDataFrame([("x", "t", "l")], "trace_id string, tenant_id string, log_id string")
    assert [(r.trace_id, r.score) for r in jobs.latest_feedback(jobs.valid_feedback(rows, traces)).collect()] == [("x", 5)]
