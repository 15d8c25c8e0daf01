"""Queries against their SQL on tables with rows that the supplied small ones lack."""

import datetime as dt

from trawl.plans import catalog


def differs(spark, path, name, table, rows, schema):
    """Writes one table under ``path`` and gives the rows of the query and of its SQL."""
    import duckdb

    frame = spark.createDataFrame(rows, schema)
    frame.withColumn("ts", frame.ts.cast("timestamp_ntz")).write.parquet(f"{path}/{table}.parquet") if "ts" in frame.columns else frame.write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    found = catalog.queries()[name](spark, str(path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect()), key=repr), sorted(want, key=repr)


def test_increase_of_a_value_of_zero(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start, 1, "click", 0.0 if i % 2 else 7.25) for i in range(24)]
    got, want = differs(spark, tmp_path, "k10_increase", "events", rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert got == want and (3, None) in got and (6, 0.0) in got


def test_attempts_at_texts_of_low_information(spark, tmp_path):
    rows = [(7 * i, text, "en", "src1", 1) for i, text in enumerate(["!!!", "# Heading", "привет", "| a |\n| --- |", " \t\n", "words"])]
    got, want = differs(spark, tmp_path, "j2_attempts", "documents", rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert got == want and ("d0", 1, "INDEXED", None) in got and ("d28", 1, "FAILED", "no chunks") in got


def test_snapshots_of_low_information_and_repeated_ids(spark, tmp_path):
    texts = ["!!!", "# Heading", "привет", "| a |\n| --- |", " \t\n", "words"]
    rows = [(10 * i + 2, text, "en", "src10", 1) for i, text in enumerate(texts)] + [(62, text, "en", "src10", 1) for text in ("one", "one", "two", "")]
    rows += [(None, "no id", "en", "src10", 1), (81, "deleted", "en", "src10", 1), (3, "even", "en", "src1", 1)]
    got, want = differs(spark, tmp_path, "c5_snapshots", "documents", rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert got == want == [("src1", "ready", 0, 0), ("src10", "ready", 12, 8)]
