"""Faults, publication and batches of streams: what goes wrong stays where it is."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tagweave import sources, streaming
from tagweave.operators import html, taggers
from tagweave.plans import annotate


def test_halving():
    seen = []

    def f(batch):
        seen.append(batch.num_rows)
        if pc.any(pc.equal(batch.column(0), 5)).as_py() or batch.num_rows == 3:
            raise ValueError("no fives")
        return batch

    batch = pa.RecordBatch.from_arrays([pa.array(range(16))], ["x"])
    parts = list(annotate.halved(f, batch))
    assert [x for part, _, _ in parts for x in part.column(0).to_pylist()] == list(range(16))
    assert [(p.column(0).to_pylist(), c) for p, out, c in parts if out is None] == [([5], "no fives")] and len(seen) < 12
    assert list(annotate.halved(f, batch.slice(0, 0))) == []


def test_python_tagger(spark):
    def shout(batch):
        if any(t is not None and "bad" in t for t in batch.column("text").to_pylist()):
            raise ValueError("a bad text")
        return pa.RecordBatch.from_arrays([pa.array([None if t is None else t.upper() for t in batch.column("text").to_pylist()]), pc.utf8_length(batch.column("text"))], ["loud", "n"])

    rows = [(i, "bad" if i in (3, 77) else f"text {i}", "old") for i in range(100)] + [(100, None, "old")]
    df = spark.createDataFrame(rows, "id long, text string, loud string").repartition(3)
    out = {r.id: r for r in annotate.python_tagger("shout", shout, {"loud": ("string", None), "n": ("int", -1)})(df).collect()}
    for i, text, old in rows:
        r = out[i]
        if text == "bad":
            assert (r.loud, r.n, r.shout_error, r.shout_error_comment) == (old, -1, 1, "a bad text")
        else:
            assert (r.loud, r.n, r.shout_error, r.shout_error_comment) == (text and text.upper(), text and len(text), 0, "")


PAGE = "<html><body><p>first {0}</p><div>second {0}</div></body></html>"


def planted(tagger, column):
    """tagger, failing on rows whose column has a bomb."""
    def run(df):
        return tagger(df.withColumn(column, F.when(F.col(column).contains("bomb"), F.raise_error(F.lit("bomb found"))).otherwise(F.col(column)).cast("string")))

    return run


def test_any_tagger_in_a_fault_boundary(spark):
    df = spark.createDataFrame([(i, PAGE.format("bomb" if i == 4 else i)) for i in range(12)], "page_id long, html string").repartition(2)
    plain = html.extract_html(df).where("page_id <> 4").select("page_id", "text", "tags_html").collect()
    found = annotate.with_fault_boundary("html", planted(html.extract_html, "html"), {"text": "''", "tags_html": "null"})(df)
    rows = {r.page_id: r for r in found.select("page_id", "text", "tags_html", "html_error", "html_error_comment").collect()}
    assert len(rows) == 12 and {i for i, r in rows.items() if r.html_error} == {4}
    assert "bomb found" in rows[4].html_error_comment and rows[4].text == ""
    assert all((rows[r.page_id].text, rows[r.page_id].tags_html, rows[r.page_id].html_error_comment) == (r.text, r.tags_html, "") for r in plain)
    # old values stay; a tagger that groups
    ready = html.extract_html(df).withColumn("text", F.when(F.col("page_id") == 7, "bomb").otherwise(F.col("text")))
    held = annotate.with_fault_boundary("paragraph", planted(lambda d: taggers.tag_paragraph(d, "page_id"), "text"), {"tags_paragraph": "array()"})(ready)
    want = {r.page_id: r.tags_paragraph for r in taggers.tag_paragraph(ready, "page_id").collect()}
    for r in held.collect():
        assert (r.paragraph_error, r.text == "bomb", r.tags_paragraph) == ((1, True, []) if r.page_id == 7 else (0, False, want[r.page_id]))
    assert annotate.with_fault_boundary("html", html.extract_html, {})(df.where("false")).count() == 0


def test_publishing(spark, tmp_path):
    path, df = f"{tmp_path}/out", spark.range(3)
    assert sources.publish(sources.write_columnar, df, path) and not sources.publish(sources.write_columnar, spark.range(9), path)
    assert sources.read_published(spark, path).count() == 3

    def failing(d, to):
        sources.write_columnar(d, to)
        raise OSError("the writer is lost")

    before = sources.read_published(spark, path)
    with pytest.raises(OSError):
        sources.publish(failing, spark.range(50), path, replace=True)
    assert sources.read_published(spark, path).count() == 3 and list(sources.versions(spark, path)) == [1]
    assert sources.publish(sources.write_columnar, spark.range(5), path, replace=True)
    assert sources.read_published(spark, path).count() == 5 and sources.read_published(spark, path, version=1).count() == 3 and before.count() == 3
    # a manifest that was cut off counts for nothing, and is made again
    (tmp_path / "out" / sources.MANIFESTS / "3").write_text("part-x/none.parquet\ncompl")
    assert sources.read_published(spark, path).count() == 5
    assert sources.publish(sources.write_columnar, spark.range(6), path, replace=True) and sources.read_published(spark, path).count() == 6
    with pytest.raises(FileNotFoundError):
        sources.read_published(spark, f"{tmp_path}/nowhere")
    assert sources.publish(sources.write_jsonl_gz, spark.range(4), f"{tmp_path}/j") and sources.read_published(spark, f"{tmp_path}/j", "id long", "json").count() == 4


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="boom"):
        sources.publish(sources.write_columnar, spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id")), f"{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        sources.read_published(spark, f"{tmp_path}/out")
    assert sources.publish(sources.write_columnar, spark.range(2), f"{tmp_path}/out") and sources.read_published(spark, f"{tmp_path}/out").count() == 2


def test_taggers_that_group_and_join_on_a_stream(spark, tmp_path):
    """A stream's result is the batch's, also if a batch was published before its restart."""
    schema = "page_id long, url string, html string"
    for k in range(3):
        rows = [(i, f"https://site{i}.org/2020/05/0{1 + i % 9}/x", PAGE.format(f"Paris {i}")) for i in range(k * 4, k * 4 + 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lookups = {"gazetteer": spark.createDataFrame([("Paris", "P"), ("second", "S")], "alias string, entity string")}
    include = ["html", "url", "timestamp", "entity", "paragraph", "entity_paragraph"]
    run = lambda df: annotate.run_taggers(df, include, lookups)
    runs = []

    def failing(df):
        runs.append(1)
        if len(runs) == 2:
            raise ValueError("lost in the middle")
        return run(df)

    stream = lambda: streaming.stream_columnar(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    path, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    with pytest.raises(Exception, match="lost in the middle"):
        streaming.publish_tagged(stream(), failing, path, checkpoint).awaitTermination()
    assert list(sources.versions(spark, path, sources.BATCHES)) == [0]
    # as if the stream had been lost after the second batch was published and before it was noted
    second = spark.read.parquet(*sorted(str(p) for p in (tmp_path / "in").glob("*.parquet"))).where("page_id between 4 and 7")
    assert sources.publish_batch(run(second), path, 1) and not sources.publish_batch(run(second), path, 1)
    streaming.publish_tagged(stream(), run, path, checkpoint).awaitTermination()
    columns = ["page_id", "text", "tags_html", "tags_timestamp", "tags_entity", "tags_paragraph", "tags_entity_paragraph"]
    got = sources.read_batches(spark, path).select(columns).orderBy("page_id").collect()
    assert len(got) == 12 and got == run(spark.read.parquet(f"{tmp_path}/in")).select(columns).orderBy("page_id").collect()


@pytest.mark.parametrize("n", [7, 12, 100])
def test_counts_of_a_streams_head(spark, tmp_path, n):
    rows = [(i, ["a"] * (i % 2) + ["b"] * (i % 3 > 0) + (["c", "c"] if i > 8 else [])) for i in range(20)]
    for k in range(0, 20, 5):
        spark.createDataFrame(rows[k : k + 5], "id long, kinds array<string>").repartition(2).write.parquet(f"{tmp_path}/in/{k:02}")
    stream = streaming.stream_columnar(spark, f"{tmp_path}/in/*", "id long, kinds array<string>", files_per_trigger=2)
    streaming.publish_head_counts(stream, "kinds", n, "id", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {r.key: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: c for k in "abc" if (c := sum(k in kinds for _, kinds in rows[:n]))}
