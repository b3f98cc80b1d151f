"""Small vectors with known results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tagweave import schemas, sources, streaming
from tagweave.functions.exprs import path_date, unquote
from tagweave.operators import html, linearize, projections, sampling, taggers
from tagweave.plans import annotate, training


def values(df, column, name="value"):
    return [[n[name] for n in r[column]] for r in df.select(column).collect()]


def test_datasource(spark):
    urls = ["https://www.a.com/forum/21-new-project/x_y-5", "https://b.org/2005/03/22/end", "http://c.de/", "http://d.de/a+b.html?q=1#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = values(taggers.tag_datasource(df), "tags_generation_datasource")
    assert got == [["www.a.com > forum > x y"], ["b.org > end"], ["c.de > "], ["d.de > a b html"]]


@pytest.mark.parametrize(
    ("path", "date"),
    [("/2018/jan/22/x", "2018-01-22"), ("2021/1/3", "2021-01-03"), ("/a-2020-12-31", "2020-12-31"), ("/2021/01", None), ("2021 jan", None), ("/12", None), ("/1950/01/01", None), ("/2020/13/01", None)],
)
def test_dates(spark, path, date):
    got = spark.range(1).select(path_date(F.lit(path)).alias("d")).first()["d"]
    assert (got and got.strftime("%Y-%m-%d")) == date


def test_unquote(spark):
    r = spark.range(1).select(unquote(F.lit("/a%zz%20+b")).alias("p"), unquote(F.lit("a%20b+c"), plus=True).alias("q")).first()
    assert tuple(r) == ("/a%zz +b", "a b c")


def test_lengths(spark):
    df = spark.createDataFrame([("ab. c.d",), ("",), (None,), ("no stop",)], "text string")
    assert values(taggers.tag_length_text(df), "tags_generation_length_text") == [["7"], ["0"], [], ["7"]]
    out = taggers.tag_length_sentence(df).select("tags_generation_length_sentence").collect()
    assert [[(n.char_start_idx, n.char_end_idx, n.value) for n in r[0]] for r in out] == [[(0, 2, "2"), (2, 5, "2")], [], [], []]


def test_descriptions(spark):
    texts = ["one two", "a b c d e", "Mercury may refer to:", " ".join("w" * 51)]
    node = "array(named_struct('key', 'website_description', 'type', 'global', 'value', t))"
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{node} as tags_website_desc")
    assert values(taggers.clean_website_description(df), "tags_website_desc") == [[], ["a b c d e"], [], []]


def cleaned(spark, page, policy):
    r = html.extract_html(spark.createDataFrame([(page,)], "html string"), policy=policy).first()
    return r.text, r.tags_html


def places(text, nodes):
    return [(n.value, text[n.char_start_idx : n.char_end_idx], n.relative_start_pos, n.relative_end_pos) for n in nodes]


NEWS = (
    "<!DOCTYPE html>\n<html>\n<head><title>Harbour news</title><meta name=k>\n</head><body class=m>\n<h2>Ferry is late</h2>\nThe ferry from the north quay left an hour "
    "after its time on Monday, said the pilot. </body><footer><b>Imprint &amp; more</b></footer></html>"
)


def test_html_page(spark):
    r = html.extract_html(spark.createDataFrame([(NEWS, "old"), (None, "o"), ("  ", "o"), ("<?xml version='1.0' encoding='x'?><a/>", "o"), ("<title>x</title>", "o"), (NEWS, "same")], "html string, text string"))
    r = r.orderBy(F.length("html").desc_nulls_last()).collect()
    lines = "Ferry is late\nThe ferry from the north quay left an hour after its time on Monday, said the pilot.\n"
    assert r[0].text == r[1].text == lines and [x.text for x in r[2:]] == [""] * 4
    assert places(lines, r[0].tags_html) == [("h2", "Ferry is late", 1, 0), ("body", lines, 0, 0)]
    assert r[0].html_title == ["<title>Harbour news</title>"] and r[0].html_footer == ["<footer><b>Imprint &amp; more</b></footer>"]
    assert r[0].html_head == ['<head><title>Harbour news</title><meta name="k"/>\n</head>'] and r[0].html_error == 0


def test_html_text(spark):
    page = "<h1>A  <i> b</i></h1>x&nbsp; y<div>\n c<div>d</div> e</div><table><tr><td>1</td><td>2<tr><td>3</table><ul><li>p<li>q</ul>end"
    text, nodes = cleaned(spark, page, html.HtmlPolicy(keep_attrs=()))
    assert text == "A b\nx y\nc\nd\ne\n1 2\n3\np\nq\nend\n"
    assert [n.value for n in nodes] == "i h1 div div td td tr td tr table li li ul body".split()
    assert places(text, nodes)[2][:2] == ("div", "\nd")
    text, nodes = cleaned(spark, "<p> cut </><p>one<pre> x\n  y </pre>a<br>b<br/>c", html.HtmlPolicy(newlines=True))
    assert text == "cut >\none\n x\n  y\na\nb\nc\n" and "br" not in [n.value for n in nodes]
    text, nodes = cleaned(spark, "<a href='u'\" title>go</a>", html.HtmlPolicy())
    assert (text, nodes[0].html_attrs.attrs, list(nodes[0].html_attrs["values"])) == ("go\n", ["href", "title"], ["u", "title"])


def test_html_rules(spark):
    page = "<body><h1>a heading that stays</h1><div class='a' id=1>outer<div class='b' href='x'>tiny</div></div></body>"
    text, nodes = cleaned(spark, page, html.HtmlPolicy(fold=("div",)))
    assert text == "a heading that stays\nouter\ntiny\n"
    assert [(n.html_attrs.attrs, list(n.html_attrs["values"])) for n in nodes if n.value == "div"] == [(["class", "id", "href"], ["a b", "1", "x"])]
    for rule, left in (
        (html.Rule("div", most=5), "a heading that stays\nouter\n"),
        (html.Rule("div", most=5, bottom_up=True), "a heading that stays\n"),
        (html.Rule("div", least=9), "a heading that stays\n"),
        (html.Rule(most=4, but=("h1",)), "a heading that stays\nouter\n"),
    ):
        text, nodes = cleaned(spark, page, html.HtmlPolicy(drop=(rule,), keep_attrs=("id",)))
        assert text == left and {a for n in nodes for a in n.html_attrs.attrs} <= {"id"}
    text, nodes = cleaned(spark, page, html.HtmlPolicy(unwrap=(html.Rule("div", most=5), html.Rule(least=20, but=("body", "div")))))
    assert [n.value for n in nodes] == ["div", "body"] and text == "a heading that stays\nouter\ntiny\n"
    text, _ = cleaned(spark, "<b>x</b><script>q</script>tail<i>k</i> <u>z</u>mm<s></s><u>z</u>nn", html.HtmlPolicy(drop=(html.Rule("script"), html.Rule("u"))))
    assert text == "xtailk mmnn\n"


def test_html_nested_deep(spark):
    text, nodes = cleaned(spark, "<div>" * 3000 + "deep" + "</div>" * 3000, html.HtmlPolicy())
    assert text == "deep\n" and len(nodes) == 3001


def test_paragraphs(spark):
    node = lambda tag, s, e: (e, s, ([], []), "html", 0, 0, "local", tag)
    text = "abc\ndef\n\nghi tail"
    df = spark.createDataFrame([(1, text, [node("p", 0, 3), node("div", 4, 12)])], f"id long, text string, tags_html array<{schemas.HTML}>")
    out = taggers.tag_paragraph(df, "id").first().tags_paragraph
    assert [(p.char_start_idx, p.char_end_idx, p.marker, p.value) for p in out] == [(0, 4, "p", "abc\n"), (4, 9, "div+lf", "def\n\n"), (9, 12, "div+lf", "ghi"), (12, 17, "remainder", " tail")]
    assert "".join(p.value for p in out) == text


def test_entity_paragraphs(spark):
    schema = f"tags_entity array<{schemas.LOCAL}>, tags_paragraph array<{schemas.PARAGRAPH}>"
    e = lambda s, x, v: (x, s, "entity", "local", v)
    df = spark.createDataFrame([([e(1, 3, "A"), e(4, 6, "B"), e(1, 2, "A"), e(30, 31, "C")], [(10, 0, "paragraph", "p", "local", "x")])], schema)
    out = taggers.tag_entity_paragraph(df).first().tags_entity_paragraph
    assert [(n.char_start_idx, n.char_end_idx, n.value, n.relative_start_pos) for n in out] == [(0, 10, "A", 0), (0, 10, "B", 1), (30, 31, "C", 0)]


def test_insertion(spark):
    n = lambda key, s, e, v, r=None: (e, s, (["a"], ["1"]), key, None, r, r, "local", v)
    nodes = [n("entity", 0, 5, "Joe_B"), n("html", 0, 5, "b", 0), n("html", 5, 5, "br", 1)]
    df = spark.createDataFrame([(1, "Biden won", nodes)], f"id long, text string, tags array<{schemas.ANY}>")
    nodes_html = df.withColumn("tags", F.expr("filter(tags, n -> n.key = 'entity')"))
    r = linearize.insert_local(nodes_html, linearize.LinearizeConfig(), "id").first()
    assert r.text_with_tags == "Biden [[Joe B]] won" and r.char_mask == [0] * 5 + [1] * 10 + [0] * 4


def test_insertion_order(spark):
    """Nodes with equal offsets, empty spans, relative positions and plain nodes together, and offsets past the end."""
    n = lambda key, s, e, v, p=None, q=None: (e, s, ([], []), key, None, q, p, "local", v)
    rows = [
        (1, "red fox", [n("html", 0, 7, "p", 0, 1), n("html", 0, 3, "b", 1, 0), n("html", 3, 3, "br", 1, 2), n("html", 7, 7, "hr", 0, 2)]),
        (2, "red fox", [n("entity", 4, 7, "Fox_1"), n("mark", 4, 4, "x"), n("mark", 0, 3, "c"), n("mark", 0, 7, "d")]),
        (3, "red fox", [n("entity", 0, 99, "Out"), n("html", 0, 3, "i", 0, 0)]),
        (4, "", []),
    ]
    df = spark.createDataFrame(rows, f"id long, text string, tags array<{schemas.ANY}>")
    cfg = linearize.LinearizeConfig(tags_list=("html", "entity", "mark"), wrap_start={"html": "{"}, wrap_end={"html": "}"})
    out = {r.id: r for r in linearize.insert_local(df, cfg, "id").collect()}
    assert out[1].text_with_tags == "{<p><b>}red{</b><br></br>} fox{<hr></p></hr>}"
    assert out[2].text_with_tags == "[mark: d][mark: c]red[/mark: c] [mark: x][/mark: x]fox [[Fox 1]][/mark: d]"
    assert out[3].text_with_tags == "{<i>}red{</i>} fox" and out[4].text_with_tags == ""
    assert all(len(r.char_mask) == len(r.text_with_tags) and sum(r.char_mask) == len(r.text_with_tags) - len(r.text) for r in out.values())
    own = {"mark": lambda node, cfg: F.struct(F.lit("(").alias("start"), F.lit(")").alias("end"))}
    assert linearize.insert_local(df.where("id = 2"), cfg, "id", renderers=own).first().text_with_tags == "((red) ()fox [[Fox 1]])"


def test_renderers_reach_training_rows(spark):
    node = "array(named_struct('key', 'url', 'type', 'global', 'value', 'u'))"
    df = projections.to_v1(spark.createDataFrame([(1, "some text")], "id long, text string").selectExpr("*", f"{node} as tags_url"))
    cfg = linearize.LinearizeConfig(max_seq_len=32)
    usual, own = (linearize.train_rows(df, cfg, "id", renderers=r).first().input_ids for r in (None, {"url": lambda n, c: F.lit("other words")}))
    assert usual != own


def test_chunks(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5], [0, 1, 0, 0, 1], [9]), (2, [], [], [9])], "id int, ids array<int>, mask array<int>, prefix_ids array<int>")
    out = linearize.chunk(df, 4).orderBy("chunk_idx").collect()
    assert [(r.input_ids, r.attention_mask, r.tags_mask) for r in out] == [([9, 1, 2, 3], [1] * 4, [1, 0, 1, 0]), ([9, 4, 5, 0], [1, 1, 1, 0], [1, 0, 1, 0])]


def test_error_capture(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "v string")
    out = annotate.with_error_capture("p", {"n": "try_cast(v as int)"}, {"n": 0})(df).collect()
    assert [(r.n, r.p_error, r.p_error_comment) for r in out] == [(5, 0, ""), (0, 1, "n"), (0, 1, "n")]
    with pytest.raises(ValueError, match="no taggers"):
        annotate.run_taggers(df, ["nothing"])


def test_schema_spec():
    kind = schemas.schema_from_spec({"a": "int64", "b": [{"key": {"dtype": "string"}}]})
    assert kind.simpleString() == "struct<a:bigint,b:array<struct<key:string>>>"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "t1"), ("u2", "t2")], "url string, text string")
    sources.write_jsonl_gz(taggers.tag_url(df), f"{tmp_path}/j")
    back = sources.read_annotated(spark, f"{tmp_path}/j")
    assert sorted(v[0] for v in values(back, "tags_url")) == ["u1", "u2"] and values(back, "tags_html") == [[], []]
    sources.write_shards(sources.shard(df, 2, "url"), f"{tmp_path}/s")
    sources.write_shards(sources.shard(df, 2, "url"), f"{tmp_path}/s", "ignore")
    assert sources.concat_shards(spark, f"{tmp_path}/s", 2).count() == 2
    with pytest.raises(ValueError, match="shards"):
        sources.concat_shards(spark, f"{tmp_path}/s", 3)
    sources.write_schema(df, f"{tmp_path}/schema")
    assert "url" in spark.read.text(f"{tmp_path}/schema").first().value
    with pytest.raises(ValueError, match="txt"):
        sources.read_v1(spark, "x", ext="txt")


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([(f"http://h{i % 3}.org/a/{i}", f"text {i}") for i in range(40)], "url string, text string")
    sources.write_jsonl_gz(df.repartition(4), f"{tmp_path}/in")
    stream = streaming.stream_annotated(spark, f"{tmp_path}/in", files_per_trigger=1)
    run = lambda d: taggers.tag_datasource(taggers.tag_length_text(taggers.tag_url(d)))
    streaming.publish(run(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    cols = ["url", "tags_url", "tags_generation_datasource", "tags_generation_length_text"]
    want = sorted(map(str, run(sources.read_annotated(spark, f"{tmp_path}/in")).select(cols).collect()))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(cols).collect())) == want
    counts = sampling.column_counts(run(streaming.stream_annotated(spark, f"{tmp_path}/in", files_per_trigger=2)))
    streaming.publish_counts(counts, f"{tmp_path}/n", f"{tmp_path}/cp2").awaitTermination()
    got = {r["key"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/n").collect()}
    assert got == {"url": 40, "generation_datasource": 40, "generation_length_text": 40}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string")
    out = taggers.tag_timestamp(taggers.tag_datasource(taggers.tag_url(df)))
    assert out.count() == 0 and projections.to_v1(out).count() == 0


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2")], "id string, text string")
    df.coalesce(1).write.json(f"{tmp_path}/v1")
    assert sorted(r.text for r in sources.read_v1(spark, f"{tmp_path}/v1").collect()) == ["t1", "t2"]
    df.select("text").coalesce(1).write.text(f"{tmp_path}/txt")
    assert sources.read_v1(spark, f"{tmp_path}/txt", ext="txt", tags=False).columns == ["text"]
    sources.write_columnar(df, f"{tmp_path}/named/en/v1")
    sources.write_columnar(df, f"{tmp_path}/named/en/v1", "ignore")
    assert sources.read_named(spark, f"{tmp_path}/named", "en", "v1").count() == sources.read_columnar(spark, f"{tmp_path}/named/*/v[0-9]").count() == 2
    names = sources.read_columnar(spark, f"{tmp_path}/named/*/*").select(sources.file_name().alias("name")).distinct()
    assert sources.select_files(names, pattern=r"^part-\d+.*\.parquet$").count() == names.count() > 0
    spark.createDataFrame([('{"n": 1}',), ("{broken",)], "v string").coalesce(1).write.text(f"{tmp_path}/lines")
    assert [r.n for r in sources.read_lines(spark, f"{tmp_path}/lines", schema="n long").orderBy("n").collect()] == [None, 1]
    df.write.parquet(f"{tmp_path}/redirects")
    assert [t.count() for t in sources.read_site_tables(spark, f"{tmp_path}/redirects", f"{tmp_path}/redirects")] == [2, 2]


def test_other_prefixes(spark, tmp_path):
    df = taggers.tag_url(spark.createDataFrame([("u", "t")], "url string, text string")).withColumnRenamed("tags_url", "notes_url")
    sources.write_jsonl_gz(df, f"{tmp_path}/j")
    back = sources.read_annotated(spark, f"{tmp_path}/j", prefix="notes_").first()
    assert [n.value for n in back.tags_url] == ["u"] and back.tags_html == []


def test_sampling_ends(spark):
    a, b = spark.range(10).toDF("id"), spark.range(100, 200).toDF("id")
    both = sampling.interleave([a, b], [1, 1], 3, "id", stop_first=True).orderBy("turn").collect()
    assert len(both) == 20 and sum(r.source == 0 for r in both) == 10
    loose = sampling.shuffle(b, 5, "id", total=False)
    assert sorted(r.id for r in loose.collect()) == list(range(100, 200))
    drawn = sampling.sample_with_replacement(a, 50, 1, "id").collect()
    assert len(drawn) == 50 and {r.id for r in drawn} <= set(range(10)) and len({r.id for r in drawn}) < 50


def test_old_values_come_back(spark):
    df = spark.createDataFrame([("7", 1), ("x", 2)], "v string, n int")
    out = annotate.with_error_capture("p", {"n": "try_cast(v as int)"}, {"n": 0}, keep_old=True)(df).collect()
    assert [(r.n, r.p_error) for r in out] == [(7, 0), (2, 1)]


def test_exploded_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "id long, parts array<string>")
    df.write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_columnar(spark, f"{tmp_path}/in", "id long, parts array<string>")
    streaming.publish(stream.select("id", F.explode("parts").alias("part")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.part for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_config_switches(spark):
    node = lambda k, v: f"array(named_struct('key', '{k}', 'type', 'global', 'value', '{v}'))"
    df = spark.createDataFrame([(i, "some <s> text") for i in range(20)], "id long, text string")
    df = df.selectExpr("*", f"{node('url', 'u')} as tags_url", f"{node('title', 't')} as tags_title")
    assert [n.key for n in projections.to_v1(df, ("title",)).first().tags] == ["title"]
    cfg = linearize.LinearizeConfig(max_seq_len=32, special_tokens={"html": "<s>"})
    rows = {}
    for name, c in (("all", cfg), ("special", replace(cfg, special_token_state=True)), ("title", replace(cfg, tags_columns=("title",))), ("drawn", replace(cfg, random_sample=True, sample_weights={"url": 1.0, "title": 1.0}))):
        rows[name] = [r.input_ids for r in training.build_dataset(df, c, "with_tags_all", "id").orderBy("id").collect()]
    assert rows["all"] != rows["special"] and rows["all"] != rows["title"] and 1 < len({tuple(x) for x in rows["drawn"]}) <= 3
    assert linearize.regex_tokens and cfg.specials() == () and replace(cfg, special_token_state=True).specials() == ("<s>",)
