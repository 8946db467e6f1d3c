"""Catalogue, articles, books, translation, sources, streaming and logs on small rows."""

import gc
import io
import json
import os
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom import catalog
from lexiloom.functions.dom import Node, parse
from lexiloom.operators import articles, blocks, books, catalogue, metrics, ngrams, tokens, translation
from lexiloom.plans import cleaning
from lexiloom.sources import corpora, epub
from lexiloom.streaming import incremental


def test_tree_tolerates_open_tags():
    root = parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<div>z</div><!-- no --><br><b>q")
    assert [li.text() for li in root.first("ul").own("li")] == ["a", "bc"]
    assert [p.text() for p in root.all("p")] == ["x", "y"] and root.first("div").text() == "z" and root.first("b").text() == "q"


def test_trees_go_without_the_collector(spark):
    html = "<div class='navbox'><p>a<b>b</b></p></div><section><ruby>x<rt>y</rt></ruby><blockquote>q<br>r</blockquote></section>" * 5
    gc.collect()
    gc.disable()
    try:
        articles.clean_html(html)
        articles.parse_page("t", html)
        assert not [x for x in gc.get_objects() if isinstance(x, Node)]
    finally:
        gc.enable()
    sizes = spark.range(2000, numPartitions=1).selectExpr("cast(id as string) title", "'<p>x</p>' html")
    articles.page_text(sizes)
    got = sizes.select("html").mapInPandas(lambda batches: (x.head(1).assign(html=str(len(x))) for x in batches), "html string").collect()
    assert max(int(r.html) for r in got) <= articles.BATCH_ROWS


def test_cleaner_rules():
    html = '<head><title>t</title></head><p>漢<ruby>字<rp>(</rp><rt>じ</rt></ruby> 文<sup class="reference">[1]</sup><sup>2</sup><span class="mw-editsection">edit</span><a href="x">リンク</a><b>太 <span>字</span></b><i>斜</i><span><img></span><span> </span><small>s</small></p><table><tr><td>x</td></tr></table><table class="wikitable"><tr><td>k</td></tr></table><div class="navbox">n</div><blockquote>a\n b<br><cite>c  d</cite></blockquote>'
    clean = articles.clean_html(html)
    assert "<table><tr>" not in clean and 'class="wikitable"' in clean and "[1]" not in clean and "edit" not in clean and "navbox" not in clean
    assert "漢字文2リンク**太 字**斜" in clean or "漢字文2リンク**太字**斜" in clean
    assert "<blockquote>a b<br/>c d</blockquote>" in clean


def test_sections_and_errors(spark):
    page = '<section data-mw-section-id="0"><p>l(e)ad</p><table><tr><td><p>in table</p></td></tr></table></section>'
    rows = articles.parse_page("t", page + '<section data-mw-section-id="1"><h5>deep</h5><div class="columns-list__wrapper"><ul><li>one。</li></ul></div></section>')
    assert [(r[2], r[5], r[6], r[10]) for r in rows] == [("l0", "paragraph", None, "l（e）ad"), ("b0", "heading", 4, "deep"), ("b1", "list", None, None), ("b1.0", "list_item", None, "one。")]
    bad = articles.blocks(spark.createDataFrame([("b", page + "<section><p>x</p></section>"), ("n", None)], "title string, html string"))
    assert {r.title: r.error for r in articles.failures(bad).collect()} == {"b": "ValueError: section ? has no heading", "n": "ValueError: no section 0"}


def test_description_lists(spark):
    page = '<section data-mw-section-id="0"><p>l</p></section><section><h2>h</h2><dl><dd>orphan</dd><dt>t</dt><dd><p>a</p><ul><li>x</li><li>y</li></ul></dd></dl><dl><dd>plain</dd></dl></section>'
    rows = articles.blocks(spark.createDataFrame([("p", page)], "title string, html string"))
    assert blocks.to_markdown(rows).first().markdown == "# p\n\nl\n\n## h\n**t**\na\n\nplain"
    found = articles.description_lists(spark.createDataFrame([("p", page)], "title string, html string"))
    assert [(r.title, r.n) for r in articles.last_section_lists(found).collect()] == [("p", 2)]


def test_empty_descriptions_go(spark):
    page = '<section data-mw-section-id="0"><p>l</p></section><section><h2>h</h2><dl><dt>t</dt><dd><ul><li>x</li></ul></dd></dl></section>'
    rows = articles.blocks(spark.createDataFrame([("p", page)], "title string, html string"))
    assert blocks.to_markdown(rows).first().markdown == "# p\n\nl"


def test_refresh(spark):
    parsed, fused = spark.createDataFrame([("a", "1"), ("b", "2")], "title string, blocks string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "title string, blocks string")
    made = blocks.refresh(parsed, fused)
    assert {r.title: (r.is_changed, r.blocks) for r in made.collect()} == {"a": (False, "1"), "b": (True, "2"), "c": (False, "3")}
    assert blocks.refresh_summary(made).first().changed == 1


def test_page_merge_chain(spark):
    p = lambda *x: [{"type": t, "content": c} for t, c in x]
    rows = [("k", 1, None, p(("paragraph", "a"))), ("k", 2, False, p(("paragraph", "b"))), ("k", 3, False, p(("paragraph", "c"))), ("k", 10, False, p(("dialogue", "d"), ("paragraph", "e"))), ("z", 1, False, p(("paragraph", "q"))), ("z", 2, True, p(("paragraph", "r")))]
    pages = spark.createDataFrame(rows, "book string, page int, first_paragraph_has_indent boolean, paragraphs array<struct<type:string,content:string>>")
    got = [(r.book, r.page, [x.content for x in r.paragraphs]) for r in books.merge_pages(pages).orderBy("book", "page").collect()]
    assert got == [("k", 1, ["ab"]), ("k", 2, []), ("k", 3, ["cd"]), ("k", 10, ["e"]), ("z", 1, ["q"]), ("z", 2, ["r"])]


def test_indent_decision(spark):
    rows = spark.createDataFrame([("他说。”", False), ("未完", True), ("", True), (None, False), ("完！", False)], "last string, indent boolean")
    assert [r[0] for r in rows.select(books.starts_fresh(F.col("last"), F.col("indent"))).collect()] == [True, False, True, False, True]


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml#x" media-type="application/xhtml+xml"/><item id="m" href="gone.xhtml" media-type="text/html"/><item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="b"/><itemref idref="m"/><itemref idref="s"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>A</p><p> </p>\n<ruby>字<rt>じ</rt></ruby>")
        z.writestr("o/b.xhtml", "<p>B</p>")
        z.writestr("o/s.css", "p{\n}")
    (tmp_path / "x.epub").write_bytes(data.getvalue())
    got = {r.name: (r.kind, r.number, r.content, r.missing) for r in epub.read_epub(spark, str(tmp_path)).collect()}
    assert got == {"1.html": ("html", 1, "<p>B</p>", False), "2.html": ("html", 2, None, True), "3.html": ("html", 3, "<p>A</p>字", False), "s.css": ("css", None, "p{}", False)}


def test_sources(spark, tmp_path):
    spark.createDataFrame([("a", "0.9"), ("b", "0.1")], "content string, score string").write.parquet(f"{tmp_path}/web/part")
    assert [r.content for r in cleaning.score_filter(corpora.read_web(spark, f"{tmp_path}/web/part")).collect()] == ["a"]
    spark.range(6).select(F.col("id").cast("string").alias("text")).repartition(3).write.parquet(f"{tmp_path}/wiki")
    files = corpora.list_files(spark, [f"{tmp_path}/wiki", f"{tmp_path}/web", f"{tmp_path}/none"])
    assert {r.label for r in files.collect()} == {"wiki", "web"}
    order = [r.path for r in corpora.interleave(files).collect()]
    assert len(order) == files.count() and order == [r.path for r in corpora.interleave(files).collect()]
    assert corpora.sample_files(files, 2).count() == 2
    assert corpora.read_texts(spark, f"{tmp_path}/wiki").count() == 6
    (tmp_path / "wiki" / "bad.parquet").write_bytes(b"no parquet")
    assert corpora.read_texts(spark, f"{tmp_path}/wiki", tolerant=True).count() == 6
    os.makedirs(tmp_path / "book" / "k")
    for name in ("2", "10", "x"):
        (tmp_path / "book" / "k" / f"{name}.json").write_text(json.dumps({"first_paragraph_has_indent": False, "paragraphs": [{"type": "title", "content": name}]}))
    assert [(r.book, r.page) for r in corpora.read_pages(spark, f"{tmp_path}/book").orderBy("page").collect()] == [("k", 2), ("k", 10)]
    assert corpora.read_pages(spark, f"{tmp_path}/book", 5).count() == 1
    (tmp_path / "done.jsonl").write_text('{"ja_title":"a"}\n\nbroken\n{"ja_title":5}\n{"ja_title":"a"}\n')
    assert [r.ja_title for r in corpora.read_done(spark, f"{tmp_path}/done.jsonl").collect()] == ["a"]
    os.makedirs(tmp_path / "md")
    (tmp_path / "md" / "a.md").write_bytes("é\n".encode() + b"\xff")
    assert corpora.read_markdown(spark, f"{tmp_path}/md").first().text == "é\n"
    with pytest.raises(FileNotFoundError):
        corpora.read_markdown(spark, f"{tmp_path}/book")
    corpora.write_texts(spark.createDataFrame([("a/b", "# x\ny")], "title string, markdown string"), f"{tmp_path}/out")
    assert os.path.isdir(tmp_path / "out" / "name=a_b")
    assert corpora.to_upload(spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("p",)], "path string")).first().path == "q"


def test_incremental_files(spark, tmp_path):
    run = lambda: incremental.run_new_files(spark, f"{tmp_path}/in", "n long", lambda d: d.where("n > 1"), f"{tmp_path}/out", f"{tmp_path}/ck")
    spark.range(4).toDF("n").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.range(10, 12).toDF("n").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_batches_replace(spark, tmp_path):
    spark.range(3).toDF("n").coalesce(1).write.parquet(f"{tmp_path}/in")
    incremental.run_batches(spark, f"{tmp_path}/in", "n long", incremental.replace_batch(f"{tmp_path}/out"), f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"time":"2025-01-02 03:04:05","step":1,"lr":"1e-3","loss":"2.5","grad_norm":"0.1"}\n')
    row = metrics.read_log(spark, f"{tmp_path}/log.jsonl").first()
    assert row.loss == 2.5 and row.lr == 0.001 and row.time.year == 2025
    rows = spark.createDataFrame([(800.0, 1)], "loss double, tokens long")
    assert metrics.weighted_loss(rows).first().ppl == float("inf")
    rows = spark.createDataFrame([("s", 0, 1), ("s", 1, 1), ("s", 2, 0)], "seq string, pos int, mask int")
    assert [r.position_id for r in metrics.position_ids(rows).orderBy("pos").collect()] == [0, 1, 1]


def test_training_and_encoders(spark):
    docs = spark.createDataFrame([("低低低 低低 12",), ("低低 低低\n\nab ab ab ab ab",)], "text string")
    vocab, merges = tokens.train(docs, size=100, least=2)
    assert vocab[:6] == list(tokens.SPECIALS) and ("低", "低") in merges and ("a", "b") in merges and "12" not in vocab
    import public_tokenizers

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    row = docs.select(tokens.file_encoder(spec, 50256)(F.col("text")).alias("ids"), tokens.in_context(spec)(F.lit("中国")).alias("c"), tokens.with_offsets(spec)(F.lit("ab c")).alias("o")).first()
    assert row.ids[-1] == 50256 and row.c and [(x.first, x.past) for x in row.o] == [(0, 2), (2, 4)]


ODD_TEXTS = [
    (1, "The the, THE end."), (2, " \x0b\t "), (3, ""), (4, None), (5, "a\u00a0b\x1fc\u3000中文。\U0001f600x\U00020000y"), (6, "\n.x" * 50), (7, "the"), (8, "İI ſß x1٣"), (None, "end the"), (None, "x"), (9, "a b c"), (9, "d e"),
]


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_encoded_words_of_odd_texts(spark, chunk):
    docs = spark.createDataFrame(ODD_TEXTS, "k int, text string").repartition(3)
    cut = [(r.k, list(r.w)) for r in docs.select("k", tokens.words(F.col("text")).alias("w")).collect() if r.w]
    counts = Counter(w for _, ws in cut for w in ws)
    ids = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())), 1)}
    vocab = tokens.vocabulary(docs)
    assert {r.word: (r.n, r.id) for r in vocab.collect()} == {w: (counts[w], i) for w, i in ids.items()}
    # Texts that share a key are merged by places, and by ids at one place.
    places = defaultdict(list)
    for k, ws in cut:
        places[k] += [(at, ids[w]) for at, w in enumerate(ws)]
    wanted = {k: [i for _, i in sorted(x)] + [0] for k, x in places.items()}
    for given in (None, vocab):
        made = tokens.encode_words(docs, given, "k", chunk=chunk).collect()
        assert len(made) == len(wanted) and {r.k: r.ids for r in made} == wanted
    some = {w: i for w, i in ids.items() if w in ("the", "end", ".")}
    made = tokens.encode_words(docs.where("k < 9"), spark.createDataFrame(list(some.items()), "word string, id int"), "k", eos=-5, chunk=chunk)
    assert {r.k: r.ids for r in made.collect()} == {k: [some[w] for w in ws if w in some] + [-5] for k, ws in cut if k and k < 9 and set(ws) & set(some)}


def test_encoding_shuffles_no_row_for_each_token(spark):
    docs = spark.createDataFrame([(k, "the cat, the dog " * 20) for k in range(50)], "k int, text string")
    plan = tokens.encode_words(docs, tokens.vocabulary(docs), "k")._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan
    # Of the numbering, only the sizes of ranges meet in one task.
    assert "row_number" not in tokens.vocabulary(docs)._jdf.queryExecution().executedPlan().toString()


def test_ngrams_of_short_segments(spark):
    docs = spark.createDataFrame([("一 二三",), ("",), (None,)], "text string")
    assert [(r.term, r.n) for r in ngrams.frequencies(ngrams.han_ngrams(docs)).collect()] == [("二三", 1)]
    assert ngrams.word_ngrams(docs, 3).count() == 0


def test_overlapping_occurrences(spark):
    row = spark.createDataFrame([("aaaa", "aa"), ("b", "aa")], "t string, k string").select(tokens.occurrences(F.col("t"), F.col("k")).alias("o")).collect()
    assert [r.o for r in row] == [[0, 1, 2], []]


def test_fusing(spark):
    rows = spark.createDataFrame([("a", {"k": "v"}, ["l"], "parsed"), ("b", None, ["l"], "parsed"), ("c", {"k": "v"}, ["l"], "parsed")], "title string, infobox map<string,string>, lead array<string>, stage string")
    out = translation.fuse(rows, spark.createDataFrame([("a", '{"lead":["n"]}'), ("b", '{"lead":["n"]}')], "title string, response string"))
    assert {r.title: (r.lead, r.stage) for r in out.collect()} == {"a": (["n"], "fused"), "b": (["l"], "skip_fused"), "c": (["l"], "parsed")}


def test_every_query_has_a_stable_schema(spark):
    for name, q in catalog.queries().items():
        df = q(spark, "/root/testdata/sf0.001")
        assert len(set(df.columns)) == len(df.columns), name


def test_occurrences_of_odd_terms(spark):
    rows = [("ababa", "aba"), ("a\\Eb\\Eb", "\\Eb"), ("x𠮷𠮷y𠮷", "𠮷"), ("", "a"), ("abc", "x"), ("a.c", "."), ("ab", ""), (None, "a"), ("ab" * 20000, "b")]
    made = spark.createDataFrame(rows, "t string, k string").select("t", tokens.occurrences(F.col("t"), F.col("k")).alias("o")).collect()
    for (text, term), row in zip(rows, made, strict=True):
        want = None if text is None else [i for i in range(len(text) + 1) if text.startswith(term, i)]
        assert row.o == want, (text, term)


def test_deeply_nested_pages():
    deep = 3000
    assert articles.clean_html("<div>" * deep + "x" + "</div>" * deep) == "<div>" * deep + "x" + "</div>" * deep
    assert articles.clean_html("<blockquote>" + "<em>" * deep + "x<br>y" + "</em>" * deep + "</blockquote>") == "<blockquote>x<br/>y</blockquote>"


def test_category_levels_end_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), (None, "z")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("a",)], "name string")
    tree = lambda depth: sorted(tuple(r) for r in catalogue.category_tree(edges, roots, depth).collect())
    assert tree(0) == [("a", 0)]
    assert tree(1) == [("a", 0), ("b", 1), ("c", 1)]
    assert tree(50) == [("a", 0), ("b", 1), ("c", 1)]
