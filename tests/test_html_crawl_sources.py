"""HTML extraction, category walks, sitemaps and the interchange files."""

from pyspark.sql import functions as F

from skald.functions import html as H
from skald.operators import crawl, index, stats
from skald.operators import tokens as K
from skald.sources import config, interchange

LONG = "Это достаточно длинный абзац текста, чтобы остаться."


def clean(spark, html, url="http://x.org/a", hint=None):
    df = spark.createDataFrame([(html, url, hint)], "html string, url string, hint string")
    return H.clean_pages(df, hint_col="hint").first()


def test_article_rules(spark):
    html = f"""<html><head><meta property="og:title" content=" Заглавие "><title>T — site</title></head><body><div id="content"><h1>{LONG}</h1>
    <p>{LONG}<sup>[1]</sup> [2]</p><p>{LONG} [2]</p><p>коротко</p><p>Нажмите править эту статью прямо сейчас, пожалуйста.</p>
    <table><tr><td><p>{LONG} таблица</p></td></tr></table><li><a href="#">{LONG} ссылка</a></li><h2>1.2 Литература:</h2><p>{LONG} конец</p></div></body></html>"""
    r = clean(spark, html)
    assert r["title"] == "Заглавие"
    assert r["clean_text"] == f"{LONG}\n\n{LONG} ссылка"
    assert r["word_count"] == 15


def test_roots_and_sources(spark):
    wiki = f'<div class="x mw-parser-output"><p>{LONG}</p><div class="navbox"><p>{LONG} нет</p></div></div><p>{LONG} вне</p>'
    assert clean(spark, wiki, "http://ru.wikipedia.org/w")["clean_text"] == LONG
    assert clean(spark, wiki)["clean_text"] == LONG  # known by its markup
    assert clean(spark, f"<body><div><h1>t</h1><p>{LONG}</p></div></body>")["clean_text"] == LONG
    for empty in ("", None, "<p>no body"):
        r = clean(spark, empty)
        assert (r["clean_text"], r["word_count"], r["title"]) == ("", 0, H.UNTITLED)


def test_unclosed_blocks_hold_what_follows():
    found = H.blocks(f"<body><article><p><b>one<br><p>{LONG}</p></article></body>")
    assert found == [("p", f"one {LONG}"), ("p", LONG)]


def test_titles():
    assert H.title("<h1> A <b>b</b></h1>") == "A b"
    assert H.title("<title>Name - site | more</title>") == "Name"
    assert H.title('<meta name="title" content="M">') == "M"
    assert H.title("<p>x") == H.UNTITLED


def test_category_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert {r["node"]: r["depth"] for r in crawl.category_depths(edges, "a", 8).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["node"] for r in crawl.category_depths(edges, "a", 1).collect()} == {"a", "b", "c"}
    walks = [(r["node"], r["depth"]) for r in crawl.category_paths(edges, "a", 2).collect()]
    assert sorted(walks) == [("a", 0), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 2)]
    articles = spark.createDataFrame([("b", "x"), ("d", "x"), ("d", "y"), ("z", "w")], "category string, article string")
    found = crawl.category_articles(crawl.category_depths(edges, "a", 8), articles)
    assert {(r["article"], r["depth"]) for r in found.collect()} == {("x", 1), ("y", 2)}


def test_sitemaps_of_any_depth_and_broken_ones(spark):
    deep = "<urlset>" + "".join(f"<a{i}>" for i in range(40)) + "x" + "".join(f"</a{i}>" for i in reversed(range(40))) + "<url><loc>http://a/1</loc><x:image a='1' b=\"2>3\"/></url></urlset>"
    good = [deep, "<!-- c --><urlset><url><loc><![CDATA[http://a/1]]></loc></url></urlset>\n", '<?xml version="1.0"?><urlset><url><loc>http://a/&#49;</loc></url></urlset>']
    broken = ["<urlset><url><loc>http://a/1</url></loc></urlset>", "<urlset a='1' a='2'><url><loc>http://a/1</loc></url></urlset>", "<urlset><url><loc>http://a/1</loc></url></urlset><urlset/>", "x<urlset/>", "<urlset/>x", "<urlset><url><loc>&#0;</loc></url></urlset>", "<urlset><url><loc>\x01</loc></url></urlset>", "</urlset>", "<urlset><url <loc>http://a/1</loc></url></urlset>", "<urlset><url><loc>&#x1F;</loc></url></urlset>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*good, *broken])], "i int, xml string")
    got = {r["i"]: r["u"] for r in df.select("i", crawl.sitemap_urls(F.col("xml")).alias("u")).collect()}
    assert got == {i: ["http://a/1"] if i < len(good) else [] for i in got}


def test_sitemaps(spark):
    maps = {
        "ok": '<urlset xmlns="http://s"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc><priority>1</priority></url></urlset>',
        "broken": "<urlset><url><loc>http://a/1</loc>", "other": "<rss><url><loc>x</loc></url></rss>", "text": "no xml", "entity": "<urlset><url><loc>a&b</loc></url></urlset>",
    }
    df = spark.createDataFrame(list(maps.items()), "url string, xml string")
    got = {r["url"]: r["u"] for r in df.select("url", crawl.sitemap_urls(F.col("xml")).alias("u")).collect()}
    assert got == {"ok": ["http://a/1", "http://a/2"], "broken": [], "other": [], "text": [], "entity": []}
    assert [r["url"] for r in crawl.resolve_sitemaps(df, "ok").orderBy("url").collect()] == ["http://a/1", "http://a/2"]


def test_files_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "u1", "s", "t", "Биология это наука\n2024"), ("2", "u2", "s", "t", "а")], interchange.CORPUS)
    interchange.write_corpus(corpus, f"{tmp_path}/c")
    (tmp_path / "c" / "more.json").write_text('{"doc_id": "3"}\n\nnot json\n')
    back = interchange.read_corpus(spark, f"{tmp_path}/c")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, corpus.collect()))
    assert interchange.read_corpus(spark, f"{tmp_path}/c", strict=False).count() == 3
    tokens = K.tokenize(corpus)
    docs = K.docs_index(corpus, tokens)
    interchange.write_tokens(tokens, f"{tmp_path}/t")
    interchange.write_docs_index(docs, f"{tmp_path}/d")
    assert sorted(map(tuple, interchange.read_tokens(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, tokens.collect()))
    assert [tuple(r) for r in interchange.read_docs_index(spark, f"{tmp_path}/d").orderBy("doc_id").collect()] == [("1", 0, 4), ("2", len("1\t0\tбиология\n1\t1\tэто\n1\t2\tнаука\n1\t3\t2024\n".encode()), 0)]
    lines = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert lines == "1\t0\tбиология\n1\t1\tэто\n1\t2\tнаука\n1\t3\t2024\n"
    (tmp_path / "odd").write_text("1\t0\tx\r\n1\t\ty\n1\ta\tz\nbad\n\t1\tw\n")
    assert [tuple(r) for r in interchange.read_tokens(spark, f"{tmp_path}/odd").collect()] == [("1", 0, "x")]
    assert sorted(r[0] for r in interchange.read_token_column(spark, f"{tmp_path}/odd").collect()) == ["w", "x", "y", "z"]
    (tmp_path / "oddidx").write_text("1\t0\t5\n2\t0\n3\t0\tx\n")
    assert [tuple(r) for r in interchange.read_docs_index(spark, f"{tmp_path}/oddidx").collect()] == [("1", 0, 5)]
    terms = K.term_freq(tokens)
    interchange.write_zipf(K.zipf(terms), f"{tmp_path}/z")
    assert interchange.read_zipf(spark, f"{tmp_path}/z").count() == terms.count()
    interchange.write_top_terms(K.top_terms(terms, 2), f"{tmp_path}/top")
    (tmp_path / "q").write_text("a b\n\n c\n")
    assert interchange.read_queries(spark, f"{tmp_path}/q") == ["a b", " c"]
    assert interchange.choose_tokens(spark, f"{tmp_path}/t", "x")[1] == "zipf_stem"
    assert interchange.choose_tokens(spark, f"{tmp_path}/none", "x") == ("x", "zipf")


def test_statistics(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "u", " s ", " first ", "один два"), ("2", "u", "", "", "три"), ("3", "u", None, "t", "")], interchange.CORPUS)
    tokens = K.tokenize(corpus)
    row = stats.statistics(corpus, tokens, K.docs_index(corpus, tokens)).first()
    assert row["corpus_from_export"]["sources"] == {"s": 1, "UNKNOWN": 2}
    assert (row["corpus_from_export"]["documents"], row["tokens"]["tokens_total"], row["tokens"]["tokens_per_doc"]["max"]) == (3, 3, 2)
    assert "Tokens: 3" in stats.report_text(row)
    assert [r["title"] for r in stats.sample_titles(corpus).collect()] == ["first", "t"]
    for values, expected in (([], 0), ([10], 10), ([1, 2, 3, 4], 3), (range(1, 101), 95)):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert df.agg(stats.truncated_percentile(F.col("v"), 95)).first()[0] == expected
    interchange.write_statistics(stats.statistics(corpus, tokens, K.docs_index(corpus, tokens)), f"{tmp_path}/s")
    empty = stats.corpus_stats(corpus.limit(0)).first()
    assert list(empty) == [0, 0, 0.0, 0.0, 0.0]


def test_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "Клетка клетки DNA 12"), (2, "клетками"), (2, "клетками dna")], "doc_id long, clean_text string")
    plain = {(r["term"], r["doc_id"]): r["tf"] for r in index.build_index(corpus).collect()}
    assert plain == {("клетка", 1): 1, ("клетки", 1): 1, ("dna", 1): 1, ("12", 1): 1, ("клетками", 2): 2, ("dna", 2): 1}
    stemmed = index.build_index(corpus, stemmed=True)
    assert {(r["term"], r["doc_id"]): r["tf"] for r in stemmed.collect()} == {("клетк", 1): 2, ("dna", 1): 1, ("клетк", 2): 2, ("dna", 2): 1}
    assert {r["term"]: r["doc_ids"] for r in index.nested(stemmed).collect()} == {"клетк": [1, 1, 2, 2], "dna": [1, 2]}
    assert [tuple(r) for r in index.duplicate_ids(corpus).collect()] == [(2, 2)]
    index.write_index(stemmed, f"{tmp_path}/i")
    assert index.read_index(spark, f"{tmp_path}/i").count() == 4


def test_settings():
    s = config.Settings.of({"store": "x", "wikipedia": {"min_words": 600, "odd": 1}, "encyclopedia": {"allowed_prefixes": ["a"]}})
    assert (s.store, s.wikipedia.min_words, s.encyclopedia.allowed_prefixes, s.encyclopedia.min_words) == ("x", 600, ("a",), 500)
