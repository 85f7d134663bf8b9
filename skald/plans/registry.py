"""Queries over the driver's tables, one for each operator, and the DuckDB SQL each equals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.functions import html as H
from skald.functions import text as X
from skald.operators import crawl, index, refresh, search, stats
from skald.operators import tokens as K
from skald.sources import interchange as io
from skald.sources.shared import drop, settle, shared_dir
from skald.sources.tables import table

NOW, AGE = 1_001_000_000, 999_000_000
POLICY = refresh.Policy(min_words=60, revisit_seconds=604_800)
RUSSIAN = (
    "тюлень морское млекопитающее семейства буровато-серая клетка клетки клетками важнейший молодость постоянно учившись организмов организм вид "
    "2024 dna-полимераза ёлка Ёлочный белок белками дыхание размножение животных животными наблюдавшийся пришедшие бегущая написанный написавши "
    "умывшись смеяться смеялась радость гость длинный длинная сильнейший сильнейшие красивее учителями земля землёй семьями чтение читаешь читают "
    "сделана сделано большинство большого зелёная зеленью вода водой птицы птиц лес леса лесов ген гены генов жизнь жизни и я ель кость власть "
    "хвост хвоста древность древнейшее строение строения клеточный клеточная мембранный рибосомами ядерная митохондрии Растение растущие"
).split()


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus records: url from the id, title from the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc://"), F.col("doc_id")).alias("normalized_url"), F.col("source").alias("source_name"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("clean_text"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of documents as a store of some days ago, a seventh of them with other text."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    at = (F.lit(AGE) + F.col("doc_id") % 1000 * 3600).cast("long")
    url = F.concat(F.lit("doc://"), F.col("doc_id"))
    meta = F.struct(F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("language"), F.array("source").alias("categories"))
    values = {"url": url, "normalized_url": url, "source_name": F.col("source"), "raw_html": F.when(F.col("doc_id") % 3 > 0, text), "clean_text": text, "word_count": X.count_words(text), "crawled_at": at, "updated_at": at, "content_hash": F.md5(text), "status": F.when(F.col("doc_id") % 4 == 1, "pending").otherwise("processed"), "metadata": meta}
    return d.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in refresh.STORE])


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages fetched now."""
    d = table(spark, sf_dir, "documents")
    meta = F.struct(F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("language"), F.array("source").alias("categories"))
    return refresh.prepared(d.select(F.concat(F.lit("doc://"), F.col("doc_id"), F.lit("?v=2")).alias("url"), F.col("source").alias("source_name"), F.col("text").alias("raw_html"), F.col("text").alias("clean_text"), meta.cast(refresh.METADATA).alias("metadata")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """world -> regions -> nations -> world again."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.lit("world").alias("parent"), F.col("r_name").alias("child"))
    middle = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    back = nation.select(F.col("n_name").alias("parent"), F.lit("world").alias("child"))
    return top.union(middle).union(back)


def round9(df: DataFrame) -> DataFrame:
    """Doubles rounded to nine places in binary, as DuckDB rounds: a half-up of their shortest decimals differs near a tie."""
    return df.select(*[(F.round(F.col(c) * 1e9) / 1e9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tokenize(spark, sf_dir):
    return K.tokenize(corpus(spark, sf_dir))


def docs_idx(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return K.docs_index(c, K.tokenize(c))


def tokens_per_doc_stats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    counts = c.select("doc_id", F.size(X.tokens(F.col("clean_text"))).cast("long").alias("token_count"))
    return round9(stats.tokens_per_doc_stats(counts))


def terms(spark, sf_dir) -> DataFrame:
    return K.term_freq(K.occurrences(corpus(spark, sf_dir)))


def term_freq(spark, sf_dir):
    return terms(spark, sf_dir)


def zipf(spark, sf_dir):
    return round9(K.zipf(terms(spark, sf_dir)))


def zipf_top(spark, sf_dir):
    return K.top_terms(terms(spark, sf_dir), 50)


def zipf_plot(spark, sf_dir):
    return round9(K.zipf_plot(K.zipf(terms(spark, sf_dir))))


def stem_words(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in RUSSIAN], "word string")
    return words.select("word", X.stem(F.col("word")).alias("stem"))


def stem_zipf_top(spark, sf_dir):
    return K.top_terms(K.stem_freq(terms(spark, sf_dir)), 50)


def stem_counters(spark, sf_dir):
    return K.stem_counters(K.occurrences(corpus(spark, sf_dir)))


def postings(spark, sf_dir):
    return index.build_index(corpus(spark, sf_dir), analyzer="ascii")


def index_totals(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return round9(index.index_totals(index.build_index(c, analyzer="ascii"), c))


def _found(spark, sf_dir, queries, **options) -> DataFrame:
    c = corpus(spark, sf_dir)
    return search.search(index.build_index(c, analyzer="ascii"), queries, direct=index.direct_index(c), **options)


def search_and(spark, sf_dir):
    return _found(spark, sf_dir, ["the of &&"], syntax="postfix", semantics="multiset").select("doc_id", "n")


def search_or(spark, sf_dir):
    return _found(spark, sf_dir, ["la de ||"], syntax="postfix", semantics="multiset", literal_or=True).select("doc_id", "n")


def search_not(spark, sf_dir):
    return _found(spark, sf_dir, ["the and !"], syntax="postfix", semantics="multiset").select("doc_id", "n")


def search_nested(spark, sf_dir):
    return _found(spark, sf_dir, ["(the || der) and || !of && la", "in the !and", "zzzz || of"]).select("query_id", "doc_id")


def search_enriched(spark, sf_dir):
    c = corpus(spark, sf_dir)
    direct = index.direct_index(c)
    return search.with_documents(search.search(index.build_index(c, analyzer="ascii"), ["The && der"], direct=direct), direct).select("doc_id", "title", "url")


def search_algebra(spark, sf_dir):
    p = index.build_index(corpus(spark, sf_dir), analyzer="ascii").filter("term in ('the', 'of', 'and')")
    hits = {t: p.filter(F.col("term") == t).select("doc_id", F.col("tf").alias("n")) for t in ("the", "of", "and")}
    return search.minus_hits(search.or_hits(hits["the"], hits["of"]), search.and_hits(hits["of"], hits["and"]))


def corpus_by_source(spark, sf_dir):
    return stats.by_source(corpus(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return round9(stats.corpus_stats(corpus(spark, sf_dir)))


def sample_titles(spark, sf_dir):
    return stats.sample_titles(corpus(spark, sf_dir))


def token_summary(spark, sf_dir):
    c = corpus(spark, sf_dir)
    counts = c.select("doc_id", F.size(X.tokens(F.col("clean_text"))).cast("long").alias("token_count"))
    s = stats.token_stats(K.occurrences(c), counts, 30)
    return round9(s.select("tokens_total", "tokens_total_from_docs_idx", "avg_token_length_chars", F.explode("top_tokens").alias("t")).select("tokens_total", "tokens_total_from_docs_idx", "avg_token_length_chars", "t.token", "t.freq"))


def raw_store_stats(spark, sf_dir):
    return round9(stats.raw_store_stats(store(spark, sf_dir)))


def store_stats(spark, sf_dir):
    return stats.store_stats(store(spark, sf_dir))


def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("normalized_url"))


def content_hash(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", X.content_hash(F.col("clean_text")).alias("content_hash"))


def unique_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat("source", F.lit("/"), F.col("doc_id") % 50).alias("normalized_url"), F.col("doc_id").alias("updated_at"), F.md5("text").alias("content_hash"))
    return refresh.unique_urls(rows)


def clean_text_norm(spark, sf_dir):
    noisy = F.concat(F.lit("[12] ( "), F.regexp_replace("clean_text", "e", " - e [n 1] , "), F.lit(" )"))
    return corpus(spark, sf_dir).select("doc_id", F.md5(X.clean_text(noisy)).alias("cleaned"))


def word_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", X.count_words(F.col("clean_text")).alias("word_count"))


def headings(spark, sf_dir):
    numbered = F.concat(F.lit(" 1.2.3 "), "title", F.lit(": "))
    return corpus(spark, sf_dir).select("doc_id", X.normalize_heading(numbered).alias("heading"))


def sizes(spark, sf_dir):
    n = F.octet_length("clean_text").cast("double")
    return corpus(spark, sf_dir).select("doc_id", X.human_bytes(n).alias("small"), X.human_bytes(n * 1000000.0).alias("large"))


def export_corpus(spark, sf_dir):
    d = corpus(spark, sf_dir)
    twice = d.union(d.filter("doc_id % 3 = 0")).union(d.filter("doc_id % 10 = 0").withColumn("clean_text", F.lit("")))
    return refresh.export_corpus(twice.withColumn("metadata", F.struct("title")))


def html_clean(spark, sf_dir):
    return H.clean_pages(table(spark, sf_dir, "pages")).select("page_id", "clean_text", "word_count")


def html_title(spark, sf_dir):
    return H.clean_pages(table(spark, sf_dir, "pages")).select("page_id", "title")


def refresh_actions(spark, sf_dir):
    return refresh.action_counts(refresh.decide(store(spark, sf_dir), fetched(spark, sf_dir), NOW, POLICY))


def refresh_store(spark, sf_dir):
    new = refresh.refresh(store(spark, sf_dir), fetched(spark, sf_dir), NOW, POLICY)
    return new.select("url", "normalized_url", "source_name", "word_count", "crawled_at", "updated_at", "content_hash", "status", F.col("metadata.language").alias("language"))


def due_for_revisit(spark, sf_dir):
    return refresh.due_for_revisit(store(spark, sf_dir), NOW, 7).select("normalized_url", "updated_at")


def visit_budget(spark, sf_dir):
    visits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("visit_seq"), (F.col("doc_id") % 3 > 0).alias("is_write"))
    return refresh.within_budget(visits, 300)


def category_walk(spark, sf_dir):
    depths = crawl.category_depths(edges(spark, sf_dir), "world", 8)
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    articles = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias("category"), F.col("c_name").alias("article"))
    return crawl.category_articles(depths, articles)


def category_paths(spark, sf_dir):
    return crawl.category_paths(edges(spark, sf_dir), "world", 5).groupBy("node", "depth").agg(F.count("*").alias("walks"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls as sitemaps of fifty (every fifth of them broken off) and an index of these."""
    located = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024</lastmod></url>"))
    number = F.floor(F.col("page_id") / 50)
    name = F.concat(F.lit("http://maps/"), F.col("k"), F.lit(".xml"))
    pages = table(spark, sf_dir, "pages").select(number.alias("k"), located.alias("x")).groupBy("k").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    maps = pages.select(name.alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.when(F.col("k") % 5 == 4, "").otherwise("</urlset>")).alias("xml"))
    entries = maps.select(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")).alias("x"))
    root = entries.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list("x"), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("root").alias("url"), "xml")
    return maps.union(root)


def sitemap_urls(spark, sf_dir):
    return sitemaps(spark, sf_dir).select(F.col("url").alias("sitemap"), F.explode(crawl.sitemap_urls(F.col("xml"))).alias("url"))


def sitemap_pages(spark, sf_dir):
    return crawl.resolve_sitemaps(sitemaps(spark, sf_dir), "root")


def allowed_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(crawl.allowed(F.col("url"), ["https://m.", "http://t"])).select("page_id", "url")


def source_detection(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("example"), F.lit("wikipedia"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("example.net"), F.lit("bigenc.ru"))).otherwise(F.col("url")).alias("url"))
    hint = F.when(F.col("page_id") % 7 == 0, F.lit("Wikipedia"))
    return pages.select("page_id", X.detect_source(F.col("url"), hint).alias("source"))


CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз")
INFLECTIONS = ["", "ами", "ости", "ившись", "ейшая", "ующий", "ится", "ение", "нность", "ая", "ого", "ь", "ла"]


def stem_cyrillic(spark, sf_dir):
    """The tables' words in Cyrillic letters, each with an ending by its length."""
    word = F.concat(F.translate("term", *CYRILLIC), F.element_at(F.array(*[F.lit(x) for x in INFLECTIONS]), F.length("term") % len(INFLECTIONS) + 1))
    return terms(spark, sf_dir).select(word.alias("word")).distinct().select("word", X.stem(F.col("word")).alias("stem"))


def invalid_text(spark, sf_dir):
    """Every fifth text ends in a byte that is no UTF-8: it has no tokens."""
    c = corpus(spark, sf_dir)
    broken = F.concat(F.encode("clean_text", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    return K.occurrences(c.withColumn("clean_text", F.when(F.col("doc_id") % 5 == 0, broken).otherwise(F.col("clean_text")))).groupBy("doc_id").agg(F.count("*").alias("n"))


def article_rules(spark, sf_dir):
    """Sentences as blocks: every second document has each twice, every third a closing heading after the third sentence."""
    sentence = F.transform(F.split("clean_text", r"\. "), lambda x: F.struct(F.lit("p").alias("tag"), x.alias("text")))
    heading = F.array(F.struct(F.lit("h2").alias("tag"), F.lit(" 7.1 Примечания: ").alias("text")))
    closed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.slice(sentence, 1, 3), heading, F.slice(sentence, 4, 1 << 30))).otherwise(sentence)
    twice = F.when(F.col("doc_id") % 2 == 0, F.flatten(F.transform(closed, lambda b: F.array(b, b)))).otherwise(closed)
    return corpus(spark, sf_dir).select("doc_id", H.article(twice).alias("article"))


def duplicate_ids(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return index.duplicate_ids(c.union(c.filter("doc_id % 4 = 0")).union(c.filter("doc_id % 8 = 0")))


def visited_urls(spark, sf_dir):
    return refresh.visited_urls(store(spark, sf_dir), 1 << 30)


def get_document(spark, sf_dir):
    return refresh.get_document(store(spark, sf_dir), "doc://7?v=3#top").select("url", "content_hash", "status")


def existing_urls(spark, sf_dir):
    return refresh.existing(corpus(spark, sf_dir).select("normalized_url"), store(spark, sf_dir))


def throughput(spark, sf_dir):
    c = corpus(spark, sf_dir)
    n, kb = K.occurrences(c).count(), c.agg((F.sum(F.octet_length("clean_text")) / 1024).alias("kb")).first()["kb"]
    return round9(spark.createDataFrame([K.throughput(n, kb, 2.0)], "kb_per_sec double, us_per_kb double, tokens_per_sec double"))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skald-{name}-{uuid.uuid4().hex}"


def _read_back(spark: SparkSession, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What a reader finds in what a writer wrote; the files are dropped."""
    path = _path(spark, name)
    write(path)
    out = settle(read(path))
    drop(spark, path)
    return out


def corpus_file(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _read_back(spark, "corpus", lambda p: io.write_corpus(c, p), lambda p: io.read_corpus(spark, p))


def corpus_file_lenient(spark, sf_dir):
    """A seventh of the lines are cut off in the middle, another has no text."""
    c = corpus(spark, sf_dir)
    line = F.to_json(F.struct("doc_id", "source_name", F.when(F.col("doc_id") % 7 != 1, F.col("clean_text")).alias("clean_text")))
    line = F.when(F.col("doc_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    return _read_back(spark, "lenient", lambda p: c.select(line.alias("value")).write.text(p), lambda p: io.read_corpus(spark, p, strict=False).select("doc_id", "source_name", F.md5("clean_text").alias("text")))


def corpus_file_literal(spark, sf_dir):
    """Lines with every e escaped, which is no JSON, and with the id as a number or quoted."""
    escaped = F.col("clean_text")
    for plain, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("e", "\\e")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(by))
    quote = F.when(F.col("doc_id") % 2 == 0, '"').otherwise("")
    line = F.concat(F.lit('{"doc_id" : '), quote, "doc_id", quote, F.lit(', "clean_text":  "'), escaped, F.lit('", "doc_id": 0}'))
    return _read_back(spark, "literal", lambda p: corpus(spark, sf_dir).select(line.alias("value")).write.text(p), lambda p: io.read_corpus(spark, p, literal=True).select("doc_id", F.md5("clean_text").alias("text")))


def tokens_file(spark, sf_dir):
    return _read_back(spark, "tokens", lambda p: io.write_tokens(K.tokenize(corpus(spark, sf_dir)), p), lambda p: io.read_tokens(spark, p))


def token_column_file(spark, sf_dir):
    return _read_back(spark, "column", lambda p: io.write_tokens(K.tokenize(corpus(spark, sf_dir)), p), lambda p: K.term_freq(io.read_token_column(spark, p, trimmed=True)))


def stems_file(spark, sf_dir):
    return _read_back(spark, "stems", lambda p: io.write_tokens(K.stem_tokens(K.tokenize(corpus(spark, sf_dir))), p), lambda p: io.read_tokens(spark, p))


def docs_idx_file(spark, sf_dir):
    return _read_back(spark, "docs", lambda p: io.write_docs_index(docs_idx(spark, sf_dir), p), lambda p: io.read_docs_index(spark, p))


def zipf_file(spark, sf_dir):
    return _read_back(spark, "zipf", lambda p: io.write_zipf(K.zipf(terms(spark, sf_dir)), p), lambda p: io.read_zipf(spark, p))


def top_terms_file(spark, sf_dir):
    return _read_back(spark, "top", lambda p: io.write_top_terms(zipf_top(spark, sf_dir), p), lambda p: io.read_top_terms(spark, p))


def query_file(spark, sf_dir):
    """The regions' names as queries with blank lines between."""
    lines = table(spark, sf_dir, "region").select(F.explode(F.array("r_name", F.lit(""), F.lit("  "))).alias("value"))
    return _read_back(spark, "queries", lambda p: lines.write.text(p), lambda p: spark.createDataFrame([(q,) for q in io.read_queries(spark, p)], "query string"))


def index_files(spark, sf_dir):
    return _read_back(spark, "index", lambda p: index.write_index(index.build_index(corpus(spark, sf_dir), analyzer="ascii"), p), lambda p: index.read_index(spark, p))


def direct_files(spark, sf_dir):
    return _read_back(spark, "direct", lambda p: index.write_direct(index.direct_index(corpus(spark, sf_dir)), p), lambda p: index.read_direct(spark, p))


def write_stored(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A stored index of documents, analysed and stemmed."""
    c = corpus(spark, sf_dir)
    index.write_index(index.build_index(c, stemmed=True), f"{path}/postings")
    index.write_direct(index.direct_index(c), f"{path}/direct")
    index.write_about(spark, f"{path}/about", stemmed=True)


def open_stored(spark: SparkSession, path: str) -> Callable[[list[str]], DataFrame]:
    """A stored index to ask: queries to hits with titles, the queries read as the index read its texts."""
    postings, direct, about = index.read_index(spark, f"{path}/postings"), index.read_direct(spark, f"{path}/direct"), index.read_about(spark, f"{path}/about")

    def ask(queries: list[str]) -> DataFrame:
        analyze = search.analysis(spark, queries, **about)
        return search.with_documents(search.search(postings, queries, direct=direct, analyze=analyze), direct)

    return ask


def search_stored(spark, sf_dir):
    ask = lambda p: open_stored(spark, p)(['THE && "Der,"', "that-the || (Der !the)", "a && the"])
    return _read_back(spark, "stored", lambda p: write_stored(spark, sf_dir, p), lambda p: ask(p).select("query_id", "doc_id", "title"))


def statistics_file(spark, sf_dir):
    c = corpus(spark, sf_dir)
    made = stats.statistics(c, K.occurrences(c), docs_idx(spark, sf_dir), 5)
    schema = made.schema
    found = _read_back(spark, "statistics", lambda p: io.write_statistics(made, p), lambda p: spark.read.schema(schema).json(p))
    return round9(found.select("corpus_from_export.documents", "corpus_from_export.clean_text_bytes_total", F.element_at("corpus_from_export.sources", "web").alias("web"), "tokens.tokens_total", "tokens.avg_token_length_chars", "tokens.tokens_per_doc.median", F.element_at("tokens.top_tokens", 1)["token"].alias("first_token")))


QUERIES = (
    tokenize, docs_idx, tokens_per_doc_stats, term_freq, zipf, zipf_top, zipf_plot, stem_words, stem_zipf_top, stem_counters, postings, index_totals,
    search_and, search_or, search_not, search_nested, search_enriched, search_algebra, corpus_by_source, corpus_stats, sample_titles, token_summary,
    raw_store_stats, store_stats, normalize_url, content_hash, unique_urls, clean_text_norm, word_count, headings, sizes, export_corpus, html_clean,
    html_title, refresh_actions, refresh_store, due_for_revisit, visit_budget, category_walk, category_paths, sitemap_urls, sitemap_pages, allowed_urls,
    source_detection, stem_cyrillic, invalid_text, article_rules, duplicate_ids, visited_urls, get_document, existing_urls, throughput, corpus_file,
    corpus_file_lenient, corpus_file_literal, tokens_file, token_column_file, stems_file, docs_idx_file, zipf_file, top_terms_file, query_file, index_files,
    direct_files, search_stored, statistics_file,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
