"""The stages as commands: python -m skald COMMAND ...

Paths are anything Spark reads: local, shared or object stores.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.functions.html import clean_pages
from skald.operators import index, refresh, search, stats
from skald.operators import tokens as K
from skald.sources import interchange as io
from skald.sources.config import Settings
from skald.sources.shipping import ship


def crawl(spark: SparkSession, a: argparse.Namespace) -> None:
    """Merge a table of fetched pages (url, html[, source_name]) into the store; prints the counters."""
    settings = Settings.load(a.config) if a.config else Settings()
    policy = refresh.Policy.of_days(a.min_words if a.min_words is not None else settings.wikipedia.min_words, a.revisit_days if a.revisit_days is not None else settings.wikipedia.revisit_days)
    pages = spark.read.parquet(a.pages)
    named = pages if "source_name" in pages.columns else pages.withColumn("source_name", F.lit("Wikipedia"))
    cleaned = clean_pages(named.withColumn("raw_html", F.col("html")))
    got = cleaned.withColumn("metadata", F.struct("title", F.lit("ru").alias("language"), F.lit(None).cast("array<string>").alias("categories")))
    fetched = refresh.prepared(got)
    at = a.now if a.now is not None else int(time.time())
    store = spark.read.schema(refresh.STORE).parquet(a.store) if a.store else spark.createDataFrame([], refresh.STORE)
    refresh.refresh(store, fetched, at, policy).write.mode("errorifexists").parquet(a.out)
    refresh.action_counts(refresh.decide(store, fetched, at, policy)).show()


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the store's texts as a JSON-lines corpus; ids are the urls' hashes."""
    store = spark.read.schema(refresh.STORE).parquet(a.store)
    io.write_corpus(refresh.export_corpus(store.withColumn("doc_id", F.md5("normalized_url"))), a.out)


def tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tokens and the document index of a corpus."""
    corpus = io.read_corpus(spark, a.corpus)
    began = time.time()
    io.write_tokens(K.tokenize(corpus), f"{a.out}/tokens.tsv")
    io.write_docs_index(K.docs_index(corpus, io.read_tokens(spark, f"{a.out}/tokens.tsv")), f"{a.out}/docs.idx")
    took = time.time() - began
    about = corpus.agg(F.count("*").alias("docs"), (F.sum(F.octet_length("clean_text")) / 1024).alias("kb")).first()
    read = io.read_tokens(spark, f"{a.out}/tokens.tsv").agg(F.count("*").alias("n"), K.mean_length().alias("length")).first()
    print({"documents": about["docs"], "tokens": read["n"], "mean_token_length": read["length"], **K.throughput(read["n"], about["kb"] or 0.0, took)})


def stem(spark: SparkSession, a: argparse.Namespace) -> None:
    """Stems of a token file; prints what was read, written, dropped and changed."""
    tokens = io.read_tokens(spark, a.tokens)
    io.write_tokens(K.stem_tokens(tokens), a.out)
    print(K.stem_counters(tokens).first().asDict())


def zipf(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rank and frequency tables of a token file; without one, stems are preferred to tokens."""
    path, name = (a.tokens, None) if a.tokens else io.choose_tokens(spark, "data/tokens/tokens_stem.tsv", "data/tokens/tokens.tsv")
    out = a.out or f"data/{name or 'zipf'}"
    terms = K.term_freq(io.read_token_column(spark, path))
    io.write_zipf(K.zipf(terms), f"{out}/zipf_rank_freq.tsv")
    io.write_top_terms(K.top_terms(terms, a.top), f"{out}/zipf_terms_top.tsv")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Forward and inverted index of a corpus; prints the totals."""
    corpus = io.read_corpus(spark, a.corpus, strict=False)
    index.write_index(index.build_index(corpus, analyzer=a.analyzer, stemmed=a.stemmed), f"{a.out}/postings")
    index.write_direct(index.direct_index(corpus), f"{a.out}/direct")
    index.write_about(spark, f"{a.out}/about", analyzer=a.analyzer, stemmed=a.stemmed)
    print(index.index_totals(index.read_index(spark, f"{a.out}/postings"), corpus).first().asDict())


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answer a file of queries, one a line; infix words are read as the index read its texts."""
    postings, direct = index.read_index(spark, f"{a.index}/postings"), index.read_direct(spark, f"{a.index}/direct")
    queries = io.read_queries(spark, a.queries)
    analyze = search.analysis(spark, queries, **index.read_about(spark, f"{a.index}/about"))
    hits = search.search(postings, queries, direct=direct, syntax=a.syntax, semantics=a.semantics, literal_or=a.syntax == "postfix", analyze=analyze)
    found: dict[int, list] = {}
    for r in search.with_documents(hits, direct).orderBy("query_id", "doc_id").toLocalIterator():
        found.setdefault(r["query_id"], []).append(r)
    for i, query in enumerate(queries):
        print(query)
        for r in found.get(i, []):
            print(f"  {r['doc_id']}\t{r['title']}\t{r['url']}")
        if i not in found:
            print("  nothing found")
        print()


def plot(spark: SparkSession, a: argparse.Namespace) -> None:
    """The points of a log-log plot of a rank table; a picture too, where matplotlib is there."""
    points = K.zipf_plot(io.read_zipf(spark, a.zipf))
    io.write_plot(points, f"{a.out}/zipf_plot.tsv")
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return
    rows = K.thinned(points).orderBy("log10_rank").collect()  # PLOTTED points, about
    plt.plot([r["log10_rank"] for r in rows], [r["log10_freq"] for r in rows], label="frequency")
    plt.plot([r["log10_rank"] for r in rows], [r["log10_zipf"] for r in rows], label="C / rank")
    plt.xlabel("log10 rank")
    plt.ylabel("log10 frequency")
    plt.legend()
    plt.savefig(a.picture)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics of a corpus and its tokens as JSON, and printed."""
    row = stats.statistics(io.read_corpus(spark, a.corpus, strict=False), io.read_tokens(spark, a.tokens), io.read_docs_index(spark, a.docs_idx), a.top)
    io.write_statistics(row, f"{a.out}/statistics")
    print(stats.report_text(row.first()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m skald", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        c = commands.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for names, options in arguments:
            c.add_argument(*names.split(), **options)

    flag = lambda name, **options: (name, options)
    command("crawl", crawl, flag("pages"), flag("out"), flag("--store"), flag("--config"), flag("--now", type=int), flag("--min-words", type=int), flag("--revisit-days", type=int))
    command("export", export, flag("store"), flag("out", nargs="?", default="data/corpus.jsonl"))
    command("tokenize", tokenize, flag("corpus"), flag("out"))
    command("stem", stem, flag("tokens", nargs="?", default="data/tokens/tokens.tsv"), flag("out", nargs="?", default="data/tokens/tokens_stem.tsv"))
    command("zipf", zipf, flag("tokens", nargs="?"), flag("out", nargs="?"), flag("top", nargs="?", type=int, default=50))
    command("index", build, flag("corpus", nargs="?", default="data/corpus.jsonl"), flag("out", nargs="?", default="data/index"), flag("--analyzer", choices=["unicode", "ascii"], default="unicode"), flag("--stemmed", action="store_true"))
    command("search", find, flag("queries"), flag("--index", default="data/index"), flag("--syntax", choices=["infix", "postfix"], default="infix"), flag("--semantics", choices=["set", "multiset"], default="set"))
    command("plot", plot, flag("zipf", nargs="?", default="data/zipf/zipf_rank_freq.tsv"), flag("out", nargs="?", default="data/zipf"), flag("--picture", default="zipf.png"))
    command("stats", statistics, flag("--corpus", default="data/corpus.jsonl"), flag("--tokens", default="data/tokens/tokens.tsv"), flag("--docs-idx", default="data/tokens/docs.idx"), flag("--out", default="data/stats"), flag("--top", type=int, default=30))
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"skald {a.command}").getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
