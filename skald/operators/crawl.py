"""Walking category graphs and sitemaps that have been fetched into tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_depths(edges: DataFrame, root: str, max_depth: int) -> DataFrame:
    """node, depth: the least depth at which each category under root is reached, root at 0, by rounds over (parent, child).

    Each round joins only the last round's new nodes and leaves out known ones,
    so cycles end and a dense graph costs its edges once a level.
    """
    spark = edges.sparkSession
    kind = edges.schema["child"].dataType
    start = spark.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth"))
    known, front = start, start
    for depth in range(1, max_depth + 1):
        reached = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = _kept(reached.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def _kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, where a checkpoint folder is set."""
    spark = df.sparkSession
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()


def category_paths(edges: DataFrame, root: str, max_depth: int) -> DataFrame:
    """node, depth of every walk from root (a node comes as often as walks reach it), as one recursive query; for trees."""
    edges.createOrReplaceTempView("_skald_edges")
    root_sql = str(root).replace("'", "''")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE walk(node, depth) AS (
            SELECT '{root_sql}', 0
            UNION ALL
            SELECT CAST(e.child AS STRING), w.depth + 1 FROM walk w JOIN _skald_edges e ON w.node = e.parent WHERE w.depth < {int(max_depth)}
        ) SELECT node, depth FROM walk
    """)


def category_articles(depths: DataFrame, articles: DataFrame, limit: int = 0) -> DataFrame:
    """article, depth: the articles of the walked categories at their least depth; the first limit by (depth, article) if limit is not 0."""
    found = depths.join(articles, depths["node"] == articles["category"]).groupBy("article").agg(F.min("depth").alias("depth"))
    return found.orderBy("depth", "article").limit(limit) if limit else found


def sitemap_urls(xml: Column) -> Column:
    """The locations of a sitemap or a sitemap index, trimmed, without blanks; empty for other or broken XML."""
    location = lambda outer, inner: f'/*[local-name()="{outer}"]/*[local-name()="{inner}"]/*[local-name()="loc"][1]/text()'
    found = F.concat(F.xpath(xml, F.lit(location("urlset", "url"))), F.xpath(xml, F.lit(location("sitemapindex", "sitemap"))))
    return F.when(well_formed(xml), F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"(?U)^\s+|\s+$", "")), lambda u: u != "")).otherwise(F.array().cast("array<string>"))


_ATTRIBUTES = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*"""
_TAG = rf"<(?:/[A-Za-z_][\w:.-]*\s*|[A-Za-z_][\w:.-]*{_ATTRIBUTES}/?)>"
#: Two attributes of one name; characters, and references to them, that no XML may have.
_TWICE = r"""\s([\w:.-]+)\s*=\s*(?:"[^"]*"|'[^']*')(?=(?:[^"']|"[^"]*"|'[^']*')*\s\1\s*=)"""
_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]|&#0*(?:[0-8]|1[124-9]|2\d|3[01]|\d{7,});|&#x0*(?:[0-8BCEFbcef]|1[\dA-Fa-f]|[Dd][89A-Fa-f][\dA-Fa-f]{2}|[\dA-Fa-f]{6,});"


def well_formed(xml: Column) -> Column:
    """Whether the parser can read a sitemap: one root, tags that nest to any depth, by a stack over the tags."""
    xml = F.coalesce(xml, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*>", ""), r"(?s)<!\[CDATA\[.*?\]\]>", "x")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    tags = F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))
    legal = ~xml.rlike(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)") & ~xml.rlike(_ILLEGAL) & ~F.exists(tags, lambda t: t.rlike(_TWICE))
    framed = bare.rlike(r"(?s)^<.*>$") & ~F.contains(F.regexp_replace(bare, _TAG, ""), F.lit("<"))

    def step(s: Column, tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^</?([\w:.-]+)", 1)
        closes, whole = tag.startswith("</"), tag.endswith("/>")
        fits = F.coalesce(F.get(s["open"], F.lit(0)) == name, F.lit(False))
        open_ = F.when(whole, s["open"]).when(closes, F.slice(s["open"], F.lit(2), F.size(s["open"]))).otherwise(F.concat(F.array(name), s["open"]))
        roots = s["roots"] + F.when((F.size(s["open"]) == 0) & ~closes, 1).otherwise(0)
        return F.struct(F.when(s["good"], open_).otherwise(s["open"]).alias("open"), roots.alias("roots"), (s["good"] & (~closes | fits)).alias("good"))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("roots"), F.lit(True).alias("good"))
    nests = F.aggregate(tags, start, step, lambda s: s["good"] & (s["roots"] == 1) & (F.size(s["open"]) == 0))
    return legal & framed & nests


def resolve_sitemaps(maps: DataFrame, root: str) -> DataFrame:
    """url: the pages of a sitemap (maps: url, xml); if any of its locations ends in .xml, all are read as sitemaps in turn."""
    listed = maps.select(F.col("url").alias("map"), sitemap_urls(F.col("xml")).alias("urls"))
    top = listed.filter(F.col("map") == root)
    nested = F.exists("urls", lambda u: u.endswith(".xml"))
    direct = top.filter(~nested).select(F.explode("urls").alias("url"))
    children = top.filter(nested).select(F.explode("urls").alias("map"))
    return direct.union(children.join(listed, "map").select(F.explode("urls").alias("url")))


def allowed(url: Column, prefixes: Iterable[str]) -> Column:
    """Whether a url starts with one of the prefixes."""
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(url, p))
