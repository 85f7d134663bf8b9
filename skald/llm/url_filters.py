"""URL filters by a temporal join with dated lists (operator 2).

List events (an entry is added or removed at a time) become validity intervals
[valid_from, valid_to); an as-of join holds every capture against the entries
that were active when it was fetched. An entry is a domain, which covers its
subdomains, or a host with the first steps of a path. Hosts are compared in
lower case, paths as they are; empty steps of a path do not count. The longest
active entry decides, and a block beats an allowance of equal length. All of
it is native DataFrame work.

A capture has a key for every number of labels that some domain of the list
has, and for every number of steps that some path of it has. So the join is an
equality of keys plus the interval, keys that no entry can equal are not made,
and the keys of a url take time in proportion to its length.

Captures are first reduced to the different (url, time) pairs. The intervals
are settled and counted: they are broadcast if there are at most BROADCAST;
beyond that, both sides are shuffled by key and adaptive execution splits hot
hosts.

Defined results: a capture whose url is null or has no host, or whose time is
null, meets no entry and is not blocked; an entry that is added twice stays
active from its first addition; a removal without an addition does nothing;
of an addition and a removal at one time the removal counts last; repeated
captures get equal rows; an empty list blocks nothing; columns of captures
named host, n_active, decided_by or blocked are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skald.llm.common import others, quoted, settle, unused

BROADCAST = 200_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host, null if there is none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def _joined(name: Column, path: Column) -> Column:
    """A host and the steps of a path with single slashes between."""
    return F.regexp_replace(F.concat(name, F.lit("/"), path), "/+$|(/)/+", "$1")


def normal_entry(entry: Column) -> Column:
    """An entry with its host in lower case and without empty steps."""
    name = F.lower(F.substring_index(entry, "/", 1))
    return _joined(name, F.substring(entry, F.length(name) + 1, F.length(entry)))


def url_keys(url: Column, labels: list[int], steps: list[int]) -> Column:
    """The entries that could cover the url, of these numbers of labels (domains) and steps (hosts with a path)."""
    name, own = host(url), _joined(host(url), F.regexp_extract(url, PATH, 1))
    part = lambda text, by, n: F.call_function("substring_index", text, F.lit(by), n)
    n_labels, n_steps = F.size(F.split(name, r"\.")), F.size(F.split(own, "/")) - 1
    domains = F.transform(F.filter(_ints(labels), lambda n: n <= n_labels), lambda n: part(name, ".", -n))
    paths = F.transform(F.filter(_ints(steps), lambda n: n <= n_steps), lambda n: part(own, "/", n + 1))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def intervals(events: DataFrame) -> DataFrame:
    """(entry, list, verdict, valid_from, valid_to) from events (entry, list, verdict, action, at); valid_to is null while open."""
    of = W.partitionBy("entry", "list", "verdict").orderBy("at", "action")  # 'add' before 'remove' at one time
    known = events.filter("entry is not null and at is not null and action in ('add', 'remove')").withColumn("entry", normal_entry(F.col("entry")))
    turns = known.withColumn("before", F.lag("action").over(of)).filter("action <> coalesce(before, 'remove')")
    return turns.withColumn("valid_to", F.lead("at").over(of)).filter("action = 'add'").select("entry", "list", "verdict", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at", most_broadcast: int = BROADCAST) -> DataFrame:
    """captures with host, n_active, decided_by (the longest active entry) and blocked."""
    valid = settle(intervals(events))
    n_steps = F.size(F.split("entry", "/")) - 1
    n_labels = F.when(n_steps == 0, F.size(F.split("entry", r"\.")))
    about = valid.agg(F.count("*").alias("n"), F.collect_set(F.when(n_steps > 0, n_steps)).alias("steps"), F.collect_set(n_labels).alias("labels")).first()
    small = about["n"] <= most_broadcast
    url, time = F.col(quoted(url_col)), F.col(quoted(time_col))
    asked = captures.select(url.alias("u"), time.alias("t")).filter("u is not null and t is not null").distinct()
    keyed = asked.select("u", "t", F.explode(url_keys(F.col("u"), sorted(about["labels"]), sorted(about["steps"]))).alias("entry"))
    met = keyed.join(F.broadcast(valid) if small else valid, "entry").filter("valid_from <= t and (valid_to is null or t < valid_to)")
    weight = F.struct(F.length("entry"), F.when(F.col("verdict") == "block", 1).otherwise(0), "entry")
    found = met.groupBy("u", "t").agg(F.count("*").alias("n_active"), F.max(F.struct(weight.alias("w"), "verdict")).alias("top"))
    u, t, top = unused(captures.columns, "_u", "_t", "_top")
    found = found.select(F.col("u").alias(u), F.col("t").alias(t), F.struct("n_active", F.col("top.w.entry").alias("decided_by"), (F.col("top.verdict") == "block").alias("blocked")).alias(top))
    joined = captures.join(found, (url == F.col(u)) & (time == F.col(t)), "left")
    kept = [F.col(quoted(c)) for c in others(captures.columns, "host", "n_active", "decided_by", "blocked")]
    return joined.select(*kept, host(url).alias("host"), F.coalesce(f"{top}.n_active", F.lit(0).cast("long")).alias("n_active"), F.col(f"{top}.decided_by").alias("decided_by"), F.coalesce(f"{top}.blocked", F.lit(False)).alias("blocked"))
