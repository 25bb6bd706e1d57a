"""Source formats as column expressions over fetched text: feeds, sitemaps, papers, front matter, posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 25
_BARE = r"<(/?)(?:\w+:)?(\w+)(?:\s+xmlns(?::\w+)?=\"[^\"]*\")*"  # namespace prefixes and declarations


def _plain(xml: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(xml, r"<\?[^>]*\?>", ""), _BARE, "<$1$2")


def parse_feed(docs: DataFrame, xml: str, most: int = MOST_ENTRIES) -> DataFrame:
    """docs' other columns with pos, title, link, published and content of each RSS or Atom entry."""
    tidy = docs.withColumn("_x", _plain(F.col(xml)))
    item = "struct<title:string,link:string,pubDate:string,description:string>"
    entry = "struct<title:string,link:array<struct<_href:string>>,published:string,updated:string,summary:string,content:string>"
    atom = F.col("_x").rlike(r"^\s*<feed")
    rss = F.from_xml("_x", F.lit(f"channel struct<item:array<{item}>>"))["channel"]["item"]
    atoms = F.from_xml("_x", F.lit(f"entry array<{entry}>"))["entry"]
    one = lambda t, k, p, c: F.struct(t.alias("title"), k.alias("link"), p.alias("published"), c.alias("content"))
    from_rss = F.transform(rss, lambda i: one(i["title"], i["link"], i["pubDate"], i["description"]))
    from_atom = F.transform(atoms, lambda e: one(e["title"], F.get(e["link"], F.lit(0))["_href"], F.coalesce(e["published"], e["updated"]), F.coalesce(e["content"], e["summary"])))
    entries = F.slice(F.when(atom, from_atom).otherwise(from_rss), 1, most)
    kept = [c for c in docs.columns if c != xml]
    return tidy.select(*kept, F.posexplode(entries).alias("pos", "_e")).select(*kept, "pos", "_e.*")


def parse_sitemap(docs: DataFrame, xml: str, prefix: str) -> DataFrame:
    """(loc, lastmod) of the pages under a prefix, once each."""
    urls = F.from_xml(_plain(F.col(xml)), F.lit("url array<struct<loc:string,lastmod:string>>"))["url"]
    return docs.select(F.explode(urls).alias("u")).select(F.trim("u.loc").alias("loc"), "u.lastmod").where(F.col("loc").startswith(prefix)).dropDuplicates(["loc"])


def child_sitemaps(docs: DataFrame, xml: str) -> DataFrame:
    """(loc) of the sitemaps that an index names; callers fetch them and go down level by level."""
    maps = F.from_xml(_plain(F.col(xml)), F.lit("sitemap array<struct<loc:string>>"))["sitemap"]
    return docs.select(F.explode(maps).alias("m")).select(F.trim("m.loc").alias("loc"))


def render_paper(title: Column, authors: Column) -> Column:
    """A paper as a deterministic text document."""
    return F.concat(F.lit("title: "), title, F.lit("\nauthors: "), F.array_join(authors, "; "))


def authors_line(text: Column) -> Column:
    """Names of the first 'authors: ' line; null without one."""
    line = F.regexp_extract(text, r"(?m)^authors: (.*)$", 1)
    return F.when(text.rlike(r"(?m)^authors: "), F.filter(F.transform(F.split(line, ";"), lambda a: F.trim(a)), lambda a: a != ""))


def front_matter(docs: DataFrame, raw: str) -> DataFrame:
    """docs with meta map<string,string> and body of text under a --- header."""
    head = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)
    body = F.when(F.col(raw).rlike(r"(?s)^---\n.*?\n---"), F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)).otherwise(F.col(raw))
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1)))
    values = F.transform(pairs, lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1)))
    return docs.withColumn("meta", F.map_from_arrays(keys, values)).withColumn("body", body)


def truthy(c: Column) -> Column:
    """Booleans that arrive as text."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def cache_key(text: Column, version: int, model: str) -> Column:
    return F.concat(F.substring(F.sha2(text, 256), 1, 16), F.lit(f":v{version}:{model}"))


def hydrated(body: Column, *others: Column) -> Column:
    """The longest of the candidate bodies; the first wins ties."""
    out = body
    for o in others:
        out = F.when(F.length(F.coalesce(o, F.lit(""))) > F.length(F.coalesce(out, F.lit(""))), o).otherwise(out)
    return out
