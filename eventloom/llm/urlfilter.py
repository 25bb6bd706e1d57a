"""URL filter over a Bloom filter cascade.

Every key that a corpus can ask for is known: its hosts' last labels, as many as some rule or listed
host has, alone and with path prefixes, each typed by what is asked. A host of any length thus has a
few keys. The
cascade's first filter encodes the listed keys, the second those of the corpus's other keys that
the first lets through, the third the listed keys that the second lets through, and so on until
none is left over. Asking level by level is then exact for every key of the corpus, and needs no
join: the filters are constants of the expression.

The filters' size is checked against MAX_BITS; a longer list is looked up by an equi-join instead.

Edge cases: a null url, or one without '://', has empty host and path, which no rule fits; repeated
rows are judged each; other columns are ignored; an empty list lets everything through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import materialise

MAX_BITS = 1 << 26  # 9 MB at seven bits a byte
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rules asked for, (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# The production block list: sites by name under the example domains.
BLOCKED_SITES = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


@dataclass(frozen=True)
class Level:
    bits: bytes  # seven to a byte, so that a byte is an ASCII character
    size: int
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for at in _positions(key, self.size, self.hashes, self.salt):
            byte = F.ascii(F.substring(F.lit(self.bits), (at / 7).cast("int") + 1, F.lit(1)).cast("string"))
            out = out & (F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), (at % 7 + 1).cast("int"))) != 0)
        return out


def _positions(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(size)) for j in range(hashes)]


def bloom_level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of n distinct keys (column key) that lets others through at this rate."""
    hashes = max(1, round(math.log2(1 / rate)))
    size = max(63, math.ceil(n * hashes / math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), size, hashes, salt))).alias("at"))
    ones = at.groupBy((F.col("at") / 7).cast("int").alias("byte")).agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), (F.col("at") % 7 + 1).cast("int"))).alias("v"))
    bits = bytearray(size // 7 + 1)
    for r in ones.collect():  # at most size / 7 rows, and size is bounded
        bits[r.byte] = r.v
    return Level(bytes(bits), size, hashes, salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].holds(key), out).otherwise(F.lit(i % 2 == 0))
        return out


def build(universe: DataFrame, listed: DataFrame, first_rate: float = 0.01, rate: float = 0.5) -> Cascade | None:
    """The cascade of listed over universe (both: key); None if the list is too long for one."""
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if n * 10 > MAX_BITS:
        return None
    if not n:
        return Cascade(())
    levels = [bloom_level(listed, n, first_rate, 1)]
    through = universe.select("key").where(levels[0].holds(F.col("key")))
    tagged = through.withColumn("own", F.lit(0)).unionByName(listed.withColumn("own", F.lit(1))).groupBy("key").agg(F.max("own").alias("own"))
    inside, outside = listed, materialise(tagged.where("own = 0").select("key"), "cascade")
    while m := outside.count():
        if m * 2 > MAX_BITS:
            return None
        levels.append(bloom_level(outside, m, rate, len(levels) + 1))
        inside, outside = outside, materialise(inside.where(levels[-1].holds(F.col("key"))), "cascade")
    return Cascade(tuple(levels))


def with_parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)})


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The host's last labels, as many as a rule or a listed host may have; the whole host if it has fewer."""
    counts = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<int>")
    return F.array_distinct(F.transform(counts, lambda n: F.call_function("substring_index", host, F.lit("."), -n)))


def _rule_keys(labels: list[int], lengths: list[int]) -> Column:
    """Host suffix and path prefix, for every length of a rule's path that the url's path has."""
    paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(_suffixes(F.col("host"), labels), lambda s: F.transform(paths, lambda p: F.concat(s, p))))


def _label_counts(rules: tuple[tuple[str, str], ...], blocked_hosts: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the rules' hosts have, and how many the listed hosts; a name has 127 at most, so these are few."""
    listed = blocked_hosts.where("host is not null").select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()
    return sorted({r[: r.index("/")].count(".") + 1 for _, r in rules}), sorted(r.n for r in listed)


def _constants(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A column of fixed values that no Python worker has to make."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...], blocked_hosts: DataFrame) -> DataFrame:
    """pages with host, path, rule and verdict; blocked_hosts: (host)."""
    spark: SparkSession = pages.sparkSession
    own = with_parts(pages)
    lengths = sorted({len(r[r.index("/") :]) for _, r in rules})
    typed = lambda kind, keys: F.transform(keys, lambda k: F.concat(F.lit(kind), k))
    in_rules, in_list = _label_counts(rules, blocked_hosts)
    rule_keys = _rule_keys(in_rules, lengths) if lengths else F.array().cast("array<string>")
    asked = own.select(F.explode(F.concat(typed("rule ", rule_keys), typed("block ", rule_keys), typed("host ", _suffixes(F.col("host"), in_list)))).alias("key")).distinct()
    ruled = [f"rule {r}" for _, r in rules] + [f"block {r}" for v, r in rules if v == "block"]
    listed = blocked_hosts.select(F.concat(F.lit("host "), F.translate("host", _UPPER, _UPPER.lower())).alias("key"))
    if ruled:
        listed = listed.unionByName(_constants(spark, ruled, "key"))
    cascade = build(asked, listed)
    if cascade is None:
        return _judge_by_join(own, rules, blocked_hosts, rule_keys, in_list)
    fitting = F.filter(rule_keys, lambda k: cascade.contains(F.concat(F.lit("rule "), k)))
    longest = F.sort_array(F.transform(fitting, lambda k: F.struct((-F.length(k)).alias("n"), (-F.instr(k, "/")).alias("h"), k.alias("k"))))
    out = own.withColumn("rule", F.get(longest, F.lit(0))["k"])
    listed_host = F.exists(_suffixes(F.col("host"), in_list), lambda s: cascade.contains(F.concat(F.lit("host "), s)))
    block = F.when(F.col("rule").isNotNull(), cascade.contains(F.concat(F.lit("block "), F.col("rule")))).otherwise(listed_host)
    return out.withColumn("verdict", F.when(block, "block").otherwise("allow"))


def _judge_by_join(own: DataFrame, rules, blocked_hosts: DataFrame, rule_keys: Column, in_list: list[int]) -> DataFrame:
    """The way beyond MAX_BITS: distinct hosts that have a listed suffix are found by an equi-join."""
    hosts = own.select("host").distinct()
    suffixed = hosts.select("host", F.explode(_suffixes(F.col("host"), in_list)).alias("s"))
    bad = suffixed.join(blocked_hosts.select(F.translate("host", _UPPER, _UPPER.lower()).alias("s")).distinct(), "s").select("host").distinct().withColumn("_bad", F.lit(True))
    verdicts = {r: v for v, r in rules}
    known = F.array(*[F.lit(r) for r in verdicts]) if verdicts else F.array().cast("array<string>")
    fitting = F.filter(rule_keys, lambda k: F.array_contains(known, k))
    longest = F.sort_array(F.transform(fitting, lambda k: F.struct((-F.length(k)).alias("n"), (-F.instr(k, "/")).alias("h"), k.alias("k"))))
    out = own.withColumn("rule", F.get(longest, F.lit(0))["k"]).join(bad, "host", "left")
    block = F.when(F.col("rule").isNotNull(), F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])).otherwise(F.coalesce("_bad", F.lit(False)))
    return out.withColumn("verdict", F.when(block, "block").otherwise("allow")).drop("_bad")


def url_rows(pages: DataFrame) -> DataFrame:
    blocked = _constants(pages.sparkSession, list(BLOCKED_SITES), "host")
    return judge(pages.select("page_id", "url"), RULES, blocked).select("page_id", "host", "path", "rule", "verdict")
