"""URL verdicts from host rules and a Bloom filter cascade, in DataFrame expressions alone.

The listed keys are host suffixes (a host is listed if it or a parent domain is). The cascade is built over the
corpus's complete key universe: all suffixes of all its hosts. Level 1 encodes the listed keys of the universe; level
2 the unlisted keys that level 1 lets pass; level 3 the listed ones that level 2 lets pass, and so on until a level
errs on no key. Membership is then exact for every key of the corpus: the first level that rejects a key decides, by
its parity. Levels are bit arrays held as literals in the expression, so that no join is needed; their size follows
the list: about 1.44 log2(unlisted / listed) bits a listed key and a few more. Where that is more than MAX_BITS, the
keys are cut into ranges of their hash, each with a cascade of its own that fits; the pages then pass one range after
the other, and what was found so far is written between them.

Cases: a null url, or one without "://", has empty host and path, matches nothing and is allowed, whatever the list.
Repeated rows are judged alike. An empty list or an empty table gives a cascade without levels, which lists nothing;
null and empty keys of the list list nothing either. Keys of the list that no url of the corpus has are left out. Extra
columns are carried along by judge(); columns that have its output's names, in any letter case, are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, Scratch

#: Bits that a cascade may have to be sent with a plan (4 MB).
MAX_BITS = 1 << 25


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """a.b.c: [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def bit_positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing; each level has hash functions of its own."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    # halves of 31 bits, so that no product overflows
    a, b = F.pmod(a, F.lit(1 << 31)), F.pmod(b, F.lit(1 << 31))
    return [F.pmod(a + F.lit(i) * b + F.lit(i * i), F.lit(bits)) for i in range(hashes)]


class Level:
    """One Bloom filter: its number of bits and of hash functions, and its 64-bit words."""

    def __init__(self, number: int, bits: int, hashes: int, words: list[int]):
        self.number, self.bits, self.hashes, self.words = number, bits, hashes, words

    def passes(self, key: Column) -> Column:
        array = F.lit(self.words)
        out = F.lit(True)
        for p in bit_positions(key, self.number, self.bits, self.hashes):
            word = F.element_at(array, (F.floor(p / 64) + 1).cast("int"))
            out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """A filter over the column key of so many rows. Its set bits, not the keys, come to the driver."""
    bits = max(64, -(-int(count * 1.4427 * math.log2(1 / rate)) // 64) * 64)
    hashes = max(1, round(bits / max(count, 1) * 0.6931))
    hashes = min(hashes, 16)
    at = keys.select(F.explode(F.array(*bit_positions(F.col("key"), number, bits, hashes))).alias("p"))
    got = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in got:
        words[r["w"]] = r["v"]
    return Level(number, bits, hashes, words)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            # a key that level n rejects is listed if n is even; one that passes the last level, if their number is odd
            out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def _bits(n_in: int, n_out: int) -> tuple[float, float]:
    """The first level's rate of false positives, and about how many bits a cascade takes."""
    rate = min(0.5, max(n_in / max(n_out, 1) / math.sqrt(2), 1e-9))
    return rate, n_in * 1.4427 * math.log2(1 / rate) + 2 * n_out * rate * 1.4427 + 64 * 8


def build_cascades(universe: DataFrame, listed: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> list[Cascade]:
    """Over the distinct keys of universe (a column key), of which those in listed are encoded: one for each range of
    the keys' hashes (range_of), as many as keep each below max_bits."""
    keys = universe.select("key").distinct()
    both = scratch.save(keys.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))))
    n_in, n_out = both.where("listed").count(), both.where("not listed").count()
    ranges = max(1, math.ceil(_bits(n_in, n_out)[1] / max_bits))
    out = []
    for r in range(ranges):
        part = both if ranges == 1 else both.where(range_of(F.col("key"), ranges) == r)
        inside, outside, levels = part.where("listed"), part.where("not listed"), []
        n_in = inside.count()
        while n_in:
            rate = 0.5 if levels else _bits(n_in, outside.count())[0]
            level = build_level(inside, n_in, len(levels) + 1, rate)
            levels.append(level)
            outside = outside.where(level.passes(F.col("key")))
            inside, outside, n_in = outside, inside, outside.count()  # the next level encodes this one's false positives
        out.append(Cascade(levels))
    scratch.drop(both)
    return out


def range_of(key: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(ranges))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, host, path) rules: the fitting one with the longest host and path, as a struct of rule and verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: list[str] | DataFrame, rules: list[tuple[str, str, str]], url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule's, else block if the host or a parent is listed.
    listed: hosts, as a list or as a frame's first column."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    c = Carried(pages, "host", "path", "rule", "verdict")
    address = F.col(c.at(url)).cast("string")
    base = c.df.select(*c.kept, host_of(address).alias("host"), path_of(address).alias("path"))
    if isinstance(listed, DataFrame):
        blocklist = Carried(listed).df.select(F.lower(F.col("_c0").cast("string")).alias("key"))
    else:
        blocklist = spark.range(1).select(F.explode(F.array(*[F.lit(k.lower()) for k in listed]).cast("array<string>")).alias("key"))
    blocklist = blocklist.where("key <> ''")
    universe = c.df.select(host_of(address).alias("host")).where("host <> ''").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    cascades = build_cascades(universe, blocklist, scratch, max_bits)
    # the empty host is no key of the universe: the cascades may not be asked about it
    asks = lambda cascade, r: F.exists(suffixes(F.col("host")), lambda k: (k != "") & (range_of(k, len(cascades)) == r if len(cascades) > 1 else F.lit(True)) & cascade.contains(k))
    blocked = (F.col("host") != "") & asks(cascades[0], 0)
    for r, cascade in enumerate(cascades[1:], 1):
        before = scratch.save(base.withColumn("_bad", blocked))
        base, blocked = before, F.col("_bad") | ((F.col("host") != "") & asks(cascade, r))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    return c.back(base, "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.when(blocked, "block").otherwise("allow")).alias("verdict"))
