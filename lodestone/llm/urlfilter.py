"""URL filters: host and path rules, and a Bloom filter cascade for listed keys.

The first level of the cascade encodes the listed keys. The second encodes those other keys of the universe that pass
the first by mistake, the third those listed keys that pass the second, and so on until no mistake is left. The first
level that a key fails says whether it is listed, so membership is exact for every key of the universe, without a join.
All steps are DataFrame functions; a level is an array of 64-bit words built by bit_or and used as a constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BITS_PER_KEY, HASHES = 10, 7
# A level of this many keys takes 10 MB. More listed keys are cut into shards, each with a cascade of its own.
SHARD_KEYS = 8_000_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one; of equal lengths the longer host wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        answer = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(rule.fits(host, path), answer).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    words: list[int]
    seed: int

    def has(self, key: Column) -> Column:
        # A constant: the optimizer folds it once, and lookups take constant time.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for bit in _bits(key, self.seed, 64 * len(self.words)):
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            hit = hit & (F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return hit


def _bits(key: Column, seed: int, size: int) -> list[Column]:
    """Positions of a key in a filter of ``size`` bits, from two hashes."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return [F.pmod(F.shiftright(a, 2) + F.shiftright(b, 8) * i, F.lit(size).cast("bigint")) for i in range(HASHES)]


def _level(keys: DataFrame, n: int, seed: int) -> Level:
    """The filter of ``n`` keys. Words are or-ed per task before the shuffle; the driver gets BITS_PER_KEY bits a key."""
    words = max(1, math.ceil(n * BITS_PER_KEY / 64))
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), seed, 64 * words))).alias("bit"))
    set_ = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = dict(set_.collect())
    return Level([found.get(i, 0) for i in range(words)], seed)


def _levels(universe: DataFrame) -> list[Level]:
    """``universe``: distinct (key, listed). Alternates until the last level passes no key of the other side."""
    sides = {True: universe.where("listed"), False: universe.where("not listed")}
    levels, side = [], True
    while n := sides[side].count():
        level = _level(sides[side], n, len(levels) + 1)
        levels.append(level)
        sides[not side] = materialize(sides[not side].where(level.has(F.col("key"))), "cascade")
        side = not side
    return levels


@dataclass(frozen=True)
class Cascade:
    """One list of levels for each shard of keys."""

    shards: list[list[Level]]

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), key), F.lit(len(self.shards))).cast("int")

    @staticmethod
    def _listed(levels: list[Level], key: Column) -> Column:
        out = F.lit(len(levels) % 2 == 1)  # passes all levels
        for i in reversed(range(len(levels))):
            out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with the boolean column ``name``: whether the key is listed. A null key is not.

        With several shards, their rows are marked shard by shard, so that a task holds one shard's filters at a time.
        """
        key = F.coalesce(key, F.lit(""))
        parts = [df if len(self.shards) == 1 else df.where(self._shard(key) == i) for i in range(len(self.shards))]
        marked = [part.withColumn(name, self._listed(levels, key)) for part, levels in zip(parts, self.shards)]
        out = marked[0]
        for part in marked[1:]:
            out = out.unionByName(part)
        return out


def build(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade of ``universe`` (key, listed): every key of the corpus and whether it is listed.

    A key is listed if any of its rows says so; null keys count as empty text. Without listed keys nothing is listed.
    Null keys and repeated rows are allowed; hot keys are merged per task before the shuffle.
    """
    keys = universe.groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.coalesce(F.bool_or("listed"), F.lit(False)).alias("listed"))
    keys = materialize(keys, "universe")
    n = keys.where("listed").count()
    shards = max(1, math.ceil(n / shard_keys))
    if shards == 1:
        return Cascade([_levels(keys)])
    shard = F.pmod(F.xxhash64(F.lit(0), F.col("key")), F.lit(shards)).cast("int")
    return Cascade([_levels(keys.where(shard == i)) for i in range(shards)])


def judge(pages: DataFrame, rules: list[Rule], listed, id: str = "page_id", url: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; null and malformed urls have empty host and path.

    The longest rule that fits decides. Else the cascade does: a page whose key, host and path, is listed gets block,
    any other allow. ``listed`` is a table with the listed keys in its column ``key`` (host and path, the host in lower
    case; nulls and repeats are left out of account), or a function of host and path that gives a boolean column. A listed
    key that no page has does not matter. An empty table gives no rows.
    """
    parts = pages.select(F.col(id).alias("id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    key = F.concat("host", "path")
    if callable(listed):
        universe = parts.select(key.alias("key"), listed(F.col("host"), F.col("path")).alias("listed"))
    else:
        # The only join is that of the corpus' distinct keys with the list, once, to build the filters.
        names = listed.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
        universe = parts.select(key.alias("key")).distinct().join(names.withColumn("listed", F.lit(True)), "key", "left")
    cascade = build(universe, shard_keys)
    out = cascade.mark(parts, key, "listed").withColumn("fit", longest_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
