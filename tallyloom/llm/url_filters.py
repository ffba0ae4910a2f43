"""URL rules by a Bloom filter cascade: exact membership of a url's keys in rule lists, without a join and without Python.

The universe is every key that a url of the corpus has: its host's suffixes with its path's prefixes of the rules' lengths.
Level 1 holds the listed keys; level 2 the keys of the universe that level 1 takes by mistake; level 3 the listed ones that
level 2 takes by mistake, and so on until a level makes no mistakes. A key is listed if the number of levels that take it
in a row, from the first on, is odd. This is exact for each key of the universe.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import ascii_lower, discard, fresh_name, kept

#: Bits that a level may have, so that what one pass sends to the executors is small (4 MB a level); a longer rule list is cut
#: into parts by its keys' hashes, and the pages are judged by one part after the other.
MOST_BITS = 1 << 25
#: Fixed by the query: rules as (host and path prefix, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def takes(self, key: Column, salt: int) -> Column:
        words = F.lit(self.words)
        out = F.lit(True)
        for p in positions(key, salt, self.bits, self.hashes):
            out = out & (F.getbit(F.get(words, F.call_function("shiftright", p, F.lit(6)).cast("int")), (p % 64).cast("int")) == 1)
        return out


def positions(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    """The bits of a key: h + i g, of two hashes that depend on the level."""
    h, g = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(-1 - salt)), F.lit(bits))
    return [F.pmod(h + i * g + i * i, F.lit(bits)) for i in range(hashes)]


def bits_for(count: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of so many keys, for about this rate of mistakes."""
    per_key = max(1.0, -math.log(rate) / math.log(2) ** 2)
    bits = 64 * max(1, math.ceil(count * per_key / 64))
    return bits, max(1, round(bits / max(count, 1) * math.log(2))) if count * per_key > 64 else max(1, round(per_key * math.log(2)))


def level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the keys, for about this rate of mistakes. The driver gets its words that aren't 0, of 64 bits each."""
    bits, hashes = bits_for(count, rate)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), salt, bits, hashes))).alias("p"))
    told = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[told["w"].to_numpy()] = told["v"].to_numpy()
    return Level(bits, hashes, words)


def first_rate(count: int, universe_rows: int) -> float:
    """Level 1's rate: such that its mistakes are about as many as the listed keys."""
    return min(0.5, count / (1.4 * max(universe_rows, 1)))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the levels that take it in a row are odd in number."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[n].takes(key, n), out).otherwise(F.lit(n % 2 == 1))
        return out


def cascade(listed: DataFrame, universe: DataFrame, universe_rows: int) -> Cascade:
    """A cascade for the column key of both; universe may repeat keys and is scanned once, for level 1's mistakes.

    Those are about as many as the listed keys, so each level's size is bound by the list.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    levels = [level(listed, n, first_rate(n, universe_rows), 0)]
    wrong = kept(universe.select("key").where(levels[0].takes(F.col("key"), 0)).distinct().join(listed, "key", "left_anti"), "mistakes")
    right = listed
    while (k := wrong.count()):
        own, other = wrong, right
        levels.append(level(own, k, 0.5 if len(levels) < 40 else 0.01, len(levels)))
        right, wrong = own, kept(other.where(levels[-1].takes(F.col("key"), len(levels) - 1)), "mistakes")
    return Cascade(tuple(levels))


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """A url's keys, the longest first (of equal ones that with the longer host): suffixes of at most so many labels of its host, with prefixes of its path of these lengths.

    No rule has more labels or other lengths, so no longer suffix and no other prefix can be one. Each is (key, host).
    """
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: F.length(path) >= x)
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda x: F.struct((-F.length(h) - x).alias("long"), (-F.length(h)).alias("host_long"), F.concat(h, F.substring(path, F.lit(1), x)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(keys), lambda k: k["key"]))


def judged(pages: DataFrame, rules: DataFrame, name: str, *, url: str = "url", default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict in a struct column of that name.

    rules: key (host and path prefix, from the first / on) and verdict (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's. Of the verdicts of a repeated key block wins. A url that no rule fits, a null
    one too, gets the default: the cascade finds none of its keys listed. The driver sees the lengths of the rules' paths.
    """
    rules = rules.select("key", "verdict").where("key is not null and instr(key, '/') > 1").groupBy("key").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.collect_set(F.length("key") - F.instr("key", "/") + 1).alias("lengths"), F.count("*").alias("rules")).first()
    lengths = sorted(shape.lengths or [])
    u = pages.withColumn(name, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    own = F.col(name)
    if not lengths:
        return u.withColumn(name, F.struct(own["host"].alias("host"), own["path"].alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
    keys = u.select(keys_of(own["host"], own["path"], shape.labels, lengths).alias("keys"))
    universe = keys.select(F.explode("keys").alias("key"))
    rows = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = -(-bits_for(shape.rules, first_rate(shape.rules, rows))[0] // most_bits)
    rules, tables = kept(rules, "rules"), []
    u = u.withColumn(name, F.struct(own["host"].alias("host"), own["path"].alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
    for part in range(parts):
        own_part = lambda key: F.pmod(F.hash(key), F.lit(parts)) == part  # noqa: E731, B023
        some = rules.where(own_part(F.col("key")))
        own_keys = universe.where(own_part(F.col("key")))
        listed, blocked = cascade(some, own_keys, -(-rows // parts)), cascade(some.where("verdict = 'block'"), own_keys, -(-rows // parts))
        rule = F.get(F.filter(keys_of(own["host"], own["path"], shape.labels, lengths), lambda k: own_part(k) & listed.holds(k)), F.lit(0))  # noqa: B023
        found = u.withColumn(name, F.struct(own["host"].alias("host"), own["path"].alias("path"), own["rule"].alias("rule"), own["verdict"].alias("verdict"), rule.alias("new")))
        new = own["new"]
        #: Of two rules that fit, both suffixes of the host with the path from its start, the longer one.
        longer = new.isNotNull() & (own["rule"].isNull() | (F.length(new) > F.length(own["rule"])) | ((F.length(new) == F.length(own["rule"])) & (F.instr(new, "/") > F.instr(own["rule"], "/"))))
        verdict = F.when(blocked.holds(new), F.lit("block")).otherwise(F.lit("allow"))
        u = found.withColumn(name, F.struct(own["host"].alias("host"), own["path"].alias("path"), F.when(longer, new).otherwise(own["rule"]).alias("rule"), F.when(longer, verdict).otherwise(own["verdict"]).alias("verdict")))
        if part + 1 < parts:
            tables.append(kept(u, "judged"))
            u = tables[-1]
            discard(*tables[:-1])
            tables = tables[-1:]
    return u


def report(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    return judged(pages.select("page_id", "url"), rules, "_url").select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


def allowed(pages: DataFrame, rules: DataFrame, *, url: str = "url", **options) -> DataFrame:
    """The pages that aren't blocked, as they were."""
    name = fresh_name(pages, "_url")
    return judged(pages, rules, name, url=url, **options).where(F.col(name)["verdict"] != "block").select(*[F.col(f"`{c}`") for c in pages.columns])
