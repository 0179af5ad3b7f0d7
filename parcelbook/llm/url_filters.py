"""URL filters by a cascade of Bloom filters: exact membership without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, drop_stored, stored, table

#: Fixed rules of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Fixed words of hosts that the query's list blocks.
LISTED = "casino casinos bet bets pill pills poker loan loans viagra porn xxx".split()
MAX_BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def position(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits))

    def hit(self, key: Column) -> Column:
        """Folded to one literal array by the optimiser."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for i in range(self.hashes):
            at = self.position(key, i)
            out &= F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
        return out


def member(key: Column, levels: list[Level]) -> Column:
    """Whether the key is listed: levels hold listed keys and false positives in turn."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.hit(key) & ~out
    return out


def build(keys: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Cascade over a complete universe (key string, listed boolean).

    Level 1 holds the listed keys, level 2 the unlisted ones that pass level 1, level 3
    the listed ones that pass level 2 and so on until no key passes wrongly, so each key
    of the universe is answered exactly. The first level's rate is chosen so that about
    as many false positives come back as there are listed keys: bits grow with the list
    (times the logarithm of the universe), not with the universe, and are checked
    against ``max_bits`` before anything is collected. Null keys are ignored.
    """
    pool = stored(keys.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    inside, outside = pool.where("listed"), pool.where("not listed")
    levels: list[Level] = []
    n, others = inside.count(), outside.count()
    while n:
        hashes = max(1, round(math.log2(max(2, others / n))))
        bits = max(64, math.ceil(n * hashes / math.log(2)))
        if bits > max_bits:
            raise ValueError(f"{n} keys need {bits} bits, more than {max_bits}: split the list")
        empty = Level((), bits, hashes, len(levels))
        at = F.explode(F.array(*[empty.position(F.col("key"), i) for i in range(hashes)]))
        words = inside.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v"))
        filled = {r.w: r.v for r in words.collect()}
        level = Level(tuple(filled.get(i, 0) for i in range(math.ceil(bits / 64))), bits, hashes, len(levels))
        levels.append(level)
        inside, outside = outside.where(level.hit(F.col("key"))), inside
        n, others = inside.count(), n
    drop_stored(pool)
    return levels


def located(pages: DataFrame) -> DataFrame:
    """(page_id, host, path); both are empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select("page_id", F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, shape, 2).alias("path"))


def candidates(rules: list[tuple[str, str, str]]) -> Column:
    """Every key under which a rule could fit: suffixes of the host with starts of the path."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(path) for _, _, path in rules})
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed_host: Column) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    The longest rule that fits decides; else a host for which ``listed_host`` holds is
    blocked. Rules and listed hosts are the listed keys of one cascade; its universe is
    every key that the pages can ask for. Repeated rows are judged alike.
    """
    places = located(pages)
    known = {host + path: verdict for verdict, host, path in rules}
    # "=" starts a whole host, "/" a rule's key, so that they cannot meet
    asked = places.select("host", F.explode(candidates(rules)).alias("c")).select(F.concat(F.lit("/"), "c").alias("key"), F.col("c").isin(list(known)).alias("listed"))
    hosts = places.select(F.concat(F.lit("="), "host").alias("key"), F.coalesce(listed_host, F.lit(False)).alias("listed"))
    levels = build(asked.unionByName(hosts))
    fits = F.filter(candidates(rules), lambda c: member(F.concat(F.lit("/"), c), levels))
    best = F.array_max(F.transform(fits, lambda c: F.struct(F.length(c).alias("n"), c.alias("rule"))))["rule"]
    verdicts = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    blocked = F.when(member(F.concat(F.lit("="), F.col("host")), levels), "block").otherwise("allow")
    return places.withColumn("rule", best).select("page_id", "host", "path", "rule", F.coalesce(F.get(F.map_values(F.map_filter(verdicts, lambda k, _: k == F.col("rule"))), F.lit(0)), blocked).alias("verdict"))


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every url of ``pages``; hosts that carry a listed word are the method's list."""
    shape = rf"(^|[.-])({'|'.join(LISTED)})([.-]|$)"
    return judge(table(spark, folder, "pages"), RULES, F.col("host").rlike(shape))


QUERIES: dict[str, Query] = {"op9_url_filters": op9_url_filters}
ORACLES = {
    "op9_url_filters": f"""
        with p as (
          select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
        r(verdict, rhost, rpath) as (values {", ".join(str(x) for x in RULES)})
        select page_id, host, path,
          (select arg_max(rhost || rpath, length(rhost || rpath)) from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as rule,
          coalesce((select arg_max(verdict, length(rhost || rpath)) from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
                   case when regexp_matches(host, '(^|[.-])({"|".join(LISTED)})([.-]|$)') then 'block' else 'allow' end) as verdict
        from p"""
}
