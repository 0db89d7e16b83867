"""URL filters: rules by host and path, and a cascade of Bloom filters over a key list.

The list holds host labels (`casino-win` lists every host with that label) and the universe is every distinct label of every
host of the corpus. Level 0 of the cascade encodes the listed labels of the universe; the labels that it takes for listed
and are not go into level 1; the listed labels that level 1 takes for such go into level 2, and so on until a level makes no
mistake. Within the universe the answer is exact: the first level that does not hold a key decides. Levels are bitmaps,
built by DataFrame aggregation and put into the plan as constants, so the pages are judged in one scan without a join.

The bitmaps of a cascade are a stated bound, `MOST_BITS` or 64 MB, together (some 50 million listed keys of the universe), since
constants of a size that follows the data have no place in a plan: a longer list raises an error and is not met otherwise.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, settle

#: Rules: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Host labels listed as advertising, gambling, adult, pharmacy and spam.
LISTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
MOST_BITS = 1 << 29
HASHES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what stands between the first :// and the next / ? # or the end, A-Z lower-cased; path: from there to ? # or
    the end. Both are empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits. Rules of equal length: the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _bits(n: int) -> int:
    """Bits of a level for n keys: a power of two, 64 at least, about 6 to 12 bits a key."""
    return 1 << max(6, math.ceil(math.log2(max(1, n) * 6)))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(level), F.lit(k), key).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


def _bitmap(keys: DataFrame, level: int, bits: int) -> bytes:
    """The level's bitmap; at most bits / 64 rows reach the driver."""
    words = (
        keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS INT)))").alias("v"))
    )
    out = bytearray(bits >> 3)
    for r in words.toLocalIterator():
        out[r["w"] * 8 : r["w"] * 8 + 8] = (r["v"] & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(out)


def _holds(key: Column, level: int, bits: int, bitmap: bytes) -> Column:
    """Whether the level holds the key; the bitmap is one constant of the plan, of which a test reads a byte."""
    tests = []
    for p in _places(key, level, bits):
        byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.shiftright(p, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
        tests.append(F.call_function("getbit", byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership of the universe's keys in a list. Keys outside the universe may be taken for either."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
        """listed, universe: (key), universe distinct. ValueError where the bitmaps would exceed most_bits."""
        inside, outside = universe.join(listed, "key", "left_semi"), universe.join(listed, "key", "left_anti")
        encode, other, levels, total = settle(inside, "listed"), settle(outside, "unlisted"), [], 0
        n = encode.count()
        while n:
            bits, level = _bits(n), len(levels)
            total += bits
            if total > most_bits:
                raise ValueError(f"the cascade of {n} keys on level {level} takes more than {most_bits} bits")
            levels.append((bits, _bitmap(encode, level, bits)))
            wrong = settle(other.where(_holds(F.col("key"), level, *levels[-1])), "level")
            encode, other, n = wrong, encode, wrong.count()
        release(encode, other)
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """True for a listed key: the first level that does not hold it is an odd one, or the last level is an even one."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            answer = F.when(_holds(key, level, *self.levels[level]), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def labels_of(host: Column) -> Column:
    return F.array_distinct(F.split(host, r"\."))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a text file of one label a line; blank lines and those that begin with # are none."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("key")).where("key <> '' AND NOT startswith(key, '#')").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The verdict is the longest fitting rule's; without one it is block where a label of the host is listed, else allow.
    listed: (key), from a table or `read_list`, `LISTED` by default; nulls and repeated keys count once or not at all. A null url, or one without ://,
    has an empty host and path and is allowed. Repeated rows stay; columns other than page_id and url are not read.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    universe = rows.select(F.explode(labels_of(F.col("host"))).alias("key")).distinct()
    cascade = Cascade.build(listed.select("key").where("key is not null").distinct(), universe, most_bits)
    rows = rows.withColumn("listed", F.exists(labels_of(F.col("host")), cascade.holds))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages by the rules and the default list; nulls and repeated rows as in `judge`."""
    return judge(load(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
u AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
        list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS listed FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM u
"""
