"""URL rules held as a Bloom filter cascade, all in DataFrame and SQL functions.

A rule is a host and the beginning of a path. It fits a URL of that host or of a host below it whose path begins so; a
URL's candidate keys are the ends of its host (by labels) with beginnings of its path, of the shapes (labels, path characters) that rules
have. The first filter of a cascade holds the listed keys; the second those keys of the corpus that the first lets through though they
are not listed; the third the listed keys that the second lets through, and so on, until a filter lets nothing wrong through. For every key of
the corpus the first filter that does not hold it then says whether it is listed, so pages are judged row by row and never joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Bits that a filter has for each key: the first one, which sees the whole corpus, and the others; and bits that a key sets.
FIRST, OTHERS = 16, 6
BITS_OF_A_KEY = 4
#: Bits of a filter at most (16 MB). A list beyond it is held in several cascades, each for its own part of the keys.
MAX_BITS = 2**27

RULE_SCHEMA = "host string, path string, verdict string"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. The host follows the first "://" up to "/", "?", "#" or the end, A to Z in lower case; the path goes on up to "?", "#" or the end. Both are empty for null and without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _word(key: Column, bits: int, salt: int) -> Column:
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")


def mask_of(key: Column) -> Column:
    """The bits that a key sets in its word of a filter, the same in every filter; its words differ."""
    hash_, mask = F.xxhash64(key, F.lit("mask")), F.lit(0).cast("long")
    for k in range(BITS_OF_A_KEY):
        at = F.shiftrightunsigned(hash_, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def _filter_words(keys: DataFrame, bits: int, salt: int) -> DataFrame:
    """One row: words, the filter of keys(key). Bits are gathered by word with partial aggregation; what one task gathers is the filter."""
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    by_word = keys.select(_word(F.col("key"), bits, salt).alias("word"), mask_of(F.col("key")).alias("mask")).unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return by_word.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words"))


@dataclass(frozen=True)
class Level:
    words: DataFrame
    bits: int
    salt: int

    def holds(self, key: Column, mask: Column) -> Column:
        """Whether the filter has all bits of a key set. The filter itself is a scalar subquery, sent to the tasks with the plan."""
        return F.get(self.words.scalar(), _word(key, self.bits, self.salt)).bitwiseAND(mask) == mask


@dataclass(frozen=True)
class Cascade:
    """parts[p]: the levels for the keys whose hash says p."""

    parts: tuple[tuple[Level, ...], ...]

    def listed(self, key: Column, mask: Column | None = None) -> Column:
        """Whether a key of the corpus is listed, false for null; exact for the keys that the cascade was built over. mask: mask_of(key) where it is at hand."""
        mask = mask_of(key) if mask is None else mask
        out = F.lit(False)
        for p, levels in enumerate(self.parts):
            # Behind level i (from 0) lies the answer of the levels after it; an even level that doesn't hold the key says no, an odd one yes.
            answer = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                answer = F.when(levels[i].holds(key, mask), answer).otherwise(F.lit(i % 2 == 1))
            out = answer if len(self.parts) == 1 else F.when(_part(key, len(self.parts)) == p, answer).otherwise(out)
        return key.isNotNull() & out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))


def _size(n: int, per_key: int) -> int:
    return max(64, 1 << (max(n, 1) * per_key - 1).bit_length())


def build_cascade(listed: DataFrame, universe: DataFrame, first: int = FIRST, others: int = OTHERS, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade of listed(key) over universe(key), the corpus's keys, repeated or not.

    Null keys are left out. Keys of the corpus are moved only where they pass the first filter, each once for each task. The first filter has as many bits for a key
    as it takes to let through about as many wrong keys as are listed, so that all filters grow with the list, whatever the corpus.
    """
    spark = listed.sparkSession
    listed = materialize(listed.select("key").filter("key IS NOT NULL").distinct(), "listed")
    total = listed.count()
    ratio = universe.filter("key IS NOT NULL").count() / max(total, 1)
    first = max(first, int(BITS_OF_A_KEY * ratio ** (1 / BITS_OF_A_KEY)))
    n_parts = 1
    while _size(-(-total // n_parts), first) > max_bits:
        n_parts *= 2
    made = []
    for p in range(n_parts):
        mine = lambda df: df if n_parts == 1 else df.filter(_part(F.col("key"), n_parts) == p)
        made.append(_levels(spark, mine(listed), mine(universe.select("key").filter("key IS NOT NULL")), first, others))
    return Cascade(tuple(made))


def _levels(spark: SparkSession, listed: DataFrame, universe: DataFrame, first: int, others: int) -> tuple[Level, ...]:
    levels: list[Level] = []
    inside, outside = listed, None  # the keys that the next filter holds, and those that it must not let through
    left = inside.count()
    while left:
        # From the fifth filter on each has twice the bits for a key, so that few are needed whatever the parameters.
        bits = _size(left, (others if levels else first) << max(0, len(levels) - 3))
        level = Level(materialize(_filter_words(inside, bits, len(levels)), "filter"), bits, len(levels))
        levels.append(level)
        through = lambda df, level=level: df.filter(level.holds(F.col("key"), mask_of(F.col("key"))))
        if outside is None:  # the corpus: what passes, once each, less what is listed
            both = through(universe).select("key", F.lit(False).alias("on")).unionByName(listed.select("key", F.lit(True).alias("on")))
            wrong = both.groupBy("key").agg(F.bool_or("on").alias("on")).filter("NOT on").select("key")
        else:
            wrong = through(outside)
        wrong = materialize(wrong, "through")
        left = wrong.count()
        inside, outside = wrong, inside
    return tuple(levels)


def rule_keys(rules: DataFrame) -> DataFrame:
    """key and verdict of rules (RULE_SCHEMA): the lower-case host with its path. Of rules of one key the block stands; null hosts and paths count as empty."""
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    keyed = rules.select(F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"), (F.col("verdict") == "block").alias("block"))
    return keyed.groupBy("key", "labels", "chars").agg(F.bool_or("block").alias("block"))


def candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """The keys of a URL, one for each of the given shapes: ends of its host with beginnings of its path; null where the URL is too short for the shape."""
    n_labels = F.size(F.split(host, r"\."))
    return [F.when((n_labels >= labels) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars))) for labels, chars in shapes]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the longest rule that fits, and its verdict; without one null and the default.

    Of rules of equal length that fit one URL the one of the longer host stands. A null url has an empty host and path. Repeated rows are rows of their own; an empty
    table gives an empty one. The driver sees the shapes of the rules, fewer than labels of a host times characters of a path, and a page's expression
    grows with them.
    """
    keyed = materialize(rule_keys(rules), "rules")
    shapes = sorted((r.labels, r.chars) for r in keyed.select("labels", "chars").distinct().collect())
    host, path = parts(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return placed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Which keys are rules, over the keys of the corpus; which rules block, over the rules.
    keys = placed.select(F.explode(F.array(*candidates(F.col("host"), F.col("path"), shapes))).alias("key"))
    is_rule, blocks = build_cascade(keyed, keys), build_cascade(keyed.filter("block"), keyed)
    for k, key in enumerate(candidates(F.col("host"), F.col("path"), shapes)):
        placed = placed.withColumn(f"_key{k}", key)
    placed = placed.withColumns({f"_mask{k}": mask_of(F.col(f"_key{k}")) for k in range(len(shapes))})
    fits = []
    for k, (_, chars) in enumerate(shapes):
        key = F.col(f"_key{k}")
        fits.append(F.when(is_rule.listed(key, F.col(f"_mask{k}")), F.struct(F.length(key).alias("n"), (F.length(key) - chars).alias("host_n"), key.alias("rule"))))
    found = placed.select("page_id", "host", "path", F.array_max(F.array(*fits))["rule"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocks.listed(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", verdict)


#: The rules of the query: fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge(pages, pages.sparkSession.createDataFrame(RULES, RULE_SCHEMA))


URL_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM rest),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rule_host, rule_path, verdict)),
fit AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM cut, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (n)
"""
