"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Each rule compares one statistic of a document with a cutoff of its stratum (language).
Cutoffs come from labelled documents: along a fixed grid, from lenient to strict, an exact
binomial test says whether the rule would reject more than its share of good documents. A grid
is walked in this fixed order, so its tests need no correction among themselves; over rules and
strata the level is divided (Bonferroni), and the limit on false rejections over the rules. So with
probability 1 - DELTA no stratum loses more than ALPHA of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words_of

#: The most good documents, of each stratum, that all rules together may reject.
ALPHA = 0.04
#: The probability that any stratum's limit is exceeded.
DELTA = 0.05
#: Bad documents that a cutoff must reject for each good one that it rejects.
WORTH = 10
#: Rules: statistic in thousandths (larger is worse), and the grid's step; CELLS steps each.
RULES = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", 25),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 25),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", 12),
    "long_words": ("1000 * word_chars div nullif(n_words, 0)", 300),
}
CELLS = 41
MIN_WORDS = 50
MAX_REPEATS = 50  # percent of the words


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more."""

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
        )

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.aggregate(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"],
            )

        return F.when(F.size(w) < 3, 0).otherwise(_let(F.sort_array(windows), positions))

    return _let(words, covered)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, stratum, fp (hash of the text) and the statistics of every whole text. A null text is an empty one; a null or empty lang is the stratum 'unknown'."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\r\x0b\x0c", "") != "")
    return (
        documents.select("doc_id", "lang", text.alias("text"))
        .withColumn("_words", words_of(F.col("text")))
        .select(
            "doc_id",
            F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("stratum"),
            F.xxhash64("text").alias("fp"),
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate("text", " \t\n\r\x0b\x0c", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
            _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        )
        .withColumns({"n_dup_lines": F.col("_lines.dup"), "n_lines": F.col("_lines.n")})
        .drop("_lines")
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words"))
    )


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by 8 so that its error is under 1e-12."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for i in range(1, 9):
        series = series - F.log(n + float(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial in n trials of probability p; 1 where k is not below the mean.

    Terms are summed downwards from k; those left out beyond 40 standard deviations are under 1e-300.
    """
    top = F.exp(_ln_factorial(n.cast("double")) - _ln_factorial(k.cast("double")) - _ln_factorial((n - k).cast("double")) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(
        F.sequence(k.cast("long"), F.greatest(F.lit(1), (k - 50 - 40 * F.sqrt(k)).cast("long")).cast("long"), F.lit(-1).cast("long"))
    )
    total = F.aggregate(
        steps,
        F.struct(top.alias("sum"), top.alias("term")),
        lambda a, j: F.transform(
            F.array(a["term"] * j * (1 - p) / ((n - j + 1) * p)), lambda t: F.struct((a["sum"] + t).alias("sum"), t.alias("term"))
        )[0],
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_false, p_value: the certified cutoff of each rule; no row where none is certified or worth it.

    labels(doc_id, quality) are the holdout: nothing but the choice of cutoffs is learnt from them. Labels that are null, of unknown
    documents or of documents that fail the base rules are left out; equal texts are one trial, that of the smallest doc_id. The grid is fixed, so counts by grid cell, stratum and rule hold all
    that the tests need.
    """
    held = stats.filter(~F.col("base_failed")).join(
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality"), "doc_id"
    )
    trial = F.struct(*[c for c in held.columns if c != "fp"])
    held = held.groupBy("fp").agg(F.min_by(trial, F.struct("doc_id", "quality", "stratum")).alias("t")).select("t.*")
    cells = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(f"least(({value}) div {step}, {CELLS})").alias("cell")) for name, (value, step) in RULES.items()])
    )
    counts = (
        held.select("stratum", "quality", cells.alias("c"))
        .groupBy("stratum", "c.rule", "c.cell")
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    every = counts.select("stratum").distinct()
    grid = every.withColumn("rule", F.explode(F.array(*map(F.lit, RULES)))).withColumn("cell", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(CELLS).cast("long"))))
    filled = grid.unionByName(counts.select("stratum", "rule", "cell"), allowMissingColumns=True).distinct()
    counts = filled.join(counts, ["stratum", "rule", "cell"], "left").fillna(0, ["good", "bad"])
    by = W.partitionBy("stratum", "rule")
    above = by.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    tests = every.agg((F.count(F.lit(1)) * len(RULES)).alias("tests"))
    tested = (
        counts.select("*", F.sum("good").over(by).alias("n_good"), F.sum("good").over(above).alias("n_false"), F.sum("bad").over(above).alias("n_bad"))
        .filter("cell >= 1")
        .withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), ALPHA / len(RULES)))
        .crossJoin(F.broadcast(tests))  # one row
        .withColumn("_passes", F.col("p_value") <= F.lit(DELTA) / F.col("tests"))
        .withColumn("_certified", F.min("_passes").over(above))  # the walk ends at the first failure
        .filter("_certified")
        .withColumn("_gain", F.col("n_bad") - WORTH * F.col("n_false"))
    )
    best = F.max(F.struct("_gain", "cell", "n_good", "n_false", "p_value"))
    return (
        tested.groupBy("stratum", "rule")
        .agg(best.alias("b"))
        .filter("b._gain > 0")
        .select("stratum", "rule", F.col("b.cell").alias("cell"), F.col("b.n_good").alias("n_good"), F.col("b.n_false").alias("n_false"), F.col("b.p_value").alias("p_value"))
    )


def apply_cutoffs(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """stats with kept: false where the base rules fail or any rule reaches its stratum's cutoff."""
    wide = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cell"))
    reached = F.lit(False)
    for name, (value, step) in RULES.items():
        reached = reached | F.coalesce(F.expr(f"least(({value}) div {step}, {CELLS}) >= {name}"), F.lit(False))
    return stats.join(wide, "stratum", "left").withColumn("kept", ~(F.col("base_failed") | reached))


def judge_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics and the verdict of every document; repeated rows are judged each, empty tables give an empty result."""
    stats = materialize(statistics(documents), "quality")
    out = apply_cutoffs(stats, cutoffs(stats, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(name: str) -> str:
    value, step = RULES[name]
    value = value.replace(" div ", " // ")
    return f"least(({value}) // {step}, {CELLS})"


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) AS r(o) GROUP BY doc_id),
s AS (SELECT w.doc_id, stratum, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
stats AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed FROM s),
held AS (SELECT stratum, quality, stats.* EXCLUDE (stratum) FROM stats JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, quality, stats.stratum) = 1),
cells AS ({" UNION ALL ".join(f"SELECT stratum, quality, '{x}' AS rule, {_rule_sql(x)} AS cell FROM held" for x in RULES)}),
strata AS (SELECT DISTINCT stratum FROM held),
grid AS (SELECT stratum, rule, cell FROM strata, (SELECT DISTINCT rule FROM cells), range(1, {CELLS + 1}) AS r(cell)),
walk AS (SELECT g.stratum, g.rule, g.cell, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND c.cell >= g.cell) AS n_false,
  count(*) FILTER (quality = 0 AND c.cell >= g.cell) AS n_bad FROM grid g JOIN cells c ON g.stratum = c.stratum AND g.rule = c.rule GROUP BY ALL),
tested AS (SELECT *, CASE WHEN n_false >= n_good * {ALPHA / len(RULES)} THEN 1.0 ELSE list_sum(list_transform(range(0, n_false + 1), lambda j:
  exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({ALPHA / len(RULES)}) + (n_good - j) * ln(1 - {ALPHA / len(RULES)})))) END
  <= {DELTA} / (SELECT count(*) * {len(RULES)} FROM strata) AS passes FROM walk),
certified AS (SELECT * FROM tested QUALIFY bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY cell DESC)),
chosen AS (SELECT stratum, rule, cell FROM certified WHERE n_bad - {WORTH} * n_false > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY n_bad - {WORTH} * n_false DESC, cell DESC) = 1),
verdict AS (SELECT stats.*, EXISTS (SELECT 1 FROM chosen c WHERE c.stratum = stats.stratum AND CASE c.rule {" ".join(f"WHEN '{x}' THEN {_rule_sql(x)}" for x in RULES)} END >= c.cell) AS hit FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR hit) AS kept FROM verdict
"""
