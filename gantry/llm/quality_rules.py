"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every text gets fixed measurements.  A rule rejects texts whose measurement is above a
cutoff from a grid fixed in advance.  Cutoffs are set per stratum (language) on its n good labelled rows, as
a tolerance region of statistically equivalent blocks (Tukey): whatever the distribution, the share of good texts
beyond k successive cuts, each at the largest remaining value of a measurement, has the law Beta(k, n - k + 1).  So k cuts
reject more than ``risk`` of the good with probability P(Binomial(n, risk) <= k - 1), the exact
(Clopper-Pearson) bound, for all rules together and without a correction for rules or cutoffs; the largest k for which it
is at most ``delta`` over the number of strata is taken.  So with probability 1 - ``delta`` no stratum loses more
than ``risk`` of its good texts to the rules.

Cuts are dealt to the rules in turn, in the fixed order of ``RULES``, so that a
rule with m of them has the lowest cutoff that fewer than m good rows exceed, and an odd text only costs the rules that it is odd
by.  Ties, rounding up to the grid and counting rows that other rules have cut already only make cutoffs higher than the bound asks for.
A stratum with fewer cuts than rules gets cutoffs for the first of them only, one with too few good rows for one cut gets none.

The law asks for independent rows, so a trial is a distinct text: copies, and rows of one id, count once.  Near copies still count
one by one; where they abound, deduplicate first.

Defined cases: null text has no words.  A null language is a stratum of its own, and one
without labels gets no cutoffs.  Of contradicting labels of a ``doc_id`` or a text the lowest counts.
Repeated rows are judged alike.  Other columns are not read.  Measurements and cutoffs are
computed and written while the query is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import ASCII_UPPER, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
GRID = (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
RISK = 0.02
DELTA = 0.05
CANDIDATES = 64
# Strata whose cutoffs are sent to all executors; with more, they are joined by a shuffle.
BROADCAST_STRATA = 5_000


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum``, the counts of the base rules, and each rule's measurement."""
    base = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("lang", F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    split = base.select(
        "doc_id",
        "stratum",
        F.array_remove(F.split(F.translate("text", BLANKS[1:], " " * 5), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(without(F.col("text"), BLANKS)).alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        (F.length("text") - F.length(without(F.col("text"), ASCII_UPPER))).alias("n_upper"),
        (F.length("text") - F.length(without(F.col("text"), "!"))).alias("n_shouts"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )
    # Three-word windows as numbers, place in the low bits and hash in the others, sorted so that equal ones meet.
    keys = split.withColumn("bits", F.length(F.bin(F.size("words").cast("long")))).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    keys = keys.withColumn(
        "keys",
        F.expr(
            "CASE WHEN size(words) < 4 THEN array() ELSE sort_array(transform(sequence(0, size(words) - 3), i ->"
            " shiftleft(shiftright(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), bits), bits) | i)) END"
        ),
    )
    # Whether a window is that before it: 0 no, 1 yes by its words, 2 only by its hash.
    same = " AND ".join(f"get(words, cast(x & mask AS int) + {k}) = get(words, cast(get(keys, j - 1) & mask AS int) + {k})" for k in range(3))
    met = keys.withColumn(
        "met",
        F.expr(f"transform(keys, (x, j) -> CASE WHEN shiftright(x, bits) = shiftright(get(keys, j - 1), bits) THEN CASE WHEN {same} THEN 1 ELSE 2 END ELSE 0 END)"),
    )
    # Places of windows met twice or more.  Where different windows have met, windows are sorted as strings instead.
    as_strings = (
        "array_sort(transform(sequence(0, greatest(size(words) - 3, 0)), i ->"
        " struct(concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2)) AS w, i AS i)))"
    )
    places = met.withColumn(
        "places",
        F.expr(
            "CASE WHEN coalesce(array_max(met), 0) = 0 THEN array()"
            " WHEN array_max(met) = 1 THEN sort_array(array_compact(transform(keys, (x, j) ->"
            " CASE WHEN get(met, j) = 1 OR get(met, j + 1) = 1 THEN cast(x & mask AS int) END)))"
            f" ELSE sort_array(array_compact(aggregate(array({as_strings}), cast(array() AS array<int>), (a, windows) -> transform(windows, (x, j) ->"
            " CASE WHEN x.w = get(windows, j - 1).w OR x.w = get(windows, j + 1).w THEN x.i END)))) END"
        ),
    )
    counted = places.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(transform(places, (p, j) -> least(3, coalesce(get(places, j + 1) - p, 3))), 0L, (a, x) -> a + x)"
        ).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_upper",
        "n_shouts",
        "digest",
    )
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    return counted.select(
        "doc_id", "stratum", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("n_upper", "word_chars").alias("capitals"),
        share("n_shouts", "n_words").alias("shouts"),
    )


RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouts")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), for k <= n * p; from the largest term down, in logarithms."""
    k, n = k.cast("double"), n.cast("double")
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    within = lambda j: j.cast("double") <= k
    choose = F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.when(within(j), F.log((n - k + j) / j)).otherwise(0.0))
    terms = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all")),
        lambda a, j: F.struct(
            (a["term"] * _ratio(k, n, j, p, within)).alias("term"),
            (a["all"] + a["term"] * _ratio(k, n, j, p, within)).alias("all"),
        ),
        lambda a: a["all"],
    )
    return F.exp(choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)) + F.log(terms))


def _ratio(k: Column, n: Column, j: Column, p: float, within) -> Column:
    """Of the term of k - j to that of k - j + 1 (0 beyond the first)."""
    at = k - j + 1
    return F.when(within(j), at / (n - at + 1) * ((1 - p) / p)).otherwise(0.0)


def allowed_cuts(counts: DataFrame, risk: float, delta: float) -> DataFrame:
    """``counts`` with the largest number of cuts that holds the risk (of ``CANDIDATES`` near the bound); strata with none go."""
    strata = counts.agg(F.count("*").alias("strata"))
    most = F.floor(F.col("n") * risk)
    least = F.floor(F.greatest(F.lit(0.0), F.col("n") * risk - 8 * F.sqrt(F.col("n") * risk)))
    tried = F.sequence(least, most, F.greatest(F.lit(1).cast("long"), F.floor((most - least) / CANDIDATES)))
    tests = counts.select("stratum", "n").join(F.broadcast(strata)).select("stratum", "strata", "n", F.explode(tried).alias("k"))
    held = tests.filter(binomial_cdf(F.col("k"), F.col("n"), risk) <= F.lit(delta) / F.col("strata"))
    return counts.join(held.groupBy("stratum").agg((F.max("k") + 1).alias("cuts")), "stratum")


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per stratum the lowest cutoff of each rule that holds the risk of all; null where none does.

    ``digest`` tells distinct texts apart; without it each ``doc_id`` is a trial.
    """
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    trial = F.col("digest" if "digest" in features.columns else "doc_id").alias("trial")
    texts = features.select("doc_id", "stratum", trial, *RULES).join(labels, "doc_id").groupBy("stratum", "trial")
    good = texts.agg(*(F.min(r).alias(r) for r in RULES), F.min("quality").alias("quality")).filter("quality = 1")
    counts = good.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)),
    )
    lowest = lambda r, m: F.coalesce(*(F.when(F.col(f"{r}_{i}") < m, F.lit(c)) for i, c in enumerate(GRID)))
    dealt = [F.floor((F.col("cuts") + len(RULES) - 1 - k) / len(RULES)) for k in range(len(RULES))]
    return allowed_cuts(counts, risk, delta).select("stratum", *(lowest(r, m).alias(f"max_{r}") for r, m in zip(RULES, dealt, strict=True)))


def judge(features: DataFrame, limits: DataFrame) -> DataFrame:
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rejected = reduce(lambda a, b: a | b, (F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RULES))
    return features.join(limits, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~rejected).alias("kept"),
        *(F.col(f"max_{r}") for r in RULES),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row per row of ``docs`` with counts, ``base_failed``, ``kept`` and its stratum's cutoffs.

    The measurements are written once: the calibration and the verdicts both read them.
    """
    features = written(measured(docs), "quality")
    return judge(features, written(cutoffs(features, labels, risk, delta), "cutoffs"))


def oracle_sql(risk: float = RISK, delta: float = DELTA) -> str:
    grid = ", ".join(f"({c}::DOUBLE)" for c in GRID)
    limits = ", ".join(
        f"min(c) FILTER (rule = '{r}' AND above < (cuts + {len(RULES) - 1 - k}) // {len(RULES)}) AS max_{r}"
        for k, r in enumerate(RULES)
    )
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) o(k) GROUP BY r),
c AS (
  SELECT r, doc_id, stratum, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM w LEFT JOIN covered USING (r)),
m AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines,
         n_repeat_words / greatest(n_words, 1) AS repeats, n_upper / greatest(word_chars, 1) AS capitals, n_shouts / greatest(n_words, 1) AS shouts FROM c),
l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
good AS (
  SELECT stratum, text, {", ".join(f"min({r}) AS {r}" for r in RULES)} FROM m JOIN l USING (doc_id) GROUP BY stratum, text HAVING min(quality) = 1),
n AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM good GROUP BY stratum),
tried AS (
  SELECT stratum, strata, n, unnest(range(low, most + 1, greatest(1, (most - low) // {CANDIDATES}))) AS k
  FROM (SELECT *, floor(n * {risk})::BIGINT AS most, floor(greatest(0, n * {risk} - 8 * sqrt(n * {risk})))::BIGINT AS low FROM n)),
cdf AS (
  SELECT stratum, strata, k, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM tried) GROUP BY stratum, strata, k),
cuts AS (SELECT stratum, max(k) + 1 AS cuts FROM cdf WHERE p <= {delta} / strata GROUP BY stratum),
v AS (
  SELECT stratum, unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule, unnest([{", ".join(RULES)}]) AS v FROM good),
above AS (SELECT stratum, rule, c, count(*) FILTER (v > c) AS above FROM v, (VALUES {grid}) grid(c) GROUP BY stratum, rule, c),
limits AS (SELECT stratum, {limits} FROM above JOIN cuts USING (stratum) GROUP BY stratum, cuts),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m LEFT JOIN limits USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} > max_{r}, false)" for r in RULES)}) AS kept, {", ".join(f"max_{r}" for r in RULES)}
FROM judged
"""
