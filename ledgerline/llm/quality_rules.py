"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import write_down

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, and per cent of words in repeated windows
MOST_LOST = 0.05   # of a stratum's good texts, all rules together
MISTAKE = 0.05     # chance that any cutoff of any stratum loses more than its share
BINS = 50          # cutoffs of a rule; scores beyond the last share it


@dataclass(frozen=True)
class QualityRule:
    """Rejects texts of a high score, the whole part of ``score`` (SQL) by ``per``; cutoffs are ``step`` apart.
    A text for which ``per`` is zero has the score 0."""
    name: str
    score: str
    per: str
    step: int


RULES = (
    QualityRule("symbols", "1000 * n_symbols", "n_words", 20),
    QualityRule("long_words", "100 * word_chars", "n_words", 25),
    QualityRule("dup_lines", "1000 * n_dup_lines", "n_lines", 20),
    QualityRule("repeats", "1000 * n_repeat_words", "n_words", 10),
)


def _repeated_words(windows: Column, sorted_windows: Column) -> Column:
    """How many words lie in windows of three that occur twice; windows sorted by hash stand beside their equals."""
    at = lambda k: F.get(sorted_windows, k)["h"]
    twice = F.filter(sorted_windows, lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(starts, first, lambda a, i: F.struct(
        i.alias("last"), (a["total"] + F.least(F.lit(3), i - a["last"])).alias("total")))["total"]


def text_features(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` reduced to ``kept``, a hash of the text and its counts ``n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words``. Windows are told apart by 64-bit hashes within one text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(WORD))
    words = docs.select(*kept, F.xxhash64(text).alias("text_key"), F.array_remove(F.split(text, SPACE), "").alias("_words"),
                        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    n = F.size("_words")
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    counted = words.select(
        *kept, "text_key", "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("_windows"))
    # Most texts repeat no window, which distinct hashes show without a sort.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = counted.withColumn("_sorted", F.when(some, F.array_sort(placed)))
    repeated = F.coalesce(_repeated_words(F.col("_windows"), F.col("_sorted")), F.lit(0)).cast("long")
    return ordered.withColumn("n_repeat_words", repeated).drop("_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def most_lost(n: Column, rate: float, chance: Column) -> Column:
    """The most losses among ``n`` at which a loss rate above ``rate`` is refuted at level ``chance``: the
    greatest k with P(Binomial(n, rate) <= k) <= chance, exactly, -1 without any. Its terms are added from
    0 on, as far as the mean."""
    odds = math.log(rate / (1 - rate))
    start = F.struct((n * math.log1p(-rate)).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("best"))

    def step(a: Column, j: Column) -> Column:
        total = a["sum"] + F.exp(a["log"])
        return F.struct((a["log"] + F.log((n - j) / (j + 1)) + odds).alias("log"), total.alias("sum"),
                        F.when(total <= chance, j).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * rate).cast("long")), start, step)["best"]


def controlled_cutoffs(votes: DataFrame, rules: Sequence[QualityRule] = RULES, lost: float = MOST_LOST,
                       mistake: float = MISTAKE) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_lost, n_caught`` for rules that have a cutoff in a stratum.

    ``votes`` holds labelled texts: ``stratum``, ``good`` (boolean) and a bin for each rule. A rule may
    lose an equal part of ``lost``, and ``mistake`` is shared by all rules of all strata
    (Bonferroni). Within one, cutoffs are tested from the greatest down until the first that exact
    binomial bounds do not allow (a fixed sequence, which needs no further correction), so with
    probability 1 - ``mistake`` no stratum's rules reject more than ``lost`` of its good texts. Of the
    allowed cutoffs that one counts which catches most bad texts less the good ones it loses; the
    greatest of equal ones, and none if that is not above zero.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("bin")) for r in rules])).alias("b")
    counts = write_down(votes.select("stratum", F.col("good").cast("long").alias("good"), bins)
                        .groupBy("stratum", "b.rule", "b.bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    strata = counts.where(F.col("rule") == rules[0].name).groupBy("stratum").agg(F.sum("good").alias("n_good")).where("n_good > 0")
    tests = max(1, strata.count() * len(rules))
    limits = strata.withColumn("limit", most_lost(F.col("n_good"), lost / len(rules), F.lit(mistake / tests)))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))  # a row a bin
    summed = counts.withColumns({"n_lost": F.sum("good").over(above), "n_caught": F.sum("bad").over(above)})
    allowed = summed.where("bin > 0").join(limits, "stratum").where(F.col("n_lost") <= F.col("limit"))
    gain = F.struct((F.col("n_caught") - F.col("n_lost")).alias("gain"), F.col("bin").alias("cutoff"), "n_good", "n_lost", "n_caught")
    best = allowed.groupBy("stratum", "rule").agg(F.max(gain).alias("best"))
    return best.select("stratum", "rule", "best.*").where("gain > 0").drop("gain")


def _bins(rules: Sequence[QualityRule]) -> dict[str, Column]:
    return {r.name: F.expr(f"coalesce(least({r.score} div nullif({r.per}, 0) div {r.step}, {BINS}), 0)").cast("long") for r in rules}


def judge_quality(docs: DataFrame, labels: DataFrame, rules: Sequence[QualityRule] = RULES, lost: float = MOST_LOST,
                  mistake: float = MISTAKE) -> DataFrame:
    """One row per document: ``doc_id``, the counts of :func:`text_features`, ``base_failed``, ``kept`` and the
    names of the ``rules`` that reject it.

    A text goes that fails a base rule, or whose score reaches the cutoff of a rule in its stratum, its
    ``lang``. Cutoffs come from all labelled texts that pass the base rules, as
    :func:`controlled_cutoffs` has it; nothing else is learnt from labels. A distinct text of a stratum
    has one vote, as copies are no independent evidence, and is good unless one of its labels
    (``doc_id, quality``; null counts for nothing) says 0. A stratum with too few labels to prove
    anything has no cutoffs.

    Null texts are empty: no words, so they fail. Null and empty ``lang`` are one stratum. Rows of
    null ``doc_id`` are judged and have no label; repeated rows are judged each. Empty tables give an empty result, other columns are ignored.
    A text is handled in one row, however long, in memory that grows with its words; a hot stratum
    is counted where its texts are read.
    """
    rows = write_down(text_features(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum")), "doc_id", "stratum")
                      .withColumn("base_failed", base_failed()))
    scored = rows.withColumns(_bins(rules))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    votes = scored.where("not base_failed").join(known, "doc_id").groupBy("stratum", "text_key") \
        .agg((F.min("quality") == 1).alias("good"), *[F.max(r.name).alias(r.name) for r in rules])
    cutoffs = controlled_cutoffs(votes, rules, lost, mistake).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"{r.name}_cutoff") for r in rules])
    hits = F.array_compact(F.array(*[F.when(F.col(r.name) >= F.col(f"{r.name}_cutoff"), r.name) for r in rules]))
    judged = scored.join(write_down(cutoffs), "stratum", "left").withColumn("rules", hits)
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), "rules")


#: The same by plain SQL, for DuckDB, with the parameters of the registered query.
ORACLE_SQL = r"""
WITH texts AS (SELECT text, row_number() OVER () AS text_id, string_split(text, chr(10)) AS lines, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
windows AS (SELECT text_id, unnest(list_zip(range(1, len(words) - 1), words[:-3], words[2:-2], words[3:])) AS w FROM texts WHERE len(words) >= 3),
twice AS (SELECT text_id, unnest(list(w[1])) AS i FROM windows GROUP BY text_id, w[2], w[3], w[4] HAVING count(*) > 1),
covered AS (SELECT text_id, count(DISTINCT i + o) AS n FROM twice, range(3) t(o) GROUP BY text_id),
counts AS (SELECT text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
    len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_unlike, coalesce(n, 0) AS n_repeat
  FROM texts LEFT JOIN covered USING (text_id)),
judged AS (SELECT *, n_lines - n_unlike AS n_dup, n_words < 50 OR 100 * n_repeat > 50 * n_words AS base FROM counts),
bins AS (SELECT text, unnest([{'rule': 'symbols', 'bin': least(1000 * n_symbols // n_words // 20, 50)},
    {'rule': 'long_words', 'bin': least(100 * word_chars // n_words // 25, 50)},
    {'rule': 'dup_lines', 'bin': least(1000 * n_dup // n_lines // 20, 50)},
    {'rule': 'repeats', 'bin': least(1000 * n_repeat // n_words // 10, 50)}], recursive := true) FROM judged WHERE NOT base),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
votes AS (SELECT coalesce(lang, '') AS stratum, d.text, min(quality) AS good FROM documents d JOIN known USING (doc_id)
  JOIN judged j ON coalesce(d.text, '') = j.text WHERE NOT base GROUP BY ALL),
counted AS (SELECT stratum, rule, bin, sum(good) AS good, sum(1 - good) AS bad FROM votes v JOIN bins b ON coalesce(v.text, '') = b.text GROUP BY ALL),
strata AS (SELECT stratum, sum(good) AS n FROM votes GROUP BY stratum HAVING sum(good) > 0),
terms AS (SELECT stratum, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))
    OVER (PARTITION BY stratum ORDER BY j) AS p FROM (SELECT stratum, n, unnest(range(0, 1 + floor(n * 0.0125)::BIGINT)) AS j FROM strata)),
limits AS (SELECT stratum, max(j) AS most FROM terms WHERE p <= 0.05 / (4 * (SELECT count(*) FROM strata)) GROUP BY stratum),
summed AS (SELECT stratum, rule, bin, sum(good) OVER w AS lost, sum(bad) OVER w AS caught FROM counted WINDOW w AS (PARTITION BY stratum, rule ORDER BY bin DESC)),
best AS (SELECT stratum, rule, bin AS cutoff FROM summed JOIN limits USING (stratum) WHERE bin > 0 AND lost <= most AND caught > lost
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - lost DESC, bin DESC) = 1),
gone AS (SELECT DISTINCT stratum, text FROM bins JOIN best USING (rule) WHERE bin >= cutoff)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
  n_repeat::BIGINT AS n_repeat_words, base AS base_failed, NOT base AND g.text IS NULL AS kept
FROM documents d JOIN judged j ON coalesce(d.text, '') = j.text LEFT JOIN gone g ON g.text = j.text AND g.stratum = coalesce(d.lang, '')
"""
