"""Quality rules: counts against a plain model, exact bounds, cutoffs per stratum, and odd inputs."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.quality_rules import RULES, controlled_cutoffs, judge_quality, most_lost

SPACE = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, quality int, toxic int, score string"


def counts(text):
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside))


def failed(text):
    n, *_, repeated = counts(text)
    return n < 50 or 100 * repeated > 50 * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in rows], LABELS)


def test_counts_follow_a_plain_model(spark, documents):
    rng = random.Random(11)
    piece = lambda: rng.choice(["a", "b", "c", "é", "#x", "<>", " ", "　z", "😀"]) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b"])
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "\n\nx\nx\n x\nx", *("".join(piece() for _ in range(rng.randrange(90))) for _ in range(60))]
    texts += ["w " * 100_000, " ".join(f"w{i % 70_000}" for i in range(200_000))]  # very long ones
    got = judge_quality(documents(list(enumerate(texts))), labels(spark, [])).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in NAMES) == counts(texts[r.doc_id]) and r.base_failed == failed(texts[r.doc_id]) and r.kept == (not r.base_failed)


@pytest.mark.parametrize("n", [1, 30, 421, 1000, 20_000])
@pytest.mark.parametrize("rate", [0.0125, 0.1])
def test_bounds_are_exact(spark, n, rate):
    chance = 0.003
    p = Fraction(rate)
    total, k = Fraction(0), -1
    term = (1 - p) ** n
    while n <= 1000:
        total += term
        if total > chance:
            break
        k += 1
        term = term * (n - k) / (k + 1) * p / (1 - p)
    else:  # large n by logarithms
        logs = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate)
        k, total = -1, math.exp(logs(0))
        while total <= chance:
            k += 1
            total += math.exp(logs(k + 1))
    got = spark.range(1).select(most_lost(F.lit(n).cast("long"), rate, F.lit(chance))).first()[0]
    assert got == k


def votes(spark, rows):
    return spark.createDataFrame(rows, "stratum string, good boolean, symbols long, long_words long, dup_lines long, repeats long")


def test_cutoffs_are_those_that_exact_bounds_allow(spark):
    rng = random.Random(5)
    rows = [("en", True, 1 if i < 12 else 0, 20, 0, rng.randrange(5)) for i in range(3000)]       # 12 good texts with symbols
    rows += [("en", False, rng.choice([1, 4, 9]), 20, 0, rng.randrange(5)) for _ in range(300)]
    rows += [("es", True, 0, 20, 0, 0)] * 60 + [("es", False, 40, 20, 0, 0)] * 60                  # too few to prove anything
    rows += [("xx", False, 40, 20, 0, 0)] * 10                                                     # no good text at all
    got = [tuple(r) for r in controlled_cutoffs(votes(spark, rows)).collect()]
    assert got == [("en", "symbols", 1, 3000, 12, 300)]
    # With losses above the bound the next cutoff counts, and beyond all none.
    more = [(s, g, 1 if g and i < 40 else b, *rest) for i, (s, g, b, *rest) in enumerate(rows)]
    assert [tuple(r)[2:5] for r in controlled_cutoffs(votes(spark, more)).collect()] == [(4, 3000, 0)]
    assert controlled_cutoffs(votes(spark, rows), lost=0.001).count() == 0


def test_few_strata_lose_more_than_their_share(spark):
    """Of many strata whose good texts are like the bad ones but for a rate near the limit, nearly all are held."""
    rng = random.Random(3)
    lost, strata = 0.05, 40
    rate = 1.1 * lost / len(RULES)  # just above what one rule may lose
    rows = [(f"s{s}", good, int(not good or rng.random() < rate), 0, 0, 0) for s in range(strata) for good in [True] * 1500 + [False] * 200]
    assert controlled_cutoffs(votes(spark, rows), lost=lost).count() <= 1


def clean(i):
    return " ".join(f"w{i}x{k} plain" for k in range(30))


def test_learnt_rules_reject_bad_texts_and_leave_clean_ones(spark, documents):
    noisy = lambda i: " ".join(f"w{i}x{k}##$" for k in range(60))
    rows = [(i, clean(i) if i % 4 else noisy(i), "en", "s") for i in range(1600)] + [(2000 + i, noisy(i + 9000), "fr", "s") for i in range(5)]
    rows += [(None, clean(1), "en", "s"), (None, noisy(5000), "en", "s"), (1, clean(1), "en", "s"), (3000, noisy(5001), None, "s"), (3001, noisy(5002), "", "s")]
    known = [(i, int(i % 4 > 0)) for i in range(1600)] + [(1, None), (None, 0), (2000, 0)]
    got = judge_quality(documents(rows), labels(spark, known)).collect()
    assert len(got) == len(rows)
    kept = {(r.doc_id, r.n_symbols): (r.kept, r.rules) for r in got}
    assert all(kept[i, 0] == (True, []) for i in range(1600) if i % 4) and all(not kept[i, 180][0] and "symbols" in kept[i, 180][1] for i in range(0, 1600, 4))
    assert kept[None, 0] == (True, []) and not kept[None, 180][0]
    assert all(kept[i, 180][0] for i in (*range(2000, 2005), 3000, 3001))  # strata without proof


def test_copies_have_one_vote(spark, documents):
    noisy = " ".join(f"x{k}##$" for k in range(60))
    rows = [(i, clean(0) if i % 4 else noisy, "en", "s") for i in range(2000)]
    got = judge_quality(documents(rows), labels(spark, [(i, int(i % 4 > 0)) for i in range(2000)]))
    assert got.where("kept").count() == 2000


def test_empty_tables(spark, documents):
    assert judge_quality(documents([]), labels(spark, [(1, 1)])).collect() == []
    assert [r.kept for r in judge_quality(documents([(1, clean(1))]), labels(spark, [])).collect()] == [True]
