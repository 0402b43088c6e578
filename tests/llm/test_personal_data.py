"""What the trees add to the strict rules: planted disguises are found, look-alikes are not."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.personal_data import KINDS, find_personal_data, listed_spans

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper".split()


def card(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def wrong_card(rng):
    c = card(rng)
    return c[:-1] + str((int(c[-1]) + 1 + rng.randrange(8)) % 10)


def fours(number, mark):
    return mark.join(number[i:i + 4] for i in range(0, 16, 4))


def tables(n=60, seed=3):
    """Documents with base spans and look-alikes, and planted spans by document."""
    rng = random.Random(seed)
    around = lambda: " ".join(rng.choices(WORDS, k=4))
    base, wrong, planted = [], [], []
    for i in range(n):
        octets = [str(rng.randrange(1, 255)) for _ in range(4)]
        area, line = rng.randrange(100, 999), rng.randrange(1000, 9999)
        a, b, c = rng.choices(WORDS, k=3)
        base += [(f"user{i}.x@mail{i % 7}.example.com", f"{a}.{b}@{c}.org", f"{a}{i}@{b}.net", f"{a}@{b}{i}.{c}.org")[i % 4], ".".join(octets), card(rng), f"+1 ({area}) 555-{line}"]
        wrong += [f"meet{i}@noon", ".".join([str(rng.randrange(256, 999)), *octets[1:]]).replace(".", "[.]"), wrong_card(rng), *([fours(wrong_card(rng), ".")] if i % 12 == 0 else []), f"2024-{i % 12 + 1:02d}-17 12:30",
                  f"invoice {rng.randrange(10**9, 10**10)}", f"order {area}-{line}-{area}", f"{rng.randrange(10**8, 10**9)}"]
        if i % 3 == 0:
            planted += [(0, f"ann{i} (at) host{i % 5} (dot) example (dot) org"), (0, f"bob{i}(at)host(dot)net"), (1, "[.]".join(octets)),
                        (2, fours(card(rng), ".")), (2, fours(card(rng), "/")), (3, f"1 ({area}) 555-{line + 1}"), (3, f"001 ({area}) 555-{line}")]
    text = lambda x: f"{around()} {x} {around()}."
    rows = [text(x) for x in base] + [text(x) for x in wrong]
    return [(i, t) for i, t in enumerate(rows)], [(len(rows) + i, text(x), kind, x) for i, (kind, x) in enumerate(planted)]


@pytest.fixture(scope="module")
def judged(spark):
    rows, planted = tables()
    df = spark.createDataFrame(rows + [p[:2] for p in planted], "doc_id long, text string")
    return rows, planted, df, {r.doc_id: r for r in find_personal_data(df).collect()}


def test_disguised_spans_are_added_and_look_alikes_are_not(judged):
    rows, planted, _, got = judged
    added = {(i, s.kind, s.start, s.end) for i, r in got.items() for s in r.added}
    wanted = {(i, kind, t.index(x), t.index(x) + len(x)) for i, t, kind, x in planted}
    assert len(added & wanted) >= 0.9 * len(wanted), wanted - added
    assert len(added & wanted) >= 0.95 * len(added), added - wanted
    for kind in range(len(KINDS)):
        assert {a for a in added & wanted if a[1] == kind}


def test_spans_do_not_depend_on_partitions(spark, judged):
    _, _, df, got = judged
    again = listed_spans(find_personal_data(df.repartition(7, F.rand(1)))).collect()
    assert {r.doc_id: r.spans for r in again} == {r.doc_id: r.spans for r in listed_spans(find_personal_data(df.coalesce(1))).collect()}


def test_base_spans_alone_teach_nothing(spark):
    rows, _ = tables(10)
    df = spark.createDataFrame(rows[:40], "doc_id long, text string")
    assert all(not r.added for r in find_personal_data(df).collect())


def test_a_very_long_text(spark, judged):
    rows, planted, _, _ = judged
    long = " ".join(t for _, t in rows * 3) + " alder" * 200_000
    (r,) = find_personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert r.n_email == 60 * 3 and len(r.base) == 4 * 60 * 3
