"""The filter audit against documents taken through every order one filter at a time, with odd inputs."""

import random
from itertools import permutations

import numpy as np

from ledgerline.llm.filter_audit import audit_documents, audit_filters, survivors

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]


def failing(rows):
    """The letters that each row (doc_id, text, ...) fails."""
    found = []
    for i, text, *_ in rows:
        t = text or ""
        w = words_of(t)
        copies = [j for j, other, *_ in rows if j is not None and i is not None and j < i and (other or "") == t]
        found.append({f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), bool(copies))) if bad})
    return found


def expected(rows, marks):
    """All rows of the audit, by running the documents through each order."""
    bad, out = failing(rows), []
    for part in {r[2] or "" for r in rows}:
        docs = [(f, marks.get(r[0], (0, 0)) if r[0] is not None else (0, 0)) for r, f in zip(rows, bad) if (r[2] or "") == part]
        figures, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                alive = [d for d in alive if f not in d[0]]
                sums[f] += len(gone)
                figures.append((f, (part, "".join(order), step, len(alive), len(gone), redundant, sum(d[0] == {f} for d in docs),
                                    sum(d[1][0] for d in gone), sum(d[1][1] for d in gone))))
        out += [(*row, sums[f]) for f, row in figures]
    return sorted(out)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_audit_follows_documents_through_every_order(spark, documents):
    rng = random.Random(13)

    def text():
        n = rng.choice([0, 1, 150, 199, 200, 230])
        kind = rng.choice(["w", "W", "w#"])
        return " ".join(f"{kind}{rng.randrange(rng.choice([40, 5000]))}" for _ in range(n)) + rng.choice(["", "\n", "\t\x0b "])

    texts = [text() for _ in range(25)]
    rows = [(i, rng.choice([None, "", *texts]), rng.choice([None, "", "en", "de"]), "s") for i in range(120)]
    rows += [(None, texts[0], "en", "s"), (None, texts[0], None, "s"), (None, None, "de", "s"), (3, texts[1], "en", "s"), (3, texts[1], "en", "s"),
             (500, "Long " * 300_000, "en", "s"), (501, "Long " * 300_000, "fr", "s")]
    known = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(100)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1)]
    marks = {}
    for i, q, t in known:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    df = documents(rows).withColumnRenamed("part", "mask")
    got = sorted(tuple(r) for r in audit_documents(df, labels(spark, known)).collect())
    assert got == expected(rows, marks)


def test_a_text_with_many_copies(spark, documents):
    rows = [(i, "same", "en", "s") for i in range(400)] + [(i, f"own {i}", "de", "s") for i in range(400, 420)]
    got = {(r.part, r.filter_order, r.step): r for r in audit_documents(documents(rows), labels(spark, [])).collect()}
    assert got["en", "EABCD", 1].removed == 399 and got["en", "AEBCD", 2].redundant == 399 and got["de", "EABCD", 1].removed == 0
    assert len(got) == 2 * 120 * 5


def test_states_are_those_of_every_subset():
    rng = np.random.default_rng(1)
    masks, weights = np.arange(32), rng.integers(0, 9, (32, 3))
    for subset, state in enumerate(survivors(masks, weights, 5)):
        assert (state == weights[(masks & subset) == 0].sum(axis=0)).all()


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 1, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(cells, "xy").collect()}
    assert got == {("xy", 1): (5, 6, 0, 4, 1, 1, 10), ("xy", 2): (5, 0, 2, 0, 0, 0, 2), ("yx", 1): (9, 2, 0, 0, 1, 1, 2), ("yx", 2): (5, 4, 2, 4, 0, 0, 10)}


def test_empty_tables(spark, documents):
    assert audit_documents(documents([]), labels(spark, [(1, 1, 1)])).collect() == []
