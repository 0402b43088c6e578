"""The manifest against a plain tree of digests, with hot sources, ties, nulls and tampering."""

import hashlib
import random
import zlib

import pytest

from ledgerline.llm import manifest
from ledgerline.llm.manifest import dataset_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root of a list of digests, and each one's (left, right) on its way up."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(at, min(at + 3, len(nodes))) for at in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for i in spans[k]:
                    paths[i].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        spans = [[i for k in run for i in spans[k]] for run in runs]
        nodes = [H(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def expected(rows):
    """The manifest of rows (doc_id, text, lang, source, n_chars)."""
    by_source, out = {}, []
    for doc_id, text, lang, source, n_chars in rows:
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text),
                                                 leaf(doc_id, source, lang, n_chars, text and text.replace("\n", ""))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    for s, up in zip(order, above):
        for (known, doc_id, own, less), below in zip(sorted(by_source[s]), trees[s][1]):
            path = below + up
            folded = less if known and zlib.crc32(str(doc_id).encode()) % 2 == 0 else own
            for left, right in path:
                folded = H(left, folded, right)
            out.append((doc_id if known else None, s, own, trees[s][0], root, H(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


NAMES = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def table(spark, rows):
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return kept.selectExpr("*", "'x' AS leaf", "'x' AS grp", "1 AS pos", "1 AS n", "'x' AS digest", "'x' AS path")


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 2, 3, 4, 9, 10, 243, 244, 800])
def test_digests_and_proofs_follow_a_plain_tree(spark, many_parts, hot):
    rng = random.Random(hot)
    text = lambda: rng.choice([None, "", "\n", "é\nü\n", "a\nb", "plain", "😀 - 1:x"])
    ids = rng.sample(range(-5, 5000), hot + 60)
    rows = [(i, text(), rng.choice([None, "", "en"]), "hot", rng.choice([None, 3])) for i in ids[:hot]]
    rows += [(i, text(), "de", rng.choice([None, "", "é", "z", "Z", "\U0001f600", "￿"]), 1) for i in ids[hot:]]
    rows += [(i, "q", "en", f"one{i}", 2) for i in range(6000, 6000 + hot % 50)]
    assert got(dataset_manifest(table(spark, rows))) == expected(rows)


def test_several_rounds_of_blocks(spark, many_parts, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rows = [(i, f"t\n{i}", "en", "hot", i) for i in range(500)] + [(i, f"t{i}", "en", f"s{i % 200}", i) for i in range(500, 700)]
    assert got(dataset_manifest(table(spark, rows))) == expected(rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "a\n", None, "s", 1), (4, "a\nb", None, "s", 1), (4, "a\nb", None, "s", 1),
            (4, "other", None, "s", 1), (5, "x" * 2_000_000 + "\n", None, "s", 1)]
    result = dataset_manifest(table(spark, rows))
    assert got(result) == expected(rows)
    assert {r.verified for r in result.where("doc_id is null").collect()} == {True}


def test_one_document_and_none(spark):
    assert got(dataset_manifest(table(spark, [(1, "a", "en", "s", 1)]))) == expected([(1, "a", "en", "s", 1)])
    assert dataset_manifest(table(spark, [])).collect() == []
