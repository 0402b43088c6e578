"""Recurring lines against a plain model of the tree, short pages with long footers, and copies."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.queries import ORACLE_SQL, QUERIES

FIELD = "<*>"


def plain(texts, least):
    """The text that stays of each distinct text."""
    lines = {}
    for t in set(texts) - {None}:
        for no, line in enumerate(t.split("\n")):
            tokens = tuple(FIELD if re.search("[0-9@]", w) else w for w in re.split(r"[ \t\n\x0b\x0c\r]+", line) if w)
            if tokens:
                lines[t, no] = tokens
    leaf = lambda k: (len(k), k[:2])
    leaves, of = defaultdict(set), defaultdict(set)
    for (t, _), k in lines.items():
        leaves[leaf(k)].add(t)
        of[k].add(t)
    wanted = {k for k in of if len(leaves[leaf(k)]) >= least}
    common = Counter()
    for k in wanted:
        common.update({(leaf(k), i, w): len(of[k]) for i, w in enumerate(k)})
    template = {}
    for k in wanted:
        own = [i for i, w in enumerate(k) if w != FIELD]
        stays = [i for i in own if common[leaf(k), i, k[i]] >= least]
        if own:
            fits = len(stays) >= 4 and 100 * len(stays) >= 75 * len(k)
            template[k] = tuple(w if i in stays else FIELD for i, w in enumerate(k)) if fits else k
    holders = defaultdict(set)
    for (t, _), k in lines.items():
        if k in template:
            holders[template[k]].add(t)
    order = {t: tuple(template.get(lines[t, no], lines[t, no]) for no in range(t.count("\n") + 1) if (t, no) in lines) for t in set(texts) - {None}}
    alike = Counter(order.values())
    kept = {}
    for t in set(texts) - {None}:
        gone = {no for no in range(t.count("\n") + 1) if (t, no) in lines and len(holders.get(template.get(lines[t, no]), ())) >= least}
        kept[t] = t if alike[order[t]] > 1 else "\n".join(line for no, line in enumerate(t.split("\n")) if no not in gone)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_follow_a_plain_tree(spark, documents, many_parts, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "n1", "x@y", "é"])
    stock = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 20]))] for _ in range(9)]

    def line():
        tokens = list(rng.choice(stock)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            if tokens:
                tokens[rng.randrange(len(tokens))] = rng.choice([f"own{rng.randrange(999)}", "rare", word(), "".join(rng.choices("abcdef", k=6))])
        return rng.choice([" ", "  ", "\t"]).join(tokens) + rng.choice(["", "", " "])

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += [texts[0]] * 8 + [texts[1].replace(" ", "  ")] + [None, "", "\n", "7 8 9"]
    kept = plain(texts, 5)
    got = drop_recurring_lines(documents(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.text == (None if texts[r.doc_id] is None else kept[texts[r.doc_id]])
        assert r.n_lines - r.n_dropped == (0 if r.text is None else r.text.count("\n") + 1) or r.n_lines == r.n_dropped


def test_a_long_footer_goes_from_short_pages(spark, documents):
    letters = lambda i, k: "".join(chr(97 + (i * 7 + k * 5 + j * 3) % 26) for j in range(6))
    foot = "\n".join(" ".join(f"footer{chr(97 + n)}word{chr(97 + k)}" for k in range(20)) for n in range(5))
    rows = [(i, " ".join(letters(i, k) for k in range(own)) + "\n" + foot) for i, own in enumerate([20, 20, 20, 20, 25, 30, 30, 3])]
    for r in drop_recurring_lines(documents(rows)).collect():
        assert (r.n_dropped, r.text) == (5, rows[r.doc_id][1].split("\n")[0])


def test_copies_stay_whole(spark, documents):
    rows = [(i, f"A line of copy {i}\nanother line of all of them\nlast words of it @{i}") for i in range(9)]
    assert all(r.n_dropped == 0 and r.text == rows[r.doc_id][1] for r in drop_recurring_lines(documents(rows)).collect())


def test_a_hot_line_and_a_long_text(spark, documents):
    long = "\n".join(f"unlike line number of words {'abc'[i % 3]}{'def'[i // 3 % 3]} " + "z" * (i % 50) for i in range(20_000))
    rows = [(i, f"{'own ' * (i + 1)}\nthe same line in all of these") for i in range(300)] + [(500, long)]
    got = {r.doc_id: r for r in drop_recurring_lines(documents(rows)).collect()}
    assert all(got[i].n_dropped >= 1 and "the same line" not in got[i].text for i in range(300)) and got[500].n_lines == 20_000


def test_a_template_of_many_fields_goes(spark, documents):
    """Five of 24 tokens differ, one in each quarter at least, so no quarter recurs whole."""
    letters = lambda i, k: "".join(chr(97 + (i * 7 + k * 5 + j * 3) % 26) for j in range(6))
    places = (3, 8, 13, 18, 23)
    notice = lambda i: " ".join(letters(i, k) if k in places else f"constant{chr(97 + k)}" for k in range(24))
    rows = [(i, f"{letters(i, 50)} {letters(i, 60)} own line\n{notice(i)}") for i in range(6)]
    for r in drop_recurring_lines(documents(rows)).collect():
        assert (r.n_dropped, r.text) == (1, rows[r.doc_id][1].split("\n")[0])


def test_the_query_drops_recurring_lines_from_copies_too(spark, documents, tmp_path):
    """A pair with the same templates loses its footer as others do, and so do eight texts with equal templates."""
    foot, letters = "the same footer under all of these", lambda i, k: "".join(chr(97 + (i * 7 + k * 5 + j * 3) % 26) for j in range(6))
    pair = [(i, f"An article printed on day {i}\nits second line\n{foot}") for i in range(2)]
    others = [(10 + i, f"{letters(i, 50)} {letters(i, 60)} own line\n{foot}") for i in range(4)]
    notices = [(20 + i, f"A line of notice {i}\nanother line of all of them\n{letters(i, 70)} 7\nlast words of it @{i}") for i in range(8)]
    documents(pair + others + notices).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_line_templates"](spark, str(tmp_path)).collect()}
    for i, text in pair + others:
        assert (got[i].n_dropped, got[i].text) == (1, text.rpartition("\n")[0])
    for i, text in notices:
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (4, 3, text.split("\n")[2])


@pytest.mark.parametrize("seed", range(2))
def test_the_query_agrees_with_sql_on_texts_with_copies(spark, documents, many_parts, tmp_path, seed):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "the", "of", "n1", "x@y"])
    stock = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 8, 13]))) for _ in range(12)]
    texts = ["\n".join(rng.choice(stock) if rng.random() < 0.7 else " ".join(word() for _ in range(9)) for _ in range(rng.randrange(1, 6))) for _ in range(50)]
    texts += [t.replace("n1", f"n{k}").replace("x@y", f"x@{k}") for t in texts[:12] for k in range(2, 6)] + [texts[0], None, "", "\n"]
    documents(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL["op10_line_templates"])
    df = QUERIES["op10_line_templates"](spark, str(tmp_path))
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
