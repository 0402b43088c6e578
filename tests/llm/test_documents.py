"""Operators on documents against plain models on small tables with nulls, ties, copies and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import language, ngram_join, passages
from ledgerline.llm.decontamination import contamination
from ledgerline.llm.language import identify
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.mixing import capped_targets, mix, sainte_lague
from ledgerline.llm.ngram_join import jaccard_groups, matrix_links
from ledgerline.llm.passages import band_keys, paragraph_starts, repeated_passages
from ledgerline.llm.personal_data import KINDS, find_personal_data, listed_spans
from ledgerline.llm.shingles import words_of

EMPTY = []
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "é"), (None, "some words without an id here at all"), (904, "x" * 30_000), (904, "x" * 30_000)]


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice("alder birch cedar dogwood elm fir gum hazel ivy juniper kauri larch maple".split()) + str(r.randrange(40)) for _ in range(n)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(seed, n, words=60, changes=4):
    """Copies of one text with some words changed, of which many link and many do not."""
    r, base, out = random.Random(seed), prose(seed, words), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes)):
            w[r.randrange(words)] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_groups_equal_brute_force(spark, documents):
    rows = [(i, t) for i, t in enumerate(near_copies(1, 40) + near_copies(2, 25, 12, 3) + [" ".join(prose(i, 9)) for i in range(9, 30)])]
    rows += [(200 + i, " ".join(prose(3, 8)[:n])) for i, n in enumerate((4, 5, 7, 8, 8))] + [(300, rows[0][1].upper()), *ODD]
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    expected = sorted((repr((i, len(s), least.get(top(k)))) for k, (i, s) in enumerate(sets)))
    got = [repr((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_groups(documents(rows)).collect()]
    assert sorted(got) == expected


def test_jaccard_groups_of_drifting_copies(spark, documents, monkeypatch):
    """A chain in which only neighbours link is one group, whichever leaders are drawn, and so is a large group
    of near copies beside a smaller one that shares a passage with it."""
    base, chain = prose(77, 120), []
    for i in range(50):
        base = [*base[:i * 2 % 118], f"step{i}", *base[i * 2 % 118 + 1:]]
        chain.append(" ".join(base))
    shared = prose(5, 200)
    large = [" ".join(f"n{i}" if k == i % 200 else w for k, w in enumerate(shared)) for i in range(150)]
    small = [" ".join(shared[:90] + prose(8, 110)[:110 - i]) for i in range(4)]
    rows = list(enumerate(chain)) + [(100 + i, t) for i, t in enumerate(large)] + [(400 + i, t) for i, t in enumerate(small)]
    for worthwhile in (50, 10**9):  # as registered, and with stars until they join nothing
        monkeypatch.setattr(ngram_join, "WORTHWHILE", worthwhile)
        got = {r.doc_id: r.component_id for r in jaccard_groups(documents(rows)).collect()}
        assert got == {i: 0 if i < 100 else 100 if i < 400 else 400 for i, _ in rows}


def test_a_common_passage_meets_few_bundles(spark, monkeypatch):
    """Sets that share some of a passage's tokens and little else are sent to one or two bundles each, whatever
    frequent token each of them is looked up under; the links among them are found."""
    rng, sent = np.random.default_rng(5), []
    held = [sorted({*rng.choice(12, 8, replace=False).tolist(), *rng.integers(100, 2**62, 12).tolist()}) for _ in range(300)]
    held += [[*h[:-1], 2**62 + k] for k, h in enumerate(held[:300:30])]
    posts = [(k, k, 20, t, sum(t in h for h in held)) for k, own in enumerate(held) for t in own if t < 12]

    def counted(df, *path):
        if "bundle" in df.columns and "own" not in df.columns:
            sent.append(df.count())
        return write_down(df, *path)
    write_down = ngram_join.write_down
    monkeypatch.setattr(ngram_join, "write_down", counted)
    links = matrix_links(spark.createDataFrame(posts, "class long, component long, n long, token long, df long"),
                         spark.createDataFrame([(k, 20, h) for k, h in enumerate(held)], "class long, n long, tokens array<long>"))
    assert {frozenset(r) for r in links.collect()} == {frozenset((30 * k, 300 + k)) for k in range(10)}
    members, meets = sent
    assert members == 310 and meets <= 2 * members


def test_matrix_finds_all_links_in_many_bundles(spark, documents, monkeypatch):
    rows = list(enumerate(near_copies(11, 60) + near_copies(12, 30, 40, 7)))
    expected = sorted(jaccard_groups(documents(rows)).select("doc_id", "component_id").collect())
    for name, value in (("WORTHWHILE", 0), ("BUNDLE", 4), ("QUERIES", 3), ("TOKENS", 200), ("BITS", 32768)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "LEADERS", 0)  # no stars: the matrix has to find every link
    assert sorted(jaccard_groups(documents(rows)).select("doc_id", "component_id").collect()) == expected


def test_possible_rows_hold_all_wanted_ones(spark):
    keys = spark.range(20_000).selectExpr("id as a", "id * 7 as b", "'t' as text")
    wanted = keys.where("a % 100 = 3").select("a", "b")
    kept = ngram_join.possible(keys, wanted, "a", "b")
    assert kept.columns == keys.columns and 200 <= kept.count() < 220
    assert kept.join(wanted, ["a", "b"], "left_semi").count() == 200
    assert not ngram_join.possible(keys, wanted.limit(0), "a", "b").count()


def test_contamination_equals_brute_force(spark, documents):
    items = [(1, " ".join(prose(50, 30))), (2, "Short ITEM, here."), (3, None), (4, "!!"), (5, " ".join(prose(50, 14))), (None, "no id item")]
    a, b = prose(50, 30), prose(51, 200)
    rows = [(1, " ".join(b[:50] + a[3:20] + b[50:])), (2, "-".join(a[:13]).upper()), (3, " ".join(a[:12])), (4, "x short-item here y"),
            (5, " ".join(b)), (6, "No ID item"), *ODD]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).update({i} - {None})
    expected = []
    for i, t in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        expected.append(repr((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(documents(rows), bench).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in got) == sorted(expected)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert rows[0][1][slice(*spans[1][0])] == " ".join(a[3:20]) and rows[3][1][slice(*spans[4][0])] == "short-item here"
    assert not any(r.n_hit for r in contamination(documents(rows), bench.limit(0)).collect())


def test_contamination_in_parts(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(prose(50, 60))), (2, " ".join(prose(52, 40)))], "item_id long, text string")
    docs = documents([(1, " ".join(prose(50, 60) + prose(52, 30))), (2, " ".join(prose(53, 90))), (2, " ".join(prose(53, 90)))])
    whole = sorted(contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items").collect())
    monkeypatch.setattr("ledgerline.llm.decontamination.PART_WINDOWS", 7)
    assert sorted(contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items").collect()) == whole
    assert [(r.doc_id, r.n_hit) for r in whole] == [(1, 90), (2, 0), (2, 0)]


def test_passages_are_found_wherever_they_stand(spark, documents):
    passage, other = prose(60, 51), prose(61, 51)
    other_changed = list(other)
    other_changed[40] = "changed"
    rows = [(i, " ".join(prose(100 + i, 20 + 7 * i) + passage + prose(200 + i, 15))) for i in range(6)]
    rows += [(10 + i, " ".join(prose(300 + i, 80))) for i in range(5)]
    rows += [(20, " ".join(other)), (21, " ".join(other_changed)), (22, " ".join(passage) * 1 + "\n" + " ".join(prose(9, 40))), *ODD]
    got = {r.doc_id: r for r in repeated_passages(documents(rows)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 20, 21, 22}
    assert got[0].n_removed == 0 and all(got[i].n_removed == got[i].n_repeated > 0 for i in (1, 2, 3, 22))
    words = rows[3][1].split()
    assert all(set(words[s:e]) <= set(passage) for s, e in got[3].removed)


def test_passages_link_without_the_first_of_a_bucket(spark, documents):
    """Of a, b, c, each pair shares a run that the third lacks, in many mixed groups."""
    rows, expected = [], set()
    for g in range(40):
        ab, bc, ac = (prose(4000 + 3 * g + k, 30) for k in range(3))
        for k, parts in enumerate(((ab, ac), (ab, bc), (bc, ac))):
            rows.append((3 * g + k, " ".join(prose(5000 + 9 * g + k, 25) + parts[0] + prose(6000 + 9 * g + k, 25) + parts[1])))
            expected.add((3 * g + k, 2, k))
    assert {(r.doc_id, r.n_repeated, r.n_removed) for r in repeated_passages(documents(rows)).collect()} == expected


def own_words(name, n):
    return [f"{name}{k}" for k in range(n)]


def test_removed_words_are_the_whole_passage(spark, documents):
    rows, expected = [], {}
    for k, n in enumerate((18, 19, 30, 51, 100, 1000)):
        for copy in range(3):
            before = own_words(f"b{k}-{copy}-", 7 + 31 * copy)
            rows.append((3 * k + copy, " ".join(before + own_words(f"p{k}-", n) + own_words(f"a{k}-{copy}-", 12))))
            if n >= 19:
                expected[3 * k + copy] = [(len(before), len(before) + n)] if copy else []
    rows += [(50, rows[11][1]), (None, rows[11][1])]
    expected |= {i: [(0, len(rows[11][1].split()))] for i in (50, None)}
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in repeated_passages(documents(rows)).collect()}
    assert got == expected


def test_near_copies_with_a_changed_word_go_as_a_whole(spark, documents):
    rows, expected = [], {}
    for k in range(30):
        passage = own_words(f"p{k}-", 51)
        for copy, middle in enumerate(([passage[25]], ["changed"], [], ["two", "more"])[:2 + 2 * (k % 2)]):
            before, text = own_words(f"b{k}-{copy}-", 7 + 11 * copy), passage[:25] + middle + passage[26:]
            rows.append((4 * k + copy, " ".join(before + text + own_words(f"a{k}-{copy}-", 12))))
            start, end = len(before), len(before) + len(text)
            # 42 of 52 shingles are shared if a word is changed, 42 of 51 if it is gone, 42 of 53 if it became two.
            expected[4 * k + copy] = [] if not copy else [(start, end)] if copy < 3 else [(start, start + 25), (start + 27, end)]
    # Other words between: no link, and what is between stays.
    rows += [(1000, " ".join(own_words("q", 51))), (1001, " ".join(own_words("q", 25) + own_words("between", 9) + own_words("q", 51)[26:]))]
    expected |= {1000: [], 1001: [(0, 25), (34, 59)]}
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in repeated_passages(documents(rows)).collect()}
    assert got == expected


def test_near_copies_go_though_others_hold_their_parts(spark, documents):
    """2 and 3 link as a whole, while 0 and 1 are the first holders of either half; every pair of a bucket counts."""
    rows, expected = [], {}
    for k in range(20):
        passage = own_words(f"p{k}-", 51)
        for copy, text in enumerate((passage[:25], passage[26:], [*passage[:25], "one", *passage[26:]], [*passage[:25], "other", *passage[26:]])):
            before = own_words(f"b{k}-{copy}-", 9)
            rows.append((4 * k + copy, " ".join(before + text + own_words(f"a{k}-{copy}-", 12))))
            expected[4 * k + copy] = [[], [], [(9, 34), (35, 60)], [(9, 60)]][copy]
    got = {r.doc_id: r for r in repeated_passages(documents(rows)).collect()}
    assert {i: [tuple(x) for x in r.removed] for i, r in got.items()} == expected
    assert all(set(got[4 * k + 2].classes) & set(got[4 * k + 3].classes) for k in range(20))


def test_unlike_paragraphs_of_a_bucket_make_no_pairs(spark, monkeypatch):
    """Sets that share a band key and little else are compared in bundles, not joined pair by pair."""
    rng, made = np.random.default_rng(3), []
    rows = [(i, i, 1, 0, 30, i, 26, sorted(rng.integers(-2**62, 2**62, 26).tolist()), [7, 1000 + i]) for i in range(300)]
    both = sorted(rng.integers(-2**62, 2**62, 26).tolist())
    rows += [(300, 300, 1, 0, 30, 300, 26, both, [7, 5]), (301, 301, 1, 0, 30, 301, 25, both[:25], [7, 6])]
    signed = spark.createDataFrame(rows, "text_key long, id long, copies long, start int, end int, class long, n long, tokens array<long>, bands array<long>")
    monkeypatch.setattr(passages, "matrix_links", lambda *a: made.append(matrix_links(*a)) or made[-1])
    got = {r.text_key: (r.root, r.repeated, r.goes) for r in passages.linked_paragraphs(signed).collect()}
    assert len(made) == 1 and got[301] == (got[300][0], True, True) and got[300][1:] == (True, False)
    assert all(got[i] == (i, False, False) for i in range(300))


def test_minhash_bands_meet_at_the_limit():
    """Of 400 pairs of sets at a Jaccard similarity of 0.8, nearly all share a band; of unlike ones, none."""
    rng, met = np.random.default_rng(7), 0
    for _ in range(400):
        both, one, other = rng.integers(-2**63, 2**63 - 1, 40), rng.integers(-2**63, 2**63 - 1, 5), rng.integers(-2**63, 2**63 - 1, 5)
        a, b = band_keys(np.concatenate([both, one])), band_keys(np.concatenate([both, other]))
        met += bool(set(a) & set(b))
        assert not set(band_keys(one)) & set(band_keys(other))
    assert met >= 396


def test_every_passage_has_its_own_paragraph():
    for seed in range(60):
        passage = prose(seed, 51)
        def cut(around):
            w = words_of(" ".join(around + passage + prose(seed + 1000, 33)))
            return {tuple(w[a:a + 20]) for a in paragraph_starts(w)} & {tuple(x.encode() for x in passage[k:k + 20]) for k in range(32)}
        assert cut(prose(seed + 2000, 10)) & cut(prose(seed + 3000, 57))


def test_line_templates(spark, documents):
    foot = "Read more at our site, visit {} today or call again"
    rows = [(i, f"Own line {' '.join(re.sub('[0-9]', '', w) for w in prose(i, 9))}\nPage {i} of 9\n{foot.format('x' + str(i))}\n\nSame words everywhere.") for i in range(6)]
    copies = [(50 + i, "A line of the copies\nanother line of them\nlast") for i in range(7)]
    got = {r.doc_id: r for r in drop_recurring_lines(documents(rows + copies + ODD)).collect()}
    for i, text in rows:
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (5, 3, text.split("\n")[0] + "\n")
    assert all(got[i].n_dropped == 0 and got[i].text == t for i, t in copies)
    assert got[900].text is None and got[900].n_lines == 0 and got[901].n_lines == 1 and got[904].text == "x" * 30_000


def test_language(spark, documents):
    kinds = {"aa": "kala pami sutola reka mona", "bb": "zwrst brzgl krtchk vlsk drnt", "cc": "ñuñé çáçá ûbêr ôçêl ñàñù"}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(kinds[k].split()) for _ in range(30)), k, "s") for i, k in enumerate(list(kinds) * 60)]
    odd = [(500, None, "aa", "s"), (501, "", "aa", "s"), (502, "12 :: 34", "bb", "s"), (None, "kala pami", "bb", "s"), (503, "kala mona reka", None, "s")]
    got = identify(documents(rows + odd)).collect()
    right = {i: k for i, _, k, _ in rows}
    assert all(g.lang_pred == right[g.doc_id] and 0.5 < g.score <= 1 for g in got if g.doc_id in right)
    import zlib
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    by = {g.doc_id: (g.lang_pred, g.score) for g in got}
    assert by[500] == by[501] == by[502] == ("und", 0.0) and by[503][0] == "aa" and by[None][0] == "aa"
    assert {(g.lang_pred, g.score) for g in identify(documents([(1, "words", None, "s")])).collect()} == {("und", 0.0)}


def test_language_sample_holds_each_document_once(spark):
    r = random.Random(6)
    hashes = {k: [r.randrange(-2**63, 2**63) for _ in range(n)] for k, n in (("aa", 300), ("bb", 7))}
    rows = [(k, h, f"{k} {h}") for k, hs in hashes.items() for h in hs] + [("aa", min(hashes["aa"]), f"again {i}") for i in range(200)]
    got = language.sampled(spark.createDataFrame(rows, "lang string, h long, text string"), 40).collect()
    for k, hs in hashes.items():
        assert sorted(g.h for g in got if g.lang == k) == sorted(hs)[:40]
    assert language.SAMPLE == 1500


def test_personal_data(spark, documents):
    text = ("😀 a@b.com_x@y.z 1.2.3.4.5.6.7.8 999.1.1.1 +1 (017) 555-7713 4111 1111 1111 1111 q@r 0256.1.1.1 +12 "
            "4111111111111112 12345678901234567890 +123 m.n@o-p.q.r,\n007.0.0.255 +49-")
    rows = [(1, text), (2, "mail @ home 5"), (3, text * 20), *ODD]
    got = {r.doc_id: r for r in listed_spans(find_personal_data(documents(rows))).collect()}

    def base(x):
        out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        out += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
            if 16 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0:
                out.append((2, m))
        out += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return [f"{KINDS[k]}:{m.start()}:{m.end()}" for k, m in sorted(out, key=lambda o: (o[0], o[1].start()))]
    for i, t in rows:
        spans = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",") if got[i].spans else [])
        assert got[i].n_email == sum(s.startswith("email") for s in spans)


def test_mix(spark, documents):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(1, 300)), None, s) for i, s in enumerate((["big"] * 8 + ["little", None, "z"]) * 20)]
    rows += [(9000, None, None, "none"), (9001, "", None, "big"), (None, "no id", None, "tiny"), (9002, "a b c", None, "big"), (9002, "a b c", None, "big")]
    got = mix(documents(rows)).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mix(documents(rows)).collect()))
    sizes, taken, target = {}, {}, {}
    for g in got:
        sizes[g.source] = sizes.get(g.source, 0) + g["size"]
        taken[g.source] = taken.get(g.source, 0) + g.taken
        target[g.source] = g.target
        assert 0 <= g.taken <= 3 * g["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    assert [target[s] for s in names] == pytest.approx([float(t) for t in capped_targets([sizes[s] for s in names], [1, 2, 3, 1, 2, 3], sum(sizes.values()))])
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in names)


def test_sainte_lague_takes_the_highest_quotients():
    r = random.Random(2)
    for _ in range(200):
        votes = [r.randrange(0, 400) for _ in range(r.randrange(1, 9))]
        most = [r.randrange(0, 60) for _ in votes]
        seats = r.randrange(0, 120)
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(most[i])))[:seats]
        assert sainte_lague(votes, seats, most) == [sum(i == p for _, p in ranked) for i in range(len(votes))]


def test_one_document_of_each_group_stays(spark, documents):
    a, b, c, d = (near_copies(seed, 3, 90, 1) for seed in (21, 22, 23, 24))
    changed = [" ".join([f"w{k}", *t.split()[1:]]) for group in (a, b, c) for k, t in enumerate(group)]
    rows = [(None, t) for t in changed[:3]] + [(7, t) for t in changed[3:6]] + [(None, changed[6]), (9, changed[7]), (8, changed[8])]
    rows += [(10 + k, t) for k, t in enumerate(d[:1])] + [(20, None), (21, ""), (21, "")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, documents(rows), "").collect()]
    assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, (None, 7, 8, 10, 20, 21)))
    assert dict(got)[None] in changed[:3] and dict(got)[7] in changed[3:6]


def test_language_stage_without_languages_keeps_documents_with_letters(spark, documents):
    rows = [(1, "some words", None, "s"), (2, "été", None, "s"), (3, "12 :: 34", None, "s"), (4, None, None, "s"), (None, "no id", "aa", "s")]
    got = corpus_pipeline.known_language(spark, documents(rows), "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]


@pytest.mark.parametrize("operator", [jaccard_groups, repeated_passages, drop_recurring_lines, identify, find_personal_data, mix])
def test_empty_table(spark, documents, operator):
    assert operator(documents(EMPTY)).collect() == []
