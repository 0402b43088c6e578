"""Archives, host reputation and vector search against plain models, with nulls, ties and repeated rows."""

import hashlib
import io
import math
import random
import struct

import numpy as np
import pytest

from ledgerline.llm import warc
from ledgerline.llm.components import components
from ledgerline.llm.host_reputation import Rule, judge_urls
from ledgerline.llm.multi_index import nearest, visited


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


LONG = "<p>" + "copy é " * 200 + "</p>"
PAGES = [(1, "http://a.example/", LONG), (2, None, LONG), (9, "http://b.example/x\r\ny", LONG), (9, "http://b.example/x\r\ny", LONG),
         (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", LONG), (None, "u", "z" * 2000), (7, "u", "y" * 300_000)]


def test_archives_round_trip(spark):
    got = warc.round_trip(pages_of(spark, PAGES)).collect()
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if h == html and p is not None]
        last = max(ids) if ids and len(data) >= 1000 else None
        revisit = last is not None and i != last
        expected.append(repr((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(expected)
    assert warc.round_trip(pages_of(spark, [])).collect() == []


def test_payloads_come_back_from_the_files(spark, tmp_path):
    pages = pages_of(spark, PAGES)
    manifest = warc.write_archives(pages, str(tmp_path))
    got = warc.read_archives(spark, manifest, str(tmp_path)).where("record_type = 'response' and page_id = 7").first()
    assert bytes(got.payload) == b"y" * 300_000 and got.url == "u"


def archive(tmp_path, *records):
    writer = warc.ArchiveWriter(str(tmp_path))
    for r in records:
        writer.add(r)
    writer.close()
    with open(writer.written[0][0], "rb") as f:
        return f.read()


def test_an_archive_is_a_dictionary_and_a_frame_for_each_record(tmp_path):
    records = [warc.page_record(i, "u", b"page %d " % i * 50, warc.base32_sha1(b"page %d " % i * 50), None) for i in range(30)]
    data = archive(tmp_path, *records)
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
    assert list(warc.frames(io.BytesIO(data))) == records
    assert data.count(struct.pack("<I", warc.FRAME)) >= 30
    for damaged in (data[:-3], data[4:], data[:6]):
        with pytest.raises(Exception):
            list(warc.frames(io.BytesIO(damaged)))


@pytest.mark.parametrize("change", [lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r[:-1], lambda r: b"X" + r,
                                    lambda r: r.replace(b"WARC-Date", b"WARC-When"), lambda r: r.replace(b"hello", b"hallo")])
def test_a_damaged_record_is_refused(change):
    good = warc.page_record(1, "u", b"hello", warc.base32_sha1(b"hello"), None)
    assert warc.read_page(good)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.read_page(change(good))


def test_rules_and_reputation(spark):
    bad, good = "http://bad.shop.example/p", "http://good.shop.example/p"
    rows = [(i, bad, "") for i in range(40)] + [(100 + i, good, "") for i in range(40)] + [
        (200, "HTTP://X.Org/a?b", ""), (201, "http://org", ""), (202, None, ""), (203, "no scheme", ""), (204, "https://sub.example.org/es/1#f", ""),
        (205, "http://new.shop.example/q", ""), (None, bad, ""), (206, "http://xorg/", ""), (207, "://u:p@bad.shop.example:80/", "")]
    labels = spark.createDataFrame([(i, 1) for i in range(38)] + [(38, 0), (39, None)] + [(100 + i, 0) for i in range(40)], "page_id long, bad int")
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages_of(spark, rows), labels, rules).collect()}
    assert got[0] == ("bad.shop.example", "/p", None, "block") and got[100][3] == "allow" and got[None][3] == "block"
    assert got[200] == ("x.org", "/a", "org/", "allow") and got[201][:3] == ("org", "", None)
    assert got[202][:3] == got[203][:3] == ("", "", None)
    assert got[204] == ("sub.example.org", "/es/1", "example.org/es/", "block") and got[206][2] is None
    assert got[207][0] == "u:p@bad.shop.example:80"
    assert judge_urls(pages_of(spark, []), labels, rules).collect() == []
    assert all(r.verdict in ("allow", "block") for r in judge_urls(pages_of(spark, rows), labels.limit(0)).collect())


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, row int, q string")


def plain(rows, k=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            fine[i] = np.array(v, np.float32).astype(float)
    out = {}
    for i, q in fine.items():
        if i % 20 == 0:
            out[i] = sorted((-float(q @ v), j) for j, v in fine.items() if j != i)[:k]
    return out


def test_search_is_exact_where_everything_is_visited_and_handles_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [round(float(x), 1) for x in r.normal(size=8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(45)] + [(200, None), (201, [0.0] * 8), (220, [float("nan")] * 8), (203, [1.0, None] * 4),
             (204, [1.0]), (None, rows[0][1]), (205, []), (240, rows[20][1]), (40, rows[40][1])]
    got = {}
    for x in nearest(vectors_of(spark, rows)).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    expected = plain(rows)
    assert set(got) == set(expected)
    found = sum(len({j for _, j, _ in got[q]} & {j for _, j in expected[q]}) for q in got)
    assert found >= 0.9 * sum(map(len, expected.values()))
    for q, best in got.items():
        assert [b[0] for b in sorted(best)] == list(range(1, len(best) + 1)) and len(best) == len(expected[q])
        assert sorted(best) == [(n + 1, j, s) for n, (s, j) in enumerate((s, j) for s, j in sorted(((s, j) for _, j, s in best), key=lambda t: (-t[0], t[1])))]
    copies = [j for _, j, _ in sorted(got[100])]
    same = [j for j in [0, *range(101, 145)] if j in copies]
    assert same == same[:0] + [0, *range(101, 101 + len(same) - 1)]
    assert nearest(vectors_of(spark, [])).collect() == [] == nearest(vectors_of(spark, [(0, None)])).collect()
    assert nearest(vectors_of(spark, [(0, [1.0, 2.0])])).collect() == []


def test_cells_come_by_summed_distance():
    r = np.random.default_rng(1)
    a, b, n = r.normal(size=7), r.normal(size=5), r.integers(0, 4, (7, 5))
    ordered = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if n[i, j])
    assert visited(a, b, n, int(n.sum())) == [(i, j) for _, i, j in ordered]
    some = visited(a, b, n, 10)
    assert sum(n[c] for c in some) >= 10 > sum(n[c] for c in some[:-1])


def test_components(spark):
    r = random.Random(6)
    for links in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(60)], []):
        up = {x: x for l in links for x in l}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for x, y in links:
            x, y = sorted((top(x), top(y)))
            up[y] = x
        table = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
        got = {r.node: r.component for r in components(table, "a", "b").collect()}
        assert got == {x: top(x) for l in links if l[0] != l[1] for x in l}
