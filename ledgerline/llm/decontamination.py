"""Benchmark decontamination with an Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.texts import map_texts
from ledgerline.session import write_down

WINDOW = 13
PART_WINDOWS = 20_000  # windows in one automaton, a few MB sent to each executor

# Words are runs of digits, letters and bytes above 7F; A-Z become a-z.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
                for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def item_windows(text: str | None, width: int = WINDOW) -> list[str]:
    """Each run of ``width`` words of an item; an item of fewer words is one window."""
    words = normal_words(text)
    return [b" ".join(words[i:i + width]).decode() for i in range(max(1, len(words) - width + 1))] if words else []


def _windows_of(width: int):
    return lambda: lambda texts: {"windows": [list(dict.fromkeys(item_windows(t, width))) for t in texts]}


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words (first, last)."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _RUN.finditer(data.translate(_NORMAL))]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[at[a][0]]), int(points[at[b][1]])) for a, b in runs]


def _scan(windows):
    def start():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, (_, window) in enumerate(windows.value):
            automaton.add_word(f" {window} ", k)
        automaton.make_automaton()

        def scan(text):
            words = normal_words(text)
            found = list(automaton.iter(f" {b' '.join(words).decode()} ")) if words and windows.value else []
            if not found:
                return len(words), [], []
            ends = np.cumsum([len(w.decode()) + 1 for w in words])  # where the space after each word is
            change, held = np.zeros(len(words) + 1, np.int64), set()
            for end, k in found:
                last = int(np.searchsorted(ends, end))
                change[last - windows.value[k][1].count(" ")] += 1
                change[last + 1] -= 1
                held.add(windows.value[k][0])
            edges = np.diff(np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False])).astype(np.int64))
            runs = list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist(), strict=True))
            spans = [{"first": a, "last": b, "start": s, "end": e}
                     for (a, b), (s, e) in zip(runs, original_spans(text, runs), strict=True)]
            return len(words), spans, sorted(held)

        def work(texts):
            out = [scan(t) for t in texts]
            return {"n_words": [n for n, _, _ in out], "runs": [r for _, r, _ in out], "held": [h for _, _, h in out]}
        return work
    return start


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, percent: int = 5) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, items, spans, contaminated``.

    Texts and items are reduced to lower-case words; a window is ``width`` words of an item in a row
    (all of a shorter item). A word inside any window that occurs in the document is hit; ``items`` are
    the ids of the items with such windows and ``spans`` where hit words lie in the original text
    (code points, end exclusive; ``first`` and ``last`` count words). A document is contaminated if
    hit words are at least ``percent`` of its words.

    One automaton over all windows reads every text once. A benchmark of more than ``PART_WINDOWS``
    distinct windows is taken in parts of about that many, each with an automaton and a pass of its
    own, so what executors receive is bounded: windows and their ids. Which items these belong to is joined
    afterwards, so items that share windows weigh nothing in the automaton. Null and empty texts have no words; null item ids
    still hit but name no item; repeated rows get the same answer each; an empty benchmark hits
    nothing; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    named = write_down(map_texts(benchmark.select("item_id", "text"), "windows array<string>", _windows_of(width))
                       .select("item_id", F.explode("windows").alias("window")).withColumn("id", F.xxhash64("window")))
    windows = write_down(named.select("id", "window").distinct())
    parts = max(1, -(-windows.count() // PART_WINDOWS))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    passes = None
    for part in range(parts):
        held = windows.where(F.pmod("id", F.lit(parts)) == part).sort("window").collect()
        sent = spark.sparkContext.broadcast([(r["id"], r["window"]) for r in held])
        found = map_texts(keyed.withColumn("part", F.lit(part)), "n_words long, "
                          "runs array<struct<first:long,last:long,start:long,end:long>>, held array<long>", _scan(sent))
        passes = found if passes is None else passes.unionByName(found)
    each = passes.groupBy("doc_id", "text_key", "part").agg(
        F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("runs").alias("runs"), F.first("held").alias("held"))
    merged = write_down(each.groupBy("doc_id", "text_key").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.flatten(F.collect_list("held")).alias("held")))
    # Which items have the windows that were found; a window may belong to any number of them.
    asked = merged.where(F.size("held") > 0).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.explode("held").alias("id"))
    items = asked.join(named.select("id", "item_id").where("item_id is not null"), "id").groupBy("d", "k") \
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")
    merged = merged.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left") \
        .withColumn("items", F.coalesce("items", none))
    # Runs sorted by their first word; a run adds the words beyond the furthest one so far.
    hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
                      lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"] - 1, a["upto"]))).alias("n"),
                                            F.greatest(a["upto"], r["last"]).alias("upto")), lambda a: a["n"])
    return merged.withColumn("n_hit", hit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "text_key", "n_words", "n_hit", "items", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"))
