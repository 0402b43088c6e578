"""Repeated passages: runs of words that other documents have too, linked by MinHash bands over their shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.components import components
from ledgerline.llm.ngram_join import matrix_links, star_components, verified_pairs
from ledgerline.llm.shingles import hash_words, mix, shingle_hashes, words_of
from ledgerline.llm.texts import map_texts
from ledgerline.session import new_path, scratch, write_down

# Two passages of 20 words or more that link at 80 per cent of their five-word shingles have 19 words in a
# row in common: one changed word inside costs five shingles, which 45 shared ones must outweigh.
LEAST = 19    # words of a repeated passage
LENGTH = 10   # words of a paragraph
SPACING = 10  # of so many places in a row, one begins a paragraph; LENGTH + SPACING - 1 words hold one
WIDTH, PERCENT = 5, 80  # five words; 100 * intersection >= 80 * union
BANDS, ROWS = 8, 3  # a pair at 80 per cent meets in a band with 1 - (1 - 0.8 ** 3) ** 8 = 0.997
LAST = (1 << 63) - 1  # stands for a null id, after all others

_seeds = np.random.default_rng(20_261_203)
_FACTORS = _seeds.integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _seeds.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def paragraph_starts(words: list[bytes], length: int = LENGTH, spacing: int = SPACING) -> np.ndarray:
    """Where paragraphs of ``length`` words begin: at the least hash of three words among every ``spacing``
    places in a row, so that a passage begins the same ones wherever it stands."""
    places = len(words) - length + 1
    if places <= 0:
        return np.empty(0, np.int64)
    h = shingle_hashes(words[:places + 2], 3)
    if places <= spacing:
        return np.array([int(np.argmin(h[:places]))])
    spans = np.lib.stride_tricks.sliding_window_view(h[:places], spacing)
    return np.unique(np.argmin(spans, axis=1) + np.arange(len(spans)))


def _paragraphs(length: int, spacing: int):
    def start():
        seen: set[int] = set()  # of this task: of equal texts, one is cut into paragraphs

        def work(texts):
            out = {"at": [], "paragraph": [], "words": []}
            for text in texts:
                key, words = hash(text), words_of(text)
                new = text is not None and key not in seen
                seen.add(key)
                at = paragraph_starts(words, length, spacing) if new else none
                out["at"].append(at.astype(np.int32))
                out["paragraph"].append(shingle_hashes(words, length)[at] if len(at) else none)
                out["words"].append(len(words))
            return out
        none = np.empty(0, np.int64)
        return work
    return start


def _runs(at: np.ndarray, length: int) -> list[list[int]]:
    """``first, last``: the paragraphs, by number, that begin and end each run covered by paragraphs at
    the sorted places ``at``."""
    breaks = np.flatnonzero(np.diff(at) > length) + 1
    return [[int(r[0]), int(r[-1])] for r in np.split(np.arange(len(at)), breaks)] if len(at) else []


def _columns(batch, *names: str):
    return zip(*[batch.column(n).to_numpy(zero_copy_only=False) for n in names], strict=True)


def _ends(length: int):
    """``ends`` for each paragraph: 1 if it begins a run, 2 if it ends one, 3 for both; of the runs of all
    repeated paragraphs, and of those that go."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for own, at, first in _columns(batch, "id", "at", "first"):
                ends = np.zeros(len(at), np.int8)
                for some in (np.arange(len(at)), np.flatnonzero(first != own)):
                    for i, j in _runs(at[some], length):
                        ends[some[i]] |= 1
                        ends[some[j]] |= 2
                found.append(ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int8()))], names=[*batch.schema.names, "ends"])
    return run


def _surroundings(length: int, most: int):
    """A key for each paragraph at ``at`` and the ``n`` words on one side of it, up to ``most``, on the
    ``sides`` where any text's run ends; ``end`` where a run of this text does."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list[np.ndarray]] = []
            for row, (text, *found) in enumerate(_columns(batch, "text", "at", "paragraph", "keeper", "ends", "sides")):
                h = hash_words(words_of(text))
                for side, step in ((0, -1), (1, 1)):
                    here = (found[4] & (side + 1)) > 0
                    at, names, keeper, ends = (c[here] for c in found[:4])
                    end, keys = (ends & (side + 1)) > 0, names.view(np.uint64) + np.uint64(side)
                    beside = at - 1 if side == 0 else at + length
                    for n in range(1, most + 1):
                        inside = (beside >= 0) & (beside < len(h))
                        at, keeper, end, beside, keys = at[inside], keeper[inside], end[inside], beside[inside], mix(keys[inside] ^ h[beside[inside]])
                        if not len(at):
                            break
                        out.append([np.full(len(at), row), at, np.full(len(at), side), np.full(len(at), n), keeper, end, keys.view(np.int64)])
                        beside = beside + step
            rows, at, side, n, keeper, end, keys = np.concatenate(out, axis=1).astype(np.int64) if out else np.empty((7, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key").take(pa.array(rows)), batch.column("copies").take(pa.array(rows)), batch.column("id").take(pa.array(rows)),
                 pa.array(at.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keeper), pa.array(end == 1), pa.array(keys)],
                names=["text_key", "copies", "id", "at", "side", "n", "keeper", "end", "key"])
    return run


SPANS = "array<struct<start:int,end:int>>"


def _merged(spans) -> list[list[int]]:
    """Spans that meet or overlap as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def _paragraph_spans(runs: list[list[int]], least: int, width: int, percent: int) -> set[tuple[int, int]]:
    """What is signed: each run, two neighbours with the words between, and as many in a row as may link with a text
    that has other words between: of ``n`` shingles, ``width - 1`` and a place's words are lost at each place."""
    def may_link(chain):
        words = chain[-1][1] - chain[0][0]
        lost = sum(b[0] - a[1] + width - 1 for a, b in zip(chain, chain[1:], strict=False))
        return 100 * lost <= (100 - percent) * (words - width + 1)

    chains, chain = [[r] for r in runs] + [[a, b] for a, b in zip(runs, runs[1:], strict=False) if may_link([a, b])], []
    for run in runs:
        if not may_link([*chain, run]):
            chains.append(chain)
            chain = []
        chain = [*chain, run]
    return {(c[0][0], c[-1][1]) for c in [*chains, chain] if c and c[-1][1] - c[0][0] >= least}


def _covered(length: int, least: int, width: int, percent: int):
    """``shared``: the runs of words that other texts have too, ``earlier``: those that an earlier one has, and
    ``paragraphs``: what is signed."""
    def extended(at, reach, which):
        runs = _runs(at, length)
        return _merged((int(at[i]) - reach.get((int(at[i]), 0), none)[which], int(at[j]) + length + reach.get((int(at[j]), 1), none)[which]) for i, j in runs)

    def shared_with(at, keeper, place, i, j, step):
        """How far from paragraph ``i`` towards ``j`` the run is one of its keeper, place by place."""
        k = i
        while k != j and keeper[k + step] == keeper[i] and place[k + step] - at[k + step] == place[i] - at[i]:
            k += step
        return k

    def joined(own, at, keeper, place, reach, which):
        """Runs with the words on both sides that are repeated too; two that differ from the same earlier
        text in a few words between them are one if they link with it as a whole."""
        out: list[list[int]] = []
        before = None  # of the last run: begin and end of its words that are the keeper's, text, place less own, shingles shared
        for i, j in _runs(at, length):
            start = int(at[i]) - reach.get((int(at[i]), 0), none)[which]
            end = int(at[j]) + length + reach.get((int(at[j]), 1), none)[which]
            first, last = shared_with(at, keeper, place, j, i, -1), shared_with(at, keeper, place, i, j, 1)
            left, right = int(at[i]) - reach.get((int(at[i]), 0), none)[2], int(at[j]) + length + reach.get((int(at[j]), 1), none)[2]
            # The part that follows the left end's keeper, and the one that leads to the right end's.
            here = left, right if last == j else int(at[last]) + length, keeper[i], int(place[i] - at[i])
            links = before is not None and here[2] == before[2] != own and left >= before[1]
            if links:
                theirs = left - before[1] + here[3] - before[3]
                common = before[4] + max(0, here[1] - left - width + 1)
                mine = here[1] - before[0] - width + 1
                whole = mine + theirs - (left - before[1])
                links = theirs >= 0 and 100 * common >= percent * (mine + whole - common)
            if out and (links or start <= out[-1][1]):
                out[-1][1] = max(end, out[-1][1])
            else:
                out.append([start, end])
            if links and last == j:
                before = before[0], right, keeper[j], here[3], common
            else:
                begin = left if first == i else int(at[first])
                before = begin, right, keeper[j], int(place[j] - at[j]), max(0, right - begin - width + 1)
        return out
    none = (0, 0, 0)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[list] = [[], [], []]
            for (text, own, at, first, keeper, place), far in zip(
                    _columns(batch, "text_key", "id", "at", "first", "keeper", "place"), batch.column("beyond").to_pylist(), strict=True):
                reach = {(f["at"], f["side"]): (f["any"], f["earlier"], f["kept"]) for f in far or []}
                goes = first != own
                runs, gone = joined(text, at, keeper, place, reach, 0), joined(text, at[goes], keeper[goes], place[goes], reach, 1)
                paragraphs = _paragraph_spans(extended(at, reach, 0), least, width, percent)
                for column, spans in zip(out, (runs, gone, sorted(paragraphs)), strict=True):
                    column.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text_key", "id", "copies")), *(pa.array(c, kind) for c in out)],
                                             names=["text_key", "id", "copies", "shared", "earlier", "paragraphs"])
    return run


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """MinHash: the least values of a set of shingles under ``BANDS * ROWS`` functions, as a key for each band."""
    least = mix(tokens.view(np.uint64)[None, :] * _FACTORS + _OFFSETS).min(axis=1).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        keys = mix(keys ^ least[:, row])
    return keys.view(np.int64)


def _signed(width: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        seen: set[int] = set()  # of this task: of equal sets, one sends its tokens and bands on
        for batch in batches:
            rows, out = [], {"start": [], "end": [], "class": [], "n": [], "tokens": [], "bands": []}
            texts = batch.column("text").to_pylist()
            for row, (text, paragraphs) in enumerate(zip(texts, batch.column("paragraphs").to_pylist(), strict=True)):
                h = shingle_hashes(words_of(text), width)
                for p in paragraphs:
                    tokens = np.unique(h[p["start"]:p["end"] - width + 1])
                    rows.append(row)
                    name = int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))
                    sent = (None, None) if name in seen else (tokens, band_keys(tokens))
                    seen.add(name)
                    for column, value in zip(out.values(), (p["start"], p["end"], name, len(tokens), *sent), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("text_key", "id", "copies")), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
                names=["text_key", "id", "copies", *out])
    return run


def linked_paragraphs(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``text_key, start, end, root, repeated, goes`` of signed paragraphs: ``root`` is the component of paragraphs that
    meet in a band and link by their exact Jaccard similarity, ``repeated`` says that other texts are in it, and
    ``goes`` that an earlier text is and that the paragraph links with the one that stays, the first of all.

    Paragraphs of a bucket are held against its leaders in rounds, then each against bundles of those that it
    meets in a bucket and is not joined to; equal sets of shingles are one from the start.
    """
    sets = write_down(signed.select("class", "n", "tokens").where("tokens is not null").dropDuplicates(["class"]))
    posts = signed.select("class", "n", F.explode("bands").alias("token")).distinct()
    stars, placed = star_components(write_down(posts), sets, percent)
    often = placed.groupBy("token").agg(F.count("*").alias("df"))
    merged = components(matrix_links(write_down(placed.join(often, "token")), sets, percent), "a", "b").toDF("component", "root")
    roots = write_down(stars.join(merged, "component", "left").select(F.col("node").alias("class"), F.coalesce("root", "component").alias("root")))
    held = signed.select("text_key", "id", "copies", "start", "end", "class").join(roots, "class")
    firsts = write_down(held.groupBy("root").agg(
        F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("copies").alias("times"), F.min(F.struct("id", "text_key", "class")).alias("f"))
        .where("low != high or times > 1").select("root", F.col("f.id").alias("first"), F.col("f.class").alias("stays")))
    direct = roots.join(firsts, "root").where(F.col("class") != F.col("stays")).select(F.col("class").alias("a"), F.col("stays").alias("b"))
    near = verified_pairs(direct, sets, percent).select(F.col("a").alias("class"), F.lit(True).alias("near"))
    return held.join(firsts, "root", "left").join(near, "class", "left").select(
        "text_key", "start", "end", "root", F.col("first").isNotNull().alias("repeated"),
        F.coalesce((F.col("first") != F.col("id")) & ((F.col("class") == F.col("stays")) | F.col("near")), F.lit(False)).alias("goes"))


def _judged(least: int):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        spans = lambda found: [(p["start"], p["end"]) for p in found]
        for batch in batches:
            out = {"n_repeated": [], "n_removed": [], "classes": [], "removed": []}
            for shared, earlier, linked in zip(*(batch.column(c).to_pylist() for c in ("shared", "earlier", "linked")), strict=True):
                runs = _merged(spans(shared) + spans(p for p in linked or [] if p["repeated"]))
                gone = [r for r in _merged(spans(earlier) + spans(p for p in linked or [] if p["goes"])) if r[1] - r[0] >= least]
                out["n_repeated"].append(sum(e - s >= least for s, e in runs))
                out["n_removed"].append(len(gone))
                out["classes"].append(sorted({p["root"] for p in linked or []}))
                out["removed"].append([{"start": s, "end": e} for s, e in gone])
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
                                             names=["text_key", "id", *out])
    return run


def _repeated(texts: DataFrame, length: int) -> DataFrame:
    """``text_key, id, copies, at, paragraph, first, keeper, place, ends``: the paragraphs of each text that other texts have too, or
    its copies."""
    found = texts.select("text_key", "copies", "id", F.inline(F.arrays_zip("at", "paragraph")))
    shared = found.groupBy("paragraph").agg(
        F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("copies").alias("copies"),
        F.min(F.struct("id", "text_key", "at")).alias("f")).where("low != high or copies > 1") \
        .select("paragraph", F.col("f.id").alias("first"), F.col("f.text_key").alias("keeper"), F.col("f.at").alias("place"))
    lists = found.join(write_down(shared), "paragraph").groupBy("text_key", "id", "copies").agg(
        F.sort_array(F.collect_list(F.struct("at", "paragraph", "first", "keeper", "place"))).alias("p"))
    lists = lists.select("text_key", "id", "copies", *[F.col(f"p.{c}").alias(c) for c in ("at", "paragraph", "first", "keeper", "place")])
    return lists.mapInArrow(_ends(length), StructType([*lists.schema.fields, *StructType.fromDDL("ends array<tinyint>").fields]))


def _reach(identified: DataFrame, lists: DataFrame, length: int, spacing: int) -> DataFrame:
    """``text_key, beyond``: how many words beside each run's ends are repeated with it."""
    ends = lists.select(F.inline(F.arrays_zip("paragraph", "ends"))).where("ends > 0").groupBy("paragraph").agg(F.bit_or("ends").alias("sides"))
    there = lists.select("text_key", "id", "copies", F.inline(F.arrays_zip("at", "paragraph", "keeper", "ends"))).join(write_down(ends), "paragraph") \
        .groupBy("text_key", "id", "copies").agg(F.collect_list(F.struct("at", "paragraph", "keeper", "ends", "sides")).alias("p"))
    there = there.select("text_key", "id", "copies", *[F.col(f"p.{c}").alias(c) for c in ("at", "paragraph", "keeper", "ends", "sides")])
    beside = write_down(identified.join(there, ["text_key", "id"]).mapInArrow(
        _surroundings(length, spacing - 1), "text_key long, copies long, id long, at int, side int, n int, keeper long, end boolean, key long"))
    known = beside.groupBy("key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("copies").alias("times"),
                                      F.min(F.struct("id", "text_key")).alias("f")).where("low != high or times > 1") \
        .select("key", F.col("f.id").alias("first"), F.col("f.text_key").alias("holder"))
    reach = beside.where("end").join(known, "key").groupBy("text_key", "at", "side").agg(
        F.max("n").alias("any"), F.coalesce(F.max(F.when(F.col("first") != F.col("id"), F.col("n"))), F.lit(0)).alias("earlier"),
        F.coalesce(F.max(F.when(F.col("holder") == F.col("keeper"), F.col("n"))), F.lit(0)).alias("kept"))
    return reach.groupBy("text_key").agg(F.collect_list(F.struct("at", "side", "any", "earlier", "kept")).alias("beyond"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, spacing: int = SPACING, least: int = LEAST,
                      width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per document with passages that other documents have too: ``doc_id, n_repeated, n_removed,
    classes, removed``.

    A paragraph is ``length`` words from a place that the words themselves pick, so words in a row that
    two documents share hold the same paragraphs in both, whatever stands around them. Equal paragraphs
    of two documents or more are repeated; they stay in the document of least id and go from the others.
    A run of them is extended on both sides, word by word, as far as another document (an earlier one, for
    what goes) goes on in the same way, which is less than ``spacing`` words. Equal surroundings are
    counted, not compared. Passages are runs of ``least`` words or more. Two of them with changed words between
    are one if the whole links with the first holder's words. Each passage, and neighbouring runs with the
    changed words between, are signed by MinHash over ``width``-word shingles; those that meet in a band and link at a
    Jaccard similarity of ``percent`` form components. What links with the first of its component goes as a
    whole, the changed words with it. ``classes`` are the components of a document's passages; ``removed`` are
    runs struct(start, end) of words that go, counted from 0, end exclusive.

    Null texts and texts of fewer than ``least`` words have no passages. Null ids stay null and come
    after all others; repeated rows are documents of their own, of which those with the least id keep
    their passages; other columns are ignored; an empty table gives an empty result.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    identified = keyed.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).drop("doc_id")
    spark = docs.sparkSession
    rows_path, covered_path, links_path = (new_path(spark) for _ in range(3))
    with scratch(spark):  # what is written down on the way goes as soon as nothing reads it
        lists_path = new_path(spark)
        with scratch(spark):
            texts_path = new_path(spark)
            with scratch(spark):
                cut = write_down(map_texts(keyed, "at array<int>, paragraph array<long>, words int", _paragraphs(length, spacing)))
                texts = write_down(cut.where(f"words >= {least}").groupBy("text_key").agg(
                    F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("id"),
                    F.max("at").alias("at"), F.max("paragraph").alias("paragraph")), texts_path)
                rows = write_down(cut.select("doc_id", "text_key", "words"), rows_path)
            lists = write_down(_repeated(texts, length), lists_path)
        covered = write_down(lists.join(_reach(identified, lists, length, spacing), "text_key", "left").mapInArrow(
            _covered(length, least, width, percent), f"text_key long, id long, copies long, shared {SPANS}, earlier {SPANS}, paragraphs {SPANS}")
            .where("size(paragraphs) > 0 or size(shared) > 0"), covered_path)
    with scratch(spark):
        signed = write_down(identified.join(covered.select("text_key", "id", "copies", "paragraphs"), ["text_key", "id"]).mapInArrow(
            _signed(width), "text_key long, id long, copies long, start int, end int, class long, n long, tokens array<long>, bands array<long>"))
        links = write_down(linked_paragraphs(signed, percent).groupBy("text_key").agg(
            F.collect_set(F.struct("start", "end", "root", "repeated", "goes")).alias("linked")), links_path)
    judged = covered.join(links, "text_key", "left").mapInArrow(
        _judged(least), "text_key long, id long, n_repeated long, n_removed long, "
        "classes array<long>, removed array<struct<start:int,end:int>>").where("n_repeated > 0")
    rows = rows.join(judged, "text_key")
    # Of equal texts all but those of least id go as a whole.
    copy = F.coalesce("doc_id", F.lit(LAST)) != F.col("id")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("end")))
    return rows.select("doc_id", "n_repeated", F.when(copy, F.col("n_repeated")).otherwise(F.col("n_removed")).alias("n_removed"),
                       "classes", F.when(copy, whole).otherwise(F.col("removed")).alias("removed"))
