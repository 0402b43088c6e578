"""Nearest neighbours by an inverted multi-index over two halves of each vector."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import write_down

CENTROIDS = 60    # of each half, so that a query's cells fit a word of bits per centroid
SAMPLE = 20_000   # vectors that the centroids and the share to visit are fitted on
PROBES = 200      # of them, held against the rest to find the share
RECALL = 0.96     # that the share must reach on the sample
BLOCK = 4000      # vectors of one block of the index
QUERIES = 2000    # queries that meet one block in one task


@dataclass(frozen=True)
class Codebook:
    """Centroids of both halves, and the share of the index that a query visits."""
    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(x[:, :half], self.first), _nearest(x[:, half:], self.second)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(1) - 2 * x @ centroids.T, axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance, until they hold ``wanted`` vectors.

    ``first`` and ``second`` are a query's distances to the centroids of each half (less inner product
    is farther); a heap holds the frontier of pairs, from the nearest pair outwards.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            cells.append((int(a[i]), int(b[j])))
            held += n
        for s, t in ((i + 1, j), (i, j + 1)):
            if s < len(a) and t < len(b) and (s, t) not in seen:
                seen.add((s, t))
                heapq.heappush(heap, (float(first[a[s]] + second[b[t]]), s, t))
    return cells


def fit(x: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float = RECALL) -> Codebook:
    """Centroids of ``x``, and the least share of vectors, in order of their cells, that holds ``recall`` of
    the ``k`` nearest of some probes among ``x``."""
    half = max(1, x.shape[1] // 2)
    most = max(1, min(centroids, int(np.sqrt(len(x)))))
    book = Codebook(_k_means(x[:, :half], most), _k_means(x[:, half:], most), 1.0)
    probes = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    a, b = book.cells(x)
    near = x[probes] @ x.T
    near[np.arange(len(probes)), probes] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return book
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    q = x[probes]
    score = (q[:, :half] @ book.first.T)[:, a] + (q[:, half:] @ book.second.T)[:, b]
    ahead = np.stack([(score > np.take_along_axis(score, best[:, i:i + 1], 1)).mean(1) for i in range(k)], axis=1)
    return Codebook(book.first, book.second, float(min(1.0, np.quantile(ahead, recall) + 0.01)))


def _stack(vectors) -> np.ndarray:
    return np.array(vectors.to_list(), dtype=np.float64)


def _search_block(k: int):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "score": [], "ids": []}
        if len(queries) and len(entries):
            x, q = _stack(entries["vector"]), _stack(queries["query"])
            bits = np.array(queries["bits"].to_list(), dtype=np.int64)
            rows, columns = entries["row"].to_numpy(), entries["col"].to_numpy()
            for at in range(0, len(q), 256):
                score = q[at:at + 256] @ x.T
                open_ = (bits[at:at + 256][:, rows] >> columns) & 1 == 1
                score[~open_] = -np.inf
                if score.shape[1] > k:
                    score[score < np.partition(score, -k, axis=1)[:, -k][:, None]] = -np.inf
                i, j = np.nonzero(score > -np.inf)
                out["q"].append(queries["q"].to_numpy()[at + i])
                out["score"].append(score[i, j])
                out["ids"].extend(entries["ids"].to_numpy()[j])
        return pd.DataFrame({"q": np.concatenate([np.empty(0, np.int64), *out["q"]]),
                             "score": np.concatenate([np.empty(0), *out["score"]]), "ids": pd.Series(out["ids"], dtype=object)})
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (double) of the rows that take part: an id, no null or non-finite component, not
    all zero, and the most common length (the greater one of a tie)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = kept.where(F.size("vector") == (length["n"] if length else 0))
    return kept.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest of each row whose ``vec_id`` is divisible by ``every``, among all other rows:
    ``query_id, rank`` (from 1), ``vec_id, score``.

    Nearness is the largest inner product in double precision; ties go to the smaller vec_id. Both
    halves of the vectors are quantised apart. A query visits pairs of centroids in order of their
    summed distance (the negative inner product) until they hold the share of the vectors that reached
    ``RECALL`` on a sample, and all vectors in them are scored. Centroids and share are fitted on at
    most ``SAMPLE`` vectors; every vector is indexed.

    Equal vectors are one entry with their ``k + 1`` smallest ids, which are all that any result can
    name, and one query, so a vector with a third of the rows is searched once. Cells are laid out in
    blocks of about ``BLOCK`` vectors, a large cell over several. Rows without id, null, zero and
    non-finite vectors, and vectors of an odd length take no part; of rows with one id the least
    vector counts; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = write_down(usable(vectors).withColumn("q", F.xxhash64("vector")))
    empty = "query_id long, rank int, vec_id long, score double"
    turn = Window.partitionBy("q", "vector").orderBy("vec_id")
    entries = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1) \
        .groupBy("q", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = write_down(entries)
    total = entries.count()
    if not total:
        return spark.createDataFrame([], empty)
    drawn = entries.select("q", "vector").orderBy("q", "vector").limit(SAMPLE).repartition(1)

    def learn(batches):
        held = pd.concat(list(batches)).sort_values("q", kind="stable")
        book = fit(_stack(held["vector"]), k)
        yield pd.DataFrame({"first": [book.first.ravel()], "second": [book.second.ravel()], "size": [len(book.first)], "share": [book.share]})

    fitted = drawn.mapInPandas(learn, "first array<double>, second array<double>, size long, share double").first()
    book = Codebook(np.array(fitted["first"]).reshape(fitted["size"], -1), np.array(fitted["second"]).reshape(fitted["size"], -1), fitted["share"])
    size, half = len(book.first), book.first.shape[1]

    def assign(batches):
        for batch in batches:
            a, b = book.cells(_stack(batch["vector"]))
            yield batch.assign(row=a, col=b)

    indexed = write_down(entries.mapInPandas(assign, "q long, vector array<double>, ids array<long>, row long, col long"))
    counts = np.zeros((size, size), np.int64)
    for r in indexed.groupBy("row", "col").count().collect():
        counts[r["row"], r["col"]] = r["count"]
    wanted = int(np.ceil(book.share * total))
    # Blocks: runs of centroids of the first half, a centroid with many vectors in parts of its own.
    per_row, block, parts, filled = counts.sum(1), np.zeros(size, np.int64), np.ones(size, np.int64), 0
    for i in range(size):
        parts[i] = max(1, -(-per_row[i] // BLOCK))
        if filled and (filled + per_row[i] > BLOCK):
            filled = 0
            block[i:] += 1
        filled += per_row[i]

    def ask(batches):
        for batch in batches:
            out = {"q": [], "query": [], "block": [], "part": [], "bits": []}
            for q, vector in zip(batch["q"], batch["vector"], strict=True):
                bits = np.zeros(size, np.int64)
                for i, j in visited(-(book.first @ vector[:half]), -(book.second @ vector[half:]), counts, wanted):
                    bits[i] |= 1 << j
                for at, part in sorted({(int(block[i]), p) for i in np.flatnonzero(bits) for p in range(parts[i])}):
                    for name, value in zip(out, (q, vector, at, part, bits), strict=True):
                        out[name].append(value)
            yield pd.DataFrame(out)

    asked = rows.where(F.col("vec_id") % every == 0).select("q", "vector").distinct()
    splits = max(1, -(-asked.count() // QUERIES))
    asked = asked.mapInPandas(ask, "q long, query array<double>, block long, part long, bits array<long>") \
        .withColumn("split", F.pmod("q", F.lit(splits).cast("long")))
    sizes = spark.createDataFrame([(i, int(block[i]), int(parts[i])) for i in range(size)], "row long, block long, parts long")
    held = indexed.join(sizes, "row").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts"))) \
        .withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))) \
        .select(F.col("block").alias("b"), F.col("part").alias("p"), F.col("split").alias("s"), "vector", "ids", "row", "col")
    found = asked.groupBy("block", "part", "split").cogroup(held.groupBy("b", "p", "s")) \
        .applyInPandas(_search_block(k + 1), "q long, score double, ids array<long>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("turn", F.row_number().over(order)) \
        .where(F.col("turn") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "q").join(best, "q") \
        .select("query_id", F.posexplode(others).alias("at", "b")) \
        .select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
