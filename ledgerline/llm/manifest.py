"""A Merkle manifest of a dataset: digests of documents, of their sources and of all, with a proof for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import write_down

RUN = 3          # nodes that one digest stands for
LEVELS = 5       # levels of a block, which so has 243 nodes at most
BLOCK = RUN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _measured(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _hash(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row of documents, whose columns may be replaced."""
    return _hash(*[_measured(changed.get(c, F.col(c))) for c in FIELDS])


def leaves(docs: DataFrame) -> DataFrame:
    """``grp, doc_id, leaf, tampered``: the last is the digest after tampering, null for documents that stay.
    ``grp`` sorts as the source does, bytewise and null first."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    less = leaf_digest(text=F.translate("text", "\n", ""))
    return docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), "doc_id",
                       leaf_digest().alias("leaf"), F.when(odd, less).alias("tampered"))


def ranked(rows: DataFrame, *order_by: Column) -> DataFrame:
    """``rows`` with their position ``pos`` in ``grp`` (from 0) and the size ``n`` of the group.

    Rows are sorted by range over the whole cluster and pinned; a position is the place in the part plus what
    the group has in earlier parts, a row per group and part. A hot group spreads over many parts.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pinned = write_down(rows.orderBy("grp", *order_by).select("*", F.spark_partition_id().alias("part"), at.alias("at")))
    held = pinned.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    parts = Window.partitionBy("grp")
    before = F.sum("size").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"), F.sum("size").over(parts).alias("n"))
    return pinned.join(write_down(starts), ["grp", "part"]).withColumn("pos", F.col("at") + F.col("start")).drop("part", "at", "start")


def nested_blocks(nodes: DataFrame) -> DataFrame:
    """``grp, n, block, digest, kids`` of ``grp, n, pos, digest, item``: a row per block of nodes.

    The digits of a node's position in its block are grouped away one after the other, the lowest first: a
    run of equal higher digits becomes a struct of its digest and its child structs. All of that happens in
    the task that a block is dealt to; a block holds ``BLOCK`` nodes at most, however large the group.
    """
    digits = [f"d{i}" for i in range(LEVELS)]
    rows = nodes.select("grp", "n", F.expr(f"pos div {BLOCK}L").alias("block"), "digest", F.col("item").alias("kids"),
                        *[F.expr(f"cast(pos div {RUN ** i}L % {RUN} as tinyint)").alias(d) for i, d in enumerate(digits)])
    rows = rows.repartition("grp", "block")
    for i, digit in enumerate(digits):
        kid = F.struct(F.col(digit).alias("digit"), "digest", "kids")
        rows = rows.groupBy("grp", "n", "block", *digits[i + 1:]).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        joined = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        # While the group has several nodes on a level, each run has a digest, also a run of one.
        rows = rows.withColumn("digest", F.when(F.col("n") > RUN ** i, joined).otherwise(F.col("kids")[0]["digest"]))
    return rows


def emitted(blocks: DataFrame, *carried: str) -> DataFrame:
    """``grp, pos, digest, item, path`` and ``carried`` of the nodes of ``blocks``, which have their own ``path``.

    A path lists, from the node upwards, what stands left and right of it in each run. It is
    found on the way down through the nested structs, without joins.
    """
    rows = blocks.select("grp", "n", F.col("block").alias("pos"), "kids", "path", *carried)
    beside = lambda part: F.array_join(F.transform(part, lambda k: k["digest"]), "")
    for i in reversed(range(LEVELS)):
        kids = F.col("kids")
        placed = F.explode(F.transform(kids, lambda k, j: F.struct(
            k.alias("kid"), beside(F.slice(kids, F.lit(1), j)).alias("left"), beside(F.slice(kids, j + 2, F.lit(RUN))).alias("right")))).alias("placed")
        rows = rows.select("grp", "n", "pos", "path", placed, *carried)
        step = F.array(F.struct("placed.left", "placed.right"))
        rows = rows.select("grp", "n", (F.col("pos") * RUN + F.col("placed.kid.digit")).alias("pos"), F.col("placed.kid.digest").alias("digest"),
                           F.col("placed.kid.kids").alias("kids"), F.when(F.col("n") > RUN ** i, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *carried)
    return rows.withColumnRenamed("kids", "item")


def rollup(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of blocks, from those of ``nodes`` to one for each group; each round is written down."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [write_down(nested_blocks(nodes))]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        above = rounds[-1].select("grp", F.expr(f"(n + {BLOCK - 1}L) div {BLOCK}L").alias("n"), F.col("block").alias("pos"),
                                  "digest", F.lit(0).alias("item"))
        rounds.append(write_down(nested_blocks(above)))
    return rounds


def unrolled(rounds: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """All nodes below ``rounds`` with their paths; ``tops`` has ``grp``, the group's own ``path`` and ``carried``.
    Between rounds, paths of blocks are joined to the blocks, a row each."""
    rows = emitted(rounds[-1].join(tops, "grp"), *carried)
    for blocks in reversed(rounds[:-1]):
        paths = rows.select("grp", F.col("pos").alias("block"), "path", *carried)
        rows = emitted(blocks.join(paths, ["grp", "block"]), *carried)
    return rows


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, path``.

    Leaves ascend by ``doc_id`` in their source; runs of three become one digest, level by level, down to the
    source's ``subroot``, and subroots likewise to the ``root``. ``path`` holds the siblings left and right of a document on
    each level, ``proof_sha256`` is their digest, and ``folded_root`` is what they make of the document as
    it is after tampering (documents with an even CRC-32 of their id lose their line ends).

    Nulls are written as ``-``, unlike empty texts. A null ``doc_id`` comes first in its source and is not tampered with;
    rows of one id go by their digest, and equal rows are leaves of their own with the same digests. A source of one
    document is its leaf, one source alone is the root; an empty table gives an empty result. Other columns are
    ignored, and a text of any length leaves the task that reads it as a digest only. No source and no tree is
    ever held in one task: a block has at most ``BLOCK`` nodes.
    """
    rows = write_down(leaves(docs))
    placed = ranked(rows, F.asc_nulls_first("doc_id"), F.asc("leaf"))
    below = rollup(placed.select("grp", "n", "pos", F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("item")))
    subroots = below[-1].select(F.lit("").alias("grp"), F.col("grp").alias("item"), "digest")
    above = rollup(ranked(subroots, F.asc("item")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = above[-1].select("grp", F.col("digest").alias("root"), none.alias("path"))
    sources = unrolled(above, roots, "root").select(F.col("item").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    found = unrolled(below, write_down(sources), "subroot", "root")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("item.tampered", "digest"), lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))
    out = found.select("item.doc_id", F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("source"), F.col("digest").alias("leaf"),
                       "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same by plain SQL, for DuckDB; a CRC-32 is made bit by bit, as DuckDB has none.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS grp,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f, replace(text, chr(10), '') AS less,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
      list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
leaves AS (SELECT id, doc_id, grp, sha256(array_to_string(list_transform(f, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(array_to_string(list_transform(f[:4] || [less], lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) END AS tampered
  FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (SELECT grp, 0 AS lev, pos, n, leaf AS d FROM placed UNION ALL
  SELECT grp, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lev, n, pos // 3),
runs AS (SELECT grp, lev, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM tree WHERE n > 1 GROUP BY grp, lev, pos // 3),
subroots AS (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lev, pos, n, subroot AS d FROM subroots UNION ALL
  SELECT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lev, n, pos // 3),
top_runs AS (SELECT lev, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY lev, pos // 3),
walk AS (SELECT id, grp, 0 AS lev, pos, n, coalesce(tampered, leaf) AS d, '' AS beside FROM placed UNION ALL
  SELECT id, w.grp, w.lev + 1, pos // 3, (n + 2) // 3, sha256(array_to_string(ds[:pos % 3], '') || d || array_to_string(ds[pos % 3 + 2:], '')),
    beside || array_to_string(ds[:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '')
  FROM walk w JOIN runs r ON w.grp = r.grp AND w.lev = r.lev AND w.pos // 3 = r.run WHERE w.n > 1),
climb AS (SELECT id, 0 AS lev, s.pos, s.n, d, beside FROM walk w JOIN subroots s USING (grp) WHERE w.n = 1 UNION ALL
  SELECT id, c.lev + 1, pos // 3, (n + 2) // 3, sha256(array_to_string(ds[:pos % 3], '') || d || array_to_string(ds[pos % 3 + 2:], '')),
    beside || array_to_string(ds[:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '')
  FROM climb c JOIN top_runs r ON c.lev = r.lev AND c.pos // 3 = r.run WHERE c.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, t.d AS root, sha256(c.beside) AS proof_sha256, c.d AS folded_root, c.d = t.d AS verified
FROM leaves l JOIN climb c ON l.id = c.id AND c.n = 1 JOIN subroots s ON s.grp = l.grp, top t WHERE t.n = 1
"""
