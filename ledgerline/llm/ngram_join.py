"""Jaccard join of documents on word shingles by a token-group matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.shingles import shingle_set
from ledgerline.llm.texts import map_texts
from ledgerline.session import new_path, scratch, write_down

WIDTH, PERCENT = 5, 80  # five words; 100 * intersection >= 80 * union
LEAST_HEAD = 8   # tokens of a small set that are all looked at
LEADERS = 2      # that each document is held against in a round before the matrix
WORTHWHILE = 50  # a round is followed by another if it joined one in so many components
BUNDLE = 1024    # documents of one kind that a query meets at once
QUERIES = 2048   # that meet one bundle in one task
TOKENS = 1 << 20  # of the sets in a bundle, or of its queries in a task
BITS = 1 << 24   # of the map of documents whose texts are read again, 2 MB


def least_overlap(n, percent: int = PERCENT):
    """Tokens that a set of ``n`` shares at least with any set it links with."""
    return (percent * n + 99) // 100


def linked(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _class_id(tokens: np.ndarray) -> int | None:
    """64 bits by which sets are told apart; null for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else None


def _signatures(width: int, percent: int):
    def start():
        seen: set[int] = set()  # of this task: of equal sets, one sends its tokens on

        def work(texts):
            out = {"class": [], "n": [], "head": []}
            for text in texts:
                tokens = shingle_set(text, width)
                n, name = len(tokens), _class_id(tokens)
                needed = n - least_overlap(n, percent) + 1
                out["head"].append(None if name is None or name in seen else tokens[:max(LEAST_HEAD, needed + needed // 2)])
                seen.add(name)
                out["class"].append(name)
                out["n"].append(n)
            return out
        return work
    return start


def _token_sets(width: int):
    def work(texts):
        sets = [shingle_set(t, width) for t in texts]
        return {"class": [_class_id(s) for s in sets], "n": [len(s) for s in sets], "tokens": sets}
    return lambda: work


def signatures(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, class, n, head``: documents with equal shingle sets have one class (null
    without words); ``head`` holds the tokens of least hash that a search needs, and half as many
    again, and is null for repeats of a class in a task."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return map_texts(keyed, "class long, n long, head array<long>", _signatures(width, percent))


def postings(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``class, n, token, df``: the tokens under which a class must be looked for.

    Sets that link share all but a few tokens, so they share one of the first ``n - overlap + 1`` in
    any order common to all. The order is by frequency within the heads, where each class may leave
    out as many of its most frequent tokens as its head is longer than needed. A token of one class
    leads nowhere and is dropped before anything is joined by it.
    """
    heads = signed.where("head is not null").select("class", F.explode("head").alias("token"))
    often = heads.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    shared = write_down(heads.join(often, "token").distinct())
    counts = shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    sizes = signed.where("head is not null").select("class", "n", F.size("head").alias("head_n")).distinct()
    held = shared.join(counts, "token").join(sizes, "class")
    needed = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    alone = F.col("head_n") - F.count("*").over(Window.partitionBy("class"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "token"))
    return held.withColumns({"rank": rank, "keep": F.col("head_n") - F.least(F.floor(needed / 2), F.col("head_n") - needed) - alone}).where("rank <= keep") \
        .select("class", "n", "token", "df")


def possible(df: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` whose keys may be in ``found``, and few others: a map of ``BITS`` bits of the keys' hashes
    goes to all tasks, however many keys there are, so that a join need not shuffle the rest."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    bits = found.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("stretch")) \
        .agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    held = df.withColumn("bit", bit).withColumn("stretch", F.expr("bit div 32768")).join(F.broadcast(bits), "stretch")
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    return held.where(F.expr("cast(power(2, bit % 8) as int)").bitwiseAND(byte) != 0).select(*df.columns)


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets link."""
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(left, "a").join(right, "b") \
        .where(shared * 100 >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def star_links(placed: DataFrame, sets: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` of each class with the leaders of a few of its tokens, where these are of another
    component. ``turn`` draws other tokens and leaders."""
    drawn = Window.partitionBy("class").orderBy(F.xxhash64("token", F.lit(turn)), "token")
    tokens = placed.withColumn("turn", F.row_number().over(drawn)).where(F.col("turn") <= LEADERS)
    leader = placed.groupBy("token").agg(F.min(F.struct(F.xxhash64("class", "token", F.lit(turn)).alias("h"), F.col("class").alias("b"),
                                                        F.col("n").alias("m"), F.col("component").alias("other"))).alias("leader"))
    pairs = tokens.join(leader, "token").select(F.col("class").alias("a"), "leader.b", "n", "leader.m", "component", "leader.other") \
        .where((F.col("component") != F.col("other")) & (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
    return verified_pairs(pairs.select("a", "b").distinct(), sets, percent)


def _open(placed: DataFrame) -> DataFrame:
    """The rows of tokens that several components have."""
    tokens = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    return write_down(placed.join(tokens, "token", "left_semi"))


def star_components(posts: DataFrame, sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``node, component`` of all classes as far as stars join them, and the rows of ``posts``, with their
    component, that may hold more links.

    A round is linear work and joins most copies around its leaders, however many there are. Only what lies
    in unlike components goes on to the next, with other leaders, so a group of near copies is one
    component, or nearly, before all its remaining links are looked for. Rounds end when one joins little.
    """
    known = posts.select(F.col("class").alias("node"), F.col("class").alias("component")).distinct()
    placed, turn = _open(posts.withColumn("component", F.col("class"))), 0
    while True:
        name = placed.select("class", "component").distinct()
        links = star_links(placed, sets, turn, percent)
        links = links.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b")
        roots = write_down(components(links, "ca", "cb").toDF("component", "root"))
        joined, open_ = roots.where("component != root").count(), name.select("component").distinct().count()
        if joined:
            rooted = lambda df: df.join(roots, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")  # noqa: B023, E731
            known, placed = write_down(rooted(known)), _open(rooted(placed))
        if joined * WORTHWHILE <= open_:
            return known, placed
        turn += 1


def _open_bundles(percent: int):
    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        theirs, m = members["theirs"].to_numpy(), members["m"].to_numpy()
        held = np.concatenate(members["held"].to_list())
        order = np.argsort(held, kind="stable")
        at = np.repeat(np.arange(len(m)), [len(h) for h in members["held"]])[order]  # the members by token
        tokens, first, times = np.unique(held[order], return_index=True, return_counts=True)
        found: set[tuple[int, int]] = set()
        for own, n, asked in zip(*[queries[c] for c in ("component", "n", "tokens")], strict=True):
            place = np.searchsorted(tokens, asked)
            place = place[tokens[np.minimum(place, len(tokens) - 1)] == asked]
            counts = times[place]
            ends = np.cumsum(counts)
            if not len(ends):
                continue
            rows = at[np.arange(ends[-1]) + np.repeat(first[place] - ends + counts, counts)]
            shared = np.bincount(rows, minlength=len(m))  # with every member of the bundle at once
            links = (theirs != own) & (m >= n) & (100 * shared >= percent * (n + m - shared))
            found.update((own, other) for other in theirs[links].tolist())
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")
    return run


def _parts(members: int, n: str = "n"):
    """Into how many parts sets go, for ``members`` and ``TOKENS`` in each at most, or nearly."""
    return F.ceil(F.greatest(F.count("*") / members, F.sum(n) / TOKENS))


def matrix_links(placed: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` between the components of ``placed``, none left out.

    The documents still in question are partitioned into bundles of about ``BUNDLE`` similar ones: by component,
    else by the most frequent token they are looked up under, then by size. Such groups, if small, share
    a bundle with others around the same frequent token, so few bundles hold a token that many
    documents have. The matrix holds which tokens each bundle's documents are found under. A document no
    larger than a bundle's largest is sent there once, however many such tokens it shares, and its overlap with
    all documents of the bundle is counted in one go. Links within a component are not looked for again.
    """
    members = placed.groupBy("class", "component", "n").agg(F.max(F.struct("df", "token")).alias("anchor"))
    around = placed.select("class", "token").join(members.select("class", "anchor"), "class").groupBy("token").agg(F.max("anchor").alias("around"))
    labels = placed.select("class", "token").join(around, "token").groupBy("class").agg(F.max("around")["token"].alias("label"))
    grouped = members.join(members.groupBy("component").agg(F.count("*").alias("size")), "component").join(labels, "class") \
        .withColumn("own", F.when(F.col("size") > 1, F.col("component")).otherwise(F.col("anchor.token"))) \
        .withColumn("scale", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)))).select("class", "component", "n", "own", "scale", "label")
    counts = grouped.groupBy("own", "scale").agg(_parts(BUNDLE).alias("own_parts"), _parts(BUNDLE // 2).alias("halves"))
    grouped = write_down(grouped.join(counts, ["own", "scale"]))
    counts = grouped.where("halves = 1").groupBy("label", "scale").agg(_parts(BUNDLE).alias("parts"))
    grouped = grouped.join(counts, ["label", "scale"], "left").withColumn("bundle", F.when(
        F.col("halves") == 1, F.xxhash64("label", "scale", F.pmod(F.xxhash64("own"), F.col("parts")))).otherwise(
        F.xxhash64("own", "scale", F.pmod(F.xxhash64("class"), F.col("own_parts")))))
    grouped = write_down(grouped.select("class", "component", "n", "bundle"))
    sizes = grouped.groupBy("bundle").agg(F.min("n").alias("least"), F.max("n").alias("most"),
                                          F.min("component").alias("low"), F.max("component").alias("high"))
    matrix = placed.join(grouped.select("class", "bundle"), "class").select("token", "bundle").distinct().join(sizes, "bundle")
    meets = placed.join(matrix, "token").where(
        (F.col("n") <= F.col("most")) & (F.col("n") * 100 >= F.col("least") * percent)
        & ((F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))))
    meets = write_down(meets.select("class", "component", "n", "bundle").distinct())
    parts = meets.groupBy("bundle").agg(_parts(QUERIES).alias("parts"))
    asking = meets.join(parts, "bundle").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))) \
        .join(sets.select("class", "tokens"), "class").select("bundle", "part", "component", "n", "tokens")
    asked = grouped.join(parts, "bundle").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .join(sets.select("class", F.col("tokens").alias("held")), "class") \
        .select(F.col("bundle").alias("d"), F.col("part").alias("p"), F.col("component").alias("theirs"), F.col("n").alias("m"), "held")
    return asking.groupBy("bundle", "part").cogroup(asked.groupBy("d", "p")) \
        .applyInPandas(_open_bundles(percent), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` (its set's size), ``component_id`` (the least
    ``doc_id`` that links reach from it, itself included) and ``text_key``, a hash of its text.

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``width``-word
    shingles, words being lower-cased (A-Z) runs without white space; a text of fewer words is one
    shingle. Null, empty and blank texts have no shingles and no links. Rows with a null doc_id take
    part and get the least non-null id they reach, else null; repeated rows are rows of their own with
    the same answer; other columns are ignored; an empty table gives an empty result. No pair of
    equal sets is built, and a group of near copies is joined by stars around leaders.
    """
    return rooted_groups(docs, width, percent).drop("root")


def rooted_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """:func:`jaccard_groups` with ``root``, the component's key whatever the ids: null without shingles only."""
    path = new_path(docs.sparkSession)
    with scratch(docs.sparkSession):  # only the groups stay of what is written down on the way
        return write_down(_rooted(docs, width, percent), path)


def _rooted(docs: DataFrame, width: int, percent: int) -> DataFrame:
    signed = write_down(signatures(docs, width, percent))
    posts = write_down(postings(signed, percent))
    wanted = posts.select("class").distinct()
    found = signed.join(wanted, "class").groupBy("class").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text_key")).alias("at"))
    found = write_down(found.select(F.col("at.id").alias("id"), F.col("at.text_key").alias("text_key")).distinct())
    texts = docs.select("text", F.xxhash64("text").alias("text_key"), F.coalesce("doc_id", F.lit(-1)).alias("id"))
    texts = possible(texts, found, "text_key", "id").join(found, ["text_key", "id"], "left_semi").select("text")
    sets = map_texts(texts, "class long, n long, tokens array<long>", _token_sets(width))
    sets = write_down(sets.join(wanted, "class", "left_semi").dropDuplicates(["class"]))
    stars, placed = star_components(posts, sets, percent)
    more = components(matrix_links(placed, sets, percent), "a", "b")
    merged = more.select(F.col("node").alias("component"), F.col("component").alias("root"))
    classes = wanted.join(stars.withColumnRenamed("node", "class"), "class", "left") \
        .select("class", F.coalesce("component", "class").alias("component")) \
        .join(merged, "component", "left").select("class", F.coalesce("root", "component").alias("root"))
    least = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")) \
        .join(classes, "class", "left")
    by_root = least.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("least").alias("component_id"))
    by_class = least.select("class", F.coalesce("root", "class").alias("root")).join(by_root, "root").select("class", "component_id", "root")
    least_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "class", "text_key", F.col("n").alias("n_shingles")).join(by_class, "class", "left") \
        .select("doc_id", "n_shingles", least_id.alias("component_id"), "text_key", "root")
