"""Line deduplication by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import new_path, scratch, write_down

LEADING = 2        # leading tokens on the path to a leaf, after the token count
MIN_DOCS = 5       # texts that a template recurs in
CONSTANT = 75      # per cent of a generalised template's tokens that stay
LEAST_CONSTANT = 4
FIELD = "<*>"
WORDS = 1 << 16    # of 64 bits each, in a set of keys that is sent to all tasks


def identity(text: Column) -> Column:
    """Tells texts apart: 128 bits."""
    return F.unhex(F.md5(text))


def spaced_line(line: Column) -> Column:
    """The line's tokens, one space apart."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for part in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(part))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(spaced: Column) -> Column:
    """Tokens with a digit or an at sign become variable fields."""
    fields = F.regexp_replace(spaced, r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+", FIELD)
    return F.when(spaced.rlike("[0-9@]"), fields).otherwise(spaced)


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(WORDS))


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """The keys as ``WORDS`` words of bits at most, some bits standing for several keys: less than a
    megabyte, whatever the number of keys, to pick rows that may match before they are shuffled."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(key), F.lit(64)).cast("int"))
    return F.broadcast(keys.groupBy(_word(F.col(key)).alias("_word")).agg(F.bit_or(bit).alias("_bits")))


def _may_match(key: Column) -> Column:
    return F.coalesce(F.getbit("_bits", F.pmod(key, F.lit(64)).cast("int")) == 1, F.lit(False))


def tree_lines(docs: DataFrame) -> DataFrame:
    """``text_key, line_no, spaced, leaf`` of every line with tokens, in rows as many as its text has.

    A leaf of the tree holds the lines of one token count that begin with the same tokens. Only these tokens are
    looked at here, so that a line is masked only where its leaf or its text is of interest.
    """
    texts = docs.where("text is not null").select(identity(F.col("text")).alias("text_key"), F.split("text", "\n").alias("lines"))
    lines = texts.select("text_key", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select("text_key", "line_no", spaced_line(F.col("line")).alias("spaced")).where("spaced != ''")
    n = F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "))) + 1
    lead = masked(F.substring_index("spaced", " ", LEADING))
    return lines.select("text_key", "line_no", "spaced", F.xxhash64(n, lead).alias("leaf"))


def _line_key(lines: DataFrame) -> DataFrame:
    return lines.withColumn("masked", masked(F.col("spaced"))).withColumn("line_key", identity(F.col("masked"))).drop("spaced")


def held_lines(docs: DataFrame, keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``text_key, line_no, leaf, masked, line_key`` of the lines in leaves of ``min_docs`` texts or more. Lines of one
    template lie in one leaf, so no template that recurs is elsewhere."""
    shared = keys.select("leaf", "text_key").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = write_down(shared.select("leaf"))
    some = tree_lines(docs).join(_bits(shared, "leaf"), _word(F.col("leaf")) == F.col("_word")).where(_may_match(F.col("leaf"))).drop("_word", "_bits")
    return _line_key(some.join(shared, "leaf", "left_semi").select("text_key", "line_no", "leaf", "spaced"))


def line_templates(held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``line_key, template_key`` of held lines: in its leaf, a token that is rare at its place is a field too,
    unless too few constant tokens would stay; such a line is its own template. A token is counted over all lines
    of the leaf, each as often as it has distinct texts. Lines of fields alone have no template."""
    kinds = held.select("line_key", "leaf", "masked", "text_key").distinct().groupBy("line_key", "leaf", "masked").agg(F.count("*").alias("texts"))
    kinds = write_down(kinds.select("line_key", "leaf", "texts", F.split("masked", " ").alias("tokens")))
    tokens = kinds.select("leaf", "line_key", "texts", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != FIELD)
    common = tokens.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs).drop("n")
    # A line that recurs as it is has common tokens only.
    stay = tokens.where(F.col("texts") < min_docs).join(common, ["leaf", "place", "token"], "left_semi") \
        .groupBy("line_key").agg(F.collect_set("place").alias("places"), F.count("*").alias("stays"))
    general = F.transform("tokens", lambda t, i: F.when(F.array_contains("places", i), t).otherwise(FIELD))
    enough = (F.col("stays") >= LEAST_CONSTANT) & (F.col("stays") * 100 >= F.size("tokens") * CONSTANT)
    template = F.array_join(F.when(enough, general).otherwise(F.col("tokens")), " ")
    return kinds.where(F.exists("tokens", lambda t: t != FIELD)).join(stay, "line_key", "left").select("line_key", identity(template).alias("template_key"))


def copies(docs: DataFrame, keys: DataFrame, gone: DataFrame, named: DataFrame) -> DataFrame:
    """``text_key`` of the texts in ``gone`` of which all lines have the templates of another text's, in the same order.

    Such texts agree in their lines' leaves as well, and both lose lines; only those that do are read again.
    """
    shapes = write_down(keys.groupBy("text_key").agg(F.count("*").alias("n"), F.bit_xor("leaf").alias("leaves"))
                        .join(gone.select("text_key"), "text_key", "left_semi"))
    alike = shapes.groupBy("n", "leaves").agg(F.count("*").alias("texts")).where("texts > 1").drop("texts")
    alike = write_down(shapes.join(alike, ["n", "leaves"], "left_semi").select("text_key", F.xxhash64("text_key").alias("hash")))
    some = docs.where("text is not null").select("text", F.xxhash64(identity(F.col("text"))).alias("hash"))
    some = some.join(_bits(alike, "hash"), _word(F.col("hash")) == F.col("_word")).where(_may_match(F.col("hash"))).select("text")
    lines = _line_key(tree_lines(some)).select("text_key", "line_no", "line_key").distinct().join(alike.select("text_key"), "text_key", "left_semi")
    names = lines.join(named.select("text_key", "line_no", "name"), ["text_key", "line_no"], "left") \
        .select("text_key", "line_no", F.coalesce("name", "line_key").alias("name"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "name"))), lambda x: F.hex(x["name"]))
    texts = write_down(names.groupBy("text_key").agg(identity(F.array_join(ordered, "")).alias("templates")))
    several = texts.groupBy("templates").agg(F.count("*").alias("n")).where("n > 1").select("templates")
    return texts.join(several, "templates", "left_semi").select("text_key")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, spare_copies: bool = True) -> DataFrame:
    """``text_key, gone``: the line numbers (from 0) that go from each text that loses any."""
    keys = write_down(tree_lines(docs).select("text_key", "line_no", "leaf").distinct())
    held = write_down(held_lines(docs, keys, min_docs))
    templates = write_down(line_templates(held, min_docs))
    named = write_down(held.select("text_key", "line_no", "line_key").distinct().join(templates, "line_key", "left")
                       .select("text_key", "line_no", F.coalesce("template_key", "line_key").alias("name"), F.col("template_key").isNotNull().alias("found")))
    recurring = named.where("found").select("name", "text_key").distinct().groupBy("name").agg(F.count("*").alias("texts")) \
        .where(F.col("texts") >= min_docs).select("name")
    gone = write_down(named.where("found").join(write_down(recurring), "name", "left_semi").groupBy("text_key")
                      .agg(F.sort_array(F.collect_list("line_no")).alias("gone")))
    return gone.join(copies(docs, keys, gone, named), "text_key", "left_anti") if spare_copies else gone


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, spare_copies: bool = True) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and the counts ``n_lines, n_dropped``.

    A line's path through the tree is its token count and first tokens; fields with digits or an at
    sign, and tokens rare at their place in the leaf, are generalised as long as ``CONSTANT`` per cent of the tokens
    and ``LEAST_CONSTANT`` of them stay. A line goes if its template occurs in ``min_docs`` distinct texts or more;
    equal texts count once. It goes from every text that holds it. ``spare_copies`` is for callers that deduplicate
    documents afterwards: texts whose lines have the same templates in the same order, all of them, are then taken
    for copies of one another rather than texts with boilerplate around them, and stay whole. Blank lines, and lines
    of fields alone, stay. Rows are never dropped: null stays null (no lines), an empty text has one
    line, repeated rows lose the same lines, and other columns pass through; columns named as the two
    counts are replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    path = new_path(docs.sparkSession)
    with scratch(docs.sparkSession):  # only the line numbers stay of what is written down on the way
        gone = write_down(recurring_lines(docs, min_docs, spare_copies).select(
            F.col("text_key").alias("_key"), F.xxhash64("text_key").alias("_hash"), F.col("gone").alias("_gone")), path)
    # Texts that surely lose nothing are not shuffled.
    keyed = docs.select(*kept).withColumn("_key", identity(F.col("text")))
    keyed = keyed.withColumn("_hash", F.xxhash64("_key"))
    keyed = keyed.join(_bits(gone, "_hash"), _word(F.col("_hash")) == F.col("_word"), "left").withColumn("_may", _may_match(F.col("_hash"))) \
        .drop("_word", "_bits", "_hash")
    none = F.lit(None).cast(gone.schema["_gone"].dataType).alias("_gone")
    joined = keyed.where("_may").join(gone.drop("_hash"), "_key", "left").unionByName(keyed.where("not _may").select("*", none))
    stay = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    whole = F.col("_gone").isNull()
    dropped = F.when(whole, 0).otherwise(F.size("_gone")).cast("long")
    text = F.when(whole, F.col("text")).otherwise(stay)
    return joined.select(*[(text if c == "text" else F.col(c)).alias(c) for c in kept], count.alias("n_lines"), dropped.alias("n_dropped"))


#: The same by plain SQL, for DuckDB.
ORACLE_SQL = r"""
WITH texts AS (SELECT text, row_number() OVER () AS id FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
split AS (SELECT id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM texts),
tokens AS (SELECT id, line_no, list_transform(string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' '),
  lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END) AS toks FROM split),
lines AS (SELECT id, line_no, toks, len(toks) AS n, toks[1:2] AS lead FROM tokens WHERE toks != ['']),
uniq AS (SELECT n, lead, toks, count(DISTINCT id) AS texts FROM lines GROUP BY n, lead, toks),
places AS (SELECT n, lead, toks, texts, generate_subscripts(toks, 1) AS place, unnest(toks) AS tok FROM uniq),
common AS (SELECT n, lead, place, tok FROM places GROUP BY n, lead, place, tok HAVING sum(texts) >= 5),
stay AS (SELECT toks, list(place) AS stays FROM places SEMI JOIN common USING (n, lead, place, tok) WHERE tok != '<*>' GROUP BY toks),
templates AS (SELECT u.toks, CASE WHEN len(stays) >= 4 AND len(stays) * 100 >= n * 75
  THEN list_transform(u.toks, lambda t, i: CASE WHEN list_contains(stays, i) THEN t ELSE '<*>' END) ELSE u.toks END AS template
  FROM uniq u LEFT JOIN stay s ON u.toks = s.toks WHERE len(list_filter(u.toks, lambda t: t != '<*>')) > 0),
named AS (SELECT id, line_no, template FROM lines JOIN templates USING (toks)),
recurring AS (SELECT template FROM named GROUP BY template HAVING count(DISTINCT id) >= 5),
gone AS (SELECT text, list(line_no) AS nos FROM named SEMI JOIN recurring USING (template) JOIN texts USING (id) GROUP BY text)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  CASE WHEN g.nos IS NULL THEN 0 ELSE len(g.nos) END::BIGINT AS n_dropped,
  CASE WHEN g.nos IS NULL THEN d.text ELSE
    array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.nos, i)), chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.text = g.text
"""
