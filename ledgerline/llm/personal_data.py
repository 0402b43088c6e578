"""Personal data by high-recall candidates and boosted trees, in DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import write_down

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000      # candidates of a kind and label that the trees learn from at most
PRECISION = 0.95   # of a kind's labelled candidates above its threshold
BINS = 100         # of scores, in which thresholds are set
# How many look-alikes pass a kind's format test for one that fails it: four numbers up to 999 are all below 256 in
# one of 233 cases, a check digit is right in one of ten; shapes without such a test count as they are.
PASSING = {"email": 1.0, "ip": 1 / 232, "card": 1 / 9, "phone": 1.0}
CONTEXT = 24       # characters looked at before a span
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Possessive forms match what the plain ones match, in time linear in the text: a run of characters
# that may begin a match is entered at its start or right after the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of further candidates; a span may be proposed by several.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[\x20./-]{0,2}+[0-9]){12,18}+(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])[+(]?+[0-9](?:[\x20().\x2F-]{0,2}+[0-9]){6,14}+(?![A-Za-z0-9])",
}
_SPAN = "struct<start:int,end:int,match:string>"


def spans_of(text: Column, pattern: str) -> Column:
    """The matches from left to right as array<struct<start, end, match>>, in code points from 0."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = (start + F.length(x["match"])).cast("int")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(
            start.cast("int").alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    zipped = F.arrays_zip(matches.alias("match"), F.slice(gaps, 1, F.size(matches)).alias("gap"))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(matches) > 0, found).otherwise(none)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    total = sum((F.coalesce(F.substring(twice if i % 2 == 0 else back, i, 1).try_cast("int"), F.lit(0)) for i in range(1, 20)), F.lit(0))
    return total % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """The test that a base match must pass."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & passes_luhn(digits_of(match))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def disguised(kind: Column, match: Column, turn: Column) -> Column:
    """A base match as people write it to keep it from such rules: with other marks, or without a plus."""
    pick = lambda *ways: F.element_at(F.array(*ways), (F.pmod(turn, F.lit(len(ways))) + 1).cast("int"))
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    email = pick(*[F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot))) for at, dot in (
        (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."))])
    ip = pick(*[F.replace(match, F.lit("."), F.lit(dot)) for dot in ("[.]", "(.)", " . ")])
    card = pick(*[F.regexp_replace(digits_of(match), r"([0-9]{4})(?=[0-9])", rf"$1{mark}") for mark in (".", "/", "  ", "-")])
    bare = F.substring(match, 2, 1 << 20)
    phone = pick(bare, F.concat(F.lit("00"), bare), F.translate(bare, " -", ".."), F.translate(bare, "-", "/"))
    return F.element_at(F.array(email, ip, card, phone), kind + 1)


def proven_wrong(kind: Column, match: Column, before: Column) -> Column:
    """Whether the format alone, or what a number is called, shows that a candidate is not of its kind."""
    n = F.length(digits_of(match))
    email = ~match.rlike(r"(?:@|[\[(]at[\])]).*(?:\.|[\[(]dot[\])])")
    ip = ~F.regexp_replace(match, r"[^0-9.]", "").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    card = ~(n.between(13, 19) & passes_luhn(digits_of(match)))
    day = match.rlike(r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})")
    plain = match.rlike("^[0-9]+$") & ~before.rlike(NAMED["phone"])
    phone = ~n.between(8, 15) | day | plain
    called = before.rlike(NAMED["number"]) & (kind != 0)
    return F.element_at(F.array(email, ip, card, phone), kind + 1) | called


def found_spans(docs: DataFrame) -> DataFrame:
    """``row, text_key, doc_id, base, wider``: valid base spans, and candidates beyond them with their context."""
    text = F.coalesce("text", F.lit(""))

    def kept(k, kind):
        spans = spans_of(text, BASE[kind])
        valid = F.filter(spans, lambda s: is_valid(kind, s["match"]))
        return F.transform(valid, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))

    def wide(k, kind):
        return F.transform(spans_of(text, WIDER[kind]), lambda s: F.struct(
            F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(1)).alias("after")))

    return docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_key"), "doc_id",
                       F.concat(*[kept(k, kind) for k, kind in enumerate(KINDS)]).alias("base"),
                       F.concat(*[wide(k, kind) for k, kind in enumerate(KINDS)]).alias("wider"))


# Words that name what follows.
NAMED = {
    "phone": r"\b(?:tel|phone|call|fax|mobile|telefon|téléphone|teléfono|t[ée]l)\b",
    "mail": r"\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "card": r"\b(?:card|visa|credit|karte|carte|tarjeta)\b",
    "ip": r"\b(?:ip|addr|address|host|server)\b",
    "number": r"\b(?:id|no|nr|order|token|key|hash|invoice|ref)\b[^a-z]{0,4}$",
}


def _count(pattern: str) -> Column:
    return F.regexp_count("match", F.lit(pattern)).cast("double")


def features() -> dict[str, Column]:
    """What the trees see of a candidate: its format and its surroundings."""
    return {
        "kind": F.col("kind").cast("double"),
        "length": F.length("match").cast("double"),
        "digits": _count("[0-9]"),
        "letters": _count("[A-Za-z]"),
        "spaces": _count(r"\x20"),
        "marks": _count(r"[().\x2F-]"),
        "groups": _count("[0-9]+"),
        "opens": F.col("match").rlike(r"^[+(]").cast("double"),
        "odd": _count(r"[\[(](?:at|dot|\.)[\])]"),
        "before_space": F.col("before").rlike(r"(?:^|\s)$").cast("double"),
        "before_mark": F.col("before").rlike(r"[=\"'#:_$-]\s?$").cast("double"),
        "after_letter": F.col("after").rlike(r"[\p{L}0-9_@-]").cast("double"),
        **{f"named_{name}": F.col("before").rlike(words).cast("double") for name, words in NAMED.items()},
    }


def candidates(found: DataFrame) -> DataFrame:
    """A row per wider span: ``row, kind, start, end``, its features, whether it is ``open`` (meets no base span and
    is not proven wrong), and ``label``: 1 for a base span of its kind, whose features are those of the span in
    disguise; 0 for what meets none and is proven wrong, with the ``weight`` of the look-alikes that it stands
    for; null for all else, of which nothing is known."""
    # Held against the base spans before they are dealt out, so that no row carries the text's other spans.
    meets = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
    own = lambda c: F.get(F.filter("base", lambda b: meets(b, c) & (b["kind"] == c["kind"])), 0)["match"]
    judged = F.transform("wider", lambda c: F.struct(c.alias("c"), F.exists("base", lambda b: meets(b, c)).alias("taken"), own(c).alias("own")))
    rows = found.select("row", "text_key", F.explode(judged).alias("j")).select("row", "text_key", "j.c.*", "j.taken", "j.own")
    rows = rows.withColumns({"h": F.xxhash64("text_key", "kind", "start"), "wrong": proven_wrong(F.col("kind"), F.col("match"), F.col("before"))})
    label = F.when(F.col("own").isNotNull(), 1).when(~F.col("taken") & F.col("wrong"), 0)
    shown = F.when(F.col("own").isNotNull(), disguised(F.col("kind"), F.col("own"), F.col("h"))).otherwise(F.col("match"))
    passing = F.element_at(F.array(*[F.lit(PASSING[k]) for k in KINDS]), F.col("kind") + 1)
    rows = rows.withColumn("weight", F.when(label == 0, passing).otherwise(1.0))
    rows = rows.select("row", "kind", "start", "end", "h", "before", "after", "weight", label.alias("label"), (~F.col("taken") & ~F.col("wrong")).alias("open"), shown.alias("match"))
    return rows.select("row", "kind", "start", "end", "h", "label", "weight", "open", *[f.alias(f"f_{name}") for name, f in features().items()])


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in features()], outputCol="features").transform(rows)


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])


def train(rows: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[GBTClassificationModel | None, dict[int, float]]:
    """Boosted trees, and a threshold for each kind.

    At most ``sample`` candidates of a kind and label teach the trees, those of least hash of text, kind and start.
    Thresholds come from all labelled candidates: the least score, in steps of 1 / ``BINS``, from which on
    ``precision`` of them are right, counting one wrong one more; a kind without such a score gets none. With one label
    only there is nothing to tell apart, and no trees.
    """
    known = rows.where("label is not null")
    order = ("h", "row", "start", "end")
    drawn = None
    for kind in range(len(KINDS)):
        for label in (0, 1):
            some = known.where((F.col("kind") == kind) & (F.col("label") == label)).orderBy(*order).limit(sample)
            drawn = some if drawn is None else drawn.unionByName(some)
    drawn = write_down(drawn.coalesce(2))
    if drawn.select("label").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=16, maxDepth=4, seed=11).fit(_assembled(drawn))
    bins = _scored(model, known).groupBy("kind", F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("label").alias("right"), F.sum("weight").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("bin"))  # a row a bin
    limits = bins.select("kind", "bin", F.sum("right").over(above).alias("right"), F.sum("n").over(above).alias("n")) \
        .where(F.col("right") >= precision * (F.col("n") + 1)).groupBy("kind").agg(F.min("bin").alias("bin")).collect()
    return model, {r["kind"]: r["bin"] / BINS for r in limits}


def _of_kind(k: int) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")


def find_personal_data(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base, added``; spans are
    struct(kind, start, end, match), kind counted from 0 in ``KINDS``.

    ``base`` are the valid matches of the strict rules, which always stay. High-recall generators
    propose further spans. Those that no base span meets and no format test proves wrong are added if their
    score reaches their kind's threshold, the higher score first where they overlap (then the earlier kind and
    start). Trees learn from base spans in disguise and from candidates proven wrong; there are no other labels. Null counts as empty text; repeated rows are rows of their own; null ids stay null; empty
    tables give an empty result; other columns are ignored. Nothing but the thresholds and the trees
    reaches the driver.
    """
    found = write_down(found_spans(docs))
    rows = write_down(candidates(found))
    model, limits = train(rows, sample, precision)
    counts = [_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if model is None or not limits:
        return found.select("doc_id", *counts, "base", empty.alias("added"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in sorted(limits.items())], F.lit(2.0))
    high = _scored(model, rows.where("open")).where(F.col("score") >= limit) \
        .groupBy("row").agg(F.collect_list(F.struct(F.negative("score").alias("score"), "kind", "start", "end")).alias("high"))
    beaten = lambda s, o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (o < s)
    best = F.filter("high", lambda s: ~F.exists("high", lambda o: beaten(s, o)))
    high = high.select("row", F.transform(best, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("added"))
    return found.join(high, "row", "left").select("doc_id", *counts, "base", F.coalesce("added", empty).alias("added"))


def listed_spans(found: DataFrame) -> DataFrame:
    """``found`` with its spans as text: the base spans' hash and all spans."""
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(plain), 256).alias("base_sha256"),
                        _listed(F.concat(plain, "added")).alias("spans"))
