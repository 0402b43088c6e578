"""Joins and unions, with the row counts of a small left and right table and a brute-force model."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import relations
from ledgerline.operators.relations import Relationship, combine, components, join_on, qualify, union_mapped
from ledgerline.plans.model import DataModel, TableDataset, UnionDataset
from ledgerline.sources.schema import Field


@pytest.fixture(scope="module")
def sides(spark):
    # Five boats and the trips of three of them; one trip is of a boat that is not here.
    return (spark.createDataFrame([(k, f"boat {k}") for k in (10, 20, 30, 40, 50)], "hull int, boat string"),
            spark.createDataFrame([(20, "out"), (20, "back"), (20, "tow"), (40, "out"), (50, "tow"), (77, "lost")], "of_hull int, trip string"))


@pytest.mark.parametrize("how,count", [("INNER", 5), ("LEFT", 7), ("RIGHT", 6), ("FULL", 8), (None, 5)])
@pytest.mark.parametrize("unique", [False, True])
def test_row_counts(sides, how, count, unique):
    out = join_on(*sides, [("hull", "of_hull")], how, left_unique=unique)
    assert out.count() == count
    assert out.filter("boat is null").count() == (how in ("RIGHT", "FULL"))
    assert out.filter("trip is null").count() == 2 * (how in ("LEFT", "FULL"))


def test_unknown_join(sides):
    with pytest.raises(ValueError, match="unknown join type"):
        join_on(*sides, [("hull", "of_hull")], "SEMI")


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize("hot", [None, 1, 4])
def test_random_joins_follow_a_nested_loop(spark, how, hot, monkeypatch):
    if hot:  # nearly every key, or the hottest ones, are salted
        monkeypatch.setattr(relations, "HOT_ROWS", hot)
    rng = random.Random(how)
    pick = lambda: rng.choice([None, "k", "k", "k", "m", "n", str(rng.randint(0, 9))])
    left = [(pick(), i) for i in range(30)]
    right = [(pick(), i) for i in range(20)]
    pairs = [(a, b) for a in left for b in right if a[0] == b[0]]
    expected = [(*a, *b) for a, b in pairs]
    if how in ("LEFT", "FULL"):
        expected += [(*a, None, None) for a in left if a not in [p for p, _ in pairs]]
    if how in ("RIGHT", "FULL"):
        expected += [(None, None, *b) for b in right if b not in [p for _, p in pairs]]
    out = join_on(spark.createDataFrame(left, "a string, i int"), spark.createDataFrame(right, "b string, j int"),
                  [("a", "b")], how).select("a", "i", "b", "j")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("how", ["LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize("null_match", [True, False])
def test_salted_joins_change_no_result(spark, how, null_match, monkeypatch):
    rng = random.Random(how)
    left = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([0.0, -0.0, None]), i) for i in range(60)] + [(1, 0.0, 7)] * 5, "a int, x double, i int")
    right = spark.createDataFrame([(rng.choice([None, 1, 1, 2, 4]), rng.choice([0.0, None]), j) for j in range(50)] + [(4, 0.0, 7)] * 5, "b long, y double, j int")
    make = lambda: sorted(map(str, join_on(left, right, [("a", "b"), ("x", "y")], how, null_match).collect()))
    plain = make()
    monkeypatch.setattr(relations, "HOT_ROWS", 3)
    assert make() == plain
    condition = (left.a.eqNullSafe(right.b) & left.x.eqNullSafe(right.y)) if null_match else (left.a == right.b) & (left.x == right.y)
    assert plain == sorted(map(str, left.join(right, condition, how.lower()).collect()))


def test_keys_are_equal_as_text(spark):
    text = spark.createDataFrame([("1",), ("1.0",), (None,)], "t string")
    number = spark.createDataFrame([(1.0,), (None,)], "n double")
    whole = spark.createDataFrame([(1,), (None,)], "w int")
    assert join_on(text, number, [("t", "n")]).count() == 2      # "1.0" and the missing one
    assert join_on(number, whole, [("n", "w")]).count() == 2     # numbers of two types are one kind
    assert join_on(number, whole, [("n", "w")], null_match=False).count() == 1


def test_chain_in_declared_order_and_composite_keys(spark, rows):
    frames = {n: qualify(df, n) for n, df in {
        "student": spark.createDataFrame([(1, "Ann", 7), (2, "Bob", 7), (3, "Cy", 8)], "id int, name string, class_id int"),
        "score": spark.createDataFrame([(1, 7, 90.0), (2, 7, 80.0), (3, 9, 70.0)], "student_id int, class_id int, score double"),
        "room": spark.createDataFrame([(7, "R7")], "class_id int, room string")}.items()}
    links = [Relationship(("score", "student_id"), ("student", "id")),
             Relationship(("student", "class_id"), ("room", "class_id"), "LEFT")]
    out = combine(frames, links, ["room", "score", "student"])
    assert sorted(rows(out, "student__name", "score__score", "room__room")) == [
        ("Ann", 90.0, "R7"), ("Bob", 80.0, "R7")]
    out = combine(frames, links, ["student", "score", "room"])
    assert out.count() == 3 and out.filter("room__room is null").count() == 1
    both = [*links, Relationship(("student", "class_id"), ("score", "class_id"))]
    assert combine(frames, both, ["student", "score"]).count() == 2
    with pytest.raises(ValueError, match="no relationship connects"):
        combine(frames, links[:1], ["student", "room"])


def test_components():
    links = [Relationship(("a", "x"), ("b", "x")), Relationship(("b", "y"), ("c", "y"))]
    assert components(["d", "c", "a"], links) == [["d"], ["c", "a"]]
    assert components(["a", "d", "b"], links) == [["a", "b"], ["d"]]


def test_union_with_mapping(spark, rows):
    a = spark.createDataFrame([("Ann", "F", 30.0)], "name string, gender string, age double")
    b = spark.createDataFrame([("Bob", 1, 40)], "xm string, xb int, nl int")
    members = [("a", a, {"name": "name", "gender": "gender", "age": "age"}), ("b", b, {"name": "xm", "gender": "xb"})]
    out = union_mapped(["name", "gender", "age"], members, "from")
    assert sorted(rows(out)) == [("Ann", "F", 30.0, "a"), ("Bob", "1.0", None, "b")]


def test_model_with_nested_unions(spark, rows, tmp_path):
    spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id int, name string").write.parquet(str(tmp_path / "p"))
    fields = [Field("who"), Field("n", "NUMBER")]
    model = DataModel(spark, {
        "people": TableDataset("PARQUET", {"path": str(tmp_path / "p")},
                               [Field("id", "NUMBER", primary_key=True), Field("name")]),
        "inner": UnionDataset(fields, [("people", {"who": "name", "n": "id"}), ("people", {"who": "name"})]),
        "outer": UnionDataset(fields, [("inner", {"who": "who", "n": "n"}), ("people", {"n": "id"})])},
        [Relationship(("outer", "n"), ("people", "id"), "LEFT")])
    assert model.frame("outer").count() == 6
    out = model.combined("outer", "people")
    assert out.count() == 6 and out.filter(F.col("people__name").isNotNull()).count() == 4
    model.dictionaries["names"] = {"Ann": "A."}
    named = model.frame("people").orderBy("id")
    assert rows(model.labelled(named, "name", "names", "l").orderBy("id"), "l") == [("A.",), ("Bob",)]
    assert rows(model.labelled(named, "name", "none", "l").orderBy("id"), "l") == [("Ann",), ("Bob",)]
    with pytest.raises(ValueError, match="unknown dataset"):
        model.frame("nobody")
