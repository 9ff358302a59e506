import json

import pytest
from pyspark.sql import functions as F

from corvane.operators.validation import Shape, all_valid, checked, extracted, shape_of, typed, valid_only, violations
from corvane.sources.records import EXTRACTIONS

PERSON = Shape("object", fields={"name": Shape("text", required=True), "age": Shape("integer", least=0, most=150)})
SHAPE = Shape(
    "object",
    fields={
        "source_quote": Shape("text", required=True), "amount": Shape("number"), "kind": Shape("text", one_of=("award", "settlement")), "final": Shape("boolean"),
        "people": Shape("list", items=PERSON), "place": Shape("object", required=False, open=False, fields={"city": Shape("text", required=True)}), "tags": Shape("list", items=Shape("text")),
    },
)


def faults(spark, value, shape=SHAPE):
    text = value if isinstance(value, str) or value is None else json.dumps(value)
    found = spark.createDataFrame([(text,)], "j string").select(violations(F.col("j"), shape).alias("v")).first().v
    return [(x.path, x.reason) for x in found]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"source_quote": "x"}, []),
        ({"source_quote": "x", "amount": 5, "kind": "award", "final": True, "people": [{"name": "A", "age": 3.0}, {"name": "B"}], "place": {"city": "C"}, "tags": []}, []),
        ({"source_quote": "x", "amount": "5.5", "more": 1}, []),
        ({}, [("source_quote", "missing")]),
        ({"source_quote": None}, [("source_quote", "missing")]),
        ({"source_quote": 5, "amount": "much", "final": "yes"}, [("source_quote", "not a text"), ("amount", "not a number"), ("final", "not true or false")]),
        ({"source_quote": "x", "amount": True}, [("amount", "not a number")]),
        ({"source_quote": "x", "kind": "gift"}, [("kind", "not one of award, settlement")]),
        ({"source_quote": "x", "people": {"name": "A"}}, [("people", "not a list")]),
        ({"source_quote": "x", "people": [{"name": "A"}, {"age": 2.5}, 7, None]}, [("people[1].name", "missing"), ("people[1].age", "not a whole number"), ("people[2]", "not an object"), ("people[3]", "missing")]),
        ({"source_quote": "x", "people": [{"name": "A", "age": -1}, {"name": "B", "age": 151}]}, [("people[0].age", "less than 0"), ("people[1].age", "more than 150")]),
        ({"source_quote": "x", "place": {"zip": 1, "a": 2}}, [("place.city", "missing"), ("place.a", "unknown field"), ("place.zip", "unknown field")]),
        ({"source_quote": "x", "tags": ["a", 1]}, [("tags[1]", "not a text")]),
        ([1], [("", "not an object")]),
        ("{oops", [("", "not JSON")]),
        ("", [("", "not JSON")]),
        (None, [("", "not JSON")]),
        ("null", [("", "missing")]),
    ],
)
def test_violations(spark, value, want):
    assert faults(spark, value) == want


def test_values_are_typed(spark):
    text = json.dumps({"source_quote": "x", "amount": "5.5", "people": [{"name": "A", "age": 3.0}], "tags": ["t"]})
    value = spark.createDataFrame([(text,)], "j string").select(typed(F.col("j"), SHAPE).alias("v")).first().v
    assert value.amount == 5.5 and value.people[0].age == 3 and value.tags == ["t"] and value.place is None


def test_shapes_of_the_stored_kinds(spark):
    for ddl in EXTRACTIONS.values():
        shape = shape_of(f"source_quote string, {ddl}", ("source_quote",))
        assert faults(spark, {"source_quote": "x"}, shape) == [] and faults(spark, {}, shape) == [("source_quote", "missing")]
        assert shape.json_schema()["required"] == ["source_quote"]


def rows(spark):
    values = [(1, "It was an award of 5 dollars.", {"source_quote": "an  award of"}), (2, "Nothing.", {"source_quote": "an award"}), (3, "x", {"amount": 1}), (4, "x", {"source_quote": " "})]
    return spark.createDataFrame([(i, t, json.dumps(v)) for i, t, v in values], "id long, text string, js string")


def test_dropping_and_raising_forms(spark):
    found = checked(rows(spark), "js", SHAPE, "text")
    assert {r.id: [(v.path, v.reason) for v in r.violations] for r in found.collect()} == {1: [], 2: [("source_quote", "not in the source")], 3: [("source_quote", "missing")], 4: []}
    assert sorted(r.id for r in valid_only(found).collect()) == [1, 4]
    with pytest.raises(Exception, match="source_quote: "):
        all_valid(found).collect()
    assert sorted(r.id for r in all_valid(found.where("id IN (1, 4)")).collect()) == [1, 4]


def test_a_provider_is_asked_and_its_items_are_checked(spark):
    def extract(text, schema, instructions, most):
        assert json.loads(schema)["properties"]["people"]["type"] == "array" and instructions == "all" and most == 2
        if text == "down":
            raise OSError("no line")
        return {"two": '[{"source_quote": "two"}, {"amount": 1}, {"source_quote": "third"}]', "none": "[]", "odd": '{"a": 1}'}.get(text)

    docs = spark.createDataFrame([(1, "two"), (2, "none"), (3, "odd"), (4, "down"), (5, None), (6, "unknown")], "doc_id long, text string")
    got = extracted(docs, extract, SHAPE, "all", most=2, pause=lambda s: None).collect()
    assert sorted((r.doc_id, r.place, r.error, r.violations and [tuple(v) for v in r.violations]) for r in got) == [
        (1, 0, None, []), (1, 1, None, [("source_quote", "missing")]), (3, None, "the answer isn't a list", None), (4, None, "no line", None),
    ]
    assert [r.value.source_quote for r in got if r.value] == ["two"]
