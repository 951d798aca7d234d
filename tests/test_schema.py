"""Compiled JSON Schemas against documents whose broken rules are known."""

from __future__ import annotations

import json

import pytest

from waybill.operators.schema import schema_violations

SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "$defs": {"score": {"type": "string", "pattern": "^(0|1|0\\.[0-9]{1,3})(?![\\s\\S])"}, "named": {"allOf": [{"type": "string"}, {"minLength": 1, "maxLength": 5}]}},
    "type": "object", "additionalProperties": False, "required": ["version", "items"],
    "properties": {
        "version": {"const": 1},
        "link": {"format": "uri", "pattern": "^https://", "maxLength": 30},
        "licence": {"enum": ["MIT", None, 3, [1, 2]]},
        "items": {
            "type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True,
            "items": {
                "type": "object", "additionalProperties": False, "required": ["id"],
                "properties": {"id": {"$ref": "#/$defs/named"}, "score": {"$ref": "#/$defs/score"}, "n": {"type": "integer", "minimum": 2, "exclusiveMaximum": 9}, "prompt": {"type": "string"}, "parts": {"type": "array", "items": {"type": ["string", "null"]}}},
                "oneOf": [{"required": ["prompt"]}, {"required": ["parts"]}],
            },
        },
        "tags": {"type": "object", "additionalProperties": {"type": "number"}},
    },
}
GOOD = {"version": 1, "link": "https://a.b/c", "licence": "MIT", "items": [{"id": "a", "prompt": "p"}, {"id": "bé", "parts": ["x", None], "n": 8, "score": "0.25"}], "tags": {"a": 1.5, "b": 2}}


def but(**changes):
    return {k: v for k, v in {**GOOD, **changes}.items() if v is not ...}


def item(**changes):
    return but(items=[GOOD["items"][0], {k: v for k, v in {**GOOD["items"][1], **changes}.items() if v is not ...}])


CASES = [
    (GOOD, set()), (but(link=..., licence=..., tags=...), set()), (but(licence=None), set()), (but(licence=[1, 2]), set()), (but(version=True), {("/version", "const")}), (but(version=...), {("/version", "required")}), (but(version="1"), {("/version", "const")}),
    (but(link="http://a.b"), {("/link", "pattern")}), (but(link="https://" + "a" * 30), {("/link", "maxLength")}), (but(link="nothing"), {("/link", "pattern"), ("/link", "format")}), (but(link=5), set()), (but(licence="GPL"), {("/licence", "enum")}), (but(licence=True), {("/licence", "enum")}),
    (but(more=1), {("/", "additionalProperties")}), (but(items=[]), {("/items", "minItems")}), (but(items={}), {("/items", "type")}), (but(items=[GOOD["items"][0]] * 2), {("/items", "uniqueItems")}), (but(items=[{"id": str(i), "prompt": "p"} for i in range(4)]), {("/items", "maxItems")}),
    (item(id=""), {("/items/*/id", "minLength")}), (item(id="abcdef"), {("/items/*/id", "maxLength")}), (item(id=7), {("/items/*/id", "type")}), (item(id=...), {("/items/*/id", "required")}), (item(n=1), {("/items/*/n", "minimum")}), (item(n=9), {("/items/*/n", "exclusiveMaximum")}),
    (item(n=2.5), {("/items/*/n", "type")}), (item(score="0.2555"), {("/items/*/score", "pattern")}), (item(score="1\n"), {("/items/*/score", "pattern")}), (item(prompt="both"), {("/items/*", "oneOf")}), (item(parts=...), {("/items/*", "oneOf")}), (item(parts=["x", 3]), {("/items/*/parts/*", "type")}),
    (item(x=1), {("/items/*", "additionalProperties")}), (but(items=[1]), {("/items/*", "type"), ("/items/*", "oneOf")}), (but(tags={"a": "1"}), {("/tags/*", "type")}), ([], {("/", "type")}), (None, {("/", "type")}),
]


def test_schema_rules(spark):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, (d, _) in enumerate(CASES)] + [(900, "{"), (901, '{"a":1,"a":2}'), (902, None)]
    frame = spark.createDataFrame(rows, "id int, doc string").repartition(4)
    got: dict = {}
    for r in schema_violations(frame, "doc", SCHEMA).collect():
        got.setdefault(r["id"], set()).add((r["path"], r["keyword"]))
    want = {i: rules for i, (_, rules) in enumerate(CASES) if rules} | {i: {("/", "json")} for i in (900, 901, 902)}
    assert {i: got.get(i) for i in want} == want and set(got) == set(want)
    assert schema_violations(frame.limit(0), "doc", SCHEMA).count() == 0


def test_schemas_that_cannot_be_compiled(spark):
    frame = spark.createDataFrame([("{}",)], "doc string")
    for bad in ({"foo": 1}, {"format": "colour"}, {"$ref": "#/$defs/none"}, {"$ref": "http://x"}, {"$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}, "$ref": "#/$defs/a"}):
        with pytest.raises(ValueError):
            schema_violations(frame, "doc", bad)
