"""JSON Schema documents compiled to rules over VARIANT columns, inside the JVM.

Each keyword of each place in the schema becomes one Boolean expression; places are named by their
path, with ``*`` for the elements of an array or the further keys of an object.  A keyword that the compiler
does not know is an error at once, not a rule that always holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]

# Keywords that say nothing about values, types by VARIANT kind, forms of formats.
ANNOTATIONS = frozenset("$schema $id $defs $comment title description default examples deprecated readOnly writeOnly".split())
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "null": "^VOID$", "array": "^ARRAY<.*", "object": "^OBJECT<.*"}
FORMATS = {"uri": r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^\s/?#]+)?[^\s]*(?![\s\S])", "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?![\s\S])", "email": r"^[^\s@]+@[^\s@]+(?![\s\S])"}


def is_kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(v).rlike(f"(?s){KINDS[name]}")


def child(v: Column, key: str) -> Column:
    if '"' in key or "\\" in key:
        raise ValueError(f"schema: a key with quotes: {key}")
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def same(v: Column, value: object) -> Column:
    """Equality to a JSON value; 1 is neither true nor 1.0."""
    if isinstance(value, str):
        return is_kind(v, "string") & (F.try_variant_get(v, "$", "string") == value)
    if isinstance(value, bool):
        return is_kind(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, int):
        return is_kind(v, "integer") & (F.try_variant_get(v, "$", "bigint") == F.lit(value))
    return F.to_json(v) == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def holds(rules: list[Rule]) -> Column:
    out = F.lit(True)
    for _, _, ok in rules:
        out &= F.coalesce(ok, F.lit(False))
    return out


class Compiler:
    """Rules of one schema document; ``$ref`` leads to its own definitions."""

    def __init__(self, document: dict):
        self.document = document

    def resolved(self, ref: str) -> dict:
        if not ref.startswith("#/"):
            raise ValueError(f"schema: {ref} lies outside the document")
        found: object = self.document
        for part in ref[2:].split("/"):
            if not isinstance(found, dict) or part not in found:
                raise ValueError(f"schema: {ref} leads nowhere")
            found = found[part]
        return found

    def rules(self, schema: dict | bool, v: Column, path: str = "", above: tuple[str, ...] = ()) -> Iterator[Rule]:
        """(path, keyword, whether it holds) for a value; a keyword for other types of value holds."""
        if isinstance(schema, bool):
            if not schema:
                yield path, "false", F.lit(False)
            return
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        array = F.try_variant_get(v, "$", "array<variant>")
        keys = F.json_object_keys(F.to_json(v))
        unless = lambda kind, ok: ~is_kind(v, kind) | ok
        for word, x in schema.items():
            if word in ANNOTATIONS:
                continue
            if word == "$ref":
                if x in above:
                    raise ValueError(f"schema: {x} holds itself")
                yield from self.rules(self.resolved(x), v, path, (*above, x))
            elif word == "allOf":
                for s in x:
                    yield from self.rules(s, v, path, above)
            elif word in ("oneOf", "anyOf"):
                n = sum((holds(list(self.rules(s, v, path, above))).cast("int") for s in x), F.lit(0))
                yield path, word, (n == 1) if word == "oneOf" else (n > 0)
            elif word == "not":
                yield path, word, ~holds(list(self.rules(x, v, path, above)))
            elif word == "type":
                ok = F.lit(False)
                for kind in [x] if isinstance(x, str) else x:
                    ok |= is_kind(v, kind)
                yield path, word, ok
            elif word in ("const", "enum"):
                ok = F.lit(False)
                for value in [x] if word == "const" else x:
                    ok |= same(v, value)
                yield path, word, ok
            elif word in ("minLength", "maxLength"):
                yield path, word, unless("string", F.length(text) >= x if word == "minLength" else F.length(text) <= x)
            elif word == "pattern":
                yield path, word, unless("string", F.regexp_like(text, F.lit(x)))
            elif word == "format":
                if x not in FORMATS:
                    raise ValueError(f"schema: format {x} is not known")
                yield path, word, unless("string", F.regexp_like(text, F.lit(FORMATS[x])))
            elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                ok = {"minimum": number >= x, "maximum": number <= x, "exclusiveMinimum": number > x, "exclusiveMaximum": number < x}[word]
                yield path, word, unless("number", ok)
            elif word in ("minItems", "maxItems"):
                yield path, word, unless("array", F.size(array) >= x if word == "minItems" else F.size(array) <= x)
            elif word == "uniqueItems":
                texts = F.transform(array, lambda e: F.to_json(e))
                yield path, word, F.lit(not x) | unless("array", F.size(F.array_distinct(texts)) == F.size(texts))
            elif word == "items":
                yield from self.each(x, array, f"{path}/*", above)
            elif word == "required":
                for name in x:
                    yield f"{path}/{name}", word, unless("object", F.array_contains(keys, name))
            elif word == "properties":
                for name, s in x.items():
                    held = child(v, name)
                    for where, rule, ok in self.rules(s, held, f"{path}/{name}", above):
                        yield where, rule, held.isNull() | ok
            elif word == "additionalProperties":
                known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
                if x is False:
                    yield path, word, unless("object", F.size(F.array_except(keys, known)) == 0)
                elif x is not True:
                    more = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~F.array_contains(known, e["key"]))
                    yield from self.each(x, F.transform(more, lambda e: e["value"]), f"{path}/*", above)
            else:
                raise ValueError(f"schema: keyword {word} is not known")

    def each(self, schema: dict | bool, array: Column, path: str, above: tuple[str, ...]) -> Iterator[Rule]:
        """The rules of elements; one holds if it holds for all of them.  An array that is null has none."""
        names: list[tuple[str, str]] = []

        def named(e: Column) -> list[Rule]:
            found = list(self.rules(schema, e, path, above))
            names[:] = [(where, rule) for where, rule, _ in found]
            return found

        def only(i: int) -> Column:
            return F.forall(array, lambda e: F.coalesce(named(e)[i][2], F.lit(False)))

        F.forall(array, lambda e: holds(named(e)))
        for i, (where, rule) in enumerate(list(names)):
            yield where, rule, array.isNull() | only(i)


def schema_violations(frame: DataFrame, column: str, schema: dict, text: bool = True) -> DataFrame:
    """A row (columns of frame, path, keyword) for each rule of the schema that a document breaks; text that is no JSON breaks ``json`` alone.

    column: JSON text, or a VARIANT if ``text`` is false.
    """
    held = frame.withColumn("_v", F.try_parse_json(column) if text else F.col(column))
    v = F.col("_v")
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path or "/").alias("path"), F.lit(rule).alias("keyword"))) for path, rule, ok in Compiler(schema).rules(schema, v)]
    unread = F.array(F.struct(F.lit("/").alias("path"), F.lit("json").alias("keyword")))
    found = F.when(v.isNull(), unread).otherwise(F.array_distinct(F.array_compact(F.array(*broken))))
    return held.select(*frame.columns, F.inline(found))
