"""Validation of JSON arguments and of permissions, as expressions over whole tables.

A JSON Schema is compiled to predicates over a VARIANT column: each rule gives the path and the message of its violation or
null, so Catalyst sees one projection and no Python runs. Supported: type (one or several), required, properties,
additionalProperties false, enum, const, minimum, maximum, exclusive bounds, minLength, maxLength, pattern, minItems,
maxItems, items. Rules that are not supported raise ValueError when the schema is compiled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<", "array": "ARRAY<"}
_KNOWN = {"type", "required", "properties", "additionalProperties", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "items", "title", "description", "default", "$schema", "examples"}


def _of_type(kind: Column, number: Column, name: str) -> Column:
    if name == "number":
        return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    if name == "integer":
        return (kind == "BIGINT") | ((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (number == F.floor(number)))
    if name not in _TYPES:
        raise ValueError(f"unknown type {name!r}")
    return kind.startswith(_TYPES[name]) if name in ("object", "array") else kind == _TYPES[name]


def _rules(schema: dict, value: Column, path: Column, depth: int = 0) -> list[Column]:
    """Arrays of violations (structs of path and message) of a variant that is there."""
    odd = set(schema) - _KNOWN
    if odd:
        raise ValueError(f"not supported: {sorted(odd)}")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    none = F.array().cast("array<struct<path:string,message:string>>")
    out = []

    def rule(broken: Column, message: str | Column, at: Column = path) -> None:
        text = F.lit(message) if isinstance(message, str) else message
        out.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(at.alias("path"), text.alias("message")))).otherwise(none))

    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        right = F.lit(False)
        for name in names:
            right = right | F.coalesce(_of_type(kind, number, name), F.lit(False))
        rule(~right, f"is not of type {' or '.join(names)}")
    for key, names in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if names is not None:
            same = F.lit(False)
            for x in names:
                own = F.parse_json(F.lit(json.dumps(x, ensure_ascii=False)))
                plain = isinstance(x, (str, bool)) or x is None
                same = same | (F.to_json(value) == F.to_json(own)) | (F.lit(False) if plain or not isinstance(x, (int, float)) else F.coalesce(is_number & (number == float(x)), F.lit(False)))
            rule(~same, f"is not one of {json.dumps(names, ensure_ascii=False)}" if key == "enum" else f"is not {json.dumps(schema['const'], ensure_ascii=False)}")
    for key, test, words in (("minimum", lambda n, b: n < b, "is less than"), ("maximum", lambda n, b: n > b, "is greater than"), ("exclusiveMinimum", lambda n, b: n <= b, "is not greater than"), ("exclusiveMaximum", lambda n, b: n >= b, "is not less than")):
        if key in schema:
            rule(is_number & test(number, float(schema[key])), f"{words} {schema[key]}")
    if "minLength" in schema:
        rule(F.length(text) < schema["minLength"], f"is shorter than {schema['minLength']}")
    if "maxLength" in schema:
        rule(F.length(text) > schema["maxLength"], f"is longer than {schema['maxLength']}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
        rule(~text.rlike(schema["pattern"]), f"does not match {schema['pattern']}")
    fields = F.when(kind.startswith("OBJECT<"), F.try_variant_get(value, "$", "map<string, variant>"))
    for name in schema.get("required", []):
        rule(kind.startswith("OBJECT<") & ~F.map_contains_key(fields, F.lit(name)), f"lacks {name}")
    for name, inner in schema.get("properties", {}).items():
        field = F.try_element_at(fields, F.lit(name))
        nested = _rules(inner, field, F.concat(path, F.lit(f".{name}")), depth + 1)
        if nested:
            out.append(F.when(field.isNotNull(), F.concat(*nested)).otherwise(none))
    if schema.get("additionalProperties", True) is not True:
        if schema["additionalProperties"] is not False:
            raise ValueError("additionalProperties may only be true or false")
        extra = F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
        out.append(F.coalesce(F.transform(F.array_sort(extra), lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("is not known").alias("message"))), none))
    items = F.when(kind.startswith("ARRAY<"), F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in schema:
        rule(F.size(items) < schema["minItems"], f"has fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        rule(F.size(items) > schema["maxItems"], f"has more than {schema['maxItems']} items")
    if "items" in schema:
        each = F.transform(items, lambda x, i: F.concat(none, *_rules(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)))
        out.append(F.coalesce(F.flatten(each), none))
    return out


def violations(schema: dict | str, text: Column) -> Column:
    """array<struct<path, message>> of JSON text against a schema, in the order of its rules; text that is no JSON is one
    violation, null text another. Paths begin at $."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    value, none = F.try_parse_json(text), F.array().cast("array<struct<path:string,message:string>>")
    one = lambda message: F.array(F.struct(F.lit("$").alias("path"), F.lit(message).alias("message")))
    return F.when(text.isNull(), one("is missing")).when(value.isNull(), one("is not JSON")).otherwise(F.concat(none, *_rules(schema, value, F.lit("$"))))


def validated(calls: DataFrame, schemas: dict[str, dict], tool: str = "tool", arguments: str = "arguments") -> DataFrame:
    """calls with violations; each tool has its own schema, a tool without one is itself a violation."""
    out = F.array(F.struct(F.lit("$").alias("path"), F.lit("the tool is not known").alias("message")))
    for name, schema in schemas.items():
        out = F.when(F.col(tool) == name, violations(schema, F.col(arguments))).otherwise(out)
    return calls.withColumn("violations", out)


def permitted(calls: DataFrame, tools: DataFrame, allow_write: bool = False, allowlist: tuple[str, ...] = (), tool: str = "tool") -> DataFrame:
    """calls with allowed and reason (null if allowed). tools: tool, readonly; with an allowlist only its tools pass, and
    writing tools only with allow_write."""
    listed = F.col(tool).isin(*allowlist) if allowlist else F.lit(True)
    kinds = F.broadcast(tools.select(F.col("tool").alias("_tool"), "readonly")) if tools.limit(10_001).count() <= 10_000 else tools.select(F.col("tool").alias("_tool"), "readonly")
    own = calls.join(kinds, F.col(tool) == F.col("_tool"), "left").drop("_tool")
    reason = F.when(F.col("readonly").isNull(), "unknown tool").when(~F.coalesce(listed, F.lit(False)), "tool not in allowlist").when(~(F.col("readonly") | F.lit(allow_write)), "write tools are disabled")
    return own.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("readonly")
