"""Checks of raw JSON that need its whole tree: forbidden keys, a subset of JSON Schema.

Rows are read in Arrow batches; a text that does not parse is one problem, null gives
none, whatever the depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forbidden_paths(tree: object, forbidden: frozenset[str]) -> list[str]:
    """Paths of keys that are forbidden in any letter case, at any depth, even with null values."""
    out: list[str] = []
    todo: list[tuple[str, object]] = [("$", tree)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                here = f"{path}.{k}"
                if k.casefold() in forbidden:
                    out.append(here)
                todo.append((here, v))
        elif isinstance(x, list):
            todo.extend((f"{path}[{i}]", v) for i, v in enumerate(x))
    return sorted(out)


_KIND: dict[str, Callable[[object], bool]] = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x == x and abs(x) != float("inf"),
}


def schema_problems(value: object, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """Violations of type, enum, const, bounds, lengths, required, additionalProperties, items, anyOf and local $ref."""
    root = schema if root is None else root
    if "$ref" in schema:
        target: object = root
        for step in schema["$ref"].lstrip("#/").split("/"):
            target = target[step]  # type: ignore[index]
        return schema_problems(value, target, root, path)  # type: ignore[arg-type]
    if "anyOf" in schema:
        return [] if any(not schema_problems(value, s, root, path) for s in schema["anyOf"]) else [f"{path}: matches no alternative"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KIND[k](value) for k in kinds):
        return [f"{path}: is no {' or '.join(kinds)}"]
    out: list[str] = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not among the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the fixed value")
    if _KIND["number"](value):
        out += [f"{path}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []  # type: ignore[operator]
        out += [f"{path}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []  # type: ignore[operator]
    size = len(value) if isinstance(value, str | list) else None
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
    if size is not None:
        out += [f"{path}: too short"] if size < schema.get(low, 0) else []
        out += [f"{path}: too long"] if size > schema.get(high, size) else []
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{path}: lacks {k}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in fields:
                out += schema_problems(v, fields[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}: has unknown {k}")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_problems(v, schema["additionalProperties"], root, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_problems(v, schema["items"], root, f"{path}[{i}]")
    return out


def _problems(df: DataFrame, key: str, body: str, check: Callable[[object], list[str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, said = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                if x is None:
                    continue
                try:
                    found = check(json.loads(x))
                except (ValueError, RecursionError):
                    found = ["$: does not parse"]
                at += [i] * len(found)
                said += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=[key, "problem"])

    return df.select(key, F.col(body).cast("string").alias("body")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, problem string")


def forbidden_keys(df: DataFrame, key: str, body: str, forbidden: list[str]) -> DataFrame:
    """(key, problem): one row per forbidden key found."""
    banned = frozenset(k.casefold() for k in forbidden)
    return _problems(df, key, body, lambda tree: forbidden_paths(tree, banned))


def schema_violations(df: DataFrame, key: str, body: str, schema: dict) -> DataFrame:
    """(key, problem): one row per violation of the schema."""
    return _problems(df, key, body, lambda tree: schema_problems(tree, schema))
