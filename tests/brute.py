"""Plain Python versions of the operators, to test against on small inputs."""

from __future__ import annotations

import json
import re

from factloom.operators.nested import NODE, SHAPES


def _snake(key: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", key).replace("-", "_").lower()


def _decoded(value):
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def _get(record: dict, name: str):
    return next((v for k, v in record.items() if _snake(k) == name), None)


def nested_rows(fact_id: str, family: str, payload: str | None) -> set[tuple]:
    if payload is None or family not in SHAPES:
        return set()
    value = payload
    for _ in range(3):
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return set()
    if not isinstance(value, dict):
        return set()
    if isinstance(inner := _decoded(value.get("fact")), dict):
        value = inner
    out: set[tuple] = set()

    def place(item, k, key, parent, path):
        entry = f"{parent}/{path}:{k}"
        if isinstance(item, list):
            out.add((fact_id, "container", parent, entry, k, key, entry))
            for j, _ in enumerate(item):
                out.add((fact_id, "value", entry, entry, k, key, f"{entry}:{j}"))
        else:
            out.add((fact_id, "record" if isinstance(item, dict) else "value", parent, f"{parent}/{path}", -1, key, entry))

    def walk(record, shape, parent, path):
        for name, kind in shape.items():
            at = f"{path}.{name}" if path else name
            field = _decoded(_get(record, name))
            if isinstance(kind, dict):
                if isinstance(field, dict):
                    walk(field, kind, parent, at)
            elif kind is map:
                if isinstance(field, list):
                    field = {e["key"]: e.get("value") for e in field if isinstance(e, dict) and "key" in e}
                if isinstance(field, dict):
                    for k, key in enumerate(sorted(field)):
                        place(field[key], k, key, parent, at)
            else:
                items = field if isinstance(field, list) else [field] if isinstance(field, dict) else []
                for k, item in enumerate(items):
                    place(item, k, "", parent, at) if kind is list or not isinstance(item, dict) else out.add((fact_id, "record", parent, f"{parent}/{at}", -1, "", f"{parent}/{at}:{k}"))
                    if kind is not list and isinstance(item, dict):
                        walk(item, NODE if kind[0] == "node" else kind[0], f"{parent}/{at}:{k}", at)

    walk(value, SHAPES[family], fact_id, "")
    return out
