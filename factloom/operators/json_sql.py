"""SQL texts (DuckDB) that read payloads as the operators do: key styles, encoded values, lone objects, maps as lists."""

from __future__ import annotations


def field(j: str, name: str) -> str:
    words = name.split("_")
    styles = dict.fromkeys([name, words[0] + "".join(w.title() for w in words[1:]), "-".join(words), "".join(w.title() for w in words)])
    return "coalesce(" + ", ".join(f"""json_extract({j}, '$."{s}"')""" for s in styles) + ")"


def decoded(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(json_extract_string({x}, '$')) AND json_type(TRY_CAST(json_extract_string({x}, '$') AS JSON)) IN ('ARRAY', 'OBJECT') THEN TRY_CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"


def items(x: str) -> str:
    d = f"({decoded(x)})"
    return f"CASE json_type({d}) WHEN 'ARRAY' THEN json_extract({d}, '$[*]') WHEN 'OBJECT' THEN [{d}] ELSE CAST([] AS JSON[]) END"


def pairs(x: str) -> str:
    d = f"({decoded(x)})"
    return f"""CASE json_type({d}) WHEN 'OBJECT' THEN list_transform(json_keys({d}), lambda name_: {{'key': name_, 'value': json_extract({d}, '$."' || name_ || '"')}})
 WHEN 'ARRAY' THEN list_transform(json_extract({d}, '$[*]'), lambda e: {{'key': json_extract_string(e, '$.key'), 'value': json_extract(e, '$.value')}}) ELSE [] END"""


def as_bool(x: str) -> str:
    return f"TRY_CAST(json_extract_string({x}, '$') AS BOOLEAN)"
