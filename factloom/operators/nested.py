"""Deeply nested records as flat rows that keep their parent and container links.

Each family declares the shape of its payload (SHAPES). The shape becomes one SQL projection per family: nested
`transform` calls carry the ancestors' ids and indices down, `flatten` joins the arrays of all levels, and one `inline`
turns them into rows. Payloads are read as VARIANT, so no schema is inferred and differing encodings stay readable.
A recursive shape is unrolled LEVELS deep; what lies below is handed to the next round, until nothing is left.

Defined cases: a null, empty or unreadable payload gives no row; a family without a shape gives none; a payload may be
a JSON text within a JSON text, may be wrapped as {"fact": ...}, and its keys may be snake, camel, kebab or Pascal
case; a list or object may itself be a JSON text; a map may be a list of {key, value}; repeated deliveries of the same
content give one row. Column names of the input beyond fact_id, family and payload do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import spread, written

#: Shapes: a dict is a plain object, [dict] a list of records, list a list of values or lists, map a map, "node" the recursive tree node.
NODE = {"modifiers": list, "children": ["node"]}
SHAPES: dict[str, dict] = {
    "DataAssetFact": {"assets": [{"owners": list, "fields": [{"tags": list, "glossary_terms": list}]}]},
    "DataAssetReferenceFact": {"references": [{"upstream_health": map}]},
    "CloneGroupFact": {"fragments": [{"lines": list}]},
    "WaiverFact": {"waivers": [{"metadata": map}]},
    "TestSuiteFact": {"strict_controls": map, "markers": list},
    "ChangeFact": {"changes": [{"review": {"approvals": [{}]}, "verification_evidence": list}]},
    "CollectionFact": {"pair_sequences": list, "local_collections": list},
    "SyntaxFact": {"tree": NODE},
}
LEVELS = 6
_ROW = "array<struct<relation:string,entry_kind:string,parent_id:string,container_id:string,container_ordinal:bigint,map_key:string,ordinal:bigint,entry_id:string,value:variant>>"
_REST = "array<struct<node:variant,id:string,path:string>>"


def _field(v: str, name: str) -> str:
    words = name.split("_")
    styles = dict.fromkeys([name, words[0] + "".join(w.title() for w in words[1:]), "-".join(words), "".join(w.title() for w in words)])
    return "coalesce(" + ", ".join(f"""try_variant_get({v}, '$["{s}"]', 'variant')""" for s in styles) + ")"


def _text(v: str) -> str:
    return f"try_parse_json(try_variant_get({v}, '$', 'string'))"


def _object(v: str) -> str:
    """An object as it is, or the one a JSON text holds."""
    return f"CASE WHEN try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL THEN {v} ELSE {_text(v)} END"


def _is_object(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL"


def _items(v: str) -> str:
    """The items of a list, of a list within a JSON text, or of a lone object."""
    array = "try_variant_get({}, '$', 'array<variant>')"
    lone = f"CASE WHEN {_is_object(_text(v))} THEN array({_text(v)}) END"
    return f"coalesce({array.format(v)}, {array.format(_text(v))}, {lone}, array())"


def _pairs(v: str) -> str:
    """A map's entries as (key, value) in code-point order of the keys, from an object, a list of {key, value}, or a JSON text of either."""
    made = []
    for w in (v, _text(v)):
        m = f"try_variant_get({w}, '$', 'map<string,variant>')"
        made.append(f"map_entries({m})")
        made.append(f"transform(try_variant_get({w}, '$', 'array<variant>'), e -> named_struct('key', try_variant_get(e, '$.key', 'string'), 'value', try_variant_get(e, '$.value', 'variant')))")
    entries = f"filter(coalesce({', '.join(made)}, array()), e -> e.key IS NOT NULL)"
    return f"transform(array(struct({entries} AS all)), h -> transform(array_sort(transform(h.all, (e, i) -> struct(e.key AS key, i AS i))), o -> struct(o.key AS key, h.all[o.i].value AS value)))[0]"


def _row(relation: str, kind: str, parent: str, container: str, at: str, key: str, ordinal: str, entry: str, value: str) -> str:
    return (
        f"named_struct('relation', {relation}, 'entry_kind', {kind}, 'parent_id', {parent}, 'container_id', {container}, 'container_ordinal', cast({at} AS bigint), "
        f"'map_key', {key}, 'ordinal', cast({ordinal} AS bigint), 'entry_id', {entry}, 'value', {value})"
    )


def _entry(x: str, k: str, key: str, parent: str, path: str, n: int) -> str:
    """Rows of one entry of a list or map of values: a value, or a container with its values."""
    entry, container = f"concat({parent}, '/', {path}, ':', {k})", f"concat({parent}, '/', {path})"
    inner = f"try_variant_get({x}, '$', 'array<variant>')"
    own = _row(path, f"CASE WHEN {inner} IS NOT NULL THEN 'container' WHEN {_is_object(x)} THEN 'record' ELSE 'value' END", parent, f"CASE WHEN {inner} IS NOT NULL THEN {entry} ELSE {container} END", f"CASE WHEN {inner} IS NOT NULL THEN {k} ELSE -1 END", key, k, entry, f"CASE WHEN {inner} IS NULL AND NOT ({_is_object(x)}) THEN {x} END")
    below = _row(path, "'value'", entry, entry, k, key, f"j{n}", f"concat({entry}, ':', j{n})", f"y{n}")
    return f"concat(array({own}), transform(coalesce({inner}, array()), (y{n}, j{n}) -> {below}))"


def _project(v: str, shape: dict, parent: str, path: str, n: int, depth: int) -> tuple[list[str], list[str]]:
    """SQL arrays of rows, and of nodes left for the next round, below an object v with the id `parent` and the path `path`."""
    rows, rest = [], []
    for name, kind in shape.items():
        at = f"'{name}'" if path == "''" else f"concat({path}, '.{name}')" if not path.startswith("'") else f"{path[:-1]}.{name}'"
        value = _field(v, name)
        # A field is looked up once and bound; its readings refer to the name.
        bound = lambda read, f=f"f{n}", value=value: f"flatten(transform(array({value}), {f} -> {read(f)}))"
        if isinstance(kind, dict):
            o = f"o{n}"
            a, b = _project(o, kind, parent, at, n + 1, depth)
            held = f"array({value})"
            if a:
                rows.append(f"flatten(transform({held}, h{n} -> transform(array({_object(f'h{n}')}), {o} -> concat({', '.join(a)}))[0]))")
            if b:
                rest.append(f"flatten(transform({held}, h{n} -> transform(array({_object(f'h{n}')}), {o} -> concat({', '.join(b)}))[0]))")
        elif kind is map:
            rows.append(f"flatten(transform({bound(_pairs)}, (e{n}, k{n}) -> {_entry(f'e{n}.value', f'k{n}', f'e{n}.key', parent, at, n)}))")
        elif kind is list:
            rows.append(f"flatten(transform({bound(_items)}, (x{n}, k{n}) -> {_entry(f'x{n}', f'k{n}', chr(39) * 2, parent, at, n)}))")
        else:
            below = NODE if kind[0] == "node" else kind[0]
            x, k, r = f"x{n}", f"k{n}", f"r{n}"
            entry = f"concat({parent}, '/', {at}, ':', {k})"
            own = _entry(x, k, "''", parent, at, n)
            if kind[0] == "node" and depth == 0:
                rows.append(f"flatten(transform({bound(_items)}, (x{n}, k{n}) -> {own}))")
                rest.append(f"transform({bound(_items)}, (x{n}, k{n}) -> named_struct('node', {x}, 'id', {entry}, 'path', {at}))")
                continue
            a, b = _project(x, below, r, at, n + 1, depth - (kind[0] == "node"))
            # The id is bound once per record, so that deeper levels refer to a name instead of repeating the expression.
            if a:
                rows.append(f"flatten(transform({bound(_items)}, (x{n}, k{n}) -> concat({own}, transform(array({entry}), {r} -> concat({', '.join(a)}))[0])))")
            else:
                rows.append(f"flatten(transform({bound(_items)}, (x{n}, k{n}) -> {own}))")
            if b:
                rest.append(f"flatten(transform({bound(_items)}, (x{n}, k{n}) -> transform(array({entry}), {r} -> concat({', '.join(b)}))[0]))")
    return rows, rest


def payloads(facts: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """fact_id, family (and more columns) and the payload as an object; what cannot be read as one has no fields."""
    fact = _field("c", "fact")
    unwrapped = f"transform(array({fact}), f -> CASE WHEN {_is_object('f')} THEN f WHEN {_is_object(_text('f'))} THEN {_text('f')} ELSE c END)[0]"
    # Each step is bound to a name, so that a payload is parsed once however often a step refers to it.
    v = f"transform(array(try_parse_json(payload)), a -> transform(array({_object('a')}), b -> transform(array({_object('b')}), c -> {unwrapped})[0])[0])[0]"
    return facts.where("payload IS NOT NULL").select("fact_id", "family", *more, F.expr(v).alias("v"))


def entries(facts: DataFrame) -> DataFrame:
    """One row per entry of every list and map: fact_id, relation, entry_kind, parent_id, container_id, container_ordinal, map_key, ordinal, entry_id, value (JSON text).

    The entries of one payload differ, so only those of facts delivered more than once are made distinct; the others are
    not shuffled, and no payload is. Whether a fact is repeated is counted over the ids alone.
    """
    again = written(facts.where("payload IS NOT NULL").groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select("fact_id", F.lit(True).alias("again")))
    read = payloads(spread(facts).join(again, "fact_id", "left"), ("again",))
    row_cases, rest_cases = [], []
    for family, shape in SHAPES.items():
        rows, rest = _project("v", shape, "fact_id", "''", 0, LEVELS)
        row_cases.append(f"WHEN '{family}' THEN cast(concat({', '.join(rows)}) AS {_ROW})")
        if rest:
            rest_cases.append(f"WHEN '{family}' THEN cast(concat({', '.join(rest)}) AS {_REST})")
    parts = [read.select("fact_id", "again", F.expr(f"inline(CASE family {' '.join(row_cases)} END)"))]
    recursive = [f for f, shape in SHAPES.items() if NODE in shape.values()]
    rests = [read.where(F.col("family").isin(recursive)).select("fact_id", "again", F.expr(f"inline(CASE family {' '.join(rest_cases)} END)"))]
    while rests:
        left = written(rests[0].select("fact_id", "again", F.expr("to_json(node)").alias("node"), "id", "path"))
        if left.isEmpty():
            break
        left = left.withColumn("node", F.expr("try_parse_json(node)"))
        rows, rest = _project("node", NODE, "id", "path", 0, LEVELS)
        parts.append(left.select("fact_id", "again", F.expr(f"inline(cast(concat({', '.join(rows)}) AS {_ROW}))")))
        rests = [left.select("fact_id", "again", F.expr(f"inline(cast(concat({', '.join(rest)}) AS {_REST}))"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("value", F.expr("to_json(value)"))
    once = F.col("again").isNull() & F.col("fact_id").isNotNull()
    return out.where(once).drop("again").unionByName(out.where(~once).drop("again").distinct())
