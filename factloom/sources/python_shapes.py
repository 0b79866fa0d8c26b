"""Shapes of Python code that rules count: kernels, models and validators, queries, loops that fill sets, and the like.

Each function walks a parsed module once and yields (relation, row). Rows state what was seen; what is too much is left
to the rules.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Relations of a module's facts and their columns.
RELATIONS: dict[str, dict[str, str]] = {
    "kernel": {"name": "string", "returns_value": "boolean", "barriers_in_branches": "long", "unguarded_indexes": "array<string>", "line": "long"},
    "launch": {"kernel": "string", "parts": "long", "line": "long"},
    "model": {"name": "string", "bases": "array<string>", "fields": "array<string>", "optional": "array<string>", "variadic_tuples": "array<string>", "handwritten": "boolean", "parameters": "long", "attributes": "long", "checks": "long", "defaults": "long", "line": "long"},
    "validator": {"owner": "string", "name": "string", "kind": "string", "reads": "array<string>", "declarative": "boolean", "exclusive": "long", "line": "long"},
    "query": {"form": "string", "text": "string", "line": "long"},
    "type_check": {"types": "array<string>", "line": "long"},
    "value_read": {"owner": "string", "member": "string", "line": "long"},
    "set_loop": {"name": "string", "line": "long"},
    "lookup": {"name": "string", "pairs": "long", "line": "long"},
    "local_list": {"name": "string", "kind": "string", "elements": "long", "uses": "array<string>", "line": "long"},
    "projection": {"receiver": "string", "attributes": "long", "line": "long"},
    "static_call": {"owner": "string", "method": "string", "called": "string", "line": "long"},
    "component_alias": {"owner": "string", "attribute": "string", "source": "string", "line": "long"},
    "class_text": {"owner": "string", "name": "string", "text": "string", "line": "long"},
    "enum_table": {"name": "string", "enum": "string", "members": "array<string>", "line": "long"},
    "method_use": {"owner": "string", "method": "string", "inside": "long", "outside": "long", "line": "long"},
    "helper": {"name": "string", "lines": "long", "callers": "array<string>", "line": "long"},
    "initializer": {"owner": "string", "bases": "array<string>", "calls_super": "boolean", "called": "array<string>", "data": "array<string>", "methods": "array<string>", "line": "long"},
    "path_policy": {"name": "string", "paths": "long", "line": "long"},
    "tensor_doc": {"name": "string", "tensors": "long", "shape": "boolean", "dtype": "boolean", "line": "long"},
    "generated_cases": {"name": "string", "source": "string", "line": "long"},
    "async_test": {"name": "string", "marked": "boolean", "fixtures": "array<string>", "line": "long"},
}
_TENSORS = ("Tensor", "ndarray", "NDArray", "Array", "ArrayLike")
_POLICY = ("exclude", "ignore", "directory", "directories", "suffix", "suffixes")
_BARRIERS = ("syncthreads", "cuda.syncthreads")


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "?", *reversed(parts)])


def _decorators(node) -> list[str]:
    return [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]


def _names(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def read(tree: ast.Module) -> Iterator[tuple[str, dict]]:
    kernels = set()
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    functions = [n for n in ast.walk(tree) if isinstance(n, FUNCTION)]
    for f in functions:
        if any(d.endswith("cuda.jit") or d == "jit" for d in _decorators(f)):
            kernels.add(f.name)
            yield "kernel", _kernel(f)
        yield from _locals(f)
        if (made := _tensor_doc(f)) is not None:
            yield "tensor_doc", made
        yield from _test(f)
    for c in classes:
        yield from _class(c, tree)
    yield from _expressions(tree, kernels)
    yield from _module(tree, functions, classes)


def _kernel(f) -> dict:
    def within(node: ast.AST, inside: bool) -> int:
        n = 0
        for child in ast.iter_child_nodes(node):
            n += isinstance(child, ast.Call) and dotted(child.func) in _BARRIERS and inside
            n += within(child, inside or isinstance(child, (ast.If, ast.While)))
        return n

    indexes: dict[str, None] = {}
    for n in ast.walk(f):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func).endswith("cuda.grid"):
            for t in n.targets:
                indexes |= dict.fromkeys(sorted(_names(t)))
    compared = {x for n in ast.walk(f) if isinstance(n, (ast.If, ast.While, ast.IfExp)) for x in _names(n.test)}
    return dict(name=f.name, returns_value=any(isinstance(n, ast.Return) and n.value is not None for n in ast.walk(f)), barriers_in_branches=within(f, False), unguarded_indexes=[i for i in indexes if i not in compared], line=f.lineno)


def _locals(f) -> Iterator[tuple[str, dict]]:
    """Sets filled by a loop right after they were made, and lists that are only looked into."""
    for body in (n.body for n in ast.walk(f) if isinstance(getattr(n, "body", None), list)):
        for a, b in zip(body, body[1:]):
            if isinstance(a, ast.Assign) and isinstance(a.targets[0], ast.Name) and isinstance(a.value, ast.Call) and dotted(a.value.func) == "set" and not a.value.args and isinstance(b, ast.For) and len(b.body) == 1:
                inner = b.body[0].body[0] if isinstance(b.body[0], ast.If) and len(b.body[0].body) == 1 and not b.body[0].orelse else b.body[0]
                if isinstance(inner, ast.Expr) and isinstance(inner.value, ast.Call) and dotted(inner.value.func) == f"{a.targets[0].id}.add":
                    yield "set_loop", dict(name=a.targets[0].id, line=a.lineno)
    made = {n.targets[0].id: n for n in ast.walk(f) if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, (ast.List, ast.Tuple))}
    for name, n in made.items():
        uses = []
        for x in ast.walk(f):
            for child in ast.iter_child_nodes(x):
                if isinstance(child, ast.Name) and child.id == name and isinstance(child.ctx, ast.Load):
                    member = isinstance(x, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in x.ops) and child in x.comparators
                    uses.append("membership" if member else "iteration" if isinstance(x, (ast.For, ast.comprehension)) else "index" if isinstance(x, ast.Subscript) else "mutation" if isinstance(x, ast.Attribute) and x.attr in ("append", "extend", "insert", "remove", "pop", "sort", "clear") else "other")
        yield "local_list", dict(name=name, kind=type(n.value).__name__.lower(), elements=len(n.value.elts), uses=sorted(set(uses)), line=n.lineno)


def _tensor_doc(f) -> dict | None:
    notes = [a.annotation for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs) if a.annotation] + ([f.returns] if f.returns else [])
    tensors = sum(any(dotted(n).split(".")[-1] in _TENSORS for n in ast.walk(x) if isinstance(n, (ast.Name, ast.Attribute))) for x in notes)
    doc = (ast.get_docstring(f) or "").lower()
    return dict(name=f.name, tensors=tensors, shape="shape" in doc, dtype="dtype" in doc, line=f.lineno) if tensors and doc and not f.name.startswith("_") else None


def _test(f) -> Iterator[tuple[str, dict]]:
    if not f.name.startswith("test"):
        return
    for d in f.decorator_list:
        if isinstance(d, ast.Call) and dotted(d.func).endswith("parametrize") and len(d.args) > 1 and isinstance(d.args[1], (ast.Name, ast.Call, ast.ListComp)):
            source = d.args[1]
            yield "generated_cases", dict(name=f.name, source=type(source).__name__.lower(), line=f.lineno)
    if isinstance(f, ast.AsyncFunctionDef):
        marked = any(d.split(".")[-1] in ("asyncio", "anyio", "trio") for d in _decorators(f))
        yield "async_test", dict(name=f.name, marked=marked, fixtures=[a.arg for a in f.args.args if a.arg != "self"], line=f.lineno)


def _class(c: ast.ClassDef, tree: ast.Module) -> Iterator[tuple[str, dict]]:
    annotated = [s for s in c.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
    methods = [m for m in c.body if isinstance(m, FUNCTION)]
    fields = [s.target.id for s in annotated]
    text = {s.target.id: ast.unparse(s.annotation) for s in annotated}
    init = next((m for m in methods if m.name == "__init__"), None)
    assigned = [t.attr for n in ast.walk(init) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Attribute) and dotted(t.value) == "self"] if init else []
    yield "model", dict(
        name=c.name, bases=[dotted(b) for b in c.bases], fields=fields, optional=[f for f, t in text.items() if "None" in t or "Optional" in t], variadic_tuples=[f for f, t in text.items() if t.replace(" ", "").lower().startswith("tuple[") and t.replace(" ", "").endswith(",...]")],
        handwritten=init is not None and not c.bases, parameters=len(init.args.args) - 1 + len(init.args.kwonlyargs) if init else 0, attributes=len(set(assigned)), checks=sum(isinstance(n, ast.Raise) for n in ast.walk(init)) if init else 0,
        defaults=len(init.args.defaults) + sum(d is not None for d in init.args.kw_defaults) if init else 0, line=c.lineno,
    )
    static = {m.name for m in methods if "classmethod" in _decorators(m)}
    for m in methods:
        marks = _decorators(m)
        kind = next((k for k in ("model_validator", "field_validator", "validator", "root_validator") if any(d.split(".")[-1] == k for d in marks)), None)
        reads = sorted({n.attr for n in ast.walk(m) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("self", "values", "cls") and n.attr in fields})
        if kind:
            mode = next((k.value.value for d in m.decorator_list if isinstance(d, ast.Call) for k in d.keywords if k.arg == "mode" and isinstance(k.value, ast.Constant)), "after")
            guard = [s for s in m.body if isinstance(s, ast.If) and len(s.body) == 1 and isinstance(s.body[0], ast.Raise) and isinstance(s.test, ast.Compare) and all(isinstance(x, ast.Constant) or isinstance(x, ast.UnaryOp) for x in s.test.comparators)]
            exclusive = len({n.left.attr for n in ast.walk(m) if isinstance(n, ast.Compare) and isinstance(n.left, ast.Attribute) and any(isinstance(o, (ast.Is, ast.IsNot)) for o in n.ops) and n.left.attr in fields})
            yield "validator", dict(owner=c.name, name=m.name, kind=f"{kind}_{mode}", reads=reads, declarative=bool(guard) and len(m.body) == len(guard) + 1, exclusive=exclusive, line=m.lineno)
        if "staticmethod" in marks:
            for n in ast.walk(m):
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and dotted(n.func.value) == c.name and n.func.attr in static:
                    yield "static_call", dict(owner=c.name, method=m.name, called=n.func.attr, line=n.lineno)
    for m in methods:
        for n in ast.walk(m):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Attribute) and isinstance(n.value.value, ast.Attribute):
                for t in n.targets:
                    if isinstance(t, ast.Attribute) and dotted(t.value) == "self" and dotted(n.value).startswith("self."):
                        yield "component_alias", dict(owner=c.name, attribute=t.attr, source=dotted(n.value), line=n.lineno)
    for s in c.body:
        if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            target = s.targets[0] if isinstance(s, ast.Assign) else s.target
            if isinstance(target, ast.Name):
                yield "class_text", dict(owner=c.name, name=target.id, text=s.value.value, line=s.lineno)
    if init is not None or any(isinstance(s, (ast.Assign, ast.AnnAssign)) for s in c.body) or methods:
        calls = [n.func for n in ast.walk(init) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "__init__"] if init else []
        direct = [dotted(x.value) for x in calls if isinstance(x.value, (ast.Name, ast.Attribute))]
        data = [t.id for s in c.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)] + fields + assigned
        yield "initializer", dict(owner=c.name, bases=[dotted(b) for b in c.bases], calls_super=init is None or any(isinstance(x.value, ast.Call) for x in calls), called=direct, data=sorted(set(data)), methods=[m.name for m in methods if "property" not in _decorators(m)], line=c.lineno)
    uses = [n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)]
    own = [n.attr for n in ast.walk(c) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("self", "cls")]
    for m in methods:
        if not m.name.startswith("_"):
            yield "method_use", dict(owner=c.name, method=m.name, inside=own.count(m.name), outside=uses.count(m.name) - own.count(m.name), line=m.lineno)


def _expressions(tree: ast.Module, kernels: set[str]) -> Iterator[tuple[str, dict]]:
    enums = {c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) and any(dotted(b).split(".")[-1] in ("StrEnum", "IntEnum") for b in c.bases)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Subscript) and isinstance(f.value, ast.Name) and f.value.id in kernels:
                yield "launch", dict(kernel=f.value.id, parts=len(f.slice.elts) if isinstance(f.slice, ast.Tuple) else 1, line=n.lineno)
            if isinstance(f, ast.Name) and f.id == "isinstance" and len(n.args) == 2:
                kinds = n.args[1].elts if isinstance(n.args[1], ast.Tuple) else [n.args[1]]
                yield "type_check", dict(types=[dotted(k) for k in kinds], line=n.lineno)
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Attribute):
                before = f.value.func.attr
                if f.attr == "scalars" and before in ("execute", "exec"):
                    yield "query", dict(form=f"{before}_scalars", text=ast.unparse(n), line=n.lineno)
                if f.attr in ("first", "one", "one_or_none") and before in ("exec", "execute", "scalars"):
                    where = [c for c in ast.walk(f.value) if isinstance(c, ast.Compare) and isinstance(c.left, ast.Attribute) and c.left.attr == "id" and len(c.ops) == 1 and isinstance(c.ops[0], ast.Eq)]
                    if where:
                        yield "query", dict(form="key_select", text=ast.unparse(n), line=n.lineno)
        elif isinstance(n, ast.Attribute) and n.attr == "value" and isinstance(n.value, ast.Attribute) and isinstance(n.value.value, ast.Name) and n.value.value.id in enums:
            yield "value_read", dict(owner=n.value.value.id, member=n.value.attr, line=n.lineno)
        elif isinstance(n, ast.Dict):
            pairs = [(k.value, v) for k, v in zip(n.keys, n.values) if isinstance(k, ast.Constant) and isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.attr == k.value]
            for name in sorted({v.value.id for _, v in pairs}):
                yield "projection", dict(receiver=name, attributes=sum(v.value.id == name for _, v in pairs), line=n.lineno)
            owners = {k.value.id for k in n.keys if isinstance(k, ast.Attribute) and isinstance(k.value, ast.Name)}
            if len(owners) == 1 and len(n.keys) > 1 and all(isinstance(k, ast.Attribute) for k in n.keys):
                yield "enum_table", dict(name="", enum=next(iter(owners)), members=sorted(k.attr for k in n.keys), line=n.lineno)


def _module(tree: ast.Module, functions: list, classes: list[ast.ClassDef]) -> Iterator[tuple[str, dict]]:
    for s in tree.body:
        value = getattr(s, "value", None)
        names = [t.id for t in getattr(s, "targets", [getattr(s, "target", None)]) if isinstance(t, ast.Name)] if isinstance(s, (ast.Assign, ast.AnnAssign)) else []
        elements = value.elts if isinstance(value, (ast.List, ast.Tuple, ast.Set)) else []
        for name in names:
            pairs = [e for e in elements if isinstance(e, ast.Tuple) and len(e.elts) == 2 and isinstance(e.elts[0], ast.Constant)]
            if pairs and len(pairs) == len(elements):
                yield "lookup", dict(name=name, pairs=len(pairs), line=s.lineno)
            paths = [e for e in elements if isinstance(e, ast.Constant) and isinstance(e.value, str) and ("/" in e.value or e.value.startswith((".", "*")))]
            if any(w in name.lower().split("_") for w in _POLICY) and paths:
                yield "path_policy", dict(name=name, paths=len(paths), line=s.lineno)
    methods = {id(m): f"{c.name}.{m.name}" for c in classes for m in c.body if isinstance(m, FUNCTION)}
    for f in tree.body:
        if isinstance(f, FUNCTION) and f.name.startswith("_") and not f.name.startswith("__"):
            callers = [methods.get(id(g), g.name) for g in functions if g is not f for n in ast.walk(g) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == f.name]
            yield "helper", dict(name=f.name, lines=(f.end_lineno or f.lineno) - f.lineno + 1, callers=callers, line=f.lineno)
