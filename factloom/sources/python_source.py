"""Python sources as fact tables: one parse per file, typed relations out.

Every file is parsed once inside `mapInPandas`; its facts leave as rows of (relation, fact_id, ordinal, JSON) and are
written once, split by relation, so a rule that reads one relation scans that relation only. A caller that names the
relations it needs gets those alone. A file that does not parse gives no facts. Repeated file rows count once, of several
texts of a file the latest.

A fact's id names its repository, so equal paths of two repositories stay apart. fact_order puts a file's facts of one
family in the order in which they stand, files by their file_id (below 2^39; at most 2^24 facts of a family in a file).
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.facts import FactTable, latest
from ..session import new_path, spread
from . import python_shapes

#: Columns of each relation besides fact_id and ordinal. The first relation of a family is its facts.
RELATIONS: dict[str, dict[str, str]] = {
    "function": {
        "path": "", "name": "string", "qualname": "string", "owner": "string", "lines": "long", "statements": "long", "conditionals": "long", "controls": "long", "control_depth": "long",
        "nesting": "long", "operations": "long", "is_async": "boolean", "is_public": "boolean", "is_method": "boolean", "is_nested": "boolean", "has_docstring": "boolean", "docstring": "string",
        "decorators": "array<string>", "is_recursive": "boolean", "references": "long", "is_test": "boolean", "returns_call": "boolean", "receiver_reads": "long",
    },
    "parameter": {"name": "string", "annotation": "string", "kind": "string", "has_default": "boolean", "is_receiver": "boolean", "is_boolean": "boolean", "reads": "long", "attribute_reads": "long"},
    "call": {"callee": "string", "keywords": "array<string>", "arguments": "long", "first": "string", "first_is_literal": "boolean", "discarded": "boolean", "in_loop": "boolean", "in_function": "string", "in_async": "boolean", "line": "long", "column": "long"},
    "class": {"name": "string", "bases": "array<string>", "decorators": "array<string>", "methods": "long", "public_methods": "long", "fields": "long", "is_empty": "boolean", "is_public": "boolean", "line": "long", "end": "long"},
    "method": {"name": "string", "visibility": "long", "kind": "long", "lifecycle": "long", "protocol": "boolean", "is_static": "boolean", "is_class": "boolean", "reads_state": "boolean", "line": "long", "positional": "array<string>", "defaults": "long", "required_keywords": "array<string>", "has_args": "boolean", "has_kwargs": "boolean", "is_async": "boolean", "is_property": "boolean", "is_abstract": "boolean", "is_final": "boolean", "body": "string"},
    "import": {"module": "string", "name": "string", "alias": "string", "level": "long", "is_from": "boolean", "is_used": "boolean", "line": "long"},
    "module": {"path": "", "line_count": "long", "functions": "long", "classes": "long", "statements": "long", "has_all": "boolean", "only_reexports": "boolean", "is_init": "boolean", "is_test": "boolean", "constants": "long", "out_of_place_constants": "long"},
    "handler": {"types": "array<string>", "alias": "string", "is_inert": "boolean", "line": "long", "catches_own": "boolean", "returns_none": "boolean", "guarded": "long"},
    "raise": {"type": "string", "in_handler": "boolean", "has_cause": "boolean", "names_alias": "boolean", "line": "long"},
    "try": {"body": "long", "longest": "long", "line": "long", "literal_setup": "long"},
    "comprehension": {"kind": "string", "loops": "long", "line": "long"},
    "annotation": {"text": "string", "names": "array<string>", "nullable_boolean": "boolean", "line": "long"},
    "literal": {"text": "string", "role": "string", "fragments": "long", "line": "long"},
    "attribute": {"name": "string", "receiver": "string", "line": "long"},
    "binding": {"name": "string", "value_kind": "string", "value_text": "string", "line": "long", "in_loop_header": "boolean", "is_constant": "boolean"},
    "branch": {"arms": "long", "subject": "string", "literals": "long", "line": "long"},
    "block": {"kind": "string", "subtree_end": "long", "depth": "long", "line": "long", "else_after_jump": "boolean"},
    "effect": {"kind": "string", "line": "long"},
    "test": {"name": "string", "shape": "string", "literals": "array<string>", "fixtures": "array<string>", "reach": "array<string>", "statements": "long", "conditionals": "long", "assertions": "long", "is_async": "boolean", "decorators": "array<string>", "mutates": "boolean", "literal_loop": "long", "range_cases": "long", "line": "long"},
    "enum": {"name": "string", "member": "string", "value": "string", "base": "string", "line": "long"},
    "export": {"name": "string", "line": "long"},
    "reference": {"name": "string", "n": "long"},
    "declaration": {"name": "string", "kind": "string", "is_public": "boolean", "line": "long"},
} | python_shapes.RELATIONS
#: The first relation of each family; the others belong to ModuleFact, these to the family named.
_FAMILY = {"function": "FunctionFact", "parameter": "FunctionFact", "class": "ClassFact", "method": "ClassFact"}
_FILE_FACTS = 1 << 24
LIFECYCLE = ("__init_subclass__", "__new__", "__init__", "__post_init__", "__del__")
_INERT = (ast.Pass, ast.Continue)
_JUMPS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
_CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_BODIES = {ast.If: "branch", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.Try: "guard", ast.With: "scope", ast.AsyncWith: "scope", ast.Match: "branch"}


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    elif isinstance(node, ast.Call):
        parts.append(dotted(node.func) + "()")
    else:
        parts.append("?")
    return ".".join(reversed(parts))


def _is_test(path: str) -> bool:
    parts = path.split("/")
    return "tests" in parts[:-1] or "test" in parts[:-1] or parts[-1].startswith("test_") or parts[-1].endswith("_test.py") or parts[-1] == "conftest.py"


class _Reader(ast.NodeVisitor):
    """Walks one module and keeps its rows by relation."""

    def __init__(self, path: str, text: str, tree: ast.Module, repository: str | None = None, wanted: frozenset[str] = frozenset(RELATIONS)):
        self.path, self.text, self.tree, self.test, self.wanted = path, text, tree, _is_test(path), wanted
        self.place = f"{repository}:{path}" if repository else path
        self.rows: dict[str, list[tuple[str, dict]]] = {k: [] for k in RELATIONS}
        self.module_id = f"module:{self.place}"
        self.names: dict[str, int] = {}
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                self.names[n.id] = self.names.get(n.id, 0) + 1
            elif isinstance(n, ast.Attribute):
                self.names[n.attr] = self.names.get(n.attr, 0) + 1
        self.owner: list[ast.AST] = []
        self.loops = 0
        self.handlers: list[ast.ExceptHandler] = []
        self.module()
        self.generic_visit(tree)
        self.blocks()
        self.symbols()
        if wanted & python_shapes.RELATIONS.keys():
            for relation, row in python_shapes.read(tree):
                self.add(relation, **row)

    def add(self, relation: str, fact: str | None = None, **row) -> None:
        self.rows[relation].append((fact or self.module_id, row))

    def module(self) -> None:
        body = self.tree.body
        simple = [s for s in body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        names_all = lambda s: isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets)
        imports = [s for s in simple if isinstance(s, (ast.Import, ast.ImportFrom))]
        constants = [k for k, s in enumerate(simple) if isinstance(s, (ast.Assign, ast.AnnAssign)) and any(isinstance(t, ast.Name) and t.id.isupper() for t in (s.targets if isinstance(s, ast.Assign) else [s.target]))]
        definitions = [k for k, s in enumerate(simple) if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        late = [k for k in constants if definitions and k > definitions[0]]
        self.add(
            "module", line_count=self.text.count("\n") + (not self.text.endswith("\n") and bool(self.text)), functions=sum(isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) for s in body),
            classes=sum(isinstance(s, ast.ClassDef) for s in body), statements=sum(isinstance(n, ast.stmt) for n in ast.walk(self.tree)), has_all=any(map(names_all, body)),
            only_reexports=bool(imports) and any(map(names_all, body)) and all(s in imports or names_all(s) for s in simple), is_init=self.path.rsplit("/", 1)[-1] == "__init__.py", is_test=self.test,
            constants=len(constants), out_of_place_constants=len(late),
        )

    def blocks(self) -> None:
        """Bodies in pre-order with the end of their subtree, for enclosure by interval."""
        order = 0

        def walk(node: ast.AST, depth: int) -> None:
            nonlocal order
            for child in ast.iter_child_nodes(node):
                kind = _BODIES.get(type(child))
                chained = isinstance(child, ast.If) and isinstance(node, ast.If) and node.orelse == [child]
                if kind and not chained:
                    mine, order = order, order + 1
                    row = dict(kind=kind, depth=depth + 1, line=child.lineno, else_after_jump=isinstance(child, ast.If) and bool(child.orelse) and isinstance(child.body[-1], _JUMPS))
                    self.rows["block"].append((self.module_id, row))
                    walk(child, depth + 1)
                    row["subtree_end"] = order
                    row["_ordinal"] = mine
                else:
                    walk(child, depth)

        walk(self.tree, 0)

    def symbols(self) -> None:
        """Top-level declarations, exported names, and every name the module mentions outside its own declarations."""
        for name, n in self.names.items():
            self.add("reference", name=name, n=n)
        for s in self.tree.body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.add("declaration", name=s.name, kind="class" if isinstance(s, ast.ClassDef) else "function", is_public=not s.name.startswith("_"), line=s.lineno)
            elif isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple)):
                for e in s.value.elts:
                    if isinstance(e, ast.Constant) and isinstance(e.value, str):
                        self.add("export", name=e.value, line=e.lineno)

    def _test_case(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = list(ast.walk(node))
        literals = [repr(n.value) for n in inside if isinstance(n, ast.Constant)]
        shape = ast.dump(ast.Module([s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))], []))
        for text in sorted(set(literals), key=len, reverse=True):
            shape = shape.replace(f"value={text}", "value=_")
        calls = sorted({dotted(n.func) for n in inside if isinstance(n, ast.Call)} - {"len", "range", "print", "isinstance", "pytest.raises"})
        loops = [n for n in inside if isinstance(n, ast.For) and isinstance(n.iter, (ast.List, ast.Tuple)) and any(isinstance(x, ast.Assert) for x in ast.walk(n))]
        ranges = [n.args[-1].value - (n.args[0].value if len(n.args) > 1 else 0) for d in node.decorator_list for n in ast.walk(d) if isinstance(n, ast.Call) and dotted(n.func) == "range" and n.args and all(isinstance(a, ast.Constant) and isinstance(a.value, int) for a in n.args)]
        self.add(
            "test", name=node.name, shape=shape, literals=literals, fixtures=sorted(a.arg for a in node.args.args if a.arg != "self"), reach=calls, statements=sum(isinstance(n, ast.stmt) for n in inside) - 1,
            conditionals=sum(isinstance(n, (ast.If, ast.IfExp, ast.Match)) for n in inside), assertions=sum(isinstance(n, ast.Assert) for n in inside), is_async=isinstance(node, ast.AsyncFunctionDef),
            decorators=[dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list], mutates=any(isinstance(n, ast.Global) for n in inside), literal_loop=max((len(n.iter.elts) for n in loops), default=0),
            range_cases=max(ranges, default=0), line=node.lineno,
        )

    # -- functions

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        owners = [o.name for o in self.owner if hasattr(o, "name")]
        qualname = ".".join([*owners, node.name])
        method = bool(self.owner) and isinstance(self.owner[-1], ast.ClassDef)
        fact = f"function:{self.place}:{qualname}:{node.lineno}"
        if "test" in self.wanted and self.test and node.name.startswith("test"):
            self._test_case(node)
        doc = ast.get_docstring(node)
        body = node.body[1:] if doc is not None else node.body
        controls, depths, deepest = 0, 0, 0

        def measure(statements, depth: int) -> None:
            nonlocal controls, depths, deepest
            for s in statements:
                if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    continue
                if isinstance(s, _CONTROL):
                    controls, depths, deepest = controls + 1, depths + depth, max(deepest, depth + 1)
                for name in ("body", "orelse", "finalbody"):
                    part = getattr(s, name, None)
                    if isinstance(part, list):
                        chained = name == "orelse" and len(part) == 1 and isinstance(part[0], ast.If) and isinstance(s, ast.If)
                        measure(part, depth if chained else depth + isinstance(s, _CONTROL))
                for h in getattr(s, "handlers", []):
                    measure(h.body, depth + 1)
                for c in getattr(s, "cases", []):
                    measure(c.body, depth + 1)

        measure(body, 0)
        inside = list(ast.walk(node))
        args = node.args
        positional = [*args.posonlyargs, *args.args]
        receiver = positional[0].arg if method and positional and not any(dotted(d) == "staticmethod" for d in node.decorator_list) else None
        loads = [n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
        of_attributes = [n.value.id for n in inside if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)]
        self.add(
            "function", fact, name=node.name, qualname=qualname, owner=self.owner[-1].name if method else None, lines=(node.end_lineno or node.lineno) - (body[0].lineno if body else node.lineno) + 1,
            statements=len(body), conditionals=sum(isinstance(n, (ast.If, ast.IfExp, ast.Match)) for n in inside), controls=controls, control_depth=depths, nesting=deepest,
            operations=sum(isinstance(n, (ast.Call, ast.BinOp, ast.BoolOp, ast.Compare, ast.Await)) for n in inside), is_async=isinstance(node, ast.AsyncFunctionDef), is_public=not node.name.startswith("_"),
            is_method=method, is_nested=any(isinstance(o, (ast.FunctionDef, ast.AsyncFunctionDef)) for o in self.owner), has_docstring=doc is not None, docstring=doc, decorators=[dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list],
            is_recursive=any(isinstance(n, ast.Call) and dotted(n.func).split(".")[-1] == node.name for n in inside), references=self.names.get(node.name, 0), is_test=self.test,
            returns_call=len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Call) and len(positional) == 1 and len(body[0].value.args) == 1 and isinstance(body[0].value.args[0], ast.Name) and body[0].value.args[0].id == positional[0].arg,
            receiver_reads=loads.count(receiver) if receiver else 0, _line=node.lineno, _end=node.end_lineno, _column=node.col_offset,
        )
        defaults = [False] * (len(positional) - len(args.defaults)) + [True] * len(args.defaults)
        rows = [(a, "positional_only" if a in args.posonlyargs else "positional", d) for a, d in zip(positional, defaults)]
        rows += [(args.vararg, "variadic", False)] * bool(args.vararg) + [(a, "keyword_only", d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults)] + [(args.kwarg, "keywords", False)] * bool(args.kwarg)
        values = dict(zip([a.arg for a in positional[len(positional) - len(args.defaults) :]], args.defaults)) | {a.arg: d for a, d in zip(args.kwonlyargs, args.kw_defaults) if d}
        for a, kind, has in rows:
            note = ast.unparse(a.annotation) if a.annotation else None
            value = values.get(a.arg)
            self.add("parameter", fact, name=a.arg, annotation=note, kind=kind, has_default=has, is_receiver=a.arg == receiver, is_boolean=note == "bool" or isinstance(value, ast.Constant) and isinstance(value.value, bool), reads=loads.count(a.arg), attribute_reads=of_attributes.count(a.arg))
            if a.annotation:
                self.annotation(a.annotation)
        if node.returns:
            self.annotation(node.returns)
        loops, self.loops = self.loops, 0
        self.owner.append(node)
        self.generic_visit(node)
        self.owner.pop()
        self.loops = loops

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def annotation(self, node: ast.AST) -> None:
        if "annotation" not in self.wanted:
            return
        text = ast.unparse(node)
        names = sorted({dotted(n) for n in ast.walk(node) if isinstance(n, (ast.Name, ast.Attribute))})
        self.add("annotation", text=text, names=names, nullable_boolean=text in ("bool | None", "None | bool", "Optional[bool]"), line=node.lineno)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        fact = f"class:{self.place}:{node.name}:{node.lineno}"
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        shown = methods if "method" in self.wanted else []
        fields = [s for s in node.body if isinstance(s, (ast.Assign, ast.AnnAssign))]
        rest = [s for s in node.body if not (isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        protocol = lambda n: n.startswith("__") and n.endswith("__")
        self.add("class", fact, name=node.name, bases=[dotted(b) for b in node.bases], decorators=[dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list], methods=len(methods), public_methods=sum(not m.name.startswith("_") for m in methods), fields=len(fields), is_empty=not rest, is_public=not node.name.startswith("_"), line=node.lineno, end=node.end_lineno)
        for m in shown:
            decorators = [dotted(d.func if isinstance(d, ast.Call) else d).split(".")[-1] for d in m.decorator_list]
            positional = [a.arg for a in (*m.args.posonlyargs, *m.args.args)]
            first = positional[0] if positional else None
            body = [s for s in m.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
            self.add(
                "method", fact, name=m.name, visibility=2 if m.name.startswith("__") and not protocol(m.name) else 1 if m.name.startswith("_") and not protocol(m.name) else 0,
                kind=0 if "property" in decorators else 1 if "classmethod" in decorators else 2 if "staticmethod" in decorators else 3, lifecycle=LIFECYCLE.index(m.name) if m.name in LIFECYCLE else 99, protocol=protocol(m.name),
                is_static="staticmethod" in decorators, is_class="classmethod" in decorators, reads_state=any(isinstance(n, ast.Name) and n.id == first for n in ast.walk(m) if first), line=m.lineno,
                positional=positional[0 if "staticmethod" in decorators else 1 :], defaults=len(m.args.defaults), required_keywords=[a.arg for a, d in zip(m.args.kwonlyargs, m.args.kw_defaults) if d is None],
                has_args=bool(m.args.vararg), has_kwargs=bool(m.args.kwarg), is_async=isinstance(m, ast.AsyncFunctionDef), is_property="property" in decorators or "cached_property" in decorators,
                is_abstract="abstractmethod" in decorators, is_final="final" in decorators, body=ast.dump(ast.Module(body, [])) if body else "",
            )
        base = next((b for b in map(dotted, node.bases) if b.split(".")[-1] in ("Enum", "StrEnum", "IntEnum", "Flag", "IntFlag")), None)
        for f in fields:
            if isinstance(f, ast.AnnAssign):
                self.annotation(f.annotation)
            elif base and isinstance(f.targets[0], ast.Name):
                self.add("enum", name=node.name, member=f.targets[0].id, value=ast.unparse(f.value), base=base.split(".")[-1], line=f.lineno)
        self.owner.append(node)
        self.generic_visit(node)
        self.owner.pop()

    # -- statements

    def _import(self, node: ast.Import | ast.ImportFrom) -> None:
        for a in node.names:
            bound = a.asname or a.name.split(".")[0]
            module = node.module if isinstance(node, ast.ImportFrom) else a.name
            self.add("import", module=module, name=a.name if isinstance(node, ast.ImportFrom) else None, alias=a.asname, level=getattr(node, "level", 0) or 0, is_from=isinstance(node, ast.ImportFrom), is_used=a.name == "*" or self.names.get(bound, 0) > 0 or module == "__future__", line=node.lineno)

    visit_Import = visit_ImportFrom = _import

    def _loop(self, node) -> None:
        if isinstance(node, (ast.For, ast.AsyncFor)):
            for n in ast.walk(node.target):
                if isinstance(n, ast.Name):
                    self.add("binding", name=n.id, value_kind="item", value_text=None, line=node.lineno, in_loop_header=True, is_constant=False)
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    visit_For = visit_AsyncFor = visit_While = _loop

    def _try(self, node: ast.Try) -> None:
        raised = {dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for s in node.body for n in ast.walk(s) if isinstance(n, ast.Raise) and n.exc}
        clauses = [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody]
        setup = 0
        for s in node.body[:-1]:
            if not (isinstance(s, ast.Assign) and isinstance(s.value, (ast.Constant, ast.List, ast.Dict, ast.Tuple)) and not any(isinstance(n, ast.Call) for n in ast.walk(s))):
                break
            setup += 1
        self.add("try", body=len(node.body), longest=max(map(len, clauses)), line=node.lineno, literal_setup=setup)
        for h in node.handlers:
            kinds = [dotted(t) for t in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type] if h.type else [])]
            inert = all(isinstance(s, _INERT) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in h.body)
            none = len(h.body) == 1 and isinstance(h.body[0], ast.Return) and (h.body[0].value is None or isinstance(h.body[0].value, ast.Constant) and h.body[0].value.value is None)
            self.add("handler", types=kinds, alias=h.name, is_inert=inert, line=h.lineno, catches_own=bool(raised & ({*kinds} if kinds else raised)) or bool(raised) and any(k in ("Exception", "BaseException") for k in kinds), returns_none=none, guarded=len(node.body))
        for s in (*node.body, *node.orelse, *node.finalbody):
            self.visit(s)
        for h in node.handlers:
            self.handlers.append(h)
            self.generic_visit(h)
            self.handlers.pop()

    visit_Try = visit_TryStar = _try

    def visit_Raise(self, node: ast.Raise) -> None:
        inside = self.handlers[-1] if self.handlers else None
        if node.exc is not None:
            alias = inside.name if inside else None
            self.add("raise", type=dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc), in_handler=inside is not None, has_cause=node.cause is not None, names_alias=bool(alias) and any(isinstance(n, ast.Name) and n.id == alias for n in ast.walk(node)), line=node.lineno)
        self.generic_visit(node)

    def visit_Expr(self, node: ast.Expr) -> None:
        v = node.value
        if isinstance(v, ast.Call):
            self.call(v, True)
            for child in ast.iter_child_nodes(v):
                self.visit(child)
            return
        if isinstance(v, (ast.Name, ast.Attribute, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.Compare, ast.BinOp)) or isinstance(v, ast.Constant) and not isinstance(v.value, str) and v.value is not ...:
            self.add("effect", kind=type(v).__name__.lower(), line=node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        self.call(node, False)
        self.generic_visit(node)

    def call(self, node: ast.Call, discarded: bool) -> None:
        functions = [o for o in self.owner if isinstance(o, (ast.FunctionDef, ast.AsyncFunctionDef))]
        first = node.args[0] if node.args else None
        if "call" not in self.wanted:
            return
        self.add("call", callee=dotted(node.func), keywords=[k.arg for k in node.keywords if k.arg], arguments=len(node.args), first=ast.unparse(first) if first is not None else None, first_is_literal=isinstance(first, (ast.Constant, ast.Dict, ast.List)), discarded=discarded, in_loop=self.loops > 0, in_function=functions[-1].name if functions else None, in_async=bool(functions) and isinstance(functions[-1], ast.AsyncFunctionDef), line=node.lineno, column=node.col_offset)

    def _comprehension(self, node) -> None:
        self.add("comprehension", kind=type(node).__name__.lower(), loops=len(node.generators), line=node.lineno)
        self.generic_visit(node)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if node.attr.startswith("_") and not node.attr.startswith("__"):
            receiver = dotted(node.value)
            if receiver not in ("self", "cls") and not receiver.startswith("super()"):
                self.add("attribute", name=node.attr, receiver=receiver, line=node.lineno)
        self.generic_visit(node)

    def _assign(self, node) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        value = node.value
        for t in targets if "binding" in self.wanted else ():
            for n in ast.walk(t):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    self.add("binding", name=n.id, value_kind=type(value).__name__.lower() if value is not None else None, value_text=ast.unparse(value) if value is not None else None, line=node.lineno, in_loop_header=False, is_constant=not self.owner and n.id.isupper())
        if "literal" in self.wanted and isinstance(value, ast.Constant) and isinstance(value.value, str):
            self.literal(value, "assigned")
        if isinstance(node, ast.AnnAssign):
            self.annotation(node.annotation)
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = _assign

    def literal(self, node: ast.Constant, role: str) -> None:
        segment = ast.get_source_segment(self.text, node) or ""
        fragments = 1
        if "\n" in segment and not segment.lstrip("rbfuRBFU").startswith(('"""', "'''")):
            fragments = segment.count("\n") + 1
        self.add("literal", text=node.value, role=role, fragments=fragments, line=node.lineno)

    def visit_If(self, node: ast.If) -> None:
        arms, subjects, literals, at = 0, set(), [], node
        while True:
            t = at.test
            if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq) and isinstance(t.comparators[0], ast.Constant):
                subjects.add(ast.unparse(t.left))
                literals.append(repr(t.comparators[0].value))
            else:
                subjects.add(None)
            arms += 1
            if len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If):
                at = at.orelse[0]
            else:
                break
        if arms > 1 and None not in subjects and len(subjects) == 1:
            self.add("branch", arms=arms, subject=next(iter(subjects)), literals=len(set(literals)), line=node.lineno)
        self.generic_visit(node)


def read(path: str, text: str, repository: str | None = None, wanted: frozenset[str] = frozenset(RELATIONS)) -> dict[str, list[tuple[str, dict]]]:
    """All rows of one module; raises SyntaxError where it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _Reader(path, text, ast.parse(text), repository, wanted).rows


def tables(files: DataFrame, relations: list[str] | None = None) -> dict[str, FactTable]:
    """Fact tables of the Python files of a source table (file_id, repository, path, text, ingested_at).

    relations: those that are needed; None: all. A family's facts are read where it or one of its children is needed.
    """
    owner = {"FunctionFact": "function", "ClassFact": "class", "ModuleFact": "module"}
    wanted = frozenset(RELATIONS if relations is None else [*relations, *(owner[_FAMILY.get(r, "ModuleFact")] for r in relations)])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, repository, path, text in zip(batch["file_id"], batch["repository"], batch["path"], batch["text"]):
                try:
                    rows = read(path, text.lstrip("﻿"), repository, wanted)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for relation, found in rows.items():
                    if relation not in wanted:
                        continue
                    seen: dict[str, int] = {}
                    for number, (fact, row) in enumerate(found):
                        k = row.pop("_ordinal", None)
                        k = seen.setdefault(fact, 0) if k is None else k
                        seen[fact] = seen.get(fact, 0) + 1
                        place = [row.pop(x, None) for x in ("_line", "_column", "_end")]
                        out.append((relation, file, number, fact, path, k, *place, json.dumps(row, ensure_ascii=True)))
            yield pd.DataFrame(out, columns=["relation", "file_id", "number", "fact_id", "path", "ordinal", "line", "column", "end", "row"]).astype({"line": "Int64", "column": "Int64", "end": "Int64"})

    repository = F.col("repository") if "repository" in files.columns else F.lit(None).cast("string").alias("repository")
    rows_ = latest(files.where("path LIKE '%.py' AND text IS NOT NULL").select("file_id", repository, "path", "text", "ingested_at"), "file_id", F.col("ingested_at").desc_nulls_last(), "text").drop("ingested_at")
    schema = "relation string, file_id long, number long, fact_id string, path string, ordinal long, line long, column long, end long, row string"
    rows = spread(rows_).mapInPandas(extract, schema)
    folder = new_path(files.sparkSession)
    rows.write.partitionBy("relation").parquet(folder)
    read_ = files.sparkSession.read.schema(schema).option("basePath", folder).parquet(folder)

    def relation(name: str) -> DataFrame:
        columns = {c: t for c, t in RELATIONS[name].items() if t}
        typed = F.from_json("row", ", ".join(f"`{c}` {t}" for c, t in columns.items()))
        return read_.where(F.col("relation") == name).select("file_id", "number", "fact_id", "path", "ordinal", F.col("line").alias("_l"), F.col("column").alias("_c"), F.col("end").alias("_e"), typed.alias("r"))

    def facts(name: str) -> DataFrame:
        columns = [F.col(f"r.{c}").alias(c) for c, t in RELATIONS[name].items() if t and c not in ("line", "end")]
        start = F.coalesce("_l", "r.line", F.lit(1)) if "line" in RELATIONS[name] else F.coalesce("_l", F.lit(1))
        end = F.coalesce("_e", "r.end", start) if "end" in RELATIONS[name] else F.coalesce("_e", start)
        return relation(name).select((F.col("file_id") * _FILE_FACTS + F.col("number")).alias("fact_order"), "fact_id", "path", start.cast("long").alias("start_line"), F.coalesce("_c", F.lit(0)).cast("long").alias("start_column"), end.cast("long").alias("end_line"), F.lit(0).cast("long").alias("end_column"), F.lit("python").alias("language"), *columns)

    def child(name: str) -> DataFrame:
        return relation(name).select("fact_id", "path", "ordinal", *(F.col(f"r.{c}").alias(c) for c, t in RELATIONS[name].items() if t))

    first = {"FunctionFact": ("function", {"parameters": "parameter"}), "ClassFact": ("class", {"methods": "method"}), "ModuleFact": ("module", {k: k for k in RELATIONS if k not in _FAMILY and k != "module"})}
    return {family: FactTable(family, {"facts": facts(own), **{name: child(k) for name, k in children.items() if k in wanted}}) for family, (own, children) in first.items() if own in wanted}
