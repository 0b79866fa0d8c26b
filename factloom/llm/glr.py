"""Table-driven generalised LR recogniser over bundled grammars.

A grammar text becomes SLR(1) tables once, on the driver; conflicts are kept, and the recogniser follows every
alternative at once. Its state is a graph of stacks: readings whose stacks have the same top at the same place share one
node with an edge to every node that lies below it, so all readings stay and their number does not matter. Nodes are
hash-consed, so equal graphs are one state. Because a state is a small number, the move a whole line makes from a state is
remembered: source lines repeat in shape far more often than in text, and a remembered line costs one dictionary lookup.
"""

from __future__ import annotations

import re
from collections import defaultdict

_G = re.compile(r"#[^\n]*|'([^'\n]+)'|([A-Za-z_]\w*)|([:|;()?*+])|\s+")
_MEMO = 150_000


def read_grammar(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Productions of an EBNF text. Quoted or upper-case symbols are terminals; ? * + and groups are expanded."""
    tokens = [("t", m[1]) if m[1] else ("n", m[2]) if m[2] else ("p", m[3]) for m in _G.finditer(text) if m[1] or m[2] or m[3]]
    rules: dict[tuple[str, tuple[str, ...]], None] = {}
    made: dict[tuple, str] = {}
    at = 0

    def helper(kind: str, alternatives: tuple) -> str:
        key = (kind, alternatives)
        if key not in made:
            made[key] = name = f"_{kind}{len(made)}"
            for a in alternatives:
                rules[name, a] = None
                if kind == "many":
                    rules[name, (name, *a)] = None
        return made[key]

    def alternatives() -> list[tuple[str, ...]]:
        nonlocal at
        found = sequence()
        while tokens[at] == ("p", "|"):
            at += 1
            found += sequence()
        return found

    def sequence() -> list[tuple[str, ...]]:
        nonlocal at
        whole: list[tuple[str, ...]] = [()]
        while tokens[at][0] != "p" or tokens[at][1] == "(":
            if tokens[at][1] == "(" and tokens[at][0] == "p":
                at += 1
                part = alternatives()
                at += 1
            else:
                kind, name = tokens[at]
                part = [(("'" + name) if kind == "t" else name,)]
                at += 1
            mark = tokens[at][1] if tokens[at][0] == "p" and tokens[at][1] in "?*+" else ""
            if mark:
                at += 1
            part = list(dict.fromkeys(part))
            if mark in ("*", "+"):
                part = [(helper("many", tuple(a for a in part if a)),)]
            elif len(part) > 1:
                part = [(helper("one", tuple(part)),)]
            if mark in ("?", "*"):
                part = [(), *part]
            whole = [a + b for a in whole for b in part]
        return whole

    while at < len(tokens):
        name = tokens[at][1]
        at += 2
        for a in alternatives():
            rules[name, a] = None
        at += 1
    return list(rules)


def build(text: str, start: str = "file") -> dict:
    """SLR(1) tables: for each state, what each terminal allows (shift target, reductions) and where each nonterminal leads."""
    rules = [("_start", (start, "EOF")), *read_grammar(text)]
    heads: dict[str, list[int]] = defaultdict(list)
    for k, (head, _) in enumerate(rules):
        heads[head].append(k)
    unknown = {s for _, body in rules for s in body if s not in heads and not (s[0] == "'" or s.isupper())}
    if unknown:
        raise ValueError(f"undefined symbols {sorted(unknown)}")
    empty: set[str] = set()
    first: dict[str, set[str]] = defaultdict(set)
    follow: dict[str, set[str]] = defaultdict(set)
    changed = True
    while changed:
        changed = False
        for head, body in rules:
            size, nothing = len(first[head]), head in empty
            for s in body:
                first[head] |= first[s] if s in heads else {s}
                if s not in empty:
                    break
            else:
                empty.add(head)
            changed |= len(first[head]) != size or (head in empty) != nothing
    changed = True
    while changed:
        changed = False
        for head, body in rules:
            after = follow[head]
            for s in reversed(body):
                if s in heads:
                    size = len(follow[s])
                    follow[s] |= after
                    changed |= len(follow[s]) != size
                    after = first[s] | after if s in empty else first[s]
                else:
                    after = {s}
    reach: dict[str, frozenset[int]] = {}
    for head in heads:
        seen, todo = {head}, [head]
        while todo:
            for k in heads[todo.pop()]:
                body = rules[k][1]
                if body and body[0] in heads and body[0] not in seen:
                    seen.add(body[0])
                    todo.append(body[0])
                for a, b in zip(body, body[1:]):
                    if a not in empty:
                        break
                    if b in heads and b not in seen:
                        seen.add(b)
                        todo.append(b)
        reach[head] = frozenset(k for s in seen for k in heads[s])
    states: dict[frozenset, int] = {frozenset({(0, 0)}): 0}
    order = [frozenset({(0, 0)})]
    actions: list[dict[str, tuple[int, tuple]]] = []
    gotos: list[dict[str, int]] = []
    for kernel in order:
        items = set(kernel)
        for k, dot in kernel:
            body = rules[k][1]
            for s in body[dot:]:
                if s in heads:
                    items.update((r, 0) for r in reach[s])
                if s not in empty:
                    break
                break
        moves: dict[str, set] = defaultdict(set)
        reduces: dict[str, list] = defaultdict(list)
        for k, dot in items:
            head, body = rules[k]
            if dot < len(body):
                moves[body[dot]].add((k, dot + 1))
            else:
                for t in follow[head]:
                    reduces[t].append((len(body), head))
        goto, shift = {}, {}
        for s, target in moves.items():
            target = frozenset(target)
            if target not in states:
                states[target] = len(order)
                order.append(target)
            (goto if s in heads else shift)[s] = states[target]
        gotos.append(goto)
        actions.append({t: (shift.get(t, -1), tuple(sorted(set(reduces.get(t, ()))))) for t in {*shift, *reduces}})
    return {"actions": actions, "gotos": gotos, "terminals": sorted({s for _, body in rules for s in body if s not in heads})}


class Recogniser:
    """Feeds units (lines, or pieces of long lines) of a token skeleton to the tables and remembers each move.

    split(unit) gives the unit's tokens, each a tuple of the terminals it may stand for. semi: the terminal that may be
    inserted where a token that begins a line, closes a block or ends the file does not fit, or None.
    """

    def __init__(self, tables: dict, split, semi: str | None = None, closing: tuple[str, ...] = ()):
        self.actions, self.gotos, self.split, self.semi, self.closing = tables["actions"], tables["gotos"], split, semi, closing
        self.reset()

    def reset(self) -> None:
        self.top, self.below, self.nodes = [0], [frozenset()], {(0, frozenset()): 0}
        self.sets, self.ids = [frozenset({0})], {frozenset({0}): 0}
        self.moves: dict[tuple, int] = {}
        self.single: dict[tuple, int] = {}

    def full(self) -> bool:
        return len(self.moves) + len(self.nodes) + len(self.single) > _MEMO

    def node(self, top: int, below: frozenset[int]) -> int:
        made = self.nodes.get((top, below))
        if made is None:
            self.nodes[top, below] = made = len(self.top)
            self.top.append(top)
            self.below.append(below)
        return made

    def shifts(self, state: int, terminal: str) -> list[tuple[int, int]]:
        """(target, node below it) of every shift of the terminal, after all reductions it allows.

        Nodes made by reductions have negative numbers while they may still get edges. A new edge of such a node repeats
        only the reductions that begin with it, unless an edge between two such nodes could hide others.
        """
        actions, gotos, top, below = self.actions, self.gotos, self.top, self.below
        tops: list[int] = []
        edges: list[set[int]] = []
        made: dict[int, int] = {}
        inner = False
        found: dict[tuple[int, int], None] = {}
        todo: list[tuple[int, int | None]] = [(node, None) for node in self.sets[state]]
        while todo:
            node, edge = todo.pop()
            act = actions[top[node] if node >= 0 else tops[~node]].get(terminal)
            if act is None:
                continue
            target, reductions = act
            if target >= 0:
                found[target, node] = None
            for count, head in reductions:
                if count == 0:
                    bases = (node,)
                else:
                    bases = (edge,) if edge is not None else tuple(below[node] if node >= 0 else edges[~node])
                    for _ in range(count - 1):
                        if len(bases) == 1:
                            bases = tuple(below[bases[0]] if bases[0] >= 0 else edges[~bases[0]])
                        else:
                            bases = tuple({b for base in bases for b in (below[base] if base >= 0 else edges[~base])})
                for base in bases:
                    to = gotos[top[base] if base >= 0 else tops[~base]].get(head)
                    if to is None:
                        continue
                    inner |= base < 0
                    known = made.get(to)
                    if known is None:
                        made[to] = known = ~len(tops)
                        tops.append(to)
                        edges.append({base})
                        todo.append((known, None))
                    elif base not in edges[~known]:
                        edges[~known].add(base)
                        if inner:
                            todo += [(n, None) for n in (*self.sets[state], *made.values())]
                        else:
                            todo.append((known, base))
        settled: dict[int, int] = {}

        def settle(node: int) -> int:
            if node >= 0:
                return node
            if node not in settled:
                settled[node] = self.node(tops[~node], frozenset(map(settle, edges[~node])))
            return settled[node]

        return [(target, settle(node)) for target, node in found]

    def token(self, state: int, terminals: tuple[str, ...]) -> int:
        """The state after one token, or -1."""
        key = (state, terminals)
        if (known := self.single.get(key)) is not None:
            return known
        shifted: dict[int, set[int]] = {}
        for terminal in terminals:
            for target, node in self.shifts(state, terminal):
                shifted.setdefault(target, set()).add(node)
        if not shifted:
            after = -1
        else:
            frozen = frozenset(self.node(target, frozenset(under)) for target, under in shifted.items())
            after = self.ids.get(frozen, -1)
            if after < 0:
                self.ids[frozen] = after = len(self.sets)
                self.sets.append(frozen)
        self.single[key] = after
        return after

    def unit(self, state: int, unit: str, fresh: bool = True) -> int:
        """The state after a unit, or -1. fresh: the unit begins a line."""
        key = (state, unit, fresh)
        known = self.moves.get(key)
        if known is not None:
            return known
        now = state
        for terminals in self.split(unit):
            after = self.token(now, terminals)
            if fresh and self.semi and terminals[0] in ("'++", "'--") and (ended := self.token(now, (self.semi,))) >= 0:
                after = self.token(ended, terminals)  # a postfix sign may not begin a line
            if after < 0 and self.semi and (fresh or terminals[0] in self.closing):
                now = self.token(now, (self.semi,))
                after = self.token(now, terminals) if now >= 0 else -1
            fresh = False
            now = after
            if now < 0:
                break
        self.moves[key] = now
        return now

    def ends(self, state: int) -> bool:
        if self.token(state, ("EOF",)) >= 0:
            return True
        if self.semi and (state := self.token(state, (self.semi,))) >= 0:
            return self.token(state, ("EOF",)) >= 0
        return False
