"""Lexers of five languages: literals and comments of a source text, and the token skeleton that is left of it.

`scan` walks a text once with one pattern per language and yields its literals and comments; nested comments, formatted
strings and templates are followed to any depth. `skeleton` puts one sign for each of them, for every identifier and for
every number, and keeps key words and operators, so that lines of equal shape become equal strings. Whatever no lexical
rule covers (an open literal, a stray byte) becomes a sign that fits no grammar. `fields` gives the expressions inside a
formatted string or template, which are parsed like the rest.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from .glr import Recogniser, build

SUFFIXES = {"py": "python", "ts": "typescript", "js": "javascript", "rs": "rust", "cpp": "cpp"}

_STR = r'"(?:[^"\\\n]|\\(?s:.))*+"'
_CHR = r"'(?:[^'\\\n]|\\(?s:.))*+'"
_BLOCK = r"/\*(?s:.*?)\*/"
#: The alternatives' names: L line comment, B block comment, S string, F formatted string's start, T template, M start of a template with fields,
#: C character, Q slash, D preprocessor line, V lifetime.
_SCAN = {
    "python": r"(?P<L>\#[^\n]*)|(?P<F>(?<!\w)(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|[\"']))|(?P<S>(?:\b(?:[rbuRBU]|[rR][bB]|[bB][rR]))?(?:\"\"\"(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\(?s:.)|'(?!''))*+'''|(?!\"\"\"|''')(?:" + _STR + "|" + _CHR + ")))",
    "javascript": rf"(?P<L>//[^\n]*|\A\#![^\n]*)|(?P<B>{_BLOCK})|(?P<S>{_STR}|{_CHR})|(?P<T>`(?:[^`\\$]|\\(?s:.)|\$(?!\{{))*+`)|(?P<M>`)|(?P<Q>/)",
    "rust": rf"(?P<L>//[^\n]*|\A\#!(?!\[)[^\n]*)|(?P<B>/\*)|(?P<S>\b(?:b|c)?r(?P<H>\#*)\"(?s:.*?)\"(?P=H)|(?:\b[bc])?\"(?:[^\"\\]|\\(?s:.))*+\")|(?P<C>b?'(?:[^'\\\n]|\\(?:u\{{[^}}\n]*\}}|x[0-9a-fA-F]{{2}}|.))')|(?P<V>'[A-Za-z_]\w*)",
    "cpp": rf"(?P<L>//[^\n\\]*(?:\\(?s:.)[^\n\\]*)*)|(?P<B>{_BLOCK})|(?P<S>(?:\b(?:u8|[uUL]))?R\"(?P<H>[^()\\\s\"]{{0,16}})\((?s:.*?)\)(?P=H)\"|(?:\b(?:u8|[uUL]))?{_STR})|(?P<C>(?:\b(?:u8|[uUL]))?(?<![0-9a-fA-F]){_CHR})"
    r"|(?P<D>(?m:^)[ \t]*\#(?:[^\n\\/\"]|\\(?s:.)|/(?![*/])|" + _STR + r"|\"(?=[^\"\n]*$))*)",
}
_SCAN["typescript"] = _SCAN["javascript"]
_KEY = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while _",
    "cpp": "alignas alignof auto bool break case catch char char8_t char16_t char32_t class concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
}
_KEY["typescript"] = _KEY["javascript"]
#: Words that are key words in some places and names in others.
_SOFT = {
    "python": "match case type _",
    "javascript": "let yield of get set async static from as using target",
    "typescript": "let yield of get set async static from as using target type interface namespace module declare abstract readonly public private protected override keyof infer unique satisfies is asserts global out implements",
    "rust": "union default auto box raw macro_rules yield",
    "cpp": "final override",
}
_OPS = {
    "python": "**= //= >>= <<= ... ** // >> << <= >= == != -> += -= *= /= %= &= |= ^= @= := ( ) [ ] { } , : . ; = + - * / % & | ^ ~ < > @",
    "javascript": "... === !== **= <<= &&= ||= ??= => == != <= ++ -- && || ?? ?. ** << += -= *= /= %= &= |= ^= ( ) [ ] { } , : . ; = + - * / % & | ^ ~ < > ? ! @",
    "rust": "..= ... <<= :: -> => == != <= && || .. << += -= *= /= %= ^= &= |= ( ) [ ] { } , : . ; = + - * / % & | ^ ! < > ? @ # $",
    "cpp": "<=> ... <<= ->* .* :: -> == != <= && || << ++ -- += -= *= /= %= &= |= ^= ( ) [ ] { } , : . ; = + - * / % & | ^ ~ < > ? !",
}
_OPS["typescript"] = _OPS["javascript"]
_NUM = {
    "python": r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?=\d[\d_]*[.eEjJ])\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)",
    "javascript": r"(?:0[xX](?:_?[\da-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)",
    "rust": r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?:\d[\d_]*)?)?(?:[eE][+-]?_*\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?",
    "cpp": r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?(?:\d[\d']*)?|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uU](?:[lL]{1,2}|[zZ])?|(?:[lL]{1,2}|[zZ])[uU]?|[fF]\d*|(?:bf16)|_\w+)?",
}
_NUM["typescript"] = _NUM["javascript"]
_NAME = r"(?:[^\W\d]|\$)[\w$]*"
_DIGITS = r"0[xXbBoO]\w*|(?:\d\w*(?:\.\w*)?|\.\d\w*)(?:(?<=[eE])[+-]\d\w*)?"
_WORDS = {
    "python": rf"[^\W\d]\w*|{_DIGITS}",
    "javascript": rf"#(?=[A-Za-z_$])[\w$]*|{_NAME}|{_DIGITS}",
    "rust": r"(?:r#)?[^\W\d]\w*|0[xbo]\w*|\d\w*(?:\.(?![.\w])|\.\d\w*)?(?:(?<=[eE])[+-]\d\w*)?",
    "cpp": r"[^\W\d]\w*|\.?\d[\w']*(?:\.(?![.\w])|\.\d[\w']*)?(?:(?<=[eEpP])[+-]\d\w*)?",
}
_WORDS["typescript"] = _WORDS["javascript"]
#: Signs that stand in a skeleton for a literal of each kind; \x01 stands for a line end within one, \x02 fits no grammar.
_SIGN = {"S": '"', "T": "`", "R": "\x03", "C": "'", "V": "\x04", "L": "", "B": " ", "D": ""}
_TERMINAL = {'"': ("STR",), "`": ("TPL",), "\x03": ("REGEX",), "'": ("CHR",), "\x04": ("LIFE",), "0": ("NUM",), "i": ("NAME",), "\x05": ("PRIVATE",), "\x06": ("BYTES",), "\x07": ("FIELD",), "\n": ("NL",)}
#: While a skeleton is made, signs of literals are kept apart from quotes that stand in the text itself.
_APART = {'"': "\x0e", "`": "\x0f", "'": "\x10"}
_LETTERS = re.compile(r"[A-Za-z]*")
_BLANKS = re.compile(r"(?:\s|#[^\n]*)*")
_STRAY = re.compile(r"[\x01-\x08\x0e-\x1f]")
_NEST = re.compile(r"/\*|\*/")
_BRACKETS = re.compile(r"[()\[\]{}]")
_LAST_WORD = re.compile(r"(\.?)(?<![\w$])([\w$]+)\s*\Z")
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
_TEMPLATE_PART = re.compile(r"[`\\]|\$\{")
#: Key words after which an expression begins, and heads whose closing parenthesis is followed by a statement.
_BEFORE_EXPRESSION = set("return typeof case in of instanceof void delete do else new throw yield await".split())
_HEADS = {"if", "while", "for", "with"}
_FIELD_PART = re.compile(_SCAN["python"] + r"|(?P<X>[\[\](){}:!=])")
_CONVERSION = re.compile(r"![sra]\s*(?=[:}])")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?!\{?[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|U(?![0-9a-fA-F]{8}))")


class Lexer:
    """scan and skeleton of one language."""

    def __init__(self, language: str):
        self.language = language
        self.pattern = re.compile(_SCAN[language])
        self.words = re.compile(_WORDS[language] + "|[\"'`]")
        self.number = re.compile(_NUM[language])
        self.keys = {k: k for k in (_KEY[language] + " " + _SOFT[language]).split()}
        ops = sorted(_OPS[language].split(), key=len, reverse=True)
        self.tokens = re.compile(r"[^\W\d]\w*|[0\"`'\x03-\x07]|" + "|".join(map(re.escape, ops)) + r"|[^\s\x01]")
        soft, ok = set(_SOFT[language].split()), {*_KEY[language].split(), *ops}
        self.table = dict(_TERMINAL) | {k: ("'" + k,) for k in ok} | {k: ("NAME", "'" + k) for k in soft}
        if language == "rust":
            every = {k: (*v, "ANY") for k, v in self.table.items() if k not in "()[]{}"}
            self.table |= every
        self.cache: dict[str, str] = dict(self.keys)
        self.script = language in ("javascript", "typescript")

    def scan(self, text: str):
        """(kind, start, end) of every literal and comment in order; an open block comment has the kind '!'."""
        if self.script:
            return self._scan_script(text)
        return self._scan_python(text) if self.language == "python" else self._scan_rust(text) if self.language == "rust" else self._scan_plain(text)

    def _scan_plain(self, text: str):
        for m in self.pattern.finditer(text):
            kind = "S" if m.lastgroup == "H" else m.lastgroup
            yield (kind, *m.span(kind))

    def _scan_python(self, text: str):
        at = 0
        while m := self.pattern.search(text, at):
            kind, at = m.lastgroup, m.end()
            if kind == "F":
                end = _formatted(text, at, m[0], [])
                if end < 0:
                    continue  # open: its quote fits no grammar
                kind, at = "S", end
            yield kind, m.start(), at

    def _scan_rust(self, text: str):
        at = 0
        while m := self.pattern.search(text, at):
            kind = "S" if m.lastgroup == "H" else m.lastgroup
            at = m.end()
            if kind == "B":
                depth = 1
                while depth:
                    n = _NEST.search(text, at)
                    if n is None:
                        yield "!", m.start(), len(text)
                        return
                    depth += 1 if n[0] == "/*" else -1
                    at = n.end()
            yield kind, m.start(), at

    def _scan_script(self, text: str):
        """Whether a slash begins a pattern depends on what stands before it; brackets are only matched where that asks for it."""
        at = done = 0
        last, literal = -1, False
        gaps: list[tuple[int, str]] = []
        opened: list[int] = []
        opener: dict[int, int] = {}

        def pattern_at(place: int) -> bool:
            nonlocal done
            if literal or last < 0:
                return not literal
            sign = text[last]
            if sign in ")}":
                for base, gap in gaps[done:]:
                    for b in _BRACKETS.finditer(gap):
                        if b[0] in "([{":
                            opened.append(base + b.start())
                        elif opened:
                            opener[base + b.start()] = opened.pop()
                done = len(gaps)
                begin = opener.get(last)
                if begin is None:
                    return False
                word = _LAST_WORD.search(text, max(0, begin - 40), begin)
                if sign == ")":
                    return bool(word) and not word[1] and (word[2] in _HEADS or word[2] == "await")
                before = text[max(0, begin - 200) : begin].rstrip()[-1:]
                return not (before and before in "=(,:[?&|!+-*~^<") and not (word and not word[1] and word[2] in _BEFORE_EXPRESSION - {"do", "else"})
            if sign.isalnum() or sign in "_$":
                word = _LAST_WORD.search(text, max(0, last - 40), last + 1)
                return bool(word) and not word[1] and word[2] in _BEFORE_EXPRESSION
            if sign == "]" or sign in "+-" and text[last - 1 : last] == sign:
                return False
            return not (sign == "!" and last and (text[last - 1].isalnum() or text[last - 1] in "_$)]"))

        while m := self.pattern.search(text, at):
            kind, start, end = m.lastgroup, m.start(), m.end()
            gap = text[at:start]
            if gap.strip():
                gaps.append((at, gap))
                last, literal = at + len(gap.rstrip()) - 1, False
            if kind == "Q":
                p = _PATTERN.match(text, start) if pattern_at(start) else None
                if p is None:
                    gaps.append((start, "/"))
                    last, literal, at = start, False, end
                    continue
                kind, end = "R", p.end()
            elif kind == "M":
                end = self._template(text, end, [])
                if end < 0:
                    at, last = m.end(), start
                    continue
                kind = "T"
            if kind not in "LB":
                last, literal = end - 1, True
            at = end
            yield kind, start, end

    def _template(self, text: str, at: int, fields: list[tuple[int, int]]) -> int:
        """The end of a template whose text begins at a place, or -1; its fields' spans are added to fields."""
        while m := _TEMPLATE_PART.search(text, at):
            at = m.end()
            if m[0] == "`":
                return at
            if m[0] == "\\":
                at += 1
                continue
            begin, depth, code = at, 0, at
            for kind, start, end in (*self._inner(text, at), ("", len(text), len(text))):
                for b in _BRACKETS.finditer(text, code, start):
                    depth += 1 if b[0] in "([{" else -1
                    if depth < 0:
                        break
                if depth < 0:
                    break
                code = end
            if depth >= 0 or b[0] != "}":
                return -1
            fields.append((begin, b.start()))
            at = b.end()
        return -1

    def _inner(self, text: str, at: int):
        """Literals and comments from a place on, for a field; a slash is taken as a pattern where one fits and no value stands before it."""
        while m := self.pattern.search(text, at):
            kind, at = m.lastgroup, m.end()
            if kind == "M":
                kind, at = "T", self._template(text, at, [])
                if at < 0:
                    return
            elif kind == "Q":
                before = text[max(0, m.start() - 40) : m.start()].rstrip()
                word = _LAST_WORD.search(before)
                p = None if before[-1:] and (before[-1] in ")]}\"'`" or word and word[2] not in _BEFORE_EXPRESSION) else _PATTERN.match(text, m.start())
                if p is None:
                    continue
                kind, at = "R", p.end()
            yield kind, m.start(), at

    def fields(self, text: str, start: int, end: int) -> list[tuple[int, int]] | None:
        """Spans of the expressions inside a formatted string or a template; None: it is malformed."""
        found: list[tuple[int, int]] = []
        if self.script:
            return found if text[start] != "`" or self._template(text, start + 1, found) == end else None
        m = self.pattern.match(text, start)
        if m and m.lastgroup == "F":
            _formatted(text, m.end(), m[0], found)
            return None if (-1, -1) in found else found
        return found

    def _word(self, m: re.Match) -> str:
        word = m[0]
        if (known := self.cache.get(word)) is not None:
            return known
        if word[0].isdigit() or word[0] == "." and len(word) > 1:
            made = "0" if self.number.fullmatch(word) else "\x02"
            if made == "\x02" and self.language == "python" and (n := re.fullmatch(r"(.*?)(and|else|for|if|in|is|not|or)", word)) and self.number.fullmatch(n[1]):
                made = "0 " + n[2]
        elif word[0] == "#":
            made = "\x05"
        elif word[0] in "\"'`":
            made = "\x02"
        else:
            made = "i" if word.replace("$", "_").removeprefix("r#").isidentifier() else "\x02"
        if len(self.cache) < 200_000:
            self.cache[word] = made
        return made

    def _sign(self, kind: str, text: str) -> str:
        """The sign of one literal, or the one that fits no grammar where its body is not allowed."""
        if kind == "S" and self.language == "python":
            prefix = _LETTERS.match(text)[0].lower()
            if "r" not in prefix and "\\" in text and "b" not in prefix and _BAD_ESCAPE.search(text):
                return "\x02"
            if "b" in prefix:
                return "\x06" if text.isascii() else "\x02"
        elif kind == "S" and self.script and "\\" in text and _BAD_ESCAPE.search(text):
            return "\x02"
        return _APART.get(_SIGN[kind], _SIGN[kind])

    def skeleton(self, text: str, pieces) -> str:
        if _STRAY.search(text):
            text = _STRAY.sub("\x02", text)
        parts, at = [], 0
        for kind, start, end in pieces:
            parts.append(text[at:start])
            if kind == "!":
                parts.append("\x02")
            else:
                lines = text.count("\n", start, end)
                if lines and kind == "S" and self.language in ("javascript", "typescript", "cpp") and "\\\n" not in text[start:end] and text[start : start + 1] in "\"'":
                    parts.append("\x02")
                sign = self._sign(kind, text[start:end]) if kind in "ST" else _APART.get(_SIGN[kind], _SIGN[kind])
                parts.append(sign + ("\n" + "\x01" * (lines - 1) if lines and kind == "B" else "\x01" * lines))
            at = end
        parts.append(text[at:])
        made = self.words.sub(self._word, "".join(parts))
        for sign, apart in _APART.items():
            made = made.replace(apart, sign)
        return made

    def split(self, unit: str) -> list[tuple[str, ...]]:
        return [self.table.get(t, ("ERROR",)) for t in self.tokens.findall(unit)]


def _formatted(text: str, at: int, opening: str, fields: list[tuple[int, int]]) -> int:
    """The end of a formatted string whose text begins at a place, or -1 if it is open. Spans of its fields are added; (-1, -1): it is malformed."""
    quote = opening.lstrip("fFrR")
    stop = re.compile(r"[\\{}\n]|" + quote)
    raw = "r" in opening.lower()
    while m := stop.search(text, at):
        at = m.end()
        sign = m[0]
        if sign == quote:
            return at
        if sign == "\n":
            if len(quote) == 1:
                return -1
        elif sign == "\\":
            if text[at : at + 1] == "N" and text[at + 1 : at + 2] == "{" and not raw:
                at = text.find("}", at) + 1 or len(text)
            elif text[at : at + 1] not in "{}":
                at += 1
        elif text[at : at + 1] == sign:
            at += 1
        elif sign == "}":
            fields.append((-1, -1))
        else:
            at = _field(text, at, quote, fields)
            if at < 0:
                return -1
    return -1


def _field(text: str, at: int, quote: str, fields: list[tuple[int, int]]) -> int:
    """The place after one field of a formatted string, its format included, or -1."""
    begin, depth, end = at, 0, -1
    while end < 0:
        m = _FIELD_PART.search(text, at)
        if m is None:
            return -1
        kind, at = m.lastgroup, m.end()
        if kind == "F":
            at = _formatted(text, at, m[0], [])
            if at < 0:
                return -1
        if kind != "X":
            continue
        sign = m[0]
        if sign in "([{":
            depth += 1
        elif sign in ")]}":
            if not depth:
                if sign != "}":
                    fields.append((-1, -1))
                end = m.start()
            depth -= 1
        elif depth:
            continue
        elif sign == ":":
            end = m.start()
        elif sign == "!":
            if text[at : at + 1] == "=":
                at += 1
            else:
                end = m.start()
        elif text[at : at + 1] == "=":
            at += 1
        elif text[m.start() - 1] not in "<>!=" and text[(after := _BLANKS.match(text, at).end()) : after + 1] in ("}", ":", "!"):
            end, sign, at = m.start(), text[after], after + 1
    fields.append((begin, end))
    if sign == "!":
        m = _CONVERSION.match(text, at - 1)
        if m is None:
            fields.append((-1, -1))
            at = min((p for p in (text.find("}", at), text.find(":", at)) if p >= 0), default=-1)
            if at < 0:
                return -1
        else:
            at = m.end()
        sign = text[at]
        at += 1
    if sign != ":":
        return at
    while True:
        m = re.compile(r"[{}]|" + quote).search(text, at)
        if m is None or m[0] == quote:
            return -1
        at = m.end()
        if m[0] == "}":
            return at
        if m[0] == "{":
            at = _field(text, at, quote, fields)
            if at < 0:
                return -1


@cache
def lexer(language: str) -> Lexer:
    return Lexer(language)


def tables() -> dict[str, dict]:
    """The parse tables of every language, from the bundled grammars."""
    made = {}
    for language in SUFFIXES.values():
        text = (Path(__file__).parent / "grammars" / f"{'javascript' if language == 'typescript' else language}.g").read_text()
        text = re.sub(r"<ts\s|ts>", " ", text) if language == "typescript" else re.sub(r"<ts\s(?s:.*?)ts>", " ", text)
        made[language] = build(text)
    return made


_LONG = 160
_PIECES = re.compile(r"[^;{}]*(?:[;{}]|$)")


class Parser:
    """Parses whole texts of one language; `error_line` gives the line of the first unrecoverable error, or 0."""

    def __init__(self, language: str, table: dict):
        self.lexer = lexer(language)
        self.language = language
        self.machine = Recogniser(table, self.lexer.split, "';" if self.lexer.script else None, ("'}",))
        self.known: dict[str, bool] = {}

    def error_line(self, text: str, pieces=None) -> int:
        pieces = list(self.lexer.scan(text)) if pieces is None else pieces
        skeleton = self.lexer.skeleton(text, pieces)
        if self.machine.full():
            self.machine.reset()
        python = self.language == "python"
        line = self._python(skeleton) if python else self._braces(skeleton)
        if line or not (python or self.lexer.script):
            return line
        if python and "\0" in text:
            return 1 + text.count("\n", 0, text.index("\0"))
        for kind, start, end in pieces:
            if kind == ("S" if python else "T") and not self._fields(text, start, end):
                return 1 + text.count("\n", 0, start)
        return 0

    def _fields(self, text: str, start: int, end: int) -> bool:
        """Whether every expression inside a formatted string or template parses, to any depth."""
        if self.language == "python":
            if text[start] not in "fF" and text[start + 1 : start + 2] not in ("f", "F") or "{" not in text[start:end] and "}" not in text[start:end]:
                return True
        elif "${" not in text[start:end]:
            return True
        found = self.lexer.fields(text, start, end)
        if found is None:
            return False
        for begin, stop in found:
            part = text[begin:stop]
            ok = self.known.get(part)
            if ok is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                inner = list(self.lexer.scan(part))
                skeleton = "\x07" + re.sub(r"[\s\x01]+", " ", self.lexer.skeleton(part, inner))
                state = 0
                for piece in skeleton.replace(",", ",\n").split("\n"):
                    state = self.machine.unit(state, piece, False) if state >= 0 else -1
                ok = state >= 0 and self.machine.token(state, ("EOF",)) >= 0
                ok = ok and all(self._fields(part, a, b) for k, a, b in inner if k in "ST")
                self.known[part] = ok
            if not ok:
                return False
        return True

    def _braces(self, skeleton: str) -> int:
        machine, state = self.machine, 0
        moves, unit = machine.moves, machine.unit
        for number, line in enumerate(skeleton.split("\n")):
            line = line.strip()
            if not line:
                continue
            if len(line) <= _LONG:
                after = moves.get((state, line, True))
                state = unit(state, line) if after is None else after
            else:
                fresh = True
                for piece in _PIECES.findall(line):
                    if piece:
                        state = unit(state, piece, fresh)
                        fresh = False
                        if state < 0:
                            break
            if state < 0:
                return 1 + skeleton[: self._offset(skeleton, number + 1)].count("\x01") + number
        return 0 if machine.ends(state) else 1 + skeleton.count("\n") + skeleton.count("\x01")

    @staticmethod
    def _offset(skeleton: str, lines: int) -> int:
        return sum(len(x) + 1 for x in skeleton.split("\n")[:lines])

    def _python(self, skeleton: str) -> int:
        machine, state, depth, indents = self.machine, 0, 0, [(0, 0)]
        moves, unit, token = machine.moves, machine.unit, machine.token
        if skeleton.rstrip().endswith("\\"):
            return 1 + skeleton.count("\n") + skeleton.count("\x01")
        skeleton = skeleton.replace("\\\n", "\x01").replace("\f", "")
        for number, line in enumerate(skeleton.split("\n")):
            body = line.strip(" \t\x01\r")
            if not body:
                continue
            if not depth:
                # Columns with tabs to eight places and to one: they must compare alike, or the indentation is inconsistent.
                one = len(line) - len(line.lstrip(" \t"))
                width = len(line[:one].expandtabs(8)) if "\t" in line[:one] else one
                if width > indents[-1][0]:
                    state = token(state, ("INDENT",)) if one > indents[-1][1] else -1
                    indents.append((width, one))
                else:
                    while width < indents[-1][0] and state >= 0:
                        indents.pop()
                        state = token(state, ("DEDENT",))
                    if (width, one) != indents[-1]:
                        state = -1
            if state >= 0:
                if len(body) <= _LONG:
                    after = moves.get((state, body, True))
                    state = unit(state, body) if after is None else after
                else:
                    for piece in body.replace(",", ",\n").split("\n"):
                        state = unit(state, piece) if state >= 0 else -1
            if state >= 0:
                depth += sum(map(body.count, "([{")) - sum(map(body.count, ")]}"))
                if depth <= 0:
                    state = token(state, ("NL",))
            if state < 0:
                return 1 + skeleton[: self._offset(skeleton, number + 1)].count("\x01") + number
        for _ in indents[1:]:
            if state >= 0:
                state = token(state, ("DEDENT",))
        return 0 if state >= 0 and depth <= 0 and machine.ends(state) else 1 + skeleton.count("\n") + skeleton.count("\x01")


def normalised(text: str) -> str:
    """A text without its byte-order mark and with \\n as its only line end."""
    if text.startswith("﻿"):
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
