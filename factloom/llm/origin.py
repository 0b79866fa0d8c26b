"""Files that nobody wrote by hand: generated, minified, vendored and data files, with the rule that found each."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np

from .lexing import SUFFIXES, lexer, normalised

#: Phrases of generation notices, in lower case.
NOTICES = [
    "@generated", "code generated by", "file generated by", "autogenerated", "auto-generated", "auto generated", "automatically generated",
    "generated automatically", "produced automatically", "automatically produced", "generated by protoc", "generated by the protocol buffer compiler",
    "generated from", "machine generated", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "produit automatiquement",
    "généré automatiquement", "fichier généré", "generado automáticamente", "generado por", "archivo generado", "producido automáticamente",
    "создан автоматически", "сгенерирован", "автоматически сгенерирован", "自動生成", "自动生成", "自動的に生成",
]
#: Phrases that are a notice wherever they stand; the others must be said of the file itself, or stand beside a warning.
STRONG = {"@generated", "code generated by"}
BACKING = re.compile(r"do not (?:edit|modify)|don't edit|overwritten|will be lost|nicht (?:von hand )?(?:bearbeiten|ändern)|ne pas modifier|no (?:editar|modificar)|не редактировать|編集しないで|请勿", re.I)
#: Directories of outside code and of generated code, suffixes of generated and packed files.
VENDOR_DIRS = {"vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "node_modules", "bower_components", "site-packages"}
GENERATED_DIRS = {"gen", "generated", "stubs", "proto", "autogen", "__generated__"}
GENERATED_NAME = re.compile(r"(?:_pb2|_pb2_grpc|_pb|\.pb|_gen|\.gen|\.g|\.generated|_generated|-generated|\.designer)\.\w+$", re.I)
_PACKED_NAME = re.compile(r"(?:[.-]min|[.-]bundle|\.chunk|\.packed)\.\w+$", re.I)
_LOCK_NAME = re.compile(r"(?:^|/)(?:[\w.-]*[.-]lock(?:\.\w+)?|package-lock\.json|pnpm-lock\.ya?ml|go\.sum|npm-shrinkwrap\.json)$", re.I)
#: Code that belongs to a file's header: imports, attributes and the binding of a logger.
_PREAMBLE = re.compile(r"(?:\s*(?:(?:const|let|var|static) )?_?log(?:ger)?\s*=[^\n]*|\s*(?:import|from|use|pub use|using|package|extern crate|mod|export \* from)\b[^;{(\n]*(?:[{(][^})]*[})][^;\n]*)?(?:;|(?=\n|\Z))|\s*[;]|\s*#!?\[[^\]]*\])*\s*")
_WORD = re.compile(r"(?<!\w)[A-Za-z_]\w*")
_TOKEN = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8
#: A literal is large from this many values or characters on.
LARGE_VALUES, LARGE_CHARACTERS = 50, 400


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in NOTICES:
        a.add_word(phrase, phrase)
    a.make_automaton()
    return a


#: What may stand on a line before a phrase that is said of the file itself.
_SUBJECT = re.compile(
    r"\W*(?:(?:warning|attention|achtung|note|notice|important|hinweis|внимание)\W+)?(?:(?:this|the|diese[rs]?|dies|ce|este|esta|этот)\W+)?"
    r"(?:(?:source |header |python )?(?:file|code|module|script|header|datei|quelltext|fichier|archivo|código|файл|код)\W+)?(?:(?:is|was|has been|wurde|ist|est|a été|es|fue|был|была)\W+)?"
)


def has_notice(comment: str) -> bool:
    low = comment.lower()
    for end, phrase in _automaton().iter(low):
        start = end + 1 - len(phrase)
        if phrase in STRONG or BACKING.search(low):
            return True
        line = low[low.rfind("\n", 0, start) + 1 : start]
        if _SUBJECT.fullmatch(line) or phrase[0] > "\u3000" and len(line.strip(" \t#/*")) <= 12:
            return True
    return False


class Upstream:
    """Shingle index of the outside libraries' files: sorted hash array, the file of each entry, and each file's size."""

    def __init__(self, texts: list[str]):
        self.vocabulary: dict[str, int] = {}
        hashes, files, sizes = [], [], []
        for k, text in enumerate(texts):
            words = _TOKEN.findall(normalised(text or ""))
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
            own = self._hashes(words)
            sizes.append(len(own))
            hashes.append(own)
            files.append(np.full(len(own), k))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.files = np.concatenate(files) if files else np.empty(0, int)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.files, self.sizes = self.hashes[order], self.files[order], np.array(sizes)
        some = self.sizes[self.sizes > 0]
        self.least, self.most = (some.min() * SIMILAR, some.max() / SIMILAR) if len(some) else (1, 0)

    def _hashes(self, words: list[str]) -> np.ndarray:
        n = len(words) - SHINGLE + 1
        if n < 1:
            return np.empty(0, np.uint64)
        ids, other = np.empty(len(words), np.int64), {}
        for k, w in enumerate(words):
            i = self.vocabulary.get(w)
            ids[k] = other.setdefault(w, -1 - len(other)) if i is None else i
        value, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(SHINGLE):
            part = ids[j : j + n]
            known &= part >= 0
            value = (value ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        # A shingle with a word no library uses (numbered within its text) equals none of theirs; it only counts towards the size, once.
        value[~known] |= np.uint64(1 << 63)
        value[known] &= np.uint64((1 << 63) - 1)
        return np.unique(value)

    def best(self, text: str) -> float:
        """The largest Jaccard similarity to any outside file, on distinct shingles of five words; 0 where the sizes alone rule 0.8 out."""
        if not len(self.hashes):
            return 0.0
        words = _TOKEN.findall(text)
        if len(words) < self.least or len(set(words)) == 0:
            return 0.0
        own = self._hashes(words)
        if not self.least <= len(own) <= self.most:
            return 0.0
        low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        if not (high > low).any():
            return 0.0
        found = np.concatenate([self.files[a:b] for a, b in zip(low[high > low], high[high > low])])
        common = np.bincount(found, minlength=len(self.sizes))
        return float((common / (len(own) + self.sizes - common)).max())


def _is_data(code: str, skeleton) -> bool:
    """Nothing but one large literal: a single bound name whose value is a bracketed or quoted literal."""
    words = 0
    for m in _WORD.finditer(code):
        words += 1
        if words > 12:
            return False
    flat = re.sub(r"[\s\x01]+", "", skeleton())
    m = re.fullmatch(r"[^=\"0]*(?:\[0?\])?=(?:[&]?(?:vec!|new\w+)?[\[({](?P<a>[-+0\",:\[\]{}()]*)[\])}]|(?P<b>\"+));?", flat)
    return bool(m) and bool(m["b"] or "0" in m["a"] or '"' in m["a"])


def category(path: str | None, text: str | None, upstream: Upstream) -> tuple[str, str] | None:
    """(category, rule) of a file nobody wrote by hand, or None. Order: vendored, minified, data, generated."""
    if text is None:
        return None
    path = path or ""
    language = SUFFIXES.get(path.rsplit(".", 1)[-1], "javascript")
    text = normalised(text)
    parts = path.split("/")
    if any(p in VENDOR_DIRS for p in parts[:-1]):
        return "vendored", "directory"
    if upstream.best(text) >= SIMILAR:
        return "vendored", "upstream copy"
    lex = lexer(language)
    scanned = list(lex.scan(text))
    at, code = 0, []
    head, foot, before, begun = [], [], "", False
    for kind, start, end in scanned:
        gap = text[at:start]
        code.append(gap)
        before += "" if begun else gap
        if gap.strip() or kind not in "LB":
            foot = []
        if kind in "LB":
            # The header lasts until the first code other than imports.
            begun = begun or not _PREAMBLE.fullmatch(before)
            if not begun:
                head.append(text[start:end])
            foot.append(text[start:end])
        at = end
    code.append(text[at:])
    if code[-1].strip():
        foot = []
    code = " ".join(code)
    rows = [len(x) for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("//", "/*", "*", "#"))]
    if _is_data(code, lambda: lex.skeleton(text, scanned)):
        if len(text) >= LARGE_CHARACTERS or code.count(",") >= LARGE_VALUES:
            return "data", "one literal"
    elif rows:
        mean = sum(x * x for x in rows) / sum(rows)
        blanks = sum(map(code.count, (" ", "\t", "\n"))) / max(1, len(code))
        # A packed file's suffix counts unless the text is set out in lines; without it the text must be packed.
        if _PACKED_NAME.search(path) and (len(rows) <= 3 or mean >= 80):
            return "minified", "suffix"
        if sum(rows) >= 300 and mean >= 300 and blanks < 0.12 and language != "python":
            return "minified", "long dense lines"
    if _LOCK_NAME.search(path):
        return "generated", "lock file"
    if any(map(has_notice, (*head, *foot))):
        return "generated", "notice"
    hints = bool(GENERATED_NAME.search(parts[-1])) + any(p in GENERATED_DIRS for p in parts[:-1])
    if hints and _repetitive(lex.skeleton(text, scanned), hints):
        return "generated", "path and repeated shape"
    return None


def _repetitive(skeleton: str, hints: int) -> bool:
    """Whether a few line shapes make up nearly all of a file, as tools write it."""
    shapes = Counter(re.sub(r"(?:(?:i\.i\(0\)|0)(?:\s*[+,]\s*)?)+", "~", x.strip()) for x in skeleton.split("\n") if x.strip() and not re.match(r"\s*(?:import|from|use|include|export \{)\b", x))
    total = sum(shapes.values())
    return total >= 8 and sum(n for _, n in shapes.most_common(6)) >= (0.9 if hints == 1 else 0.75) * total
