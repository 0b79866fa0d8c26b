"""Comments and string literals of a source text as pieces of text with their first line."""

from __future__ import annotations

import re

from .lexing import lexer

_LEAD = re.compile(r"^[ \t]*(?:/{2,}[!<]?|\#+[:!]?|/\*+!?|\*+(?!/)|--+)?[ \t]?", re.M)
_TAIL = re.compile(r"[ \t]*\**\*/\s*\Z")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{1,3})|\n[ \t]*|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " ", "v": " ", "a": " ", "0": " ", "e": " "}
_OPEN = re.compile(r"([A-Za-z0-9]{0,3})(\#*)(\"\"\"|'''|[\"'`])")


def _plain(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        value = int(code, 16)
    elif m[5]:
        value = int(m[5], 8)
    else:
        return _PLAIN.get(m[6], m[6]) if m[6] else ""
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else f"\x00{value:04x}" if value < 0x110000 else " "


_PAIR = re.compile(r"\x00(d[89ab][0-9a-f]{2})\x00(d[c-f][0-9a-f]{2})")


def unescaped(body: str) -> str:
    """A literal's body with its escapes replaced by their characters (surrogate pairs joined)."""
    if "\\" not in body:
        return body
    body = _ESCAPE.sub(_plain, body)
    if "\x00" in body:
        body = _PAIR.sub(lambda m: chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), body)
    return body


def literal(source: str) -> str:
    """The text of a literal as written, with prefix and quotes; a raw literal keeps its backslashes."""
    source = source.strip()
    m = _OPEN.match(source)
    if not m:
        return unescaped(source)
    prefix, quote = m[1].lower(), m[3]
    body = source[m.end() :]
    end = body.rfind(quote + m[2])
    body = body[:end] if end >= 0 else body
    if "r" in prefix:
        if quote == '"' and "R" in m[1] and (n := re.match(r"([^()\\\s\"]{0,16})\((.*)\)\1\Z", body, re.S)):
            return n[2]
        return body
    return unescaped(body)


def comment(source: str) -> str:
    """The text of a comment without its markers."""
    return _LEAD.sub("", _TAIL.sub("", source)) if source.lstrip()[:2] == "/*" else _LEAD.sub("", source)


def pieces_of(text: str, language: str, scanned=None):
    """(first line, kind, text, bytes) of each piece; kind is 'string' or 'comment'.

    A run of lines that hold only line comments is one piece; a comment after code stands alone. bytes are those of the
    piece as it stands in the text, in UTF-8.
    """
    scanned = list(lexer(language).scan(text)) if scanned is None else scanned
    plain = text.isascii()

    def size(start: int, end: int) -> int:
        return end - start if plain else len(text[start:end].encode("utf-8", "replace"))

    def joined() -> tuple[int, str, str, int]:
        return run[0][0], "comment", "\n".join(comment(text[s:e]) for _, s, e in run), size(run[0][1], run[-1][2])

    line, at = 1, 0
    run: list[tuple[int, int, int]] = []
    for kind, start, end in scanned:
        if kind not in "LBST" and kind != "!":
            continue
        line += text.count("\n", at, start)
        at = start
        if kind == "L":
            begin = text.rfind("\n", 0, start) + 1
            alone = not text[begin:start].strip()
            if alone:
                if run and run[-1][0] == line - 1:
                    run.append((line, start, end))
                    continue
                if run:
                    yield joined()
                run = [(line, start, end)]
                continue
            if run:
                yield joined()
                run = []
            yield line, "comment", comment(text[start:end]), size(start, end)
            continue
        if run:
            yield joined()
            run = []
        if kind in "B!":
            yield line, "comment", comment(text[start:end]), size(start, end)
        else:
            yield line, "string", literal(text[start:end]), size(start, end)
    if run:
        yield joined()
