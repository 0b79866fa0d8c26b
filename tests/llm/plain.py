"""Plain versions of the operators in `llm`, to test them against."""

import re


def shared_tokens(rows, least: int = 40) -> dict:
    """rows: (stream, number, token). Tokens of each stream in a run of `least` that another stream has."""
    streams: dict = {}
    for stream, number, token in rows:
        streams.setdefault(stream, {}).setdefault(number, token)
    where: dict = {}
    for stream, tokens in streams.items():
        for start in tokens:
            if all(start + k in tokens for k in range(least)):
                where.setdefault(tuple(tokens[start + k] for k in range(least)), []).append((stream, start))
    covered: dict = {}
    for places in where.values():
        if len({s for s, _ in places}) > 1:
            for stream, start in places:
                covered.setdefault(stream, set()).update(range(start, start + least))
    return {s: len(c) for s, c in covered.items()}


def leaked(documents, items, least: int = 12) -> set:
    def words(text):
        return [w.casefold() for w in re.findall(r"[^\W_]+", text)]

    runs: dict = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(item)
    out = set()
    for doc, text in documents:
        w = words(text)
        for k in range(len(w) - least + 1):
            out.update((doc, item) for item in runs.get(tuple(w[k : k + least]), ()))
    return out


def repeated_words(text: str, run: int = 8) -> tuple[int, int]:
    words = [w.casefold() for w in re.findall(r"[^\W\d_]+", text)]
    places: dict = {}
    for k in range(len(words) - run + 1):
        places.setdefault(tuple(words[k : k + run]), []).append(k)
    marked = {j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + run)}
    return len(words), len(marked)
