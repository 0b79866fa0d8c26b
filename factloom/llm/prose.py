"""Whether a comment or literal holds prose, and in which of seven languages.

What is no prose by its form (directives, licence ids, addresses, queries, code, patterns, keys) is set aside line by
line. The script settles Russian, Japanese and Chinese. The languages in Latin script are told apart by a character
trigram model with Witten-Bell smoothing, trained on labelled documents (see `train`); a text whose words are no likelier
under any language's model than letters drawn evenly is no prose either.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

LANGUAGES = ("en", "de", "fr", "es", "ru", "ja", "zh")
LEAST_WORDS, LEAST_CHARACTERS = 4, 10
#: Frequent function words of the languages in Latin script.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been not no it its this that these those for with on at by from as if when which who what where how than then so but can cannot could will would should must may might do does did has have had we our you your they their there here only every each all any some most more never always once after before until since while because without into out over under about otherwise either neither both instead still also just let make keep see use used please",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht kein keine keinen ist sind war waren wird werden wurde wurden kann können darf dürfen muss müssen soll sollen hat haben hatte es sie er wir ihr ich man sich auf aus bei bis durch für gegen mit nach ohne seit um unter vom von vor zu zum zur über wenn weil dass damit sonst noch nur auch schon immer nie hier dort dieser diese dieses jede jeder jedem jeden aller alle wie was wo wer als aber bitte siehe im am",
    "fr": "le la les un une des du de et ou ne pas plus jamais est sont était sera être a ont avait il elle ils elles on nous vous je ce cet cette ces son sa ses leur au aux dans par pour sur sous avec sans chez vers entre depuis avant après pendant si car que qui quoi dont où quand comme mais donc sinon chaque tout toute tous toujours encore déjà aussi seulement ici voir peut doit fait même afin lorsque parce d l s n qu",
    "es": "el la los las un una unos unas y o no ni es son era fue ser está están estaba ha han había hay que se lo le les su sus este esta estos estas ese esa del al de en con sin por para sobre entre desde hasta tras ante según si cuando como donde quien cual porque pero sino aunque cada todo toda todos siempre nunca también solo sólo aún todavía ya más muy aquí puede debe vez usa después antes mientras hace",
}
#: They are counted once in every model, so that a language without labelled documents still has one.
_SEEDS = {k: v.split() for k, v in FUNCTION_WORDS.items()}
_FUNCTION = {w for words in _SEEDS.values() for w in words}
#: Probability of a letter or word end drawn evenly, and the part of letters every model leaves to that.
_EVEN, _STRAY = 1 / 30, 0.2
_LOG_EVEN = math.log(_EVEN)
_KANA, _HAN, _CYRILLIC = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾝ]"), re.compile(r"[㐀-鿿豈-﫿]"), re.compile(r"[Ѐ-ӿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ々〆]")
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
#: Lines that are never prose: directives, licence ids, addresses, paths, keys, queries, patterns.
_SKIP = re.compile(
    r"""^\W*(?:
      (?:eslint|istanbul|prettier|tslint|jshint|jslint|clang-(?:format|tidy)|noqa|nosec|nolint|pylint|pyright|mypy|flake8|isort|yapf|ruff|fmt|type|region|endregion|pragma|rustfmt|coverage|c8|v8|webpack|sourceMappingURL|\@ts-\w+|global|exported|cspell|spell-checker|NOLINT\w*|IWYU|codespell|black)\b\s*(?:[:=-]|\s(?:ignore|off|on|disable|enable|next|skip|start|end|no)\b).*
    | (?:SPDX-|vendored-at\b|Licen[sc]e-?(?:Identifier|Ref)\b).*
    | (?:\#\s*)?(?:sourceMappingURL|sourceURL)=.*
    | \#!\s?/\S+.* | -\*-.*-\*- | vim?:.*
    | \w+://\S+ | (?:[\w.~%*$@{}<>-]+)?(?:[/\\][\w.~%*$@{}<>-]+)+
    | --?\w[\w-]*(?:[= ]\S+)?
    )\W*$""",
    re.X,
)
_SQL = re.compile(r"^\s*(?:WITH\b.+\bSELECT|SELECT\b.+\bFROM|INSERT\s+INTO|UPDATE\b.+\bSET|DELETE\s+FROM|CREATE\s+(?:TABLE|INDEX|VIEW)|ALTER\s+TABLE|DROP\s+TABLE|MERGE\s+INTO)\b", re.S)
_IDENTIFIER = re.compile(r"\b(?:[A-Za-z]\w*_\w+|[a-z]+[A-Z]\w*|[A-Za-z_]\w*\.[a-z_]\w*\.?[\w.]*)\b")
_CODE = re.compile(r"[;{}]\s*$|\b\w+\([^()\s]*(?:,\s*[^()\s]+)*\)|(?<![<>=!])=(?!=)\s*\S|[=!<>]=|&&|\|\||->|=>|::|\+\+|\+=|-=|\w\[[^\]\s]*\]|^\s*(?:def|fn|func|function|class|import|return|const|let|var|pub|public|private|struct|for|while|if|else|elif|switch|case|try|catch|using|namespace|use|from)\b.*[:;({]|:\s*return\b")
_STATEMENT = re.compile(r"^\s*(?:if|for|while|elif|else|try|except|with|case)\b[^.!?]*:\s*(?:return|break|continue|pass|raise|yield)\b")
_TAG = re.compile(r"^\W*[A-Z]{3,}(?:\([^()]*\))?:")
_PLACE = re.compile(r"\$?\{[^{}]*\}|%[sdifr]\b|</?\w+[^<>]*>|`[^`]*`|\w+://\S+")


def maybe(text: str) -> bool:
    """A quick test: at least four parts between blanks, as the words of prose stand, or a Chinese or Japanese sign."""
    return len(text.split(None, 3)) > 3 or (not text.isascii() and _CJK.search(text) is not None)


def _plain(line: str) -> bool:
    if _SKIP.match(line) or _SQL.match(line):
        return False
    line = _TAG.sub("", _PLACE.sub(" ", line))
    if _STATEMENT.match(line):
        return False
    if _CODE.search(line):
        rest = _WORD.findall(_IDENTIFIER.sub(" ", line))
        hits = sum(w.lower() in _FUNCTION for w in rest)
        return len(rest) >= 4 and hits >= 2 and not re.search(r"[A-Za-z0-9]_[A-Za-z0-9]|[a-z][A-Z]|[{}]\s*$", line)
    return True


class Model:
    """Models of words and of their character trigrams, one for each language in Latin script; a word is scored once."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(_SEEDS)
        words = [Counter([*_SEEDS[k], *(w for t in texts.get(k, ()) for w in words_of(t))]) for k in self.languages]
        self.words = [{w: n / sum(c.values()) for w, n in c.items()} for c in words]
        self.tables = [self._counted(c) for c in words]
        self.cache: dict[str, tuple[float, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    @staticmethod
    def _counted(words: Counter) -> tuple[dict, dict, dict]:
        three, two, one = Counter(), Counter(), Counter()
        for word, n in words.items():
            padded = f"  {word} "
            n = n.bit_length()  # a frequent word tells little more about the language's letters than a rare one
            for k in range(2, len(padded)):
                three[padded[k - 2 : k + 1]] += n
                two[padded[k - 1 : k + 1]] += n
                one[padded[k]] += n

        def after(grams: Counter) -> dict[str, tuple[int, int]]:
            sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for gram, n in grams.items():
                sums[gram[:-1]][0] += n
                sums[gram[:-1]][1] += 1
            return {k: tuple(v) for k, v in sums.items()}

        total = sum(one.values())
        first = {c: (n + 1) / (total + 200) for c, n in one.items()}
        rest = 1 / (total + 200)
        twos, threes = after(two), after(three)
        second = {g: (n + twos[g[:-1]][1] * first[g[-1]]) / sum(twos[g[:-1]]) for g, n in two.items()}
        third = {g: (n + threes[g[:-1]][1] * second[g[1:]]) / sum(threes[g[:-1]]) for g, n in three.items()}
        # What a shorter context leaves for a longer one: its types' share.
        return third, {"two": second, "one": first, "rest": rest}, {"three": {k: t / (n + t) for k, (n, t) in threes.items()}, "two": {k: t / (n + t) for k, (n, t) in twos.items()}}

    def _word(self, word: str) -> tuple[float, ...]:
        padded = f"  {word} "
        out = []
        for known, (third, lower, left) in zip(self.words, self.tables):
            score = 0.0
            for k in range(2, len(padded)):
                gram = padded[k - 2 : k + 1]
                p = third.get(gram)
                if p is None:
                    q = lower["two"].get(gram[1:])
                    if q is None:
                        q = left["two"].get(gram[1], 1.0) * lower["one"].get(gram[2], lower["rest"])
                    p = left["three"].get(gram[:2], 1.0) * q
                score += math.log((1 - _STRAY) * p + _STRAY * _EVEN) - _LOG_EVEN
            # Half of a word's probability is that of its letters, half its own frequency.
            own = math.log(known[word]) - _LOG_EVEN * (len(word) + 1) if word in known else -math.inf
            most = max(own, score)
            out.append(most + math.log(0.5 * (math.exp(own - most) + math.exp(score - most))))
        return tuple(out)

    def scores(self, words: list[str]) -> list[float]:
        """For each language how much likelier than evenly drawn letters the words are."""
        cache, total = self.cache, [0.0] * len(self.languages)
        for w in words:
            found = cache.get(w)
            if found is None:
                found = self._word(w)
                if len(cache) < 200_000:
                    cache[w] = found
            total = [a + b for a, b in zip(total, found)]
        return total

    def best(self, words: list[str]) -> str | None:
        total = self.scores(words)
        most = max(total)
        return self.languages[total.index(most)] if most > 0 else None


def words_of(text: str) -> list[str]:
    return [p for w in _WORD.findall(text.lower()) for p in re.split(r"[’'-]", w) if p]


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of labelled texts. Labels may be wrong at times: texts the first model gives another label are left out of the second."""
    texts: dict[str, list[str]] = defaultdict(list)
    for label, text in rows:
        if label in _SEEDS:
            texts[label].append("\n".join(x for x in text.split("\n") if x.strip() and _plain(x)))
    first = Model(texts)
    return Model({k: [t for t in ts if first.best(words_of(t)) == k] for k, ts in texts.items()})


_DEFAULT: list[Model] = []


def language_of(text: str, model: Model | None = None) -> str | None:
    """The language of a piece that is prose of at least four words (ten characters in Chinese or Japanese), or None."""
    if _SQL.match(text):
        return None
    lines = [x for x in text.split("\n") if x.strip() and _plain(x)]
    if not lines:
        return None
    body = _PLACE.sub(" ", "\n".join(lines))
    signs = _CJK.findall(body)
    if len(signs) >= LEAST_CHARACTERS and 3 * len(signs) > sum(map(str.isalpha, body)):
        kana = len(_KANA.findall(body))
        return "ja" if kana and 12 * kana >= len(signs) else "zh"
    words = _WORD.findall(body)
    if len(words) < LEAST_WORDS:
        return None
    if 2 * len(_CYRILLIC.findall(body)) > sum(map(len, words)):
        return "ru"
    if len(signs) >= LEAST_CHARACTERS:
        return "ja" if _KANA.search(body) else "zh"
    if sum(w.islower() or w.istitle() for w in words) < 0.5 * len(words):
        return None
    if model is None:
        if not _DEFAULT:
            _DEFAULT.append(Model({}))
        model = _DEFAULT[0]
    return model.best(words_of(body))
