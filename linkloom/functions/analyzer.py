"""Tokens, keys, sentences and phrases of one text: small helpers for Arrow batches.

A word's key is its folded stem, or its folded self where it is a stop word or its language has no stemmer. Texts are
lowered first. Addresses and e-mails are no words; any sign that isn't part of a word breaks a run of words.
"""

from __future__ import annotations

from functools import lru_cache

import regex

from .lexicon import MEASURES, STOP
from .stemming import STEMMERS
from .text import ACCENTED, BREAK, FOLDED, MASK, WORD

_WORD, _BREAK, _MASK = regex.compile(WORD), regex.compile(BREAK), regex.compile(MASK)
_FOLD = str.maketrans(ACCENTED, FOLDED)
_NUMBER = regex.compile(r"[\p{N}.,]+")
_STOPS = {lang: frozenset(w.translate(_FOLD) for w in words.split()) for lang, words in STOP.items()}
_MEASURES = frozenset(w.translate(_FOLD) for w in MEASURES.split())
#: Abbreviations that a full stop doesn't end a sentence after.
ABBREVIATIONS = frozenset("dr dra sr sra srta prof ing lic mr mrs ms st vs etc approx fig no nº pág págs p pp ed vol cap art av ee.uu e.g i.e p.ej bzw z.b ca usw mme mlle".split())
HEADING_WORDS = 6


class Token:
    __slots__ = ("surface", "key", "stop", "content", "start", "end")

    def __init__(self, surface: str, start: int, end: int, key: str, stop: bool, content: bool):
        self.surface, self.start, self.end, self.key, self.stop, self.content = surface, start, end, key, stop, content


def _folded(word: str) -> str:
    return word if word.isascii() else word.translate(_FOLD)


def fold(word: str) -> str:
    return word.lower().translate(_FOLD)


@lru_cache(maxsize=200_000)
def known(word: str, lang: str | None, stemmed: bool) -> tuple[str, bool, bool]:
    """Key, whether it is a stop word, and whether it is a content word, of a word in lower case."""
    plain = _folded(word)
    stop = plain in _STOPS.get(lang, ())
    content = not stop and plain not in _MEASURES and (plain[:1].isalpha() or not _NUMBER.fullmatch(plain))
    key = _folded(STEMMERS[lang](word)) if stemmed and not stop and lang in STEMMERS else plain
    return key, stop, content


def masked(text: str) -> str:
    """Addresses become as many signs, so that places stay."""
    if "@" not in text and "://" not in text and "www." not in text.lower():
        return text
    return _MASK.sub(lambda m: "|" * len(m.group()), text)


def segments(line: str) -> list[list[str]]:
    """The words of a lowered line in runs that no sign interrupts. Spaces part pieces, most of which are a word, or one with a sign behind."""
    out: list[list[str]] = []
    run: list[str] = []
    for piece in line.split(" "):
        if piece.isalnum():
            run.append(piece)
        elif piece and piece[-1] in ",.;:!?" and piece[:-1].isalnum():
            run.append(piece[:-1])
            out.append(run)
            run = []
        elif piece:
            for i, part in enumerate(_BREAK.split(piece)):
                if i and run:
                    out.append(run)
                    run = []
                run += _WORD.findall(part)
    if run:
        out.append(run)
    return out


def runs(text: str, lang: str | None, stemmed: bool) -> list[list[Token]]:
    """The runs of words that no sign interrupts."""
    out, at = [], 0
    low = masked(text).lower()
    low = low if len(low) == len(text) else masked(text)  # lowering that moves places is left out
    for gap in [*_BREAK.finditer(low), None]:
        end = gap.start() if gap else len(low)
        run = [Token(text[m.start() : m.end()], m.start(), m.end(), *known(m.group(), lang, stemmed)) for m in _WORD.finditer(low, at, end)]
        if run:
            out.append(run)
        at = gap.end() if gap else end
    return out


def fields(text: str) -> list[list[list[str]]]:
    """The runs of the title (the first line), of headings (other lines of up to HEADING_WORDS words) and of the body."""
    out: list[list[list[str]]] = [[], [], []]
    for i, line in enumerate(masked(text.lower()).split("\n")):
        found = segments(line)
        out[0 if i == 0 else 1 if sum(map(len, found)) <= HEADING_WORDS else 2] += found
    return out


def terms(text: str, lang: str | None, stemmed: bool, most: int = 3) -> tuple[dict[str, list[int]], int]:
    """term -> [words, count in title, in headings, in body, order of first appearance], and the number of words that are no stop words.

    A term is a run of one to `most` words with no stop word at either end and one content word at least.
    """
    found: dict[str, list[int]] = {}
    length = place = 0
    for field, held in enumerate(fields(text)):
        for run in held:
            info = [known(w, lang, stemmed) for w in run]
            size = len(info)
            for i, (term, stop, some) in enumerate(info):
                if stop:
                    continue
                length += 1
                for n in range(1, min(most, size - i) + 1):
                    if n > 1:
                        key, ends, content = info[i + n - 1]
                        term = f"{term} {key}"
                        some = some or content
                    else:
                        ends = False
                    if some and not ends:
                        row = found.get(term)
                        if row is None:
                            row = found[term] = [n, 0, 0, 0, place]
                        row[1 + field] += 1
                    place += 1
    return found, length


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, last paragraph) of sentences: they end at line breaks, and at . ! ? … with closing signs before a space.

    Not after an abbreviation, an initial or a number of a list, nor before a small letter. Pieces without a letter or digit are left out.
    """
    out, lines, at = [], text.split("\n"), 0
    for line in lines:
        start = 0
        for m in regex.finditer(r"[.!?…]+[\"'»”’)\]]*(?=\s|$)", line):
            word = regex.search(r"(\S+)$", line[start : m.start()])
            before = word.group(1).lower().lstrip("(«\"'¿¡") if word else ""
            after = line[m.end() :].lstrip()[:1]
            if m.group()[0] == "." and (before in ABBREVIATIONS or len(before) == 1 and before.isalpha() or before.isdigit() and start + word.start() == start) or after.islower():
                continue
            out.append((at + start, at + m.end(), at))
            start = m.end()
        out.append((at + start, at + len(line), at))
        at += len(line) + 1
    out = [(a, b, p) for a, b, p in out if regex.search(r"[\p{L}\p{N}]", text[a:b])]
    final = out[-1][2] if out else 0
    return [(a, b, p == final) for a, b, p in out]
