"""Text repairs that need a decision per word, and near-equality of claims.

A sentence is read as a stream of words that know whether a line ended before them. Each
repair is a small step from one stream to the next, so they can be tested and put in
another order one by one; the words are joined again at the end.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

# First parts of compounds that keep their hyphen at a line end.
COMPOUND_HEADS = {"agent", "answer", "cross", "data", "end", "evidence", "group", "human", "long", "machine", "memory", "model", "multi", "page", "reward", "self", "source", "state", "task", "user"}
# Word ends that are no words of their own.
WORD_ENDS = {"able", "al", "ed", "es", "ible", "ing", "ion", "ity", "ive", "ly", "ment", "ness", "ous", "s"}
# Words behind which an extractor glues a symbol, and the symbols.
GLUED = ("and", "dimension", "exceeds", "to", "values", "with")
GLUED_SYMBOL = r"(?:d(?:model|[kv])|[hqr]\d*)"
# Most words and letters of a heading that runs into its sentence; least letters before a cut tail.
HEADING_WORDS, HEADING_LETTERS, TAIL_FROM = 4, 41, 30


class Word(NamedTuple):
    text: str
    new_line: bool


def _stream(text: str) -> list[Word]:
    """The words of a text in order."""
    lines = [line.split() for line in text.split("\n")]
    return [Word(w, k == 0 and n > 0) for n, line in enumerate(lines) for k, w in enumerate(line)]


def _hyphenated(head: str, tail: Word) -> str | None:
    """Two word parts as one word, or None where the hyphen does not cut a word."""
    stem = re.search(r"[A-Za-z]+(?:-[A-Za-z]+)*-$", head)
    rest = re.match(r"[A-Za-z]+", tail.text)
    if not stem or not rest:
        return None
    part = stem[0][:-1]
    if tail.new_line:
        compound = "-" in part or part.lower() in COMPOUND_HEADS
        whole_word = rest[0].lower() not in WORD_ENDS and not rest[0].isupper()
        return head + tail.text if compound and whole_word else head[:-1] + tail.text
    if part.islower() and "-" not in part and rest[0].islower():
        return head[:-1] + tail.text
    return None


def _join_hyphens(words: Iterable[Word]) -> Iterator[Word]:
    held: Word | None = None
    for w in words:
        if held is not None and (one := _hyphenated(held.text, w)):
            held = Word(one, held.new_line)
            continue
        if held is not None:
            yield held
        held = w
    if held is not None:
        yield held


def _join_drop_cap(words: list[Word]) -> list[Word]:
    """A large first letter stands apart from the one or two letters that end its word."""
    if len(words) > 1 and re.fullmatch("[A-Z]", words[0].text) and re.match(r"[a-z]{1,2}\b", words[1].text):
        return [Word(words[0].text + words[1].text, False), *words[2:]]
    return words


_SEAMS = re.compile(
    rf"(?<![A-Za-z0-9_])(?:{'|'.join(GLUED)})(?={GLUED_SYMBOL}\b)"  # a symbol glued to a word
    r"|[.!?](?=[A-Z])"  # a sentence glued to the one before
    r"|[A-Z](?=(?:and|or|with)\b)",  # a conjunction glued to a symbol
    re.IGNORECASE,
)


def _part_glued(words: Iterable[Word]) -> Iterator[Word]:
    for w in words:
        at = 0
        for m in _SEAMS.finditer(w.text):
            follows = w.text[m.end() :][:1]
            # case counts for sentences and symbols
            if m[0] in ".!?" and not follows.isupper() or len(m[0]) == 1 and m[0].islower():
                continue
            yield Word(w.text[at : m.end()], w.new_line and at == 0)
            at = m.end()
        yield Word(w.text[at:], w.new_line and at == 0)


def _without_heading(words: list[Word]) -> list[Word]:
    """A short heading that ends in a full stop and runs into its sentence is left out."""
    end = next((k for k, w in enumerate(words[:HEADING_WORDS]) if "." in w.text), None)
    if end is None or end + 1 >= len(words):
        return words
    head = " ".join(w.text for w in words[: end + 1])
    short = head.index(".") == len(head) - 1 <= HEADING_LETTERS
    capitals = all("A" <= w.text[0] <= "Z" for w in (words[0], words[end + 1]))
    return words[end + 1 :] if short and capitals else words


def _without_tail(words: list[Word]) -> list[Word]:
    """What goes on in lower case behind a full stop belongs to another place of the page."""
    length = 0
    for k, w in enumerate(words[:-1]):
        length += len(w.text) + (k > 0)
        if w.text.endswith(".") and re.match("[a-z]", words[k + 1].text):
            return words[: k + 1] if length - 1 >= TAIL_FROM else words
    return words


def claim_summary(text: str) -> str:
    """A sentence of a paper in readable form, its meaning unchanged.

    An empty or blank text gives an empty one; long texts are read whole.
    """
    words = _join_drop_cap(list(_join_hyphens(_stream(text))))
    words = _without_tail(_without_heading([w for w in _part_glued(words) if w.text]))
    out: list[str] = []
    for w in words:
        marks = len(w.text) - len(w.text.lstrip(",.;:!?"))
        if marks and out:
            out[-1] += w.text[:marks]
            if w.text[marks:]:
                out[-1] += w.text[marks:]
            continue
        out.append(w.text)
    return " ".join(out)


_MARK = "[.!?。！？]"
# A mark ends a sentence before a capital or figure, an ideographic one anywhere, any at the end of the text.
_END = r"(?:[.!?][\"'”’\]]?(?=\s+[\"'“‘\[(]?[A-Z0-9])|[。！？][”’》】]?+(?!\s*\Z)|[.!?。！？](?=\s*\Z)|\.[\"”'](?=\s*\Z))"
# One unit: letters and marks that end nothing, then the end; possessive, so that each letter is read once.
_SENTENCE = re.compile(rf"(?=\S)(?:[^.!?。！？]|(?!{_END}){_MARK})*+(?:(?P<end>{_END})|\Z)", re.DOTALL)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of complete sentences, without outer white space; a tail without final mark is none."""
    return [m.span() for m in _SENTENCE.finditer(text) if m["end"]]


class Kept:
    """Claims kept so far, in the order of their lengths, so that a new one meets only those of about its length."""

    # Least length and share for containment, least length and ratio for likeness.
    CONTAINED, CONTAINED_SHARE, LIKE, LIKE_RATIO = 60, 0.9, 80, 0.96

    def __init__(self, fingerprints: Iterable[str] = ()):
        self.known: set[str] = set()
        self.by_length: list[tuple[int, str]] = []
        for f in fingerprints:
            self.add(f)

    def add(self, fingerprint: str) -> None:
        if fingerprint not in self.known:
            self.known.add(fingerprint)
            insort(self.by_length, (len(fingerprint), fingerprint))

    def _rivals(self, n: int) -> list[str]:
        """Claims whose lengths let them contain the other or be alike to it."""
        lo = bisect_left(self.by_length, (int(n * self.CONTAINED_SHARE), ""))
        hi = bisect_right(self.by_length, (int(n / self.CONTAINED_SHARE) + 1, "\U0010ffff"))
        return [f for _, f in self.by_length[lo:hi]]

    def _contains(self, a: str, b: str) -> bool:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        return len(small) >= max(self.CONTAINED, self.CONTAINED_SHARE * len(large)) and small in large

    def _alike(self, a: str, b: str) -> bool:
        if min(len(a), len(b)) < self.LIKE:
            return False
        m = difflib.SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= self.LIKE_RATIO and m.quick_ratio() >= self.LIKE_RATIO and m.ratio() >= self.LIKE_RATIO

    def holds(self, fingerprint: str) -> bool:
        """Whether a claim is one of the kept ones, or nearly so."""
        if fingerprint in self.known:
            return True
        return any(self._contains(fingerprint, k) or self._alike(fingerprint, k) for k in self._rivals(len(fingerprint)))
