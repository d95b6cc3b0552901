"""Sentence boundaries across languages and scripts by a hidden-event language model.

The words of a text are seen as a stream in which boundary tokens are hidden. A gap can
hold a boundary behind a final mark with its closing quotes, brackets and citation marker,
in scripts that write no final marks at any blank, and in texts without any final mark
between all words or ideographs. An n-gram model over words and
boundary tokens gives the chance of a boundary after its left words, of the right words
after a boundary, and of the right words without one; words back off to classes (shape,
mark, how the closing quote was opened). The model is trained without labels on the whole
corpus: expectation-maximisation over the counted windows around all gaps, anchored by
the beginnings of the texts. The forward-backward algorithm then gives each gap its
posterior chance of a boundary, neighbouring gaps being decided together.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm.lookalike import mappings
from scholiast.runtime import materialize, parallel, spread, table

# Final marks that need no blank behind them, and those that do.
TIGHT_MARKS = "。！？．｡।॥"
MARKS = ".!?…؟۔‽⁇⁈⁉" + TIGHT_MARKS
OPENERS = "“‘«„‚(（[「『【〈《"
CLOSERS = "”’»“‘)）]」』】〉》"
PAIRS = {"“": "”", "‘": "’", "«": "»", "„": "“”", "‚": "‘’", "(": ")）", "（": ")）", "[": "]", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》"}
# Scripts written without final marks.
BARE = "฀-๿຀-໿က-႟ក-៿"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_CITE = r"(?:\[\d+(?:\s*[,;–-]\s*\d+)*\])"
_HIDDEN = "­​-‏⁠﻿"
_CLOSE = re.escape("”’»\"'“‘)）]」』】〉》")
_FINAL = re.compile(rf"[{re.escape(MARKS)}][{re.escape(MARKS)}{_HIDDEN}]*[{_CLOSE}{_HIDDEN}]*{_CITE}?[{_CLOSE}{_HIDDEN}]*$")
_TIGHT = re.compile(rf"(?:[{TIGHT_MARKS}]|(?<=[{CJK}])[….!?]|[….!?](?=[{CJK}“「『（]))[{re.escape(MARKS)}{_HIDDEN}]*[{_CLOSE}{_HIDDEN}]*{_CITE}?")
_SPACED_CLOSER = re.compile(r"^»[.!?…]*$")
_UNIT = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+(?:[.,·/:]\d+)*")
_BARE = re.compile(f"[{BARE}]")
_CJKS = re.compile(f"[{CJK}]")
_MIXED = re.compile(f"[{CJK}]{{1,2}}|[^{CJK}]+")
_BRACKETS = re.compile(f"[{re.escape(''.join(PAIRS))}{re.escape(''.join(PAIRS.values()))}\"]")
_TWINS = str.maketrans({**mappings()[0], **dict.fromkeys(map(chr, (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)), "")})
START = "^"
# Frequent small words that tell languages of one script apart.
SMALL_WORDS = {
    "en": "the of and in is to for a was on with by that this are as not from at it we",
    "de": "der die das und in den von zu mit ist im für auf eine ein nicht über bei aus dem wir",
    "fr": "le la les de des du et en un une est pour par dans sur que au il vont à l'",
    "es": "el la los las de del y en un una es para por con que se al lo según su",
    "it": "il lo gli le di del e in un una è per con che si al da",
    "pt": "o os as de do da e em um uma é para por com que se ao no na",
    "nl": "de het een van en in is op voor met dat niet te aan zijn",
}
_TONGUES = {g: frozenset(w.split()) for g, w in SMALL_WORDS.items()}
_SCRIPTS = (("ja", re.compile("[\u3040-\u30ff]")), ("zh", re.compile("[\u3400-\u9fff]")), ("ru", re.compile("[\u0410-\u044f]{3}")), ("th", _BARE), ("hi", re.compile("[\u0900-\u097f]")), ("ar", re.compile("[\u0600-\u06ff]")), ("ko", re.compile("[\uac00-\ud7a3]")))


def tongue(text: str) -> str:
    """The language group of a stretch of text: by script, and by small words within the Latin one."""
    for g, script in _SCRIPTS:
        if script.search(text):
            return g
    words = re.findall(r"[^\W\d_]+", text.lower())
    best = max(_TONGUES, key=lambda g: sum(w in _TONGUES[g] for w in words))
    return best if any(w in _TONGUES[best] for w in words) else "la"


def normal(unit: str) -> str:
    """A unit with look-alikes mapped, invisible characters dropped and numbers masked."""
    return _DIGITS.sub("0", unit.translate(_TWINS))


def shape(word: str) -> str:
    """The class of a word: script, case, length, leading mark."""
    lead = word[0] if word and not word[0].isalnum() else ""
    core = word.lstrip("“‘«„‚(（[「『¿¡\"'–—*•-")
    if not core:
        return ("O" if lead in OPENERS or lead in "¿¡" else "P") + word[:2]
    if _CJKS.match(core):
        return lead + "C"
    if _BARE.match(core):
        return lead + "T"
    letters = [c for c in core if c.isalpha()]
    if not letters:
        return lead + ("0" if "0" in core else "P" + core[:1])
    head = core[0]
    kind = "0" if head == "0" else "X" if len(letters) > 1 and all(c.isupper() for c in letters) else "W" if head.isupper() else "w" if head.islower() else "n"
    size = "1" if len(letters) == 1 else "3" if len(letters) <= 3 else "9"
    inner = "." if "." in core.rstrip(".…!?")[1:] else ""
    return lead + kind + size + inner


def enclosed(text: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Spans (open, close) of matched quotes and brackets, and for each closer its opener."""
    stack: list[tuple[str, int]] = []
    spans, opener = [], {}
    for m in _BRACKETS.finditer(text):
        ch, at = m[0], m.start()
        if ch == '"':
            if any(o == '"' for o, _ in stack):
                while stack:
                    o, start = stack.pop()
                    if o == '"':
                        spans.append((start, at))
                        opener[at] = start
                        break
            else:
                stack.append((ch, at))
            continue
        match = next((k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS.get(stack[k][0], "")), None)
        if match is not None and ch in CLOSERS:
            start = stack[match][1]
            del stack[match:]
            spans.append((start, at))
            opener[at] = start
        elif ch in PAIRS:
            stack.append((ch, at))
    return spans, opener


def _words(unit: str) -> list[str]:
    """The words of a unit as the model sees them, up to four."""
    w = normal(unit)
    if _CJKS.search(w):
        return [m[0] for m in islice(_MIXED.finditer(w), 4)]
    if _BARE.search(w[:3]):
        return [w[:6]]
    return [w]


class Gap:
    __slots__ = ("at", "unit", "g", "l2", "l1", "cl", "r1", "cr", "r2", "cr2", "joined")

    @classmethod
    def of(cls, at: int, unit: int, joined: bool, window: str) -> Gap:
        g = cls()
        g.at, g.unit, g.joined = int(at), int(unit), bool(joined)
        g.g, g.l2, g.l1, g.cl, g.r1, g.cr, g.r2, g.cr2 = window.split(_SEP)
        return g

    def window(self) -> tuple[str, ...]:
        return self.g, self.l2, self.l1, self.cl, self.r1, self.cr, self.r2, self.cr2


def covered(spans: list[tuple[int, int]], n: int) -> list[int]:
    """For each place of a text of n characters, how many spans it lies strictly within."""
    steps = [0] * (n + 2)
    for s, e in spans:
        steps[s + 1] += 1
        steps[e] -= 1
    return list(accumulate(steps))


def _units(text: str, opener: dict[int, int]) -> list[tuple[int, int]]:
    """Runs without white space, cut behind final marks that need no blank."""
    units: list[tuple[int, int]] = []
    for m in _UNIT.finditer(text):
        start, end = m.span()
        run = m[0]
        if units and _SPACED_CLOSER.match(run):
            units[-1] = (units[-1][0], end)
            continue
        cut = 0
        cjk = bool(_CJKS.search(run))
        if len(run) > 3 and (cjk or any(c in run for c in TIGHT_MARKS)):
            for t in _TIGHT.finditer(run):
                stop = t.end()
                while stop > t.start() + 1 and run[stop - 1] in "“‘\"" and start + stop - 1 not in opener:
                    stop -= 1  # a quote that opens what follows
                if cut < stop < len(run) and (cjk or t[0][0] in "。！？।॥"):
                    units.append((start + cut, start + stop))
                    cut = stop
        units.append((start + cut, end))
    return units


# Fixed value: a stretch of this many units, or of ten times as many ideographs, without a final mark counts as unpunctuated.
UNMARKED = 60


def _loose(finals: list) -> set[int]:
    """Units behind which a boundary may stand though no final mark does: those of texts, or of long stretches, without any."""
    if not any(finals):
        return set(range(len(finals)))
    out: set[int] = set()
    run: list[int] = []
    for k, f in enumerate([*finals, True]):
        if not f:
            run.append(k)
            continue
        if len(run) >= UNMARKED:
            out.update(run)
        run = []
    return out


def analyse(text: str) -> tuple[list[Gap], Gap | None]:
    """The gaps of a text that can hold a boundary, and the window at its beginning; in time linear in the text.

    A gap stands behind a final mark, at a blank of a script without marks, and between
    all words, or ideographs, of a text or long stretch that has no final mark.
    """
    spans, opener = enclosed(text)
    units = _units(text, opener)
    if not units:
        return [], None
    inside = covered(spans, len(text))
    words = [_words(text[a:b]) for a, b in units]
    flat: list[tuple[int, str]] = [(k, w) for k, ws in enumerate(words) for w in ws]
    first: dict[int, int] = {}
    for pos, (k, _) in enumerate(flat):
        first.setdefault(k, pos)

    def right(gap: Gap, k: int) -> None:
        pos = first[k]
        gap.r1 = _bare_end(flat[pos][1])
        gap.cr = shape(gap.r1)
        gap.r2 = _bare_end(flat[pos + 1][1]) if pos + 1 < len(flat) else "$"
        gap.cr2 = shape(gap.r2) if gap.r2 != "$" else "$"
        gap.joined = pos + 1 < len(flat) and flat[pos + 1][0] == k + 1

    begin = Gap()
    begin.at, begin.unit, begin.l2, begin.l1, begin.cl, begin.g = 0, -1, START, START, START, tongue(text[:120])  # the language around the beginning
    right(begin, 0)
    gaps: list[Gap] = []
    places: set[int] = set()
    finals = [_FINAL.search(text[a:b]) for a, b in units]
    loose, unmarked = _loose(finals), not any(finals)
    for k, (a, b) in enumerate(units):
        piece = text[a:b]
        if b - a > 3 and _CJKS.search(piece) and (unmarked or b - a >= 10 * UNMARKED):
            gaps += _ideographs(text, a, b, k, inside)
        if k == len(units) - 1:
            break
        final = finals[k]
        bare = not final and bool(_BARE.search(piece[-1:]) or _BARE.search(text[units[k + 1][0]]))
        if not final and not bare and k not in loose:
            continue
        mark = a + (final.start() if final else 0)
        # within a quote or bracket, or with a final mark inside one that does not end before it
        if inside[b - 1] or inside[mark] > sum(mark < e < b and opener[e] < mark for e in range(mark + 1, b) if e in opener):
            continue
        g = Gap()
        g.at, g.unit, g.g = b, k, tongue(text[max(0, b - 70) : b + 50])
        if bare:
            left = normal(piece)
            g.l1, g.cl = left[-6:], shape(left) + "_"
        elif not final:
            left = _bare_end(normal(piece))
            g.l1, g.cl = left + "~", shape(left) + (piece[-1] if piece[-1] in ",;:" else "") + "~"
        else:
            how = ""
            for pos in range(b - 1, mark - 1, -1):
                if pos in opener and text[pos] != "]":
                    o = _end(text, opener[pos])
                    before = text[max(0, o - 6) : o]
                    how = "^" if not before or o in places or _FINAL.search(before) else "(" if text[pos] in ")）" else before[-1] if before[-1] in ":：,，、" else "m"
                    break
            tail = re.sub(rf"{_CITE}", "", normal(final[0])) + how
            core = normal(piece[: final.start()])
            if _CJKS.search(core[-1:]):
                g.l1, g.cl = core[-2:] + tail, "C" + tail
            else:
                word = core.lstrip("“‘«„‚(（[「『¿¡\"'")
                g.l1, g.cl = word + tail, shape(word or "0") + tail
        if k:
            p = normal(text[units[k - 1][0] : units[k - 1][1]])
            g.l2 = p[-6:] if _BARE.search(p[-1:]) else p[-2:] if _CJKS.search(p[-1:]) else p
        else:
            g.l2 = START
        right(g, k + 1)
        gaps.append(g)
        places.add(b)
    return gaps, begin


def _ideographs(text: str, a: int, b: int, unit: int, inside: list[int]) -> list[Gap]:
    """Gaps between the ideographs of a run without final marks."""
    out = []
    for at in range(a + 2, b - 1):
        if inside[at] or inside[at - 1] or not (_CJKS.match(text[at]) and _CJKS.match(text[at - 1])):
            continue
        g = Gap()
        g.at, g.unit, g.g = at, unit, tongue(text[max(0, at - 70) : at + 50])
        g.l2, g.l1, g.cl = normal(text[max(a, at - 4) : at - 2]) or START, normal(text[at - 2 : at]) + "~", "C~"
        g.r1, g.r2 = normal(text[at : at + 2]), normal(text[at + 2 : min(b, at + 4)]) or "$"
        g.cr, g.cr2, g.joined = shape(g.r1), shape(g.r2) if g.r2 != "$" else "$", False
        out.append(g)
    return out


def _end(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _bare_end(word: str) -> str:
    return word.rstrip(",;:") or word


def guess(cl: str, cr: str, r1: str) -> float:
    """The chance of a boundary before any training, from classes alone."""
    if cl == START:
        return 0.85
    lower = (cr[-2:-1] == "w" and cr[0] not in OPENERS) or cr.startswith("P")
    if cl.endswith("~"):
        return 0.005 if lower or cl[-2:-1] in ",;:" else 0.05
    if cl.endswith("_"):
        return 0.35 if not cr.startswith("0") else 0.05
    mark = re.sub(r"^.*?(?=[" + re.escape(MARKS) + "])", "", cl)
    quoted = mark[-1:] in "^:：,，、m(" and len(mark) > 1
    if quoted and mark[-2] in ")）":
        return (0.9 if mark[-1] == "^" else 0.2) if not lower else 0.05
    if quoted and mark[-1] in ",，、m":
        return 0.4 if not lower else 0.05
    if quoted and mark[-1] == "^" and ("C" in cr or cr[-2:-1] == "n"):
        return 0.4
    if lower:
        return 0.1 if cr[-2:] != "w1" else 0.3
    if mark[:1] in "!?؟。！？．।॥":
        return 0.95
    return 0.35 if cl[:2] in ("W1", "w1", "W3", "w3") or "." in cl[:-1] else 0.5 if cr.startswith("0") else 0.85


# How sentences begin is learned at the beginnings of texts and behind marks that end nothing else;
# a full stop, or a blank in a script without marks, tells too little about what follows it.
_SURE = re.compile(r"^\^$|^[^.…．]*[!?؟。！？।॥]+$")
# How many counts it takes to believe that a word may follow without a boundary. Were it few,
# the frequent beginnings of sentences would soon count as continuations of frequent last words.
# It holds for a corpus of so many windows and grows with the corpus: frequent words have as large
# a share of a larger one, and a fixed number of counts would soon be few.
DISTRUST, DISTRUST_WINDOWS = 300.0, 100_000


class Model:
    """Back-off probabilities over a table of expected counts."""

    def __init__(self, counts: dict[str, float], windows: int = 0):
        self.c = counts
        self.windows = windows
        self.distrust = DISTRUST * max(1.0, windows / DISTRUST_WINDOWS)
        self.get = counts.get

    def event(self, w: tuple) -> float:
        """Chance of a boundary after the left words; classes lean on the first guess."""
        g, l2, l1, cl = w[:4]
        c = self.get
        b, n = c(f"Ec|{g}|{cl}|B", 0.0), c(f"Ec|{g}|{cl}|N", 0.0)
        lean = 2 + 0.3 * (b + n)
        p = (b + lean * guess(cl, "W9", "")) / (b + n + lean)
        b, n = c("E1|" + l1 + "|B", 0.0), c("E1|" + l1 + "|N", 0.0)
        p = (b + 4 * p) / (b + n + 4)
        key = "E2|" + l2 + "|" + l1
        b, n = c(key + "|B", 0.0), c(key + "|N", 0.0)
        p = (b + 4 * p) / (b + n + 4)
        return min(max(p, 1e-4), 1 - 1e-4)

    def _share(self, g: str, word: str, kind: str) -> float:
        return (self.get(f"U|{g}|{word}", 0.0) + 0.1) / (self.get(f"UC|{g}|{kind}", 0.0) + 10.0)

    def after_boundary(self, w: tuple) -> float:
        c, g, r1, cr = self.get, w[0], w[4], w[5]
        total = c("S|" + g, 0.0)
        kind = (c(f"Sc|{g}|{cr}", 0.0) + 0.01) / (total + 1.0) * self._share(g, r1, cr)
        new = 5 + 0.3 * total  # sentences often begin with words that no sure beginning has shown
        return (c(f"S1|{g}|{r1}", 0.0) + new * kind) / (total + new)

    def without(self, w: tuple) -> float:
        c, g, l1, cl, r1, cr, d = self.get, w[0], w[2], w[3], w[4], w[5], self.distrust
        left = c(f"Ec|{g}|{cl}|N", 0.0)
        kind = (c(f"Nc|{g}|{cl}|{cr}", 0.0) + d * (c(f"Na|{g}|{cr}", 0.0) + 0.5) / (c("N|" + g, 0.0) + 5.0)) / (left + d) * self._share(g, r1, cr)
        p = (c(f"N2|{g}|{cl}|{r1}", 0.0) + d * kind) / (left + d)
        return (c("N1|" + l1 + "|" + r1, 0.0) + d * p) / (c("E1|" + l1 + "|N", 0.0) + d)

    def second(self, w: tuple, state: str) -> float:
        """Chance of the second right word after the first, B if a boundary stands before both."""
        c, g, r1, cr, r2, cr2 = self.get, w[0], w[4], w[5], w[6], w[7]
        total = c(f"S1|{g}|{r1}", 0.0) if state == "B" else c(f"M1|{g}|{r1}", 0.0)
        both = c(f"Sc|{g}|{cr}", 0.0) if state == "B" else c(f"Na|{g}|{cr}", 0.0)
        kind = (c(f"D{state}|{g}|{cr}|{cr2}", 0.0) + 0.5) / (both + 10.0) * self._share(g, r2, cr2)
        if r2 == "$":
            return 1.0  # the end of a text tells nothing
        open_ended = (5 if state == "B" else self.distrust) + 0.5 * total  # most first words go on in ever new ways
        return (c(f"T{state}|{g}|{r1}|{r2}", 0.0) + open_ended * kind) / (total + open_ended)

    def posterior(self, g: tuple) -> float:
        e = self.event(g) if g[3] != START else 0.85
        b = e * self.after_boundary(g) * self.second(g, "B")
        n = (1 - e) * self.without(g) * self.second(g, "N")
        return b / (b + n)

    def decode(self, gaps: list[Gap]) -> list[float]:
        """Posterior chance of a boundary in each gap, by forward-backward over the chain of gaps."""
        if not gaps:
            return []
        unary, ratio = [], []
        for k, gap in enumerate(gaps):
            g = gap.window()
            e = self.event(g)
            b, n = e * self.after_boundary(g), (1 - e) * self.without(g)
            sb, sn = self.second(g, "B"), self.second(g, "N")
            adjacent = gap.joined and k + 1 < len(gaps) and gaps[k + 1].unit == gap.unit + 1
            if not adjacent:
                b, n = b * sb, n * sn
            unary.append((n / (b + n), b / (b + n)))
            ratio.append(sb / sn if adjacent else 1.0)
        forward = [unary[0]]
        for k in range(1, len(gaps)):
            f0, f1 = forward[-1]
            x0, x1 = (f0 + f1 * ratio[k - 1]) * unary[k][0], (f0 + f1) * unary[k][1]
            forward.append((x0 / (x0 + x1), x1 / (x0 + x1)))
        back = (1.0, 1.0)
        out = [0.0] * len(gaps)
        for k in range(len(gaps) - 1, -1, -1):
            p0, p1 = forward[k][0] * back[0], forward[k][1] * back[1]
            out[k] = p1 / (p0 + p1)
            if k:
                n0, n1 = unary[k][0] * back[0], unary[k][1] * back[1]
                b0, b1 = n0 + n1, ratio[k - 1] * n0 + n1
                back = (b0 / (b0 + b1), b1 / (b0 + b1))
        return out


def expected(rows: Iterable[tuple], model: Model | None) -> dict[str, float]:
    """Expected counts of all n-grams from (window..., n), under a model or the first guess."""
    out: dict[str, float] = defaultdict(float)
    for *w, n in rows:
        g, l2, l1, cl, r1, cr, r2, cr2 = w
        p = guess(cl, cr, r1) if model is None else model.posterior(tuple(w))
        b, m = p * n, (1 - p) * n
        if cl != START:
            out[f"Ec|{g}|{cl}|B"] += b
            out[f"Ec|{g}|{cl}|N"] += m
            out["E1|" + l1 + "|B"] += b
            out["E1|" + l1 + "|N"] += m
            out["E2|" + l2 + "|" + l1 + "|B"] += b
            out["E2|" + l2 + "|" + l1 + "|N"] += m
        else:
            m = 0.0
        if _SURE.search(cl):
            out["S|" + g] += b
            out[f"S1|{g}|{r1}"] += b
            out[f"Sc|{g}|{cr}"] += b
            out[f"TB|{g}|{r1}|{r2}"] += b
            out[f"DB|{g}|{cr}|{cr2}"] += b
        if m:
            out["N|" + g] += m
            out[f"Na|{g}|{cr}"] += m
            out[f"M1|{g}|{r1}"] += m
            out["N1|" + l1 + "|" + r1] += m
            out[f"N2|{g}|{cl}|{r1}"] += m
            out[f"Nc|{g}|{cl}|{cr}"] += m
            out[f"TN|{g}|{r1}|{r2}"] += m
            out[f"DN|{g}|{cr}|{cr2}"] += m
        out[f"U|{g}|{r1}"] += n
        out[f"UC|{g}|{cr}"] += n
        out[f"U|{g}|{r2}"] += n
        out[f"UC|{g}|{cr2}"] += n
    return out


# Parts of a window are white-space free, so this control character, which is white space, parts them.
_SEP = "\x1f"


def gap_table(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and what `analyse` finds in each text, which training counts and decoding reads: no text is analysed twice.

    begin and win are windows in one string; at, next, unit and joined describe the gaps,
    first and last the outer offsets. Null, empty and blank texts have no row.
    """
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)
    schema += "first int, last int, begin string, at array<int>, next array<int>, unit array<int>, joined array<boolean>, win array<string>"
    names = [*keys, "first", "last", "begin", "at", "next", "unit", "joined", "win"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, t in b.itertuples(index=False, name=None):
                if not isinstance(t, str):
                    continue
                gaps, begin = analyse(t)
                if begin is None:
                    continue
                after = [_next(t, g.at) for g in gaps]
                out.append((*key, _next(t, 0), _end(t, len(t)), _SEP.join(begin.window()), [g.at for g in gaps], after, [g.unit for g in gaps], [g.joined for g in gaps], [_SEP.join(g.window()) for g in gaps]))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.select(*keys, text).mapInPandas(run, schema)


def _next(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def train(gaps: DataFrame, rounds: int = 6, least: float = 1.5) -> Model:
    """The model of a corpus, from its gap table. Counts cover every text; n-grams expected fewer than `least` times
    are left to their classes, whatever the size of the corpus."""
    seen = gaps.select(F.explode(F.concat(F.array("begin"), "win")).alias("win")).groupBy("win").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(parallel(seen))
    windows = rows.agg(F.sum("n")).first()[0] or 0
    model = None
    for _ in range(rounds):
        known = model.c if model else None

        def run(batches: Iterator[pd.DataFrame], known: dict | None = known) -> Iterator[pd.DataFrame]:
            total: dict[str, float] = defaultdict(float)
            m = Model(known, windows) if known is not None else None
            for df in batches:
                for k, v in expected(((*w.split(_SEP), n) for w, n in zip(df["win"], df["n"])), m).items():
                    total[k] += v
            yield pd.DataFrame({"k": list(total), "v": list(total.values())}, columns=["k", "v"], dtype=object)

        sums = rows.mapInPandas(run, "k string, v double").groupBy("k").agg(F.sum("v").alias("v"))
        kept = sums.where((F.col("v") >= least) | F.col("k").rlike("^(Ec|S|Sc|N|Nc|Na|UC|D[BN])[|]")).orderBy(F.desc("v"), "k")
        model = Model({k: v for k, v in kept.toPandas().itertuples(index=False, name=None)}, windows)
    return model or Model({})


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without outer white space."""
    gaps, _ = analyse(text)
    ends = [g.at for g, p in zip(gaps, model.decode(gaps)) if p >= 0.5]
    out, start = [], 0
    for end in [*ends, len(text)]:
        piece = text[start:end]
        a = start + len(piece) - len(piece.lstrip())
        b = start + len(piece.rstrip())
        if b > a:
            out.append((a, b))
        start = end
    return out


def sentences(gaps: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, sent_no, char_start, char_end of every sentence of a gap table.

    Texts of any length are read whole; those without a row in the table have no sentences.
    """
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in gaps.select(*keys).schema) + "sent_no int, char_start int, char_end int"
    counts, windows = model.c, model.windows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(counts, windows)
        for b in batches:
            out = []
            for *key, first, last, _, at, after, unit, joined, win in b.itertuples(index=False, name=None):
                chain = [Gap.of(*g) for g in zip(at, unit, joined, win)]
                start, n = first, 0
                for p, end, following in zip(m.decode(chain), at, after):
                    if p >= 0.5 and end > start:
                        n += 1
                        out.append((*key, n, start, end))
                        start = following
                if last > start:
                    out.append((*key, n + 1, start, last))
            yield pd.DataFrame(out, columns=[*keys, "sent_no", "char_start", "char_end"], dtype=object)

    return gaps.mapInPandas(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").where("role = 'body' and text is not null").select("paper_id", "block_id", "text")
    gaps = materialize(gap_table(spread(blocks), ["paper_id", "block_id"], "text"))
    return sentences(gaps, ["paper_id", "block_id"], train(gaps)).dropDuplicates(["paper_id", "block_id", "sent_no"])
