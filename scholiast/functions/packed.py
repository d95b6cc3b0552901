"""Quote-aware finite-state tokenizer for fields that hold several values.

The tokenizer walks a field once and tracks three things: whether it is inside a
packing quote (doubled quotes and backslashes escape), the nesting depth of brackets,
and the start of the current value. Only delimiters outside quotes and at depth zero
separate values. Two profiles decide which delimiters count: lists of names (`scan`) and
lists of bibliography entries (`entry_marks`), whose quotes and brackets are often left open
and whose entries also begin at marks that count them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Delimiters that separate wherever they stand outside quotes.
HARD = ";；|｜\t\r\n·、"
# Conjunctions between two names.
CONJUNCTIONS = ("and", "und", "et", "y", "и", "&", "＆")
# Words that name a kind of organisation.
ORGANISATION_WORDS = (
    "acad academy assoc association bureau center centre centro coll college committee consortium council ctr department dept faculty "
    "foundation group inst institut institute instituto lab laboratory ministry network office school soc society team univ universität "
    "université university"
).split()
# Name parts that follow a comma without starting a new name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")

_OPEN, _CLOSE = "([{（「", ")]}）」"
_CONJ = re.compile(r"\s+(?:" + "|".join(map(re.escape, CONJUNCTIONS)) + r")(?=\s)(?!\s+al\b)", re.IGNORECASE)
_SLASH = re.compile(r"\s*//\s*|\s+/\s+")
_ET_AL = re.compile(r"(?:^|[\s,]+)(?:et\s+al\b\.?|и\s+др\.)\s*$", re.IGNORECASE)
_ORG = re.compile(r"\b(?:" + "|".join(ORGANISATION_WORDS) + r")\b\.?", re.IGNORECASE)
_ORG_LINK = re.compile(r"\s(?:of|for|für|de|pour|para)\s", re.IGNORECASE)


def scan(text: str, hard: str = HARD, soft: bool = True, slash: bool = True) -> list[list[tuple[str, bool, str]]]:
    """Segments between hard delimiters, each a list of (value, was quoted, soft delimiter after it).

    Soft delimiters are the comma and, in lists of names, conjunctions.
    """
    out: list[list[tuple[str, bool, str]]] = [[]]
    buf: list[str] = []
    quoted = was_quoted = False
    depth, i, n = 0, 0, len(text)

    def emit(mark: str) -> None:
        nonlocal was_quoted
        out[-1].append(("".join(buf).strip(), was_quoted, mark))
        buf.clear()
        was_quoted = False

    while i < n:
        ch = text[i]
        if quoted:
            if ch == "\\" and i + 1 < n and text[i + 1] in '"\\/':
                buf.append(text[i + 1])
                i += 2
                continue
            if ch == '"':
                if i + 1 < n and text[i + 1] == '"':
                    buf.append('"')
                    i += 2
                    continue
                quoted = False
            else:
                buf.append(ch)
            i += 1
            continue
        if ch == '"' and not was_quoted and not "".join(buf).strip():
            buf.clear()
            quoted = was_quoted = True
        elif ch in _OPEN:
            depth += 1
            buf.append(ch)
        elif ch in _CLOSE:
            depth = max(0, depth - 1)
            buf.append(ch)
        elif depth == 0 and ch in hard:
            emit("")
            out.append([])
        elif depth == 0 and slash and ch in "/ " and (m := _SLASH.match(text, i)):
            emit("")
            out.append([])
            i = m.end()
            continue
        elif depth == 0 and ch in ",，":
            emit(",")
        elif depth == 0 and soft and ch.isspace() and (m := _CONJ.match(text, i)):
            emit("&")
            i = m.end()
            continue
        else:
            buf.append(ch)
        i += 1
    if quoted:  # the quote never closes: it was an ordinary character
        buf.insert(0, '"')
        was_quoted = False
    emit("")
    return out


def _is_org(value: str) -> bool:
    return bool(_ORG.search(value) and (_ORG_LINK.search(value) or _ORG.match(value)))


def _place_first(value: str) -> bool:
    head = re.sub(r"^the\s+", "", value, flags=re.IGNORECASE)
    m = _ORG.search(head)
    return bool(m and m.start() > 0)


def _org_lacks_place(value: str) -> bool:
    return _is_org(value) and "," not in value and "(" not in value and not re.search(r"\s[–—-]\s", value) and not _place_first(value)


def _surname_only(value: str) -> bool:
    words = value.split()
    return bool(words) and all(w[:1].islower() for w in words[:-1]) and not words[-1].endswith(".") and not _is_org(value)


def _given_like(value: str) -> bool:
    words = value.split()
    return 0 < len(words) <= 4 and all(w[:1].isalpha() or w[:1] == '"' for w in words) and not _is_org(value)


def _joins(cur: str, nxt: str, after: str, following: str) -> bool:
    """Whether a comma between two unquoted values belongs to one name."""
    if nxt.strip(".").lower().replace(".", "") in SUFFIXES:
        return True
    if _org_lacks_place(cur):
        return len(nxt.split()) == 1
    return "," not in cur and _surname_only(cur) and _given_like(nxt)


def split_names(field: str | None) -> list[str]:
    """Names of a packed author field, in order; [] for a null, empty or blank field."""
    if field is None or not (text := field.strip()):
        return []
    if len(text) > 1 and text[0] in "[{(" and text[-1] == _CLOSE[_OPEN.index(text[0])] and (text[0] != "(" or text.count("(") == 1):
        text = text[1:-1]
    values: list[str] = []
    for segment in scan(text):
        k = 0
        pieces = [p for j, p in enumerate(segment) if p[0] or p[1] or j == len(segment) - 1 or segment[j][2] != "&"]
        # a comma directly before a conjunction leaves an empty piece: the two marks are one
        while k < len(pieces):
            cur, quoted, mark = pieces[k]
            k += 1
            while cur and not quoted and k < len(pieces) and mark:
                nxt, nxt_quoted, nxt_mark = pieces[k]
                following = pieces[k + 1][0] if k + 1 < len(pieces) else ""
                if nxt_quoted or not nxt:
                    break
                if mark == "," and _joins(cur, nxt, nxt_mark, following):
                    cur, mark = f"{cur}, {nxt}" if f"{cur}, {nxt}" in field else f"{cur},{nxt}", nxt_mark
                    k += 1
                elif mark == "&" and _is_org(cur) and _org_open(cur, nxt, nxt_mark, following):
                    joined = re.search(re.escape(cur) + r"\s+\S+\s+" + re.escape(nxt), field)
                    cur, mark = joined[0] if joined else f"{cur} and {nxt}", nxt_mark
                    k += 1
                else:
                    break
            cur = cur if quoted else _ET_AL.sub("", cur).strip()
            if cur:
                values.append(cur)
    return values


def _org_open(cur: str, nxt: str, mark: str, following: str) -> bool:
    """Whether a conjunction stands inside the name of an organisation."""
    if "," in cur or "(" in cur or re.search(r"\s[–—]\s", cur):
        return False
    if _place_first(cur):
        return not re.search(r"(?:^|\s)\w\.", nxt) and len(nxt.split()) <= 2
    return "(" in nxt or bool(re.search(r"\s[–—]\s", nxt)) or (mark == "," and len(following.split()) == 1)


_MARKER = re.compile(r"\s*(?:\[\d{1,5}\]|\(\d{1,5}\)|\(\w\)|\d{1,5}[.)](?=\s))\s*")
# How a mark that counts entries can look: in square brackets, with a full stop, a letter or digit in round ones.
_COUNTS = (re.compile(r"\[(\d{1,5})\](?=\s)"), re.compile(r"(?<![\w.(\[–-])(\d{1,5})\.(?=\s)"), re.compile(r"\((\w)\)(?=\s)"))
_FIRST_LETTERS = "aAiα"
_ENDING = ".…”»\"'])）"
# Delimiters of entries and what each asks of the text before it: nothing, a closed entry, or a closed entry that is no list of authors.
_BREAK = re.compile(r"(?P<line>[\r\n\t]+)|(?P<bar>\s+(?://+|\|+|·)\s+|\|\|)|(?P<semicolon>\s*[;；]\s+)")
_LONG_TAIL = re.compile(r"(?:\d|[^\W\d_]{2,}|\])[.”\"]*\.$")
_INITIAL = re.compile(r"(?:^|\W)[^\W\d_]\.$")
_PAIRED = {"(": ")", "[": "]", "{": "}", "（": "）", "“": "”", "«": "»", "„": "“”"}
_WATCHED = re.compile(r"[\\\"\[\](){}（）“”«»„;；|\d\r\n\t]|\s(?=[\s/|·;；])")


class Mark(NamedTuple):
    """A place outside quotes and brackets where entries may part."""

    kind: str  # line, bar, semicolon, or count0.. by the look of the mark
    start: int
    end: int
    rank: int = 0


def entry_marks(text: str) -> list[Mark]:
    """Delimiters and counting marks of an entry field outside quotes and brackets, in order.

    One walk with a stack of open quotes and brackets, each with the number of marks seen
    before it: when one closes, the marks within it are taken back. One that never closes
    protects nothing. A backslash takes the next character out of account; a straight quote opens
    behind a blank or bracket and closes before a blank, mark or bracket.
    """
    marks: list[Mark] = []
    stack: list[tuple[str, int]] = []

    def close(ch: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if ch in (_PAIRED.get(stack[k][0]) or stack[k][0]):
                del marks[stack[k][1] :]
                del stack[k:]
                return

    i = 0
    while m := _WATCHED.search(text, i):
        i = m.start()
        ch = text[i]
        before = text[i - 1] if i else " "
        if ch == "\\":
            i += 2
            continue
        n = "[d(".find("d" if ch.isdigit() else ch)
        if n >= 0 and (c := _COUNTS[n].match(text, i)):
            marks.append(Mark(f"count{n}", i, c.end(), int(c[1]) if c[1].isdigit() else ord(c[1])))
            i = c.end()
        elif (ch.isspace() or ch in ";；|") and (c := _BREAK.match(text, i)):
            marks.append(Mark(c.lastgroup, i, c.end()))
            # the blank behind a delimiter may belong to the next mark
            i = c.end()
        elif ch == '"':
            after = text[i + 1] if i + 1 < len(text) else " "
            if (before.isspace() or before in "([{“") and not after.isspace():
                stack[:] = [s for s in stack if s[0] != '"']
                stack.append((ch, len(marks)))
            elif any(s[0] == '"' for s in stack):
                close(ch)
            i += 1
        elif any(s[0] == "„" for s in stack) and ch == "“":
            close(ch)
            i += 1
        elif ch in _PAIRED:
            stack.append((ch, len(marks)))
            i += 1
        elif ch in ")]}）”»":
            close(ch)
            i += 1
        elif ch.isdigit():
            while i < len(text) and text[i].isdigit():
                i += 1
        else:
            i += 1
    return marks


def _closed(text: str, at: int) -> bool:
    """Whether what stands before a place can end an entry."""
    while at and text[at - 1].isspace():
        at -= 1
    return at > 0 and text[at - 1] in _ENDING


def _counted(text: str, marks: list[Mark]) -> list[int]:
    """Starts of the entries whose marks count upwards from the one that opens the field, itself or behind another mark; [] if there are none."""
    head = _MARKER.match(text)
    for opening in (0, head.end() if head else 0):
        for n in range(len(_COUNTS)):
            own = [m for m in marks if m.kind == f"count{n}" and m.start >= opening]
            if not own or own[0].start != opening or (n == 2 and not text[own[0].start + 1].isdigit() and text[own[0].start + 1] not in _FIRST_LETTERS):
                continue
            starts, last = [opening], own[0].rank
            for m in own[1:]:
                if m.rank == last + 1 and _closed(text, m.start):
                    starts.append(m.start)
                    last += 1
            if len(starts) > 1:
                return starts
    return []


def _parts(text: str, start: int, m: Mark) -> bool:
    """Whether a delimiter parts two entries, by the text from start to it."""
    if m.kind == "bar":
        return True
    if m.kind == "line":
        return _closed(text, m.start)
    tail = text[max(start, m.start - 80) : m.start].rstrip()
    word = tail.rsplit(None, 1)[-1] if tail else ""
    return bool(_LONG_TAIL.search(tail)) and word.lower() != "al." and not _INITIAL.search(word)


def split_entries(field: str | None) -> list[str]:
    """Bibliography entries of a packed field, in order; [] for a null, empty or blank field.

    Fields all of whose values are quoted are cut by `scan`; any other by the marks that
    `entry_marks` finds outside quotes and brackets: counting marks first, else delimiters.
    """
    if field is None or not (text := field.strip()):
        return []
    if text.startswith('["') and text.endswith('"]'):
        text = text[1:-1]
    if text.startswith('"'):
        pieces = [p for seg in scan(text, hard=";；|｜\n\r\t", soft=False) for p in seg]
        if all(q or not v for v, q, _ in pieces):
            return [e for v, _, _ in pieces if (e := _unmarked(v))]
    marks = entry_marks(text)
    if starts := _counted(text, marks):
        return [e for a, b in zip(starts, [*starts[1:], len(text)]) if (e := _unmarked(text[a:b]))]
    cuts, start = [], 0
    for m in marks:
        if not m.kind.startswith("count") and _parts(text, start, m):
            cuts.append((start, m.start))
            start = m.end
    cuts.append((start, len(text)))
    return [e for a, b in cuts if (e := _unmarked(text[a:b]))]


def _unmarked(value: str) -> str:
    value = value.strip()
    for _ in range(2):
        if m := _MARKER.match(value):
            value = value[m.end():].strip()
    if len(value) > 1 and value[0] == value[-1] == '"':
        value = value[1:-1].replace('""', '"').strip()
    return value


PROFILES = {"names": split_names, "entries": split_entries}
