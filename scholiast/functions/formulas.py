"""Equations as text: a token stream, from which symbols, LaTeX and definitions are read; MathML from LaTeX.

An equation is cut into tokens once: names, numbers and signs, each with the blank before
it. Names are cut where their letters cannot belong to one symbol. An index or power that
an extractor set apart is bound to its name as the stream is read. All readings (the
repaired text, LaTeX, variables) print or filter the same stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

_GREEK = "Α-Ωα-ω"
_L = f"A-Za-z{_GREEK}"
# Names of functions, and words that are no variables.
FUNCTIONS = frozenset("cos exp ffn gelu log max mean min relu sigmoid sin softmax sqrt sum tan tanh".split())
NO_VARIABLES = frozenset("a an and as at by e for from i in is of or the to where with".split())
# Greek letters and signs in LaTeX.
GREEK_LATEX = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "ω": "omega",
    "Α": "Alpha", "Β": "Beta", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Σ": "Sigma", "Φ": "Phi", "Ω": "Omega",
}
SIGN_LATEX = {"∑": "sum", "∫": "int", "√": "sqrt", "≤": "le", "≥": "ge", "→": "to", "≈": "approx", "×": "times", "·": "cdot"}
# Signs that print like another.
TWIN_SIGNS = str.maketrans("ϵµ", "εμ")
# Words that say what a symbol stands for, and nouns that name one.
SAYS = {"is", "denotes", "represents", "indicates"}
SAYS_WHERE = {"is", "are", "denote", "denotes", "represent", "represents", "indicate", "indicates"}
NOUNS = {
    "query", "queries", "key", "keys", "value", "values", "matrix", "matrices", "vector", "vectors", "dimension", "dimensions", "size", "sizes",
    "position", "positions", "number", "numbers", "parameter", "parameters", "rate", "rates",
}
# How many letters before and behind a symbol such words are looked for; longest left side and its most words.
WHERE_BEFORE, SAYS_AFTER, NOUN_BEFORE = 160, 100, 80
LEFT_LETTERS, LEFT_WORDS = 32, 2


@dataclass
class Token:
    kind: str  # name, number, sign
    text: str
    gap: bool = False  # a blank stands before it
    index: str = ""
    power: str = ""

    def plain(self) -> str:
        return self.text + ("_" + self.index if self.index else "") + ("^" + self.power if self.power else "")


_TOKEN = re.compile(rf"(?P<gap>\s*)(?:(?P<name>[{_L}][{_L}0-9_]*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>\S))")
# Within a run of letters a new symbol begins at a Greek letter behind a Latin one, and at a capital behind a single small letter.
_NEW_SYMBOL = re.compile(rf"(?<=[A-Za-z])(?=[{_GREEK}])|(?<=(?<![A-Za-z])[a-zα-ω])(?=[A-ZΑ-Ω])")


def _cut(text: str) -> Iterator[Token]:
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        gap = bool(m["gap"])
        if kind != "name":
            yield Token(kind, m[kind], gap)
            continue
        for k, part in enumerate(_NEW_SYMBOL.split(m["name"])):
            yield Token("name", part, gap or k > 0)


def read(text: str) -> list[Token]:
    """The tokens of an equation, detached indices and powers bound to their names."""
    out: list[Token] = []
    todo = [t for t in _cut(text.translate(TWIN_SIGNS))]
    k = 0
    while k < len(todo):
        t = todo[k]
        after = todo[k + 1 : k + 4]
        if t.kind == "name" and len(t.text) == 1 and t.text.isascii():
            # a power set above and an index below come out as "d −0.5 model"
            kinds = [(a.kind, a.text in "−-" if a.kind == "sign" else a.gap) for a in after]
            if len(kinds) == 3 and kinds[0] == ("sign", True) and kinds[1][0] == "number" and kinds[2] == ("name", True) and re.fullmatch("[A-Za-z]{2,}", after[2].text):
                out.append(Token("name", t.text, t.gap, after[2].text, after[0].text + after[1].text))
                k += 4
                continue
        if t.kind == "name" and "_" not in t.text and not t.text[-1].isdigit() and after and after[0].kind == "number" and after[0].gap and not (after[1:] and after[1].kind == "name" and not after[1].gap):
            whole, point, rest = after[0].text.partition(".")
            out.append(Token("name", t.text, t.gap, whole))
            out += [Token("number", point + rest)] if point else []
            k += 2
            continue
        out.append(t)
        k += 1
    return out


def repair(text: str) -> str:
    """Equation text with one blank between parts and indices joined to their letters."""
    return "".join((" " if t.gap and k else "") + t.plain() for k, t in enumerate(read(text)))


# How the parts of a symbol are told apart: base and index in each row, and whether the index is always braced.
_SYMBOL = [
    (re.compile(rf"(?P<base>[{_L}])_?(?P<index>\d+)"), "never"),
    (re.compile(rf"(?P<base>[{_L}]+)_(?P<index>[A-Za-z0-9]+)"), "always"),
    (re.compile(r"(?P<base>d)(?P<index>[a-z]{1,10})"), "long"),
    (re.compile(rf"(?P<base>[A-Z{_GREEK}])(?P<index>[a-z])"), "never"),
    (re.compile(r"(?P<base>[a-z]{2,15})(?P<index>i)"), "never"),
]


def symbol(token: str) -> str:
    """The one form of a symbol, its index behind an underscore."""
    t = token.translate(TWIN_SIGNS).strip()
    for form, braces in () if t in FUNCTIONS else _SYMBOL:
        if m := form.fullmatch(t):
            braced = braces == "always" or (braces == "long" and len(m["index"]) > 1)
            return m["base"] + "_" + ("{" + m["index"] + "}" if braced else m["index"])
    return t


def variables(text: str) -> list[str]:
    """Symbols of an equation in the order they come in, functions and small words left out; [] where nothing is equated."""
    tokens = read(text)
    first = next((k for k, t in enumerate(tokens) if t.text == "="), None)
    if first is None:
        return []
    found = [t for t, n in zip(tokens, tokens[1:]) if t.kind == "name" and n.text == "="]
    left = " ".join(t.plain() for t in tokens[:first])
    if len(left) <= LEFT_LETTERS and sum(len(w) > 1 for w in re.findall("[A-Za-z]+", left)) <= LEFT_WORDS:
        # an equation ends at a full stop that a sentence follows
        end = next((k for k in range(first, len(tokens) - 1) if tokens[k].text == "." and tokens[k + 1].gap and re.match("[A-Z]", tokens[k + 1].text)), len(tokens))
        for t, n in zip(tokens[:end], [*tokens[1:end], Token("sign", "")]):
            called = n.text == "(" and t.text.isalpha() and len(t.plain()) > 1
            if t.kind == "name" and not called and t.text.lower() not in FUNCTIONS:
                found.append(t)
    named = dict.fromkeys(symbol(t.text + ("_" + t.index if t.index else "")) for t in found)
    return [s for s in named if s.lower() not in NO_VARIABLES | FUNCTIONS]


_LATEX = {sign: "\\" + name for sign, name in (SIGN_LATEX | GREEK_LATEX).items()} | {"−": "-"}


def _latex_token(t: Token) -> str:
    """A token in LaTeX: its base and index in braces where longer than one letter."""
    if t.kind == "name" and t.text.lower() not in FUNCTIONS:
        if m := re.fullmatch(r"([A-Z])([A-Z])T", t.text):
            return f"{m[1]}{m[2]}^{{T}}"
        base, _, index = symbol(t.text + ("_" + t.index if t.index else "")).partition("_")
        index = index if len(index.strip("{}")) < 2 or index[0] == "{" else "{" + index + "}"
    else:
        base, index = t.text, ""
    out = "".join(_LATEX.get(c, c) for c in base) + ("_" + index if index else "")
    return out + ("^" + t.power.replace("−", "-") if t.power else "")


def latex(text: str, label: str | None = None) -> str:
    """An equation in LaTeX; its number is left out where given as label."""
    tokens = read(text)
    if label and [t.text for t in tokens[-3:]] == ["(", label, ")"]:
        tokens = tokens[:-3]
    out: list[str] = []
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t.gap and out and t.text != ")" and not out[-1].endswith(","):
            out.append(" ")
        if t.text == "√" and k + 1 < len(tokens) and tokens[k + 1].kind == "name":
            out.append("\\sqrt{" + _latex_token(tokens[k + 1]) + "}")
            k += 2
            continue
        out.append(_latex_token(t))
        k += 1
    return "".join(out)


def symbol_pattern(sym: str) -> str:
    """A pattern for the forms an extractor may give a symbol: joined, spaced or braced index."""
    base, _, index = sym.partition("_")
    if not index:
        return re.escape(sym)
    name = re.escape(index.strip("{}"))
    ways = (name, r"_\s*" + name, r"_\s*\{\s*" + name + r"\s*\}")
    return re.escape(base) + r"\s*(?:" + "|".join(ways) + ")"


def defines(sym: str, text: str) -> bool:
    """Whether a text says what a symbol stands for: by a sign or verb behind it, in a clause with "where", or by a noun before it."""
    s = repair(text)
    spot = re.compile(rf"(?<![A-Za-z0-9]){symbol_pattern(sym)}(?![A-Za-z0-9])", re.IGNORECASE)
    for m in spot.finditer(s):
        behind = s[m.end() : m.end() + SAYS_AFTER + 12].lstrip()
        words = re.findall(r"[A-Za-z]+", behind[:30].lower())
        if behind.startswith(("=", "∈", ":=")):
            return True
        if behind[:1].isalpha() and words and (words[0] in SAYS or words[:2] == ["refers", "to"]):
            return True
        # the clause around the symbol
        before = re.split("[.;:]", s[: m.start()])[-1]
        after = re.split("[.;:]", s[m.end() : m.end() + SAYS_AFTER + 12])[0]
        told = [w.end() for w in re.finditer(r"\w+", before) if w[0].lower() == "where"]
        if told and len(before) - told[-1] <= WHERE_BEFORE and any(w.start() <= SAYS_AFTER and w[0].lower() in SAYS_WHERE for w in re.finditer(r"\w+", after)):
            return True
        if any(w[0].lower() in NOUNS and len(before) - w.end() <= NOUN_BEFORE for w in re.finditer(r"\w+", before)):
            return True
    return False


_PIECE = re.compile(rf"\\([A-Za-z]+)|([{_L}]+)|(\d+(?:\.\d+)?)|([_^])|([{{}}])|(\S)")
_GLYPH = {name: sign for sign, name in (SIGN_LATEX | GREEK_LATEX).items()}


def mathml(tex: str, known: tuple[str, ...] = ()) -> str:
    """Presentation MathML of simple LaTeX: names, numbers, roots, fractions, indices and powers."""
    pieces = [m for m in _PIECE.finditer(tex)]
    at = 0

    def group() -> str:
        nonlocal at
        if at < len(pieces) and pieces[at][0] == "{":
            at += 1
            out = row("}")
            at += 1
            return f"<mrow>{out}</mrow>"
        return atom()

    def atom() -> str:
        nonlocal at
        if at >= len(pieces):
            return "<mrow></mrow>"
        m = pieces[at]
        at += 1
        if m[1] == "sqrt":
            return f"<msqrt>{group()}</msqrt>"
        if m[1] == "frac":
            return f"<mfrac>{group()}{group()}</mfrac>"
        if m[1]:
            return f"<mi>{escape(_GLYPH.get(m[1], m[1]))}</mi>"
        if m[2]:
            mark = f' data-symbol="{escape(m[2])}"' if m[2] in known else ""
            return f"<mi{mark}>{escape(m[2])}</mi>"
        return f"<mn>{m[3]}</mn>" if m[3] else f"<mo>{escape(m[0])}</mo>"

    def row(end: str) -> str:
        nonlocal at
        out = []
        while at < len(pieces) and pieces[at][0] != end:
            base, low, high = group(), None, None
            while at < len(pieces) and pieces[at][4]:
                at += 1
                if pieces[at - 1][4] == "_":
                    low = group()
                else:
                    high = group()
            if low and high:
                base = f"<msubsup>{base}{low}{high}</msubsup>"
            elif low or high:
                base = f"<msub>{base}{low}</msub>" if low else f"<msup>{base}{high}</msup>"
            out.append(base)
        return "".join(out)

    return f"<math>{row('')}</math>"
