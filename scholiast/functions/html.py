"""HTML of a page of evidence: a small renderer, a tokenizer and the rules an auditor checks."""

from __future__ import annotations

import json
import re
from html import escape
from html.parser import HTMLParser


class _Tokens(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str]]] = []
        self.words: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.extend(data.split())


def tokens(html: str) -> tuple[list[tuple[str, dict[str, str]]], str]:
    """(start tags with attributes, visible text)."""
    t = _Tokens()
    t.feed(html)
    t.close()
    return t.tags, " ".join(t.words)


def render(title: str, lang: str, items: list[dict]) -> str:
    """A self-contained page of evidence cards with their registry."""
    registry = {i["id"]: {"page": i["page"], "text": i["text"]} for i in items}
    data = json.dumps(registry, ensure_ascii=False, sort_keys=True)
    for ch in "<>&\u2028\u2029":
        data = data.replace(ch, f"\\u{ord(ch):04x}")
    cards = "".join(f'<article data-evidence="{escape(i["id"])}" tabindex="0" role="button"><p>{escape(i["text"])}</p></article>' for i in items)
    return (
        f'<!doctype html><html lang="{escape(lang)}"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{escape(title)}</title>'
        f'<style>@media (max-width: 700px) {{}} @media (prefers-reduced-motion: reduce) {{}}</style></head><body><a class="skip" href="#main">Skip</a><main id="main">{cards}</main>'
        f'<script type="application/json" id="registry">{data}</script></body></html>'
    )


def audit(html: str, expected: set[str] | None = None) -> list[str]:
    """The rules a page breaks, in a fixed order."""
    tags, _ = tokens(html)
    names = [t for t, _ in tags]
    has = lambda tag, key, test: any(t == tag and test(a.get(key, "")) for t, a in tags)
    found = re.search(r'<script[^>]*id="registry"[^>]*>(.*?)</script>', html, re.DOTALL)
    try:
        registry = set(json.loads(found[1])) if found else None
    except ValueError:
        registry = None
    triggers = {a["data-evidence"] for _, a in tags if "data-evidence" in a}
    rules = (
        ("no doctype", not html.lstrip().lower().startswith("<!doctype html")),
        ("no language", not any(t == "html" and a.get("lang") for t, a in tags)),
        ("no skip link", not has("a", "href", lambda v: v.startswith("#"))),
        ("no viewport", not has("meta", "name", lambda v: v == "viewport")),
        ("external script", has("script", "src", bool)),
        ("external style", any(t == "link" and "stylesheet" in a.get("rel", "") for t, a in tags)),
        ("external image", has("img", "src", lambda v: v.startswith(("http:", "https:", "//")))),
        ("image without alternative", any(t == "img" and "alt" not in a for t, a in tags)),
        ("drawing without role", any(t == "svg" and "role" not in a for t, a in tags)),
        ("script address", any(v.strip().lower().startswith("javascript:") for _, a in tags for v in a.values())),
        ("opener leak", any(t == "a" and a.get("target") == "_blank" and "noopener" not in a.get("rel", "") for t, a in tags)),
        ("trigger without keyboard", any("data-evidence" in a and t not in ("a", "button") and "tabindex" not in a for t, a in tags)),
        ("no registry", registry is None),
        ("dangling trigger", registry is not None and bool(triggers - registry)),
        ("registry differs", registry is not None and expected is not None and registry != expected),
        ("no breakpoint", "@media" not in html),
        ("motion not reduced", "prefers-reduced-motion" not in html),
        ("local path", bool(re.search(r"file://|/home/|/Users/|[A-Z]:\\\\", html))),
        ("no main part", "main" not in names),
    )
    return [name for name, broken in rules if broken]
