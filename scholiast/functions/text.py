"""String expressions over document text, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that counts as such in document text.
WS = r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Caption, heading, bibliography and formula forms.
CAPTION = rf"(?i)^(fig(?:ure)?\.?|table){WS}*([A-Z]?[0-9]+|[IVX]+){WS}*[:.\-–—]{WS}*(.*)$"
NUMBERED_HEADING = rf"^([0-9]+(?:\.[0-9]+){{0,4}})[.)]?{WS}+([^\n]{{2,120}})$"
APPENDIX_HEADING = rf"^(?:appendix(?:{WS}+[A-Z0-9])?|[A-Z](?:\.[0-9]+)*[.)]?){WS}+[A-Z][^\n]{{1,120}}$"
REFERENCE_HEADING = r"(?i)^(references|bibliography)$"
REFERENCE_START = rf"^(?:\[([0-9]{{1,4}})\]|([0-9]{{1,3}})[.)]){WS}+"
FORMULA_LABEL = r"\(([0-9]{1,4})\) *$"
HEADING_WORDS = (
    "abstract introduction background method methods methodology experiments results discussion conclusion conclusions "
    "references bibliography appendix"
).split() + ["related work"]
STRONG_MATH = ("=", "∑", "Σ", "∫", "→", "≈")
MATH = ("=", "∑", "Σ", "∫", "√", "≤", "≥", "→", "∂", "λ", "μ", "σ")
# What a reference points to.
URL = r"(?i)https?://[^\s)>\]}]+"
DOI = r"(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+"
ARXIV = r"(?i)(?:^|[^0-9])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)"
YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})"
CITATION_GROUP = r"\[([0-9]{1,4}(?: *[-,] *[0-9]{1,4})*)\]"
# Fixed value: wording by which authors announce what they contribute.
CLAIM_CUE = (
    r"(?i)\b(?:we\s+(?:propose|present|introduce|show|find|demonstrate|achieve)|our\s+(?:method|model|approach|results?)|"
    r"outperform|improv(?:e|es|ed|ement)|significant(?:ly)?|state[- ]of[- ]the[- ]art)\b"
)


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, outer white space dropped."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fingerprint(c: Column) -> Column:
    """Word characters only, case folded."""
    return F.regexp_replace(fold_case(squeeze(c)), r"[^\p{L}\p{N}\p{M}_]+", "")


def spaced_fingerprint(c: Column) -> Column:
    """Words in case-folded form parted by blanks, numeric citations left out."""
    return squeeze(F.regexp_replace(F.regexp_replace(fold_case(c), r"\[[0-9,\s-]+\]", " "), r"[^\p{L}\p{N}\p{M}_]+", " "))


def plain_title(c: Column) -> Column:
    """ASCII letters and digits parted by blanks."""
    return F.trim(F.regexp_replace(fold_case(c), "[^a-z0-9]+", " "))


def slug(c: Column, default: str = "paper") -> Column:
    s = F.regexp_replace(fold_case(c), r"[^\p{L}\p{N}]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 64)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def count_any(c: Column, marks: tuple[str, ...]) -> Column:
    """How often any of the single characters occurs."""
    return F.length(c) - F.length(F.translate(c, "".join(marks), ""))


def looks_like_formula(c: Column) -> Column:
    strong = F.translate(c, "".join(STRONG_MATH), "") != c
    labelled = c.rlike(FORMULA_LABEL) & strong
    dense = (count_any(c, MATH) >= 2) & (F.regexp_count(c, F.lit("[A-Za-z]{3,}")) <= 12)
    return (F.length(c) > 0) & (F.length(c) <= 500) & (labelled | dense)


def unclosed_formula(c: Column) -> Column:
    """An equation goes on behind an open bracket or a trailing operator, unless it bears its label."""
    s = squeeze(c)
    open_ = count_any(s, ("(", "[", "{")) > count_any(s, (")", "]", "}"))
    return ~s.rlike(FORMULA_LABEL) & (open_ | s.rlike(r"[=+\-−*/·×,(] *$"))


def role_of(text: Column, top: Column, bottom: Column, height: Column) -> Column:
    """The role of a block by its place on the page and its form."""
    s = squeeze(text)
    short = F.length(s) < 180
    return (
        F.when((top <= height * 0.055) & short, "header")
        .when((bottom >= height * 0.945) & short, "footer")
        .when(s.rlike(CAPTION), "caption")
        .when(s.rlike(REFERENCE_HEADING) | s.rlike(REFERENCE_START), "reference")
        .when(s.rlike(NUMBERED_HEADING) | s.rlike(APPENDIX_HEADING) | fold_case(s).isin(HEADING_WORDS), "heading")
        .when(looks_like_formula(s), "formula")
        .otherwise("body")
    )


def reference_number(raw: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"^\s*\[([0-9]{1,4})\]", 1), F.lit("")).cast("int"), fallback)


def reference_url(raw: Column) -> Column:
    """A reference's URL, else its DOI as a link, else its arXiv number as a link."""
    found = lambda p, g: F.nullif(F.regexp_extract(raw, p, g), F.lit(""))
    return F.coalesce(
        F.regexp_replace(found(URL, 0), "[.,;]+$", ""),
        F.concat(F.lit("https://doi.org/"), F.regexp_replace(found(DOI, 0), "[.,;]+$", "")),
        F.concat(F.lit("https://arxiv.org/abs/"), found(ARXIV, 1)),
    )


def last_year(raw: Column) -> Column:
    """The last year from 1900 to 2099 that is no part of a longer number."""
    years = F.filter(F.regexp_extract_all(F.concat(F.lit(" "), raw, F.lit(" ")), F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2}(?![0-9]))"), 1), lambda y: y != "")
    return F.try_element_at(years, F.lit(-1)).cast("int")


def cited_numbers(text: Column) -> Column:
    """Reference numbers of bracketed groups, ranges of up to 25 expanded."""
    groups = F.regexp_extract_all(text, F.lit(CITATION_GROUP), 1)

    def expand(part: Column) -> Column:
        ends = F.split(part, "-")
        lo, hi = F.trim(F.element_at(ends, 1)).cast("int"), F.trim(F.element_at(ends, -1)).cast("int")
        return F.when((hi - lo).between(0, 25), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, " *, *"))), expand))


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def source_key(c: Column) -> Column:
    """Letters and digits in lower case, line-break hyphens joined."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"-\s+", "")), r"[^\p{L}\p{N}]+", "")


def similarity(a: Column, b: Column) -> Column:
    """Containment ratio plus a half, else shared trigrams over the smaller set, of two source keys."""
    la, lb = F.length(a), F.length(b)
    inside = a.contains(b) | b.contains(a)
    ga, gb = trigrams(a), trigrams(b)
    least = F.least(F.size(ga), F.size(gb))
    shared = F.size(F.array_intersect(ga, gb))
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(inside, F.least(la, lb) / F.greatest(la, lb) + 0.5)
        .when(least == 0, F.lit(0.0))
        .otherwise(shared / least)
    )


def short_title(c: Column, limit: int = 88) -> Column:
    """The first clause, cut at a word and marked where it is longer than the limit."""
    s = squeeze(c)
    clause = F.element_at(F.split(s, r"(?<=[。！？!?])\s+|\s*[;；]\s*"), 1)
    cut = F.substring(clause, 1, limit)
    head = F.regexp_replace(cut, r" [^ ]*$", "")
    head = F.regexp_replace(F.when(F.length(head) > 0, head).otherwise(cut), "[ ,，:：;；]+$", "")
    return F.when(F.length(s) == 0, F.lit(None).cast("string")).when(F.length(clause) <= limit, clause).otherwise(F.concat(head, F.lit("…")))


def complete_sentence(c: Column) -> Column:
    """A summary as a sentence with a final mark; null where it is too short or breaks off."""
    s = F.rtrim(F.substring(F.trim(c), 1, 1200))
    dangling = s.rlike(r"(…|\.\.\.|-|—|:|;|,)$")
    closed = s.rlike("[.!?。！？][\"'”’]? *$")
    return F.when((F.length(s) >= 20) & ~dangling, F.when(closed, s).otherwise(F.concat(s, F.lit(".")))).otherwise(F.lit(None).cast("string"))


def page_link(url: Column, page: Column) -> Column:
    mark = F.when(F.contains(url, F.lit("#")), "&").otherwise("#")
    return F.concat(F.coalesce(url, F.lit("")), F.coalesce(mark, F.lit("#")), F.lit("page="), F.greatest(page, F.lit(1)).cast("string"))


SECRET_KEYS = ("token", "key", "api_key", "apikey", "access_token", "secret", "signature", "sig", "password", "auth")


def safe_url(url: Column) -> Column:
    """A URL without user information and fragment, values of secret-bearing keys masked."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^([a-zA-Z]+://)[^/@]*@", "$1")
    return F.regexp_replace(bare, rf"(?i)([?&](?:{'|'.join(SECRET_KEYS)})=)[^&]*", "$1REDACTED")


def script_safe(json: Column) -> Column:
    """JSON that cannot end the script element it stands in."""
    for ch, esc in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        json = F.replace(json, F.lit(ch), F.lit(esc))
    return json


def redact(m: Column) -> Column:
    """A map whose values under secret-bearing keys are masked."""
    return F.transform_values(m, lambda k, v: F.when(F.upper(k).rlike("KEY|TOKEN|SECRET|PASSWORD"), F.lit("***")).otherwise(v))
