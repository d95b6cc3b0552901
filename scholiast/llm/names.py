"""Variant spellings of the names of people and organisations, linked by star clustering.

Every distinct spelling is parsed into a kind, a key part (the family name of a person,
the place or last part of an organisation) and its other parts. Which of two unmarked
parts is the family name, and which given names go by which nicknames, is learned from
the spellings of the whole corpus that show it (a comma, capitals, a quoted nickname).
Spellings with the same parts collapse into one representative, so copies cost nothing.
Key parts are compared through MinHash bands over their padded q-grams; the numbers of
bands and rows follow from the collision curve and the recall asked for. Representatives
whose key parts agree or nearly agree are verified by Monge-Elkan similarity over their
parts. Star clustering then makes the best connected full spellings the centres.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions.packed import _ORG, _is_org
from scholiast.operators.packed_values import author_values
from scholiast.runtime import kept, parallel, table

# Letters that a decomposition does not reduce to a base letter.
BASE_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "ð": "d", "þ": "th"})
# Titles and suffixes that are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms sir dame phd md jr sr ii iii iv dipl ing".split())
# Words of an organisation's name that its acronym leaves out.
SMALL_WORDS = frozenset("the of for and de la le du des für und pour et para y".split())
# Common nicknames and the given names they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "ana": "anastasia", "andy": "andrew", "annie": "anna", "ben": "benjamin", "beth": "elizabeth",
    "bill": "william", "bob": "robert", "cathy": "catherine", "chris": "christopher christina", "dan": "daniel", "dave": "david",
    "dick": "richard", "ed": "edward", "fran": "francisco francis", "fred": "frederick", "gus": "gustav", "hanna": "johanna",
    "hans": "johannes", "jack": "john", "jim": "james", "joe": "joseph", "kate": "katherine", "kolya": "nikolai", "liz": "elizabeth",
    "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "max": "maximilian", "mike": "michael", "nell": "eleanor",
    "nick": "nicholas", "paco": "francisco", "peggy": "margaret", "pepe": "josé jose", "pete": "peter", "rik": "henrik",
    "sam": "samuel", "sasha": "alexander alexandra", "steve": "steven", "sue": "susan susanna", "ted": "theodore edward",
    "thea": "dorothea", "tom": "thomas", "tony": "anthony", "vicky": "victoria", "will": "william",
}
_QUOTED = re.compile(r"[\"“”'‘]([^\"“”]{2,20})[\"”’]|\(([^()\s]{2,15})\)")


def fold(s: str) -> str:
    """Letters without accents, width and joining forms, case kept."""
    s = unicodedata.normalize("NFKD", s.translate(BASE_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _words(s: str) -> list[str]:
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", s)
    return [w for w in re.split(r"[\s.]+", s) if w.strip("-")]


def roles(spelling: str) -> dict:
    """What a spelling itself says: organisation or person, family and given parts, nickname, open pairs.

    Returns kind 'org' with parts, or 'person' with family/given when marked by a comma,
    capitals or initials, else with `open` parts whose roles the corpus must tell.
    """
    text = fold(spelling).strip()
    if _is_org(text):
        return {"kind": "org", "text": text}
    nick = None
    if m := _QUOTED.search(text):
        nick = (m[1] or m[2]).strip().lower()
        text = (text[: m.start()] + " " + text[m.end():]).strip()
    head, comma, tail = text.partition(",")
    words = [w for w in _words(head) if w.lower().strip("-") not in TITLES]
    if comma:
        given = [w for w in _words(tail) if w.lower() not in TITLES]
        if given or len(words) < 2:
            return {"kind": "person", "family": words, "given": given, "nick": nick}
    if len(words) < 2:
        return {"kind": "person", "family": words, "given": [], "nick": nick}
    if re.fullmatch(r"[A-Z]{1,4}", words[-1]) and not re.fullmatch(r"[A-Z]{1,4}", words[0]):
        return {"kind": "person", "family": words[:-1], "given": list(words[-1]), "nick": nick}
    # up to five capitals in front are an acronym
    caps = [w for k, w in enumerate(words) if len(w) > (5 if k == 0 else 3) and w.isupper()]
    if caps and len(caps) < len([w for w in words if len(w) > 1]):
        return {"kind": "person", "family": caps, "given": [w for w in words if w not in caps], "nick": nick}
    initial = [len(w.replace("-", "")) <= 2 and w[0].isupper() for w in words]
    if initial[0] or any(initial[1:-1]):
        return {"kind": "person", "family": words[-1:], "given": words[:-1], "nick": nick}
    return {"kind": "person", "open": words, "nick": nick}


def _given_parts(words: list[str]) -> list[str]:
    """Given parts in lower case; a run of capitals with no vowel pattern is a run of initials."""
    out = []
    for w in words:
        for part in w.split("-"):
            if part:
                out.extend(part.lower() if re.fullmatch(r"[A-Z]{2,3}", part) and len(words) == 1 else [part.lower()])
    return out


def parse(spelling: str, given_share: dict[str, float]) -> tuple[str, str, str]:
    """(kind, key part, other parts as JSON) of a spelling; given_share tells how often a part is a given name."""
    r = roles(spelling)
    if r["kind"] == "org":
        return _parse_org(r["text"])
    if "open" in r:
        words = r["open"]
        first, last = (given_share.get(w.lower(), d) for w, d in ((words[0], 0.6), (words[-1], 0.4)))
        r |= {"family": words[:1], "given": words[1:]} if last > first else {"family": words[-1:], "given": words[:-1]}
    family, given = r["family"], r["given"]
    if len(given) == 1 and re.fullmatch(r"[A-Z]{3,5}", given[0]) and len(family) == 1:
        return "org", family[0].lower(), json.dumps([given[0].lower()])
    if len(family) == 2 and not given and re.fullmatch(r"[A-Z]{3,5}", family[0]):
        return "org", family[1].lower(), json.dumps([family[0].lower()])
    return "person", "".join(w.lower().replace("-", "") for w in family), json.dumps(_given_parts(given) or ([r["nick"]] if r["nick"] else []))


def _parse_org(text: str) -> tuple[str, str, str]:
    text = re.sub(r"^the\s+", "", text.strip(), flags=re.IGNORECASE)
    place = ""
    if m := re.search(r"\(([^()]+)\)\s*$|,\s*([^,]+)$|\s[-–—]\s+(\S+)$", text):
        place, text = next(g for g in m.groups() if g), text[: m.start()]
    words = re.findall(r"[^\W\d_]+", text)
    if not place and (m := _ORG.search(text)) and m.start() > 0:
        lead = re.findall(r"[^\W\d_]+", text[: m.start()])
        place, words = " ".join(lead), words[len(lead):]
    if not place and len(words) > 3:
        place, words = words[-1], words[:-1]
    words = [w.lower() for w in words if w.lower() not in SMALL_WORDS]
    place = "".join(re.findall(r"[^\W\d_]+", place.lower())) or (words[-1] if words else text.lower())
    return "org", place, json.dumps(["".join(w[0] for w in words), *words])


def edits(a: str, b: str, limit: int = 2) -> int:
    """Edit distance with transpositions, or limit + 1 beyond the limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
        if min(last) > limit:
            return limit + 1
    return last[-1]


def key_alike(a: str, b: str) -> bool:
    """Whether two key parts may be one part and its typo; parts of four letters may only have two letters swapped."""
    short = min(len(a), len(b))
    return a == b or (edits(a, b, 1) <= 1 and (short >= 5 or (short == 4 and sorted(a) == sorted(b))))


def _part(a: str, b: str, formal: dict[str, set[str]], later: bool = False) -> float:
    """Similarity of two given parts: equal, initial, nickname, typo."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.97 if a[0] == b[0] or (len(b) > 1 and any(f[0] == a for f in formal.get(b, ()))) or (len(a) > 1 and any(f[0] == b for f in formal.get(a, ()))) else 0.0
    fa, fb = {a, *formal.get(a, ())}, {b, *formal.get(b, ())}
    if fa & fb:
        return 0.98
    if any(_typo(x, y) for x in fa for y in fb):
        return 0.9
    return 0.85 if later and edits(a, b, 1) <= 1 and max(len(a), len(b)) >= 3 else 0.0


def _typo(a: str, b: str) -> bool:
    """One slip between two given parts; parts of three letters may only gain or lose one."""
    n = min(len(a), len(b))
    return (n >= 4 or (n == 3 and len(a) != len(b))) and edits(a, b, 1) <= 1


def monge_elkan(kind: str, key_a: str, a: list[str], key_b: str, b: list[str], formal: dict[str, set[str]] | None = None) -> float:
    """Monge-Elkan similarity of two parsed names: the mean, over the parts of the one with fewer, of the best match.

    Given parts keep their order; a part that matches nothing in its place makes the names different (0).
    """
    formal = formal or {}
    near = 1.0 if key_a == key_b else 1 - edits(key_a, key_b, 2) / max(len(key_a), len(key_b))
    if kind == "org":
        if a[:1] != b[:1]:
            return 0.0
        a, b = a[1:], b[1:]
        if not a or not b:
            return (near + 1) / 2
        short, long = sorted((a, b), key=len)
        best = [max(1.0 if x.startswith(y) or y.startswith(x) or x[0] == y[0] and min(len(x), len(y)) <= 4 else 1 - edits(x, y, 3) / max(len(x), len(y)) for y in long) for x in short]
        return (near + sum(best)) / (1 + len(best)) if min(best) >= 0.5 else 0.0
    short, long = sorted((a, b), key=lambda p: (len(p), p))
    if not short:
        return 0.0
    scores, j = [], 0
    for i, x in enumerate(short):
        s = _part(x, long[j], formal, i > 0) if j < len(long) else 0.0
        if s == 0.0 and i and j + 1 < len(long):  # initials may leave out the second half of a double name
            j += 1
            s = _part(x, long[j], formal, True)
        if s == 0.0:
            return 0.0
        scores.append(s)
        j += 1
    return (near + sum(scores)) / (1 + len(scores))


def bands_for(similarity: float, recall: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose collision curve reaches the recall at the similarity."""
    best = (permutations, 1)
    for rows in range(1, 9):
        for bands in range(1, permutations // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def padded_grams(part: str, q: int = 2) -> set[str]:
    s = "#" * (q - 1) + part + "#" * (q - 1)
    return {s[i : i + q] for i in range(len(s) - q + 1)}


def slip_forms(part: str) -> list[str]:
    """Forms of which two parts one edit apart share at least one, whatever their lengths."""
    n = len(part)
    forms = {part} | {part[:k] + part[k + 1 :] for k in range(n)} if n <= 20 else set()
    return sorted(forms | ({part[:8] + "-", "-" + part[-8:]} if n >= 20 else set()))


def alike_keys(keys: DataFrame, similarity: float = 0.55, recall: float = 0.99, permutations: int = 128) -> DataFrame:
    """Pairs key < key2 of distinct key parts that are one edit apart, found through MinHash bands and forms with one letter left out.

    The banding reaches the recall at the similarity of padded bigrams, but a part of five
    letters and its transposition share a third only. Parts one edit apart always share a
    form with one letter left out; those of twenty letters or more, of which no edit touches
    both ends, their first or last eight letters. Only distinct parts enter, so a part that a third of
    all names carry is one row. Two parts that differ by another letter and are both
    well attested (n spellings each) are two parts, not a part and its typo, nor are two of
    four letters that differ by a swap.
    """
    bands, rows = bands_for(similarity, recall, permutations)
    keys = kept(keys)
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 2**61 - 1, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**61 - 1, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for df in batches:
            out_key, out_band, out_hash = [], [], []
            for key in df["key"]:
                h = np.array([xxhash.xxh64_intdigest(g) for g in padded_grams(key)], dtype=np.uint64)
                sig = ((h[:, None] * mul + add) >> np.uint64(3)).min(axis=0).reshape(bands, rows)
                out_key.extend([key] * bands)
                out_band.extend(range(bands))
                out_hash.extend(xxhash.xxh64_intdigest(row.tobytes()) - 2**63 for row in sig)
                forms = slip_forms(key)
                out_key.extend([key] * len(forms))
                out_band.extend([-1] * len(forms))
                out_hash.extend(xxhash.xxh64_intdigest(f) - 2**63 for f in forms)
            yield pd.DataFrame({"key": out_key, "band": out_band, "h": out_hash}, dtype=object)

    banded = parallel(keys.where(F.length("key") >= 4)).mapInPandas(run, "key string, band int, h long")
    met = banded.join(banded.withColumnRenamed("key", "key2"), ["band", "h"]).where("key < key2 and abs(length(key) - length(key2)) <= 1").select("key", "key2").distinct()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([key_alike(x, y) for x, y in zip(a, b)])

    near_pairs = parallel(met).where(near("key", "key2"))
    a, b = keys.select("key", F.col("n").alias("na")), keys.select(F.col("key").alias("key2"), F.col("n").alias("nb"))
    rare = F.least("na", "nb")
    swapped = (F.array_sort(F.split("key", "")) == F.array_sort(F.split("key2", ""))) & (F.length("key") >= 5)
    return near_pairs.join(a, "key").join(b, "key2").where((F.length("key") != F.length("key2")) | swapped | (rare == 1) | (rare * 3 <= F.greatest("na", "nb"))).select("key", "key2")


def representatives(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spelling -> rep, rep -> kind, key, parts, formal names, size) of distinct spellings (name)."""

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for name in df["name"]:
                r = roles(name)
                if r["kind"] != "person":
                    continue
                if "open" in r:
                    out += [(r["open"][0].lower(), 0.2, 0.0, None), (r["open"][-1].lower(), 0.0, 0.2, None)]
                    given = r["open"][0].lower()
                else:
                    out += [(w.lower(), 0.0, 1.0, None) for w in r["family"] if len(w) > 2]
                    out += [(w.lower(), 1.0, 0.0, None) for w in r["given"] if len(w) > 2]
                    given = r["given"][0].lower() if r["given"] else ""
                if r["nick"] and len(given) > 1 and given != r["nick"]:
                    out.append((r["nick"], 1.0, 0.0, given))
            yield pd.DataFrame(out, columns=["part", "g", "f", "formal"], dtype=object)

    told = spellings.mapInPandas(evidence, "part string, g double, f double, formal string")
    told = told.groupBy("part").agg((F.sum("g") / F.sum(F.col("g") + F.col("f"))).alias("share"), F.collect_set("formal").alias("formal"))

    @F.pandas_udf("array<string>")
    def parts_of(names: pd.Series) -> pd.Series:
        return pd.Series([sorted({p for w in _words(fold(n).replace(",", " ").replace('"', " ")) for p in (w.lower(), *w.lower().split("-")) if len(p) > 2}) for n in names])

    asked = spellings.select("name", F.explode_outer(parts_of("name")).alias("part")).join(told.hint("merge"), "part", "left")
    facts = asked.groupBy("name").agg(F.collect_list(F.when(F.col("share").isNotNull(), F.struct("part", "share", "formal"))).alias("facts"))

    @F.pandas_udf("kind string, key string, parts string, formal string")
    def parsed(names: pd.Series, facts: pd.Series) -> pd.DataFrame:
        out = []
        for name, known in zip(names, facts):
            kind, key, parts = parse(name, {x["part"]: x["share"] for x in known})
            own = json.loads(parts)
            formal = {x["part"]: sorted(x["formal"]) for x in known if x["part"] in own and len(x["formal"])}
            for p in own:
                if p in NICKNAMES:
                    formal[p] = sorted({*formal.get(p, ()), *NICKNAMES[p].split()})
            out.append((kind, key, parts, json.dumps(formal, sort_keys=True)))
        return pd.DataFrame(out, columns=["kind", "key", "parts", "formal"], dtype=object)

    rows = facts.select("name", parsed("name", "facts").alias("p")).select("name", "p.*").where("length(key) > 0")
    rows = kept(rows.withColumn("rep", F.xxhash64("kind", "key", "parts")))
    reps = rows.groupBy("rep").agg(F.first("kind").alias("kind"), F.first("key").alias("key"), F.first("parts").alias("parts"), F.first("formal").alias("formal"), F.count(F.lit(1)).alias("size"))
    return rows.select("name", "rep"), reps


def first_keys(kind: str, parts: list[str], formal: dict[str, list[str]]) -> list[str]:
    """Keys under which a representative meets others that may be the same.

    An organisation has its acronym. A person has the initials of the first given part and
    of what it stands for; a written-out part also has itself and each form with one letter
    left out, so that two parts one slip apart share a key without any pair of a group
    being formed.
    """
    if not parts or not parts[0]:
        return []
    if kind == "org":
        return ["o:" + parts[0]]
    names = {parts[0], *formal.get(parts[0], ())}
    keys = {"i:" + n[0] for n in names if n}
    for n in names:
        if len(n) > 1:
            keys |= {"d:" + n} | {"d:" + n[:k] + n[k + 1 :] for k in range(len(n))}
    return sorted(keys)


def links(reps: DataFrame, threshold: float = 0.91) -> DataFrame:
    """Verified pairs a < b of representatives with their similarity."""

    @F.pandas_udf("array<string>")
    def starts(kind: pd.Series, parts: pd.Series, formal: pd.Series) -> pd.Series:
        return pd.Series([first_keys(k, json.loads(p), json.loads(f)) for k, p, f in zip(kind, parts, formal)])

    rows = kept(reps.select("rep", "kind", "key", F.explode(starts("kind", "parts", "formal")).alias("start"), F.expr("kind = 'person' and length(from_json(parts, 'array<string>')[0]) = 1").alias("short")))
    keys = reps.groupBy("key").agg(F.sum("size").alias("n"))
    near = alike_keys(keys)
    met = keys.select("key", F.col("key").alias("key2")).unionByName(near).unionByName(near.select(F.col("key2").alias("key"), F.col("key").alias("key2")))
    a = rows.select("key", "kind", "start", F.col("rep").alias("rep_a"), F.col("short").alias("short_a")).join(met, "key")
    b = rows.select(F.col("key").alias("key2"), "kind", "start", F.col("rep").alias("rep_b"))
    # an initial meets all given names with it; two given names meet only where they are alike
    met_reps = a.where(F.col("short_a") | ~F.startswith("start", F.lit("i:"))).join(b, ["key2", "kind", "start"]).where("rep_a <> rep_b")
    ids = met_reps.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    told = reps.select("rep", "kind", "key", "parts", "formal")
    pairs = ids.join(told.select(F.col("rep").alias("rep_a"), "kind", "key", F.col("parts").alias("parts_a"), F.col("formal").alias("formal_a")), "rep_a")
    pairs = pairs.join(told.select(F.col("rep").alias("rep_b"), F.col("key").alias("key2"), F.col("parts").alias("parts_b"), F.col("formal").alias("formal_b")), "rep_b")

    @F.pandas_udf("double")
    def similarity(kind: pd.Series, ka: pd.Series, pa: pd.Series, fa: pd.Series, kb: pd.Series, pb: pd.Series, fb: pd.Series) -> pd.Series:
        out = []
        for k, x, p, f, y, q, g in zip(kind, ka, pa, fa, kb, pb, fb):
            formal = {n: set(v) for d in (json.loads(f), json.loads(g)) for n, v in d.items()}
            out.append(monge_elkan(k, x, json.loads(p), y, json.loads(q), formal))
        return pd.Series(out)

    scored = parallel(pairs).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), similarity("kind", "key", "parts_a", "formal_a", "key2", "parts_b", "formal_b").alias("sim"))
    return scored.where(F.col("sim") >= threshold)


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, centre): centres are the nodes that outrank all neighbours still free; others join their most similar centre.

    Ranks are degrees, full spellings first, so stars form in parallel rounds; the rounds
    end when no node with a free neighbour is left. Nodes left without one have no row: they
    are their own centres. Two nodes of one star need not be alike, only like their centre.
    """
    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    ranked = nodes.join(degree, nodes["rep"] == degree["a"]).select("rep", F.struct("full", (F.col("degree") + F.col("size")).alias("d"), "rep").alias("rank"))
    free = both.join(ranked.select(F.col("rep").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("rep").alias("b"), F.col("rank").alias("rank_b")), "b")
    free = kept(free)
    done = None
    while not free.isEmpty():
        best = free.groupBy("a").agg(F.max("rank_b").alias("top"), F.first("rank_a").alias("rank_a"))
        centres = best.where("rank_a > top").select("a")
        joined = free.join(centres, "a").groupBy("b").agg(F.max_by("a", F.struct("sim", "rank_a")).alias("centre"))
        step = joined.select(F.col("b").alias("rep"), "centre").unionByName(centres.select(F.col("a").alias("rep"), F.col("a").alias("centre")))
        step = kept(step)
        done = step if done is None else done.unionByName(step)
        gone = step.select("rep")
        free = kept(free.join(gone.withColumnRenamed("rep", "a"), "a", "left_anti").join(gone.withColumnRenamed("rep", "b"), "b", "left_anti"))
    return done if done is not None else nodes.select("rep", F.col("rep").alias("centre")).limit(0)


def name_clusters(spellings: DataFrame) -> DataFrame:
    """(name, cluster) for every distinct spelling; null, empty and blank names have no row."""
    names, reps = representatives(parallel(spellings))
    full = F.expr("kind = 'org' or exists(from_json(parts, 'array<string>'), x -> length(x) > 1)")
    clusters = star_clusters(reps.withColumn("full", full), links(reps))
    return names.join(clusters, "rep", "left").select("name", F.coalesce("centre", "rep").alias("cluster"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of an author with the id of its cluster."""
    return name_clusters(author_values(table(spark, sf_dir, "metadata")).select(F.col("item").alias("name")).distinct())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept(p3_clusters(spark, sf_dir))
    return (
        c.select(F.col("name").alias("name_a"), "cluster").join(c.select(F.col("name").alias("name_b"), "cluster"), "cluster").where("name_a < name_b").select("name_a", "name_b")
    )
