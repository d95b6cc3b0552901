"""Visually identical text with different characters, brought to one form.

The form of a text is computed by one SQL expression that DuckDB runs inside the Arrow
batches of each partition: compatibility forms and look-alike letters are mapped with
translate and replace, invisible characters and line ends with regular expressions, and
the result is composed by nfc_normalize. Two texts have one form exactly when they look
the same in print: the width of letters and blanks does not count, while case, accents,
raised or lowered digits, dash length, line breaks and the number of blanks do.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.runtime import materialize, spread, table

# Letters that print like a Latin letter, grouped by script, and their Latin twins.
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТХԚԜаеѕіјорсухһԁԛԝӏё", "ABESIJKMHOPCTXQWaesijopcyxhdqwlë"),
    ("ЀЁЇѐї", "ÈËÏèï"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳόΆΈΉΊΌΎΪΫ", "ABEZHIKMNOPTYXovcjóÁÉH́ÍÓÝÏŸ"),
    ("օᎪᎠᎬᎻᎫᏦᏞᎷᏢᎢᏙᎳᏃɑ", "oADEHJKLMPTVWZa"),
)
# Marks that print alike.
MARKS = (("‐‑ʼµ", "--’μ"),)
# Characters without a mark of their own in print.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
# Joiners, and the scripts whose letters take another shape beside them (Arabic to Mongolian; Indic).
JOINERS = r"[\x{200C}\x{200D}]"
JOINING = r"\x{0600}-\x{08FF}\x{0900}-\x{0DFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1800}-\x{18AF}\x{A840}-\x{A87F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\r\x{0085}\x{2028}\x{2029}]"
# Decomposition kinds that change only the width or the joining form of a letter.
WIDTH_KINDS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
LIGATURES = range(0xFB00, 0xFB07)
# Roman numerals that print like letters, and ligatures of whole words, which print like no letters.
NUMERALS = range(0x2160, 0x2180)
WORD_LIGATURES = range(0xFDFA, 0xFDFE)


@lru_cache(1)
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """One-to-one and one-to-many replacements, from the tables above and the character database."""
    one: dict[str, str] = dict.fromkeys(BLANKS, " ")
    many: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if (kind in WIDTH_KINDS or cp in LIGATURES or cp in NUMERALS) and cp not in WORD_LIGATURES:
            to = unicodedata.normalize("NFKC", chr(cp)) if cp in LIGATURES or cp in NUMERALS else "".join(chr(int(x, 16)) for x in rest.split())
            (one if len(to) == 1 else many)[chr(cp)] = to
    for alike, twins in LOOKALIKES + MARKS:
        pairs = unicodedata.normalize("NFC", twins)
        if len(pairs) == len(alike):
            one.update(zip(alike, pairs))
        else:  # a twin written with a combining accent
            k = 0
            for ch in alike:
                end = k + 1
                while end < len(pairs) and unicodedata.combining(pairs[end]):
                    end += 1
                (one if end == k + 1 else many)[ch] = pairs[k:end]
                k = end
    one = {a: (one.get(b, b)) for a, b in one.items()}
    return one, {a: "".join(one.get(c, c) for c in b) for a, b in many.items()}


def form_sql(column: str) -> str:
    """The DuckDB expression for the form of a text column.

    Joiners vanish except between letters of scripts that they give another shape. The
    chain of one-to-many replacements runs only on texts that hold a character of it.
    """
    one, many = mappings()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace({column}, {quote(INVISIBLE)}, '', 'g')"
    loose = f"regexp_replace(regexp_replace(y, {quote(f'(^|[^{JOINING}]){JOINERS}+')}, '\\1', 'g'), {quote(f'{JOINERS}+([^{JOINING}]|$)')}, '\\1', 'g')"
    x = f"list_transform([{x}], lambda y: CASE WHEN regexp_matches(y, {quote(JOINERS)}) THEN {loose} ELSE y END)[1]"
    x = f"nfc_normalize(regexp_replace({x}, {quote(LINE_ENDS)}, chr(10), 'g'))"
    chain = "y"
    for ch, to in many.items():
        chain = f"replace({chain}, {quote(ch)}, {quote(to)})"
    held = "[" + "".join(f"\\x{{{ord(ch):X}}}" for ch in many) + "]"
    x = f"list_transform([{x}], lambda y: CASE WHEN regexp_matches(y, {quote(held)}) THEN {chain} ELSE y END)[1]"
    x = f"translate({x}, {quote(''.join(one))}, {quote(''.join(one.values()))})"
    return f"nfc_normalize({x})"


def with_form(df: DataFrame, text: str, form: str) -> DataFrame:
    """Add the form of a text column; a null text has a null form, an empty one an empty form.

    A column that bears the new name already is replaced.
    """
    df = df.drop(form)
    schema = df.withColumn(form, F.lit(None).cast("string")).schema
    sql = f"SELECT *, {form_sql(chr(34) + text + chr(34))} AS \"{form}\" FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                out = con.execute(sql).to_arrow_table().cast(pa.schema([*b.schema, pa.field(form, pa.string())]))
                con.unregister("batch")
                yield from out.to_batches()

    return df.mapInArrow(run, schema)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, scope, key, text: the texts to compare."""
    blocks = table(spark, sf_dir, "blocks").select(
        F.lit("blocks").alias("source_table"), F.col("paper_id").alias("scope"), F.concat("paper_id", F.lit("/"), "block_id").alias("key"), "text"
    )
    titles = table(spark, sf_dir, "metadata").select(
        F.lit("metadata").alias("source_table"), F.lit("").alias("scope"), F.col("record_id").alias("key"), F.col("title").alias("text")
    )
    return blocks.unionByName(titles).where("text is not null and key is not null")


def pairs_of_one_form(rows: DataFrame, group: list[str], key: str, text: Column, form: Column, chunk: int = 500) -> DataFrame:
    """Pairs of keys whose forms agree while their texts differ, the smaller key first.

    Rows are reduced to digests first, repeated rows of a key to one, which are written once and read by each join. Equal texts of a group become one variant, cut into
    chunks of about `chunk` keys, and only chunks of different variants meet, so a group
    of copies of any size yields no pair of equal texts and is shared out among tasks.
    """
    d = materialize(rows.select(*group, F.col(key).alias("key"), F.md5(F.encode(form, "UTF-8")).alias("f"), F.md5(F.encode(text, "UTF-8")).alias("t")).dropDuplicates([*group, "key"]))
    by = [*group, "f"]
    several = d.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").drop("lo", "hi")
    members = d.join(several, by).withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / chunk)))
    variants = members.groupBy(*by, "t", "part").agg(F.collect_list("key").alias("keys"))
    left, right = variants.drop("part").withColumnRenamed("keys", "ka"), variants.drop("part").withColumnRenamed("keys", "kb").withColumnRenamed("t", "u")
    met = left.join(right, by).where("t < u")
    return met.select(*group, F.explode("ka").alias("x"), "kb").select(*group, "x", F.explode("kb").alias("y")).select(
        *group, F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = with_form(spread(texts(spark, sf_dir)), "text", "form")
    return pairs_of_one_form(formed, ["source_table", "scope"], "key", F.col("text"), F.col("form")).select("source_table", "key_a", "key_b")


def p1_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block text and title in its one form."""
    return with_form(spread(texts(spark, sf_dir)), "text", "form").select("source_table", "key", "form").distinct()


def letterwise_sql(column: str) -> tuple[str, str]:
    """The form of a text letter by letter through one map, for the check of form_sql: letters are told by their names, not by their decompositions."""
    told = {" ": " "}
    for cp in range(0x80, sys.maxunicode + 1):
        name = unicodedata.name(chr(cp), "")
        word = name.split(" ")
        wide = word[0] in ("FULLWIDTH", "HALFWIDTH") or name == "IDEOGRAPHIC SPACE"
        joined = word[0] == "ARABIC" and word[-1] == "FORM" and cp not in WORD_LIGATURES
        letters = word[:3] == ["LATIN", "SMALL", "LIGATURE"] and 0xFB00 <= cp < 0xFB07
        numeral = word[:2] in (["ROMAN", "NUMERAL"], ["SMALL", "ROMAN"]) and cp < 0x2180
        blank = unicodedata.category(chr(cp)) == "Zs"
        if wide or joined or letters or numeral or blank:
            told[chr(cp)] = " " if blank else unicodedata.normalize("NFKC", chr(cp))
    one, many = mappings()
    # what the names do not tell: twins in other scripts, and marks
    told |= {a: b for a, b in (one | many).items() if a not in told and a in "".join(x for x, _ in LOOKALIKES + MARKS)}
    told = {a: "".join(told.get(c, c) for c in b) for a, b in told.items()}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    letters = f"MAP {{{', '.join(f'{quote(a)}: {quote(b)}' for a, b in told.items())}}}"
    gone = f"regexp_matches(c, {quote(INVISIBLE)})"
    clean = f"array_to_string(list_filter(string_split({column}, ''), lambda c: NOT {gone}), '')"
    # a joiner is kept where the nearest other characters on both sides are joining letters
    parts = f"regexp_extract_all({clean}, {quote(f'{JOINERS}+|[^{JOINERS[1:-1]}]+')})"
    kept = (
        f"list_transform({parts}, lambda p, i: CASE WHEN NOT regexp_matches(p, {quote(JOINERS)}) THEN p WHEN i > 1 AND i < len({parts}) "
        f"AND regexp_matches(right({parts}[i - 1], 1), {quote(f'[{JOINING}]')}) AND regexp_matches(left({parts}[i + 1], 1), {quote(f'[{JOINING}]')}) THEN p ELSE '' END)"
    )
    lines = f"regexp_replace(array_to_string({kept}, ''), {quote(LINE_ENDS)}, chr(10), 'g')"
    return f"nfc_normalize(array_to_string(list_transform(string_split(nfc_normalize({lines}), ''), lambda c: coalesce(l[c], c)), ''))", letters


_LETTERWISE, _LETTERS = letterwise_sql("text")
P1_FORM_SQL = f"""
WITH m AS MATERIALIZED (SELECT {_LETTERS} AS l),
t AS (SELECT 'blocks' AS source_table, paper_id || '/' || block_id AS key, text FROM blocks UNION ALL SELECT 'metadata', record_id, title FROM metadata)
SELECT DISTINCT source_table, key, CASE WHEN text = '' THEN '' ELSE {_LETTERWISE} END AS form FROM t, m WHERE text IS NOT NULL AND key IS NOT NULL"""
