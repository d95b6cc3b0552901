import itertools
import random
import unicodedata

import duckdb
import pytest

from scholiast.llm.lookalike import form_sql, p1_form, p1_found, with_form


@pytest.fixture(scope="module")
def form():
    con = duckdb.connect()
    return lambda s: con.execute(f"select {form_sql('x')} from (select ? as x)", [s]).fetchone()[0]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ａｂ１", "Ab1"), ("a b", "a b"), ("a　b", "a b"), ("é", "é"), ("a​b", "ab"), ("со", "co"), ("ΑΒ", "AB"), ("ﬁne", "fine"), ("ｶﾞ", "ガ"), ("a\r\nb", "a\nb"),
        ("x‑y", "x-y"), ("Ω", "Ω"), ("co­op", "coop"), ("Ё", "Ë"), ("ё", "ë"), ("ﺳ", "س"), ("  ", "  "),
    ],
)
def test_alike(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("e", "é"), ("x²", "x2"), ("a-b", "a–b"), ("a–b", "a—b"), ("a b", "a  b"), ("a b", "a\nb"), ("a b", "ab"), ("α", "a"), ("①", "1"), ("ß", "ss"), ("к", "k"), ("\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\u0645\u06cc\u062e\u0648\u0627\u0647\u0645"), ("\ufdfa", "\u0635\u0644\u0649")])
def test_different(form, a, b):
    assert form(a) != form(b)


def test_form_is_stable(form):
    r = random.Random(1)
    pool = [chr(c) for c in itertools.chain(range(32, 1300), range(0x2000, 0x2070), range(0xFB00, 0xFB07), range(0xFF00, 0xFFEF)) if unicodedata.category(chr(c)) not in ("Cs", "Cc")]
    for _ in range(300):
        s = "".join(r.choices(pool, k=20))
        assert form(form(s)) == form(s)


BLOCKS = "paper_id string, block_id string, text string, form string, n int"


def brute(rows, form):
    seen = {(p, b): t for p, b, t, *_ in rows if t is not None and p and b}
    out = set()
    for (ka, ta), (kb, tb) in itertools.combinations(sorted(seen.items()), 2):
        if ka[0] == kb[0] and ta != tb and form(ta) == form(tb):
            a, b = sorted(("/".join(ka), "/".join(kb)))
            out.add(("blocks", a, b))
    return out


def test_pairs_against_brute_force(spark, tables, form):
    r = random.Random(2)
    base = ["a b", "a b", "A b", "Аb", "Ab", "", " ", None, "é", "é", "x" * 20000, "ｘ" * 20000]
    rows = [(r.choice("pq"), f"block:{k}", r.choice(base), "clash", 1) for k in range(120)]
    rows += rows[:30] + [(None, "block:1", "a b", "", 1), ("p", None, "a b", "", 1)]
    sf = tables(blocks=(rows, BLOCKS))
    assert {tuple(x) for x in p1_found(spark, sf).collect()} == brute(rows, form)


def test_records_and_empty(spark, tables):
    assert p1_found(spark, tables()).count() == 0
    rows = [("r1", "Peat"), ("r2", "Рeat"), ("r3", None), ("r4", "Pe­at"), ("r4", "Pe­at"), (None, "Peat")]
    sf = tables(metadata=(rows, "record_id string, title string"))
    assert {tuple(x) for x in p1_found(spark, sf).collect()} == {("metadata", "r1", "r2"), ("metadata", "r1", "r4"), ("metadata", "r2", "r4")}
    assert p1_form(spark, sf).where("key = 'r4'").count() == 1


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("Ａ", None)], "text string, form string")
    assert [r.form for r in with_form(df, "text", "form").collect()] == [None, "", "A"]
