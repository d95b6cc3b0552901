import pytest
from hypothesis import given
from hypothesis import strategies as st

from scholiast.functions.packed import split_entries, split_names
from scholiast.operators.packed_values import author_values, p6_found

NAMES = [
    ("A. Ray; B. Lee", ["A. Ray", "B. Lee"]),
    ("Ray, Ann; Lee, Bo", ["Ray, Ann", "Lee, Bo"]),
    ("Ann Ray, Bo Lee and Cy Fox", ["Ann Ray", "Bo Lee", "Cy Fox"]),
    ("Ray, A., & Lee, B. C.", ["Ray, A.", "Lee, B. C."]),
    ('"Ray, Ann","Lee, Bo",Cy Fox', ["Ray, Ann", "Lee, Bo", "Cy Fox"]),
    ('["Ray, Ann", "Bo \\"B\\" Lee"]', ["Ray, Ann", 'Bo "B" Lee']),
    ('"Ann ""Annie"" Ray"', ['Ann "Annie" Ray']),
    ('Ann "Annie" Ray | Bo Lee', ['Ann "Annie" Ray', "Bo Lee"]),
    (" ; Ann Ray ; ; Bo Lee ;", ["Ann Ray", "Bo Lee"]),
    ("Ann Ray, Bo Lee, et al.", ["Ann Ray", "Bo Lee"]),
    ("Laboratory of Soil & Water, Ulm; Ann Ray", ["Laboratory of Soil & Water, Ulm", "Ann Ray"]),
    ("Department of Field Medicine, Ulm and Ann Ray", ["Department of Field Medicine, Ulm", "Ann Ray"]),
    ("The Institute for Peat (Ulm)\tAnn Ray", ["The Institute for Peat (Ulm)", "Ann Ray"]),
    ("Ann Ray\r\nBo Lee", ["Ann Ray", "Bo Lee"]),
    ("Ann Ray,Bo Lee; Cy Fox & Di Poe", ["Ann Ray", "Bo Lee", "Cy Fox", "Di Poe"]),
    ("Ann Ray；Bo Lee", ["Ann Ray", "Bo Lee"]),
    ("Ann Ray // Bo Lee", ["Ann Ray", "Bo Lee"]),
    (None, []),
    ("   ", []),
    ('"', ['"']),
]


@pytest.mark.parametrize(("field", "want"), NAMES)
def test_names(field, want):
    assert split_names(field) == want


A, B = "Ray, A. (1999). On peat. J. Soil, 3(1), 4-9.", "B. Lee, “On moss,” J. Moss, vol. 2, pp. 4-9, 2001."


@pytest.mark.parametrize(
    ("field", "want"),
    [
        (f"[3] {A} [4] {B}", [A, B]),
        (f"3. {A} 4. {B}", [A, B]),
        (f"[3] (a) {A} (b) {B}", [A, B]),
        (f"{A} // {B}", [A, B]),
        (f"{A} | {B}", [A, B]),
        (f"{A}\n{B}", [A, B]),
        (f"{A}; {B}", [A, B]),
        (f"[1] {A} [2] Lee, B. \"On [9] moss; x 1. 3. \" J. 2001.", [A, "Lee, B. \"On [9] moss; x 1. 3. \" J. 2001."]),
        (f"Lee, B. \"On moss. 2001 // more\" (ed. 1999. | x) J. 2001. // {A}", ["Lee, B. \"On moss. 2001 // more\" (ed. 1999. | x) J. 2001.", A]),
        (f"Lee, B. (On moss. 2001. // {A} | {B}", ["Lee, B. (On moss. 2001.", A, B]),
        ('"x ""y"" 1999.", "z 2001."', ['x "y" 1999.', "z 2001."]),
        ("Ray, N. B.; Lee, C. D.: On peat. In: J. Soil (1999), S. 4-9.", ["Ray, N. B.; Lee, C. D.: On peat. In: J. Soil (1999), S. 4-9."]),
        ("[7] " + A, [A]),
        (None, []),
        ("", []),
    ],
)
def test_entries(field, want):
    assert split_entries(field) == want


@given(st.text(max_size=200))
def test_any_text(text):
    for split in (split_names, split_entries):
        out = split(text)
        assert all(v and v == v.strip() for v in out)


@given(st.lists(st.from_regex(r"[A-Z][a-z]{3,8} [A-Z][a-z]{3,8}", fullmatch=True), min_size=1, max_size=6), st.sampled_from(["; ", " | ", "\t", "\n", " ; ; "]))
def test_round_trip(names, mark):
    assert split_names(mark.join(names)) == names


def test_edges(spark, tables):
    long = "; ".join(f"Ann Ray{k}" for k in range(5000))
    rows = [("r1", "Ann Ray; Bo Lee", 1), ("r1", "Ann Ray; Bo Lee", 2), ("r2", None, 1), ("r3", "", 1), ("r4", "Ann Ray", 1), (None, "Ann Ray; Bo Lee", 1), ("r5", long, 1), ("r6", "Ann Ray; Ann Ray", 1)]
    sf = tables(metadata=(rows, "record_id string, authors string, v int"))
    found = {(r.owner_key, r.pos, r.item) for r in p6_found(spark, sf).collect()}
    assert {x for x in found if x[0] in ("r1", None, "r6")} == {("r1", 1, "Ann Ray"), ("r1", 2, "Bo Lee"), (None, 1, "Ann Ray"), (None, 2, "Bo Lee"), ("r6", 1, "Ann Ray"), ("r6", 2, "Ann Ray")}
    assert sum(x[0] == "r5" for x in found) == 5000
    assert p6_found(spark, tables()).count() == 0
    df = spark.createDataFrame(rows, "record_id string, authors string, v int").selectExpr("*", "'x' as item", "'y' as field", "1 as pos", "2 as owner_key")
    assert author_values(df).where("owner_key = 'r1'").count() == 2
