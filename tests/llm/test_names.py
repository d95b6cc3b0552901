import random

import pytest

from scholiast.llm.names import alike_keys, bands_for, edits, key_alike, monge_elkan, name_clusters, p3_found, star_clusters

PEOPLE = [
    ["Eleanor Rudpumoor", "Rudpumoor, Eleanor", "E. Rudpumoor", "RUDPUMOOR, Eleanor", "Eleanor \"Nell\" Rudpumoor", "Rudpumoor, Nell", "Eleannor Rudpumoor", "Rudpumoor E"],
    ["Theodore Rudpumoor", "Rudpumoor, T."],
    ["Jean-Luc K. Holtopulos", "J.-L. Holtopulos", "Jean Luc Holtopulos", "JeanLuc Holtopulos", "Holtopulos, Jean-Luc"],
    ["Laboratory of Soil & Water Research, Zantam", "Lab. of Soil & Water Research, Zantam", "Laboratory of Soil and Water Research – Zantam", "The Laboratory of Soil & Water Research (Zantam)", "LSWR Zantam", "Zantam Laboratory of Soil & Water Research"],
    ["Zoë Fallustrom", "Zoe Fallustrom", "Fallustrom Zoë"],
    ["Łucja Ostmawick", "Ostmawick, Ł."],
]


def test_clusters(spark):
    names = [(n,) for group in PEOPLE for n in group] + [("Marta, Zoë",), ("Kwame, Zoë",), ("Ab",), ("Irina Vorlanko",)]
    rows = name_clusters(spark.createDataFrame(names, "name string")).collect()
    assert len(rows) == len(names)
    got = {}
    for r in rows:
        got.setdefault(r.cluster, set()).add(r.name)
    for group in PEOPLE:
        assert set(group) in got.values(), (group, [v for v in got.values() if v & set(group)])


def test_found_and_edges(spark, tables):
    assert p3_found(spark, tables()).count() == 0
    rows = [("1", "Ann Vorlanko; Bo Lestrange"), ("2", "Vorlanko, Ann"), ("2", "Vorlanko, Ann"), ("3", None), ("4", ""), ("5", " ; "), (None, "A. Vorlanko"), ("6", "x" * 5000)]
    found = {tuple(r) for r in p3_found(spark, tables(metadata=(rows, "record_id string, authors string"))).collect()}
    assert found == {("A. Vorlanko", "Ann Vorlanko"), ("A. Vorlanko", "Vorlanko, Ann"), ("Ann Vorlanko", "Vorlanko, Ann")}


def test_similarity():
    assert monge_elkan("person", "ray", ["ann"], "ray", ["a"]) > 0.9
    assert monge_elkan("person", "ray", ["ann"], "ray", ["bo"]) == 0
    assert monge_elkan("person", "ray", ["ann", "k"], "ray", ["ann", "m"]) == 0
    assert monge_elkan("person", "ray", [], "ray", ["ann"]) == 0
    assert monge_elkan("org", "ulm", ["lsw", "laboratory", "soil", "water"], "ulm", ["lsw", "lab", "soil", "water"]) > 0.9


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abcd", "abdc", 1), ("abc", "abcd", 1), ("abc", "xbc", 1), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, d):
    assert edits(a, b, 2) == min(d, 3)


def test_bands_reach_the_recall():
    for s in (0.4, 0.55, 0.7):
        b, r = bands_for(s, 0.99)
        assert 1 - (1 - s**r) ** b >= 0.99 and b * r <= 128


def test_alike_keys_find_typos(spark):
    keys = ["rudpumoor", "rudpumor", "rupdumoor", "rudpumoorx", "fallustrom", "zantamm", "abcde"]
    got = {tuple(r) for r in alike_keys(spark.createDataFrame([(k, 1) for k in keys], "key string, n long")).collect()}
    assert got == {("rudpumoor", "rudpumor"), ("rudpumoor", "rupdumoor"), ("rudpumoor", "rudpumoorx")}


def test_alike_keys_hold_every_pair(spark):
    """Slips of short, long and very long parts against brute force, transpositions of five letters among them."""
    r = random.Random(5)
    keys = set()
    for n in (5, 5, 6, 7, 8, 12, 19, 20, 21, 40) * 8:
        w = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        k = r.randrange(n - 1)
        keys |= {w, w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :], w[:k] + "x" + w[k:]}
    keys = sorted(keys)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if key_alike(a, b)}
    got = {tuple(x) for x in alike_keys(spark.createDataFrame([(k, 1) for k in keys], "key string, n long")).collect()}
    assert got == want


def test_stars(spark):
    nodes = spark.createDataFrame([(k, True, 1) for k in range(6)], "rep long, full boolean, size long")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (1, 3, 0.95), (3, 4, 0.99)], "a long, b long, sim double")
    got = {r.rep: r.centre for r in star_clusters(nodes, edges).collect()}
    assert got[0] == got[1] == got[2] == got[3] == 1 and not {4, 5} & got.keys()
    assert star_clusters(nodes, edges.limit(0)).count() == 0


def test_no_checkpoint_is_broadcast_by_its_guessed_size(spark, tmp_path):
    from scholiast.llm.names import links, representatives

    rows = [("Anna Barcalkyrenko",), ("Barcalkyrenko, A.",), ("Anna Barcalkyrneko",)]
    spark.createDataFrame(rows, "name string").write.parquet(str(tmp_path / "names"))
    plan = links(representatives(spark.read.parquet(str(tmp_path / "names")))[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
