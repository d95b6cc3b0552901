import pytest

from scholiast.functions import formulas as M
from scholiast.functions import html as H
from scholiast.functions.readable import Kept, claim_summary, sentence_spans
from scholiast.operators.page_scans import fragments, is_display, merge_continuations, page_formulas, scan_pages
from scholiast.operators.reading import column_order, region_order


def block(k, x0, y0, x1, y1, text="", role="body"):
    return {"block_id": f"b{k}", "ord": k, "c0": x0, "c1": y0, "c2": x1, "c3": y1, "text": text, "role": role}


@pytest.fixture
def order(spark):
    def run(blocks, by=column_order):
        df = spark.createDataFrame([{"paper_id": "p", "page": 1, **b} for b in blocks], "paper_id string, page int, block_id string, ord int, c0 double, c1 double, c2 double, c3 double")
        return [r.block_id for r in by(df, 600.0).orderBy("place").collect()]

    return run


def flat(k, *corners):
    b = block(k, *map(float, corners))
    return {c: b[c] for c in b if c not in ("text", "role")}


def test_two_columns(order):
    b = [flat(0, 310, 100, 560, 200), flat(1, 40, 100, 290, 200), flat(2, 310, 210, 560, 300), flat(3, 40, 210, 290, 300)]
    assert order(b) == ["b1", "b3", "b0", "b2"]


def test_spanning_block_parts_bands(order):
    b = [flat(0, 40, 100, 290, 200), flat(1, 310, 100, 560, 200), flat(2, 40, 250, 560, 300), flat(3, 40, 310, 290, 400), flat(4, 310, 310, 560, 400)]
    assert order(b[::-1]) == ["b0", "b1", "b2", "b3", "b4"]


def test_few_blocks_go_down(order):
    assert order([flat(0, 310, 50, 560, 80), flat(1, 40, 60, 290, 90)]) == ["b0", "b1"]
    assert order([]) == []


def test_regions(order):
    b = [flat(0, 40, 100, 290, 200), flat(1, 310, 90, 560, 200), flat(2, 40, 210, 290, 300), flat(3, 310, 210, 560, 300), flat(4, 40, 320, 560, 340), flat(5, 310, 350, 560, 360)]
    assert order(b, region_order) == ["b0", "b2", "b1", "b3", "b4", "b5"]


def test_pages_are_whole_whatever_the_batches(spark):
    rows = [("p", page, k, f"b{k}") for page in range(40) for k in range(7)]
    df = spark.createDataFrame(rows, "paper_id string, page int, ord int, block_id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = scan_pages(df, ["paper_id", "page"], lambda b, w, h: [{"n": len(b)}], "paper_id string, page int, n int", 600.0, 800.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.page, r.n) for r in got) == [(page, 7) for page in range(40)]


def test_continuations():
    b = [block(0, 40, 100, 290, 120, "It goes"), block(1, 40, 124, 290, 140, "on here."), block(2, 40, 144, 290, 160, "New.")]
    assert [(r["n_merged"], r["joined"]) for r in merge_continuations(b, 600, 800)] == [(2, "It goes on here."), (1, "New.")]


def test_split_equation():
    b = [
        block(0, 0, 0, 9, 9, "It is computed as:"), block(1, 0, 0, 9, 9, "f(x) = (a +"), block(2, 0, 0, 9, 9, "b · c"), block(3, 0, 0, 9, 9, ") (1)"),
        block(4, 0, 0, 9, 9, "We used a = 3 in all runs of the study."),
    ]
    out = page_formulas(b, 600, 800)
    assert [(r["block_id"], r["n_blocks"], r["label"]) for r in out] == [("b1", 3, "1")]
    assert not is_display("We used x = 3.", False)
    lines = "We have:\nf(x) = a + b (1)\nand so\ng(y) = (c +\nd) · 2 (2)\nend of it."
    assert fragments(lines) == [("f(x) = a + b (1)", 9, 25), ("g(y) = (c + d) · 2 (2)", 33, 55)] and fragments("") == []
    assert [(r["label"], r["char_start"]) for r in page_formulas([block(0, 0, 0, 9, 9, lines)], 600, 800)] == [("1", 9), ("2", 33)]


def test_symbols():
    assert M.variables("where d_k = n_1 + softmax(QK)")[:2] == ["d_{k}", "n_1"]
    assert M.symbol("dmodel") == "d_{model}" and M.symbol("x1") == "x_1" and M.symbol("Wq") == "W_q"
    assert M.latex("α = √d (2)", "2") == r"\alpha = \sqrt{d}"
    assert M.mathml("x_1^{2}") == "<math><msubsup><mi>x</mi><mn>1</mn><mrow><mn>2</mn></mrow></msubsup></math>"
    assert M.defines("d_k", "where d_k is the size of keys") and not M.defines("q", "nothing here")


def test_readable():
    assert claim_summary("a self-\nsupervised task and gener-\nation .") == "a self-supervised task and generation."
    assert sentence_spans("One is. Two is! Three") == [(0, 7), (8, 15)]
    a = "word " * 20
    kept = Kept([a.strip()])
    assert kept.holds(a.strip()) and kept.holds((a + "x").strip()) and not kept.holds("other") and not Kept().holds("")


def test_page_is_sound_and_defects_are_found():
    items = [{"id": "evidence:1", "page": 1, "text": "a </script> <b>"}]
    page = H.render("T", "en", items)
    assert H.audit(page, {"evidence:1"}) == []
    assert H.audit(page.replace(' tabindex="0"', ""), {"evidence:1"}) == ["trigger without keyboard"]
    assert H.audit(page, {"evidence:2"}) == ["registry differs"]
    assert "external script" in H.audit(page.replace("</main>", '<script src="http://x"></script></main>'))
    assert H.tokens(page)[1].startswith("T Skip a </script> <b>")


@pytest.mark.parametrize("text", ["", "   ", "=", "(", "\n\n", "≻" * 5, "x" * 5000])
def test_odd_text(text):
    is_display(text, False), M.variables(text), M.latex(text), M.mathml(text), claim_summary(text), sentence_spans(text)
