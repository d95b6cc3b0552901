import itertools
import random
import time
from collections import defaultdict

import pytest

from scholiast.llm.sentences import Model, analyse, enclosed, expected, gap_table, p2_found, sentences, split, train

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return train(gap_table(spark.read.parquet(f"{SF}/blocks.parquet").where("role = 'body' and text is not null"), [], "text"))


@pytest.mark.parametrize(
    "parts",
    [
        ["He asked, “Why siege?” and nobody replied.", "This holds for the siege ... but not for the trade route."],
        ["As shown in Fig. 4, the siege offsets the baseline year.", "See No. 8, Vol. 266, pp. 245-67 for the biopsy."],
        ["Adelkin et al. report that the dosage limits it.", "(The raw counts for the siege are in App. C.)", "Why?", "However, it is late [5, 7].[12]", "In 1974, approx. 380,250 records were kept."],
        ["研究者问：“合同条款为什么重要？”", "“河岸很稳定。”作者写道。", "结果令人惊讶！"],
        ["著者は「和音は重要だ。」と述べた。", "平均は59.2であった．", "（和音の詳細は付録を参照。）"],
        ["«Почему именно спринт?» — спросил рецензент.", "А. К. Вельмаров пишет, что диагноз и давление связаны."],
        ["Wir untersuchen z. B. Blutdruck und Dosierung im Jahr 1969.", "„Die Lohnlücke überrascht uns“, schreibt Kestrup über Wechselkurs."],
        ["انظر الجدول 9 ص. 361 للتفاصيل.", "«هل هذا صحيح؟» سأل المراجع."],
        ["“क्या यह सही है?” समीक्षक ने पूछा।", "पृ. 134 पर विधि का वर्णन है।"],
        ["งานวิจัยนี้ศึกษาข้อมูลจำนวน 492 ชุดในปี พ.ศ. 2505", "ข้อมูลทั้งหมดเผยแพร่แล้ว"],
    ],
)
def test_sentences(model, parts):
    text = ("" if any(ord(c) > 0x3000 and ord(c) < 0xA000 for c in parts[0]) else " ").join(parts)
    assert [text[a:b] for a, b in split(text, model)] == parts


def test_all_evidence_ends_are_found(spark, model):
    """Evidence spans were cut at sentence ends: nearly all such ends inside a block must be boundaries."""
    e = spark.read.parquet(f"{SF}/evidence.parquet").where("size(block_ids) = 1").selectExpr("paper_id", "block_ids[0] block_id", "char_start", "char_end")
    rows = e.join(spark.read.parquet(f"{SF}/blocks.parquet").where("role = 'body'").select("paper_id", "block_id", "text").distinct(), ["paper_id", "block_id"]).distinct().collect()
    hit = sum(r.char_end in {b for _, b in split(r.text.strip(), model)} for r in rows)
    assert len(rows) > 100 and hit / len(rows) > 0.97


def test_offsets_and_edges(spark, model):
    for text in ["", "   ", ".", "…", "?!", "​", "a  b. \n C d.", "“" * 50, ")" * 50, "x. Y. " * 3000]:
        spans = split(text, model)
        assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(text[a:b] for a, b in spans).replace(" ", "") == "".join(text.split()).replace(" ", "") or any(c.isspace() for a, b in spans for c in text[a:b])
        gaps = gap_table(spark.createDataFrame([("k", text)], "k string, text string"), ["k"], "text")
        assert [(r.char_start, r.char_end) for r in sentences(gaps, ["k"], model).orderBy("sent_no").collect()] == spans, text[:20]
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "One is. Two is.", 9)], "k long, text string, sent_no int")
    assert {r.k for r in sentences(gap_table(df, ["k"], "text"), ["k"], model).collect()} == {3}


def test_untrained_and_empty(spark, tables):
    assert split("One is. Two is.", Model({}))
    assert p2_found(spark, tables()).count() == 0
    rows = [("p", "b", "One is. Two is.", "body")] * 3 + [("p", "c", "No. 3 is.", "header"), ("p", "d", None, "body"), (None, "e", "A b.", "body")]
    found = p2_found(spark, tables(blocks=(rows, "paper_id string, block_id string, text string, role string"))).collect()
    assert {(r.block_id) for r in found} == {"b", "e"} and sum(r.block_id == "b" for r in found) <= 2


def test_quotes_nest():
    spans, opener = enclosed("a “b (c) d” e) «f")
    assert sorted(spans) == [(2, 10), (5, 7)] and opener[10] == 2
    gaps, begin = analyse("A (b. C) d. E.")
    assert [g.at for g in gaps] == [11] and begin.l1 == "^"


STARTS = {"en": ["However,", "Samples", "We", "This", "Each"], "zh": ["研究者", "结果", "我们", "这些"], "ja": ["著者", "平均", "われ", "この"]}
RESTS = {
    "en": [f"{a} {b} {c}" for a in ("came from", "measured the", "holds for", "kept some") for b in ("quiet", "narrow", "late") for c in ("harbour", "market", "biopsy", "statute")],
    "zh": [a + b + c for a in ("测量了", "说明了", "取决于") for b in ("河岸", "合同", "市场") for c in ("的变化", "的样本", "的结构")],
    "ja": [a + b + c for a in ("らは和音を", "らは市場を", "らは河岸を") for b in ("詳細に", "何度も") for c in ("測定した", "記録した", "述べた")],
}


@pytest.mark.parametrize("lang", ["en", "zh", "ja"])
def test_unpunctuated_text(lang):
    """Sentences are found in texts without any mark, by a model that has seen mostly punctuated ones."""
    r = random.Random(5)
    blank, mark = (" ", ".") if lang == "en" else ("", "。")

    def sentences_of(n):
        return [r.choice(STARTS[lang]) + blank + r.choice(RESTS[lang]) for _ in range(n)]

    texts = [(mark + blank).join(sentences_of(5)) + mark for _ in range(400)] + [blank.join(sentences_of(5)) for _ in range(40)]
    seen = defaultdict(int)
    for t in texts:
        gaps, begin = analyse(t)
        for g in [*gaps, begin]:
            seen[g.window()] += 1
    model = None
    for _ in range(6):
        model = Model(dict(expected([(*w, n) for w, n in seen.items()], model)))
    want = got = both = 0
    for _ in range(40):
        parts = sentences_of(5)
        text = blank.join(parts)
        ends = {len(blank.join(parts[:k])) for k in range(1, 6)}
        found = {b for _, b in split(text, model)}
        want, got, both = want + len(ends), got + len(found), both + len(ends & found)
    assert both / want > 0.9 and both / got > 0.9, (want, got, both)


def test_analysis_is_linear_and_marked_texts_keep_their_gaps():
    assert [g.at for g in analyse("One is. Two is.")[0]] == [7] and len(analyse("One is two is")[0]) == 3 and analyse("ab")[0] == []
    text = "He said “it is (so). Yes.” ok. " * 20_000
    began = time.time()
    assert len(analyse(text)[0]) > 20_000 and time.time() - began < 60


def test_no_count_is_cut_by_the_size_of_the_corpus(spark):
    """More than 300,000 n-grams are all in the model."""
    words = ["".join(w) for w in itertools.product("abcdefghijklmnopqrst", repeat=4)]
    texts = [(" ".join(f"on x{w} y{w}. E{w} z{w}." for w in words[k : k + 500]),) for k in range(0, 100_000, 500)] * 4
    assert len(train(gap_table(spark.createDataFrame(texts, "text string"), [], "text"), rounds=1).c) > 300_000


def test_a_larger_corpus_of_the_same_texts_loses_no_boundaries():
    import pyarrow.parquet as pq

    blocks = pq.read_table("/root/testdata/sf0.01/blocks.parquet", columns=["text", "role"]).to_pylist()
    analysed = [(gaps, begin) for b in blocks if b["role"] == "body" and b["text"] for gaps, begin in [analyse(b["text"])] if begin is not None]
    seen = defaultdict(int)
    for gaps, begin in analysed:
        for g in (begin, *gaps):
            seen[g.window()] += 1

    def boundaries(copies):
        rows, model = [(*w, n * copies) for w, n in seen.items()], None
        for _ in range(6):
            model = Model(dict(expected(rows, model)), sum(r[-1] for r in rows))
        return [p >= 0.5 for gaps, _ in analysed for p in model.decode(gaps)]

    some, many = boundaries(10), boundaries(1000)
    assert sum(a and not b for a, b in zip(some, many)) < 0.02 * sum(some)
