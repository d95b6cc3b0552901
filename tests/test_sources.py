import json
import os

import pytest

from scholiast.operators import models
from scholiast.operators.stages import Runner, Stage, StageFailed
from scholiast.plans import pipeline
from scholiast.sources import documents, pdf, sinks, web
from scholiast.streaming import ingest


def test_pdf_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF-1.4 junk")
    (tmp_path / "a/y.pdf").write_bytes(b"no")
    (tmp_path / "z.pdf").write_bytes(b"")
    f = pdf.pdf_files(spark, str(tmp_path))
    assert [r.local_pdf.rsplit("/", 1)[1] for r in f.collect()] == ["x.pdf"]
    assert pdf.decode_blocks(f).first().error


def test_text_pages(spark):
    df = spark.createDataFrame([("p", 1, "top\n\n 1 Introduction\nWe see.\nend"), ("q", 1, None), ("r", 1, "")], "paper_id string, page int, text string")
    assert [r.role for r in pdf.text_blocks(df).orderBy("ord").collect()] == ["header", "heading", "body", "footer"]


def test_urls_are_guarded(spark):
    spark.dataSource.register(web.PdfUrls)
    rows = spark.read.format("pdf_urls").option("urls", "http://a.example/secret").load().collect()
    assert rows[0].content is None and "secret" not in rows[0].error


def test_json_inputs(spark, tmp_path):
    block = {"id": "block:p0001:0000", "text": "t", "bbox": [0, 0, 1, 1], "order": 0, "role": "body"}
    doc = {"status": "passed", "source": {"sha256": "ab"}, "pages": [{"number": 1, "blocks": [block]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad.json").write_text("{")
    docs = documents.parsed_documents(spark, str(tmp_path / "*.json")).cache()
    assert documents.parsed_blocks(docs).count() == 1
    pair = {"id": "1", "paper_file": "a", "presentation_file": "b", "presentation_type": "slides"}
    (tmp_path / "m.txt").write_text(json.dumps({"pairs": [pair, {"id": "2"}]}))
    good, faulty = documents.pair_manifest(spark, str(tmp_path / "m.txt"))
    assert (good.count(), faulty.count()) == (1, 1)
    assert documents.overlay(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_sinks(spark, tmp_path):
    sinks.write_json(str(tmp_path / "o/x.json"), {"a": "é"})
    assert (tmp_path / "o/x.json").read_text() == '{\n  "a": "é"\n}\n'
    assert sinks.canonical_digest({"b": 1, "a": [{"attempt": 2}]}) == sinks.canonical_digest({"a": [{"attempt": 3}], "b": 1, "created_at": "x"})
    images = spark.createDataFrame([("i:1", "p/ng", bytearray(b"x")), ("i:2", None, bytearray(b"")), ("i:3", None, None)], "id string, extension string, bytes binary")
    saved = sinks.save_images(images, str(tmp_path / "img")).collect()
    assert [os.path.basename(r.asset_path) for r in saved] == ["i_1.png"]


def test_stage_cache_retry_and_gate(spark, tmp_path):
    tries = []

    def flaky(s, _):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return s.range(2)

    r = Runner(spark, str(tmp_path))
    assert r.run(Stage("s", "1", flaky), {}, {}).count() == 2
    assert r.run(Stage("s", "1", flaky), {}, {}).count() == 2 and len(tries) == 3
    assert [x["status"] for x in r.log] == ["failed", "failed", "passed", "cache_hit"]
    with pytest.raises(StageFailed):
        r.run(Stage("t", "1", lambda s, _: s.range(1), lambda df: df), {}, {})


def test_pipeline_is_made_once(spark, tmp_path):
    _, log = pipeline.run_pipeline(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert {x["status"] for x in log} == {"passed"}
    _, log = pipeline.run_pipeline(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert {x["status"] for x in log} == {"cache_hit"}


def test_changed_table_makes_its_stages_anew(spark, tmp_path):
    """New data under one path is seen, stages after a changed one are made again, others are read."""
    folder, root = str(tmp_path / "sf"), str(tmp_path / "root")
    os.makedirs(folder)
    for name in ("blocks", "citations", "evidence"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    frames, _ = pipeline.run_pipeline(spark, folder, root)
    n = frames["related"].count(), frames["references"].count()
    one = spark.read.parquet("/root/testdata/sf0.001/citations.parquet").where("raw_reference is not null").limit(1)
    one.selectExpr("'new' as paper_id", *one.columns[1:]).write.mode("append").parquet(f"{folder}/citations.parquet")
    frames, log = pipeline.run_pipeline(spark, folder, root)
    assert frames["references"].count() == n[1] + 1
    assert {x["stage"] for x in log if x["status"] == "passed"} == {"references", "related"}
    assert {x["stage"] for x in log if x["status"] == "cache_hit"} == {"sections", "parts", "evidence", "claims", "cited"}


def test_stage_rows_are_not_repeated(spark, tmp_path):
    for attempt in (1, 2):
        sinks.write_stage(spark.range(3), str(tmp_path / "s"), "a", "1", "h", attempt)
    sinks.write_stage(spark.range(2), str(tmp_path / "s"), "b", "1", "h")
    got = spark.read.parquet(str(tmp_path / "s")).select("stage", "attempt", "id").collect()
    assert sorted(map(tuple, got)) == [("a", 2, 0), ("a", 2, 1), ("a", 2, 2), ("b", 1, 0), ("b", 1, 1)]


def test_models(spark):
    assert models.parse_payload('x {"result": "{\\"a\\": 1}"} y') == {"a": 1}
    assert models.parse_payload("no") is None
    out = models.extract_units(spark.createDataFrame([("u", "Hello. Bye.")], "unit_id string, text string"), models.Echo(), "say").first()
    assert out.summaries == ["Hello."] and out.error is None

    class Provider:
        name = "fake"

        def search(self, title):
            return [{"title": title}]

    t = spark.createDataFrame([("A b",), ("a  B!",), ("c",)], "title string")
    first = models.look_up(t, Provider())
    assert first.count() == 2
    assert models.look_up(t, Provider(), first.limit(1)).count() == 2


def test_streams(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    for name, df in (("w", ingest.event_windows(spark, str(tmp_path / "e"))), ("s", ingest.user_sessions(spark, str(tmp_path / "e")))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() > 0
    spark.createDataFrame([("k", 1, 0), ("k", 1, 1), ("z", 1, 0)], "key string, refs long, exists long").write.parquet(str(tmp_path / "d"))
    q = ingest.maintain_counts(spark.readStream.schema("key string, refs long, exists long").parquet(str(tmp_path / "d")), str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state/v=0")).select("key", "refs", "exists").collect()} == {("k", 2, 1), ("z", 1, 0)}
