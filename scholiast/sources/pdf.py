"""PDF files as tables: scanning, decoding with whatever backend is installed, and plain page texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions.geometry import HEIGHT, WIDTH
from scholiast.functions.text import role_of, strip

BLOCK_SCHEMA = (
    "paper_id string, page int, ord int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, "
    "font_size_median double, coordinate_precision string, width double, height double, error string"
)


def pdf_files(spark: SparkSession, path: str, depth: int = 5) -> DataFrame:
    """Non-empty files below a folder that begin as PDFs do, with the hash of their content.

    Hidden folders and package folders are passed over, and folders deeper than `depth`.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    rel = F.expr("substring_index(path, 'file:', -1)")
    below = F.size(F.split(rel, "/")) - len(path.rstrip("/").split("/"))
    hidden = rel.rlike(r"/\.[^/]+|/node_modules/")
    sound = (F.col("length") > 0) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return f.where(sound & (below <= depth) & ~hidden).select(F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 16).alias("paper_id"), F.col("path").alias("local_pdf"), "length", "content")


def _decode(content: bytes) -> Iterator[tuple[int, float, float, list[tuple[str, tuple | None, float | None]]]]:
    """(page, width, height, [(text, box, font size)]) by the best backend that can be imported."""
    try:
        import pymupdf
    except ImportError:
        pymupdf = None
    if pymupdf:
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            for n, page in enumerate(doc, 1):
                rows = []
                for b in page.get_text("dict")["blocks"]:
                    if b["type"] == 0:
                        sizes = sorted(s["size"] for line in b["lines"] for s in line["spans"])
                        text = "\n".join("".join(s["text"] for s in line["spans"]).strip() for line in b["lines"])
                        rows.append((text, tuple(b["bbox"]), sizes[len(sizes) // 2] if sizes else None))
                yield n, page.rect.width, page.rect.height, rows
        return
    import io

    from pypdf import PdfReader

    for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        lines = [x.strip() for x in (page.extract_text() or "").splitlines() if x.strip()]
        yield n, float(page.mediabox.width), float(page.mediabox.height), [(x, None, None) for x in lines]


def decode_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of PDF files; a file that no backend can read gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for df in batches:
            for paper, content in zip(df["paper_id"], df["content"]):
                rows = []
                try:
                    for page, width, height, blocks in _decode(bytes(content)):
                        slot = height / max(1, len(blocks))
                        for k, (text, box, size) in enumerate(b for b in blocks if b[0].strip()):
                            x0, y0, x1, y1 = box or (0.0, k * slot, width, min(height, (k + 1) * slot))
                            rows.append((paper, page, k, f"block:p{page:04d}:{k:04d}", text, x0, y0, x1, y1, size if size is not None else math.nan, "exact" if box else "estimated", width, height, None))
                except Exception as e:  # noqa: BLE001 - whatever the backend raises becomes a row
                    rows = [(paper, None, None, None, None, *[math.nan] * 5, None, math.nan, math.nan, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "ord": "Int32"})

    return files.select("paper_id", "content").mapInPandas(run, BLOCK_SCHEMA)


def text_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages given as plain text (paper_id, page, text): one per line that is not blank, evenly spaced."""
    lines = pages.select("paper_id", "page", F.posexplode(F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda x: x != "")).alias("ord", "text"), F.size(F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda x: x != "")).alias("n"))
    slot = F.lit(HEIGHT) / F.greatest(F.col("n"), F.lit(1))
    box = F.array(F.lit(0.0), F.col("ord") * slot, F.lit(WIDTH), F.least(F.lit(HEIGHT), (F.col("ord") + 1) * slot))
    rows = lines.withColumn("bbox", box)
    role = role_of(F.col("text"), F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)), F.lit(HEIGHT))
    return rows.select("paper_id", "page", "ord", F.format_string("block:p%04d:%04d", "page", "ord").alias("block_id"), "text", "bbox", role.alias("role"), F.lit(None).cast("double").alias("font_size_median"), F.lit("estimated").alias("coordinate_precision"))
