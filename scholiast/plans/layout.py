"""Queries on page layout: roles, margins, reading order, sections, runs, captions, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import geometry as G
from scholiast.functions import text as T
from scholiast.operators.ordering import PAGE, clean_blocks, running_sum
from scholiast.operators.page_scans import caption_texts, merge_boxes, merge_continuations, page_formulas, scan_pages
from scholiast.operators.reading import COLUMN_SQL, READING_SQL, column_order

B = "b AS (SELECT DISTINCT paper_id, page, ord, block_id, text, bbox, role, font_size_median FROM blocks)"
_SQ = f"trim(regexp_replace(text, '{T.WS}+', ' ', 'g'))"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def role_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The role of every block by place and form; null texts have none."""
    b = clean_blocks(spark, sf).where("text is not null")
    return b.select("paper_id", "block_id", T.role_of(F.col("text"), G.side(F.col("bbox"), 1), G.side(F.col("bbox"), 3), F.lit(G.HEIGHT)).alias("role_found"))


def _any(marks: tuple[str, ...], s: str) -> str:
    return "length({0}) - length(translate({0}, {1}, ''))".format(s, q("".join(marks)))


_LABELLED = f"(regexp_matches(s, {q(T.FORMULA_LABEL)}) AND {_any(T.STRONG_MATH, 's')} > 0)"
_FORMULA = f"(length(s) BETWEEN 1 AND 500 AND ({_LABELLED} OR ({_any(T.MATH, 's')} >= 2 AND len(regexp_extract_all(s, '[A-Za-z]{{3,}}')) <= 12)))"
ROLE_SQL = f"""
WITH {B}, t AS (SELECT *, {_SQ} AS s FROM b WHERE text IS NOT NULL)
SELECT paper_id, block_id, CASE
  WHEN bbox[2] <= 800 * 0.055 AND length(s) < 180 THEN 'header'
  WHEN bbox[4] >= 800 * 0.945 AND length(s) < 180 THEN 'footer'
  WHEN regexp_matches(s, {q(T.CAPTION)}) THEN 'caption'
  WHEN regexp_matches(s, {q(T.REFERENCE_HEADING)}) OR regexp_matches(s, {q(T.REFERENCE_START)}) THEN 'reference'
  WHEN regexp_matches(s, {q(T.NUMBERED_HEADING)}) OR regexp_matches(s, {q(T.APPENDIX_HEADING)})
    OR replace(lower(s), 'ß', 'ss') IN ({", ".join(q(w) for w in T.HEADING_WORDS)}) THEN 'heading'
  WHEN {_FORMULA} THEN 'formula' ELSE 'body' END AS role_found FROM t"""


def formula_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = clean_blocks(spark, sf).where("text is not null").withColumn("s", T.squeeze(F.col("text")))
    return b.where(T.looks_like_formula(F.col("s"))).select("paper_id", "block_id", T.unclosed_formula(F.col("s")).alias("goes_on"))


FORMULA_SQL = f"""
WITH {B}, t AS (SELECT *, {_SQ} AS s FROM b WHERE text IS NOT NULL)
SELECT paper_id, block_id, NOT regexp_matches(s, {q(T.FORMULA_LABEL)}) AND (
  {_any(("(", "[", "{"), "s")} > {_any((")", "]", "}"), "s")} OR regexp_matches(s, {q(r"[=+\-−*/·×,(] *$")})) AS goes_on
FROM t WHERE {_FORMULA}"""


def repeated_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Header and footer blocks with the role they keep: body unless their text recurs on enough pages."""
    b = clean_blocks(spark, sf).where("text is not null")
    masked = F.regexp_replace(T.fold_case(T.squeeze(F.col("text"))), "[0-9]+", "#")
    margins = b.where("role in ('header', 'footer')").withColumn("masked", masked).where("masked <> ''")
    seen = margins.groupBy("paper_id", "masked").agg(F.count(F.lit(1)).alias("n"))
    pages = b.groupBy("paper_id").agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("page") * 0.4)).alias("least"))
    kept = margins.join(seen, ["paper_id", "masked"]).join(pages, "paper_id")
    return kept.select("paper_id", "block_id", F.when(F.col("n") < F.col("least"), "body").otherwise(F.col("role")).alias("kept_role"))


MARGIN_SQL = f"""
WITH {B}, m AS (SELECT *, regexp_replace(replace(lower({_SQ}), 'ß', 'ss'), '[0-9]+', '#', 'g') AS masked FROM b WHERE text IS NOT NULL AND role IN ('header', 'footer')),
n AS (SELECT paper_id, masked, count(*) AS n FROM m WHERE masked <> '' GROUP BY ALL),
p AS (SELECT paper_id, greatest(2, ceil(count(DISTINCT page) * 0.4)) AS least FROM b WHERE text IS NOT NULL GROUP BY ALL)
SELECT m.paper_id, block_id, CASE WHEN n < least THEN 'body' ELSE role END AS kept_role FROM m JOIN n USING (paper_id, masked) JOIN p USING (paper_id)"""


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with is_heading: by role, by number, or by a font well above the page's body text."""
    b = clean_blocks(spark, sf)
    body = b.where("role = 'body' and font_size_median is not null").groupBy(*PAGE).agg(F.expr("percentile_disc(0.5000001) within group (order by font_size_median)").alias("body_size"))
    s = T.squeeze(F.col("text"))
    large = (F.col("font_size_median") >= F.col("body_size") * 1.18) & (F.length(s) <= 140)
    is_heading = (F.col("role") == "heading") | s.rlike(T.NUMBERED_HEADING) | large
    return b.join(body, PAGE, "left").withColumn("s", s).withColumn("is_heading", F.coalesce(is_heading, F.lit(False)) & F.col("text").isNotNull())


def section_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sections from heading to heading: title, level, pages and number of blocks."""
    numbered = running_sum(headings(spark, sf), F.col("is_heading"), "section_no").where("section_no > 0")
    dots = F.regexp_replace(F.regexp_extract("s", T.NUMBERED_HEADING, 1), "[^.]", "")
    head = F.when(F.col("is_heading"), F.struct("page", "s", (F.length(dots) + 1).alias("level")))
    out = numbered.groupBy("paper_id", "section_no").agg(
        F.first(head, ignorenulls=True).alias("h"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_blocks")
    )
    return out.select("paper_id", "section_no", F.col("h.s").alias("title"), F.col("h.level").cast("int").alias("level"), F.col("h.page").alias("page_start"), "page_end", "n_blocks")


SECTION_CTE = f"""{B},
sz AS (SELECT paper_id, page, list_sort(list(font_size_median))[count(*) // 2 + 1] AS body_size FROM b WHERE role = 'body' AND font_size_median IS NOT NULL GROUP BY ALL),
h AS (SELECT b.*, {_SQ} AS s, text IS NOT NULL AND coalesce(role = 'heading' OR regexp_matches({_SQ}, {q(T.NUMBERED_HEADING)})
  OR (font_size_median >= body_size * 1.18 AND length({_SQ}) <= 140), false) AS is_heading FROM b LEFT JOIN sz USING (paper_id, page)),
n AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY paper_id ORDER BY page, ord) AS section_no FROM h)"""
SECTION_SQL = f"""
WITH {SECTION_CTE}
SELECT paper_id, section_no, max(s) FILTER (is_heading) AS title,
  max(length(regexp_replace(regexp_extract(s, {q(T.NUMBERED_HEADING)}, 1), '[^.]', '', 'g')) + 1) FILTER (is_heading) AS level,
  min(page) FILTER (is_heading) AS page_start, max(page) AS page_end, count(*) AS n_blocks
FROM n WHERE section_no > 0 GROUP BY ALL"""


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The first section, by number, that spans each page."""
    s = section_segments(spark, sf)
    pages = s.select("paper_id", "section_no", "title", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.groupBy("paper_id", "page").agg(F.min_by("title", "section_no").alias("title"))


PAGE_SECTION_SQL = f"""
WITH s AS ({SECTION_SQL}) SELECT paper_id, page, arg_min(title, section_no) AS title
FROM (SELECT paper_id, section_no, title, unnest(generate_series(page_start, page_end)) AS page FROM s) GROUP BY ALL"""


def body_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal runs of consecutive body blocks of one page and section."""
    numbered = running_sum(headings(spark, sf), F.col("is_heading"), "section_no")
    body = numbered.where((F.col("role") == "body") & (F.length(T.strip(F.col("text"))) > 0))
    w = Window.partitionBy(*PAGE, "section_no").orderBy("ord")
    runs = body.withColumn("island", F.col("ord") - F.row_number().over(w)).groupBy(*PAGE, "section_no", "island")
    return runs.agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n_blocks")).drop("island")


BODY_RUN_SQL = f"""
WITH {SECTION_CTE}, r AS (SELECT *, ord - row_number() OVER (PARTITION BY paper_id, page, section_no ORDER BY ord) AS island
  FROM n WHERE role = 'body' AND regexp_replace(text, '^{T.WS}+|{T.WS}+$', '', 'g') <> '')
SELECT paper_id, page, section_no, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_blocks FROM r GROUP BY paper_id, page, section_no, island"""


def caption_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The first block of each caption label of a paper; later blocks of the label are prose."""
    b = clean_blocks(spark, sf).withColumn("s", T.squeeze(F.col("text"))).where(F.col("s").rlike(T.CAPTION))
    kind = F.when(F.lower(F.regexp_extract("s", T.CAPTION, 1)) == "table", "table").otherwise("figure")
    label = F.lower(F.regexp_extract("s", T.CAPTION, 2))
    first = b.groupBy("paper_id", kind.alias("kind"), label.alias("label")).agg(F.min(F.struct("page", "ord", "block_id")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select("paper_id", "kind", "label", F.col("f.block_id").alias("block_id"), (F.col("n") - 1).alias("n_demoted"))


CAPTION_SQL = f"""
WITH {B}, c AS (SELECT *, {_SQ} AS s FROM b WHERE regexp_matches({_SQ}, {q(T.CAPTION)})),
k AS (SELECT *, CASE WHEN lower(regexp_extract(s, {q(T.CAPTION)}, 1)) = 'table' THEN 'table' ELSE 'figure' END AS kind, lower(regexp_extract(s, {q(T.CAPTION)}, 2)) AS label FROM c)
SELECT paper_id, kind, label, arg_min(block_id, page * 100000 + ord) AS block_id, count(*) - 1 AS n_demoted FROM k GROUP BY ALL"""


def upper_medians(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median length of block texts per role."""
    b = clean_blocks(spark, sf).where("text is not null").withColumn("n", F.length("text"))
    return b.groupBy("role").agg(F.expr("percentile_disc(0.500000001) within group (order by n)").cast("long").alias("median_length"))


MEDIAN_SQL = f"WITH {B} SELECT role, list_sort(list(length(text)))[count(*) // 2 + 1] AS median_length FROM b WHERE text IS NOT NULL GROUP BY ALL"


def bbox_normalise(spark: SparkSession, sf: str) -> DataFrame:
    b = clean_blocks(spark, sf).where("bbox is not null")
    return b.select("paper_id", "block_id", G.relative(G.bounded(F.col("bbox"))).alias("r")).select("paper_id", "block_id", "r.*")


_IN = "CASE WHEN len(bbox) = 4 THEN [least(greatest(0, least(bbox[1], 600)), greatest(0, least(bbox[3], 600))), least(greatest(0, least(bbox[2], 800)), greatest(0, least(bbox[4], 800))), greatest(greatest(0, least(bbox[1], 600)), greatest(0, least(bbox[3], 600))), greatest(greatest(0, least(bbox[2], 800)), greatest(0, least(bbox[4], 800)))] ELSE [0.0, 0.0, 600.0, 800.0] END"
BBOX_SQL = f"""
WITH {B}, i AS (SELECT paper_id, block_id, {_IN} AS k FROM b WHERE bbox IS NOT NULL),
p AS (SELECT *, greatest(0, k[1] - 1.5) AS x0, greatest(0, k[2] - 1.5) AS y0, least(600, k[3] + 1.5) AS x1, least(800, k[4] + 1.5) AS y1 FROM i)
SELECT paper_id, block_id, round_even(x0 / 600, 6) AS x, round_even(y0 / 800, 6) AS y,
  round_even(greatest(1, x1 - x0) / 600, 6) AS width, round_even(greatest(1, y1 - y0) / 800, 6) AS height FROM p"""


def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring blocks of a page that share their column, with the gap between them."""
    b = clean_blocks(spark, sf).where("bbox is not null").select(*PAGE, "ord", "bbox")
    a, c = b.withColumnRenamed("bbox", "ba"), b.select(*PAGE, (F.col("ord") - 1).alias("ord"), F.col("bbox").alias("bb"))
    j = a.join(c, [*PAGE, "ord"])
    return j.where(G.horizontal_overlap(F.col("ba"), F.col("bb")) >= 0.25).select(
        *PAGE, "ord", (G.side(F.col("bb"), 1) - G.side(F.col("ba"), 3)).alias("gap"), G.overlap_share(F.col("ba"), F.col("bb")).alias("share")
    )


OVERLAP_SQL = f"""
WITH {B}, j AS (SELECT a.paper_id, a.page, a.ord, a.bbox AS p, c.bbox AS n FROM b a JOIN b c ON a.paper_id = c.paper_id AND a.page = c.page AND c.ord = a.ord + 1)
SELECT paper_id, page, ord, n[2] - p[4] AS gap,
  greatest(0, least(p[3], n[3]) - greatest(p[1], n[1])) * greatest(0, least(p[4], n[4]) - greatest(p[2], n[2])) / greatest(1, (p[3] - p[1]) * (p[4] - p[2])) AS share
FROM j WHERE greatest(0, least(p[3], n[3]) - greatest(p[1], n[1])) / greatest(1, least(p[3] - p[1], n[3] - n[1])) >= 0.25"""


def margin_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = clean_blocks(spark, sf).where("bbox is not null and text is not null")
    return b.where(G.margin_text(F.col("bbox"), F.col("text"), 600.0, 760.0)).select("paper_id", "block_id")


MARGIN_FILTER_SQL = f"""
WITH {B} SELECT paper_id, block_id FROM b WHERE bbox IS NOT NULL AND text IS NOT NULL AND (
  ((bbox[3] < 60 OR bbox[1] > 540) AND bbox[4] - bbox[2] > (bbox[3] - bbox[1]) * 2) OR bbox[4] < 760 * 0.055 OR bbox[2] > 760 * 0.93
  OR (regexp_matches(text, '(?i)arXiv:\\s*[0-9]{{4}}\\.[0-9]+') AND bbox[3] < 84))"""


def caption_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Captions matched with the one block above them on the page that can be their picture; several leave it open."""
    b = clean_blocks(spark, sf).where("bbox is not null")
    cap = b.where("role = 'caption'").select(*PAGE, F.col("block_id").alias("caption_id"), F.col("bbox").alias("cb"))
    pic = b.where("role = 'formula' or role is null").select(*PAGE, F.col("block_id").alias("picture_id"), F.col("bbox").alias("pb"))
    near = cap.join(pic, PAGE).where((G.side(F.col("pb"), 3) <= G.side(F.col("cb"), 1) + 12) & (G.horizontal_overlap(F.col("pb"), F.col("cb")) >= 0.25))
    found = near.groupBy(*PAGE, "caption_id").agg(F.count(F.lit(1)).alias("n"), F.min("picture_id").alias("p"))
    return cap.select(*PAGE, "caption_id").join(found, [*PAGE, "caption_id"], "left").select(
        "paper_id", "caption_id", F.when(F.col("n") == 1, F.col("p")).alias("picture_id"), F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("caption_only").alias("match_status")
    )


CAPTION_PIC_SQL = f"""
WITH {B}, c AS (SELECT * FROM b WHERE role = 'caption' AND bbox IS NOT NULL), p AS (SELECT * FROM b WHERE (role = 'formula' OR role IS NULL) AND bbox IS NOT NULL),
m AS (SELECT c.paper_id, c.block_id AS caption_id, count(*) AS n, min(p.block_id) AS pid FROM c JOIN p ON c.paper_id = p.paper_id AND c.page = p.page AND p.bbox[4] <= c.bbox[2] + 12
  AND greatest(0, least(p.bbox[3], c.bbox[3]) - greatest(p.bbox[1], c.bbox[1])) / greatest(1, least(p.bbox[3] - p.bbox[1], c.bbox[3] - c.bbox[1])) >= 0.25 GROUP BY ALL)
SELECT c.paper_id, c.block_id AS caption_id, CASE WHEN n = 1 THEN pid END AS picture_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'caption_only' END AS match_status
FROM c LEFT JOIN m ON c.paper_id = m.paper_id AND c.block_id = m.caption_id"""


def nearest_caption(spark: SparkSession, sf: str) -> DataFrame:
    """For each caption the block of its column with the least vertical distance, among those within reach."""
    b = clean_blocks(spark, sf).where("bbox is not null")
    cap = b.where("role = 'caption'").select(*PAGE, F.col("block_id").alias("caption_id"), F.col("bbox").alias("cb"))
    other = b.where("role <> 'caption'").select(*PAGE, F.col("block_id").alias("near_id"), F.col("bbox").alias("ob"))
    gap = G.side(F.col("cb"), 1) - G.side(F.col("ob"), 3)
    near = cap.join(other, PAGE).where((G.horizontal_overlap(F.col("ob"), F.col("cb")) > 0.35) & gap.between(-12, 95)).withColumn("gap", gap)
    return near.groupBy(*PAGE, "caption_id").agg(F.min(F.struct(F.abs("gap").alias("g"), "near_id")).alias("m")).select("paper_id", "caption_id", F.col("m.near_id").alias("near_id"), F.col("m.g").alias("distance"))


NEAREST_SQL = f"""
WITH {B}, j AS (SELECT c.paper_id, c.block_id AS caption_id, o.block_id AS near_id, abs(c.bbox[2] - o.bbox[4]) AS g FROM b c JOIN b o ON c.paper_id = o.paper_id AND c.page = o.page
  WHERE c.role = 'caption' AND o.role <> 'caption' AND c.bbox[2] - o.bbox[4] BETWEEN -12 AND 95
  AND greatest(0, least(o.bbox[3], c.bbox[3]) - greatest(o.bbox[1], c.bbox[1])) / greatest(1, least(o.bbox[3] - o.bbox[1], c.bbox[3] - c.bbox[1])) > 0.35)
SELECT paper_id, caption_id, near_id, g AS distance FROM j QUALIFY row_number() OVER (PARTITION BY paper_id, caption_id ORDER BY g, near_id) = 1"""


def table_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that may hold a table: a table caption, many digits in short texts, or many left edges."""
    b = clean_blocks(spark, sf).where("text is not null").withColumn("s", T.squeeze(F.col("text")))
    digits = F.length("s") - F.length(F.regexp_replace("s", "[0-9]", ""))
    short = F.length("s") <= 40
    g = b.groupBy(*PAGE).agg(
        F.max(F.col("s").rlike(r"(?i)^(?:table|tab\.)\s*(?:[A-Z]?[0-9]+|[IVXLC]+)\b").cast("int")).alias("captioned"),
        F.sum(F.when(short, digits).otherwise(0)).alias("digits"),
        F.count_if(short & F.col("s").rlike("[0-9]")).alias("numeric_texts"),
        F.count_distinct(F.when(short, F.bround(G.side(F.col("bbox"), 0) / 18))).alias("edges"),
        F.count_if(short).alias("short_texts"),
    )
    numeric = (F.col("digits") >= 24) & (F.col("numeric_texts") >= 4)
    grid = (F.col("edges") >= 3) & (F.col("short_texts") >= 4)
    return g.where((F.col("captioned") == 1) | numeric | grid).select(*PAGE, (F.col("captioned") == 1).alias("captioned"), numeric.alias("numeric"), grid.alias("grid"))


TABLE_CUE_SQL = f"""
WITH {B}, t AS (SELECT *, {_SQ} AS s FROM b WHERE text IS NOT NULL),
g AS (SELECT paper_id, page, bool_or(regexp_matches(s, '(?i)^(?:table|tab\\.)\\s*(?:[A-Z]?[0-9]+|[IVXLC]+)\\b')) AS captioned,
  coalesce(sum(length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) FILTER (length(s) <= 40), 0) >= 24 AND count(*) FILTER (length(s) <= 40 AND regexp_matches(s, '[0-9]')) >= 4 AS numeric,
  count(DISTINCT round_even(bbox[1] / 18, 0)) FILTER (length(s) <= 40) >= 3 AND count(*) FILTER (length(s) <= 40) >= 4 AS grid FROM t GROUP BY ALL)
SELECT * FROM g WHERE captioned OR numeric OR grid"""


def block_histogram(spark: SparkSession, sf: str) -> DataFrame:
    b = clean_blocks(spark, sf)
    return b.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("paper_id").alias("n_papers"))


HISTOGRAM_SQL = f"WITH {B} SELECT coalesce(role, 'none') AS role, count(*) AS n_blocks, count(DISTINCT paper_id) AS n_papers FROM b GROUP BY ALL"


def flat_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with a box, its corners as columns; a null text is empty, a null role is body."""
    b = clean_blocks(spark, sf).where("bbox is not null and size(bbox) = 4")
    return b.select(*PAGE, "ord", "block_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("body")).alias("role"), *(G.side(F.col("bbox"), i).alias(f"c{i}") for i in range(4)))


def per_page(spark: SparkSession, sf: str, run, schema: str) -> DataFrame:
    """A rule over the blocks of each page."""
    return scan_pages(flat_blocks(spark, sf), PAGE, run, schema, G.WIDTH, G.HEIGHT)


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each block in the reading order of its page."""
    return column_order(flat_blocks(spark, sf).drop("text", "role"), G.WIDTH)


READING_ORDER_SQL = READING_SQL.format(b=B) + COLUMN_SQL


def continued_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a page whose sentences run on from block to block, joined."""
    return per_page(spark, sf, merge_continuations, "paper_id string, page int, block_id string, n_merged int, joined string")


def formula_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Display equations, joined over the blocks they are split into."""
    return per_page(spark, sf, page_formulas, "paper_id string, page int, block_id string, n_blocks int, formula string, label string, char_start int, char_end int")


def region_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of one kind that overlap, as one region."""
    return per_page(spark, sf, merge_boxes, "paper_id string, page int, role string, n_merged int, x0 double, y0 double, x1 double, y1 double")


def caption_text(spark: SparkSession, sf: str) -> DataFrame:
    """Captions with the blocks that a trailing hyphen joins to them."""
    return per_page(spark, sf, caption_texts, "paper_id string, page int, block_id string, n_blocks int, caption string")


QUERIES = {f.__name__: f for f in (
    role_classify, formula_filter, repeated_margin, section_segments, page_sections, body_runs, caption_distinct, upper_medians, bbox_normalise, overlap_join,
    margin_filter, caption_neighbours, nearest_caption, table_cues, block_histogram, reading_order, continued_text, formula_candidates, region_merge, caption_text,
)}
SQL = {
    "role_classify": ROLE_SQL, "formula_filter": FORMULA_SQL, "repeated_margin": MARGIN_SQL, "section_segments": SECTION_SQL, "page_sections": PAGE_SECTION_SQL,
    "body_runs": BODY_RUN_SQL, "caption_distinct": CAPTION_SQL, "upper_medians": MEDIAN_SQL, "bbox_normalise": BBOX_SQL, "overlap_join": OVERLAP_SQL,
    "margin_filter": MARGIN_FILTER_SQL, "caption_neighbours": CAPTION_PIC_SQL, "nearest_caption": NEAREST_SQL, "table_cues": TABLE_CUE_SQL, "block_histogram": HISTOGRAM_SQL, "reading_order": READING_ORDER_SQL,
}
