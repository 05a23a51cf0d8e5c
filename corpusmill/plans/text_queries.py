"""Queries of cleaning, splitting, layout and uploads, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..operators import chunking, layout, uploads
from ..params import Params
from ..sources import loaders, tables
from . import ingest

#: The supplied texts are clean, so noise of every kind is put around them.
NOISE = ("a\x01b\x0c\n\n\n\n12\nIntro.....12\nx    y\t\n  --- Page 3 ---\nKap (10)\n目 录\n第 1 页 / 共 9 页\n1.1\t7\n", "\n12345\n \n \n \n0042\nend")


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", F.concat(F.lit(NOISE[0]), "text", F.lit(NOISE[1])).alias("text"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _noisy(spark, sf_dir).withColumn("text", tx.clean(F.col("text"))).where("text is not null")
    return rows.select("doc_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n"))


def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _noisy(spark, sf_dir).withColumn("text", tx.drop_toc_lines(F.col("text")))
    return rows.select("doc_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace("html", r"<[^>]*>", "")).alias("md5"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookarounds have no counterpart in the other dialect: held against Python in the tests."""
    d = tables.documents(spark, sf_dir)
    marked = F.concat(F.lit("# H\n> **b** [t](u) ![a](u) *i* ~~s~~ `c`\n- "), "text", F.lit("\n\n\n\n1. x <b>y</b>\n---"))
    return d.select("doc_id", F.md5(tx.strip_markup(marked)).alias("md5"))


def markdown_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir)
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), "text", F.lit("\n\n### "), F.col("lang"), F.lit("\n\n- a\n  - b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n"))
    return d.select("doc_id", md.markdown(marked).alias("m")).select("doc_id", F.md5("m.text").alias("md5"), F.element_at("m.toc", -1)["path"].alias("last_path"))


def toc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a heading; paths as one digest, and how many."""
    heads = F.transform(F.split("text", "\n"), lambda x: F.struct((F.length(x) % 4).cast("int").alias("level"), x.alias("text")))
    paths = tables.documents(spark, sf_dir).select("doc_id", tx.toc_paths(heads).alias("p"))
    return paths.select("doc_id", F.md5(F.array_join(F.transform("p", lambda h: F.concat_ws(":", h["level"], h["path"])), "|")).alias("md5"), F.size("p").cast("long").alias("n"))


def toc_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines as headings."""
    heads = F.transform(F.split("text", "\n"), lambda x: F.struct((F.length(x) % 4).cast("int").alias("level"), x.alias("text")))
    return tables.documents(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.transform(tx.toc_paths(heads), lambda h: F.concat_ws(":", h["level"], h["path"])), "|")).alias("md5"))


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir)
    pages = d.select(F.col("source").alias("user_id"), F.md5(F.concat_ws("|", "doc_id", "text")).alias("md5"), F.lit(1).alias("page"), "text")
    return chunking.split_chunks(pages).select("chunk_id", "chunk_index", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n"))


def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents that an empty ledger lets in, by tenant."""
    d = tables.documents(spark, sf_dir)
    files = d.select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("original_filename"), "text")
    chunks, _ = ingest.ingest(files, tables.empty(spark, "user_id string, md5 string"))
    return chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("md5").alias("n_files"), F.max(F.length("text")).cast("long").alias("longest"))


def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label are near each other; each is a chunk of the file of that label."""
    e = tables.table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("long").alias("file_id"), F.col("vec_id").cast("int").alias("seq"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"), (F.col("vec_id") % 50).cast("int").alias("page"), F.array(F.lit("i.png")).alias("image_paths"), "embedding")
    merged = chunking.merge_chunks(rows, Params(merge_threshold=0.1, merge_max_len=60))
    return merged.select("file_id", "seq", F.md5("text").alias("md5"), "page_range", "n_merged")


def phash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    bits = F.expr("shiftleft(1L, cast(event_id % 60 as int)) - 1")
    images = e.select(F.col("user_id").alias("file_id"), F.col("event_id").cast("int").alias("seq"), F.when(F.col("event_type") != "view", bits).alias("hash"))
    return chunking.phash_groups(images)


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    items = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("seq"), F.ceil(n / 450).alias("n_chunks"), n.alias("n_chars"))
    return chunking.assign_batches(items)


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").select("source", "lang", (F.col("n_chars") % 97).cast("int").alias("p"))
    return d.groupBy("source", "lang").agg(F.collect_set("p").alias("p")).select("source", "lang", tx.page_ranges(F.col("p")).alias("ranges"))


def pdf_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    pages = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), (n > 700).alias("has_text"), F.array(F.struct((n % 60).alias("w"), (n % 45).alias("h"))).alias("images"))
    return layout.file_types(pages)


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    kind = layout.page_type(n > 700, F.array(F.struct((n % 60).alias("w"), (n % 45).alias("h"))))
    return tables.table(spark, sf_dir, "documents").select("doc_id", kind.alias("page_type"))


def _boxes(n):
    return F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct((n * i % 13).alias("x"), (n * i % 101).alias("y"), (n * i % 127).alias("w"), (n * i % 89).alias("h")))


def chart_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = F.transform(_boxes(F.col("n_chars")), lambda b: F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1")))
    kept = layout.chart_rects(rects)
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.coalesce(F.aggregate(kept, F.lit(0).cast("long"), lambda a, r: a + r["x1"] * r["y1"]), F.lit(0)).alias("s"))


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, images = layout.page_blocks(_boxes(F.col("n_chars")))
    tell = lambda a: F.array_join(F.transform(a, lambda b: F.concat_ws(":", b["y"], b["x"], b["w"], b["h"])), ",")
    return tables.table(spark, sf_dir, "documents").select("doc_id", tell(words).alias("text_boxes"), tell(images).alias("image_boxes"))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of whole texts; page as its digest and length."""
    cells = F.array(F.array(F.array(F.col("lang"), F.lit(None).cast("string")), F.array(F.col("source"), F.lit("z"))))
    page = layout.mixed_page(F.col("text"), cells, F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(page).alias("md5"), F.length(page).cast("long").alias("n"))


def mixed_pages_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of whole texts."""
    cells = F.array(F.array(F.array(F.col("lang"), F.lit(None).cast("string")), F.array(F.col("source"), F.lit("z"))))
    page = layout.mixed_page(F.col("text"), cells, F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(page).alias("md5"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), "text")
    return uploads.fingerprint(files, per_user=False).select("file_id", "md5", "first_id", "duplicate")


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), "text")
    return uploads.fingerprint(files).select("user_id", "file_id", "md5", "first_id", "duplicate")


#: Endings and first bytes that go round with the ids.
ENDINGS = ("txt", "PDF", "md", "exe", "docx", "pptx", "gz")
HEADS = ("25504446", "89504E47", "FFD8FFE0", "47494638", "D0CF11E0", "68656C6C", "")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda a: F.element_at(F.array(*[F.lit(x) for x in a]), (F.col("doc_id") % len(a) + 1).cast("int"))
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "n_chars", F.concat(F.lit("d/f."), pick(ENDINGS)).alias("name"), pick(HEADS).alias("head"))


def validate_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", uploads.validate(F.col("name"), F.col("n_chars") * 30_000).alias("verdict"))


def archive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _named(spark, sf_dir).select(F.col("source").alias("archive_id"), "name", (F.col("n_chars") * 3_000).alias("size"))
    return uploads.archive_fits(members)


def magic_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", uploads.diagnose(F.col("head")).alias("status"))


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of files, and texts as they are."""
    rows = _named(spark, sf_dir).select("doc_id", uploads.media_type(F.col("head")).alias("of_head"))
    whole = tables.documents(spark, sf_dir).select("doc_id", uploads.media_type(F.hex(F.encode("text", "UTF-8"))).alias("of_text"))
    return rows.join(whole, "doc_id")


def error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    errors = F.array(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "No module named x").otherwise("ok"), F.when(F.col("doc_id") % 2 == 0, "文件已加密").otherwise("fitz"))
    return d.select("doc_id", uploads.loader_error(errors).alias("error"))


def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in ("Empty file", "内容为空", "Size limit", "文件过大", "broken")]), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(F.col("event_type") == "view", "duplicate").otherwise("failed")
    return tables.table(spark, sf_dir, "events").select("event_id", uploads.classify_error(status, pick).alias("error_type"))


def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored in two encodings come back as they were."""
    d = tables.documents(spark, sf_dir)
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "e"), "ISO-8859-1"))
    return d.select("doc_id", F.md5(loaders.encodings_column(content)).alias("md5"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, toc_filter, html_text, markdown_strip, markdown_parse, toc_paths, toc_paths_whole, split_chunks, ingest_files, semantic_merge, phash_dedup, batch_assign, page_ranges, pdf_type, page_types,
        chart_rects, block_split, mixed_pages, mixed_pages_whole, exact_dedup, duplicate_files, validate_upload, archive_limits, magic_diagnosis, media_types, error_triage, classify_error, encoding_fallback,
    )
}


def _literal(s: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" if c < " " else f"'{c}'" for c in s) + ")"


def _pick(a: tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{x}'" for x in a) + f"])[doc_id % {len(a)} + 1]"


_RAW = f"n AS (SELECT doc_id, {_literal(NOISE[0])} || text || {_literal(NOISE[1])} AS text FROM documents)"
_STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"
_TOC = "(" + " OR ".join(f"regexp_matches({_STRIP.format('l')}, '{p}')" for p in tx.TOC_LINES) + ")"
_LINES = "list_filter(string_split(@TEXT@, chr(10)), lambda l: NOT " + _TOC + ")"
_IMAGES = "CASE WHEN n_chars > 700 AND n_chars % 60 > 30 AND n_chars % 45 > 30 THEN 'text_mix_pdf' WHEN n_chars % 60 > 30 AND n_chars % 45 > 30 THEN 'scan_pdf' ELSE 'text_pdf' END"
_BOXES = "b AS (SELECT doc_id, unnest(range(1, 10)) AS i, n_chars * unnest(range(1, 10)) % 13 AS x, n_chars * unnest(range(1, 10)) % 101 AS y, n_chars * unnest(range(1, 10)) % 127 AS w, n_chars * unnest(range(1, 10)) % 89 AS h FROM documents)"
_FILES = "f AS (SELECT source AS user_id, doc_id AS file_id, md5(text) AS md5 FROM documents)"
_OK = "lower(regexp_extract(name, '\\.([^./]*)$', 1)) IN ('txt', 'pdf', 'md', 'pptx', 'docx')"
_BOX_LIST = "coalesce(string_agg(concat_ws(':', y, x, w, h), ',' ORDER BY y, x, w, h) FILTER (WHERE w * h >= 500 AND {} (w * h > 5000 AND w > 50 AND h > 50)), '')"

ORACLES = {
    "clean_text": f"WITH {_RAW}, c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g') AS t FROM n), "
    f"s AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda l: {_STRIP.format('l')}), chr(10)) AS t FROM c), "
    f"m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{tx.PAGE_MARKS[0]}', '', 'g'), '(?m){tx.PAGE_MARKS[1]}', '', 'g'), '{tx.PAGE_MARKS[2]}', '', 'g') AS t FROM s), "
    f"o AS (SELECT doc_id, {_STRIP.format('array_to_string(' + _LINES.replace("@TEXT@", "t") + ', chr(10))')} AS t FROM m) SELECT doc_id, md5(t) AS md5, length(t) AS n FROM o WHERE t <> ''",
    "toc_filter": f"WITH {_RAW}, o AS (SELECT doc_id, array_to_string({_LINES.replace("@TEXT@", "text")}, chr(10)) AS t FROM n) SELECT doc_id, md5(t) AS md5, length(t) AS n FROM o",
    "html_text": "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS md5 FROM pages",
    "toc_paths": "WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), h AS (SELECT doc_id, i, greatest(length(t) % 4, 1) AS lv, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l)), "
    "r AS (SELECT doc_id, i, lv, [t] AS stack FROM h WHERE i = 1 UNION ALL SELECT h.doc_id, h.i, h.lv, list_append(r.stack[1:h.lv - 1], h.t) FROM r JOIN h ON h.doc_id = r.doc_id AND h.i = r.i + 1) "
    "SELECT doc_id, md5(string_agg(lv || ':' || array_to_string(stack, ' > '), '|' ORDER BY i)) AS md5, count(*) AS n FROM r GROUP BY doc_id",
    "toc_paths_whole": "WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), h AS (SELECT doc_id, i, greatest(length(t) % 4, 1) AS lv, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l)), "
    "r AS (SELECT doc_id, i, lv, [t] AS stack FROM h WHERE i = 1 UNION ALL SELECT h.doc_id, h.i, h.lv, list_append(r.stack[1:h.lv - 1], h.t) FROM r JOIN h ON h.doc_id = r.doc_id AND h.i = r.i + 1) "
    "SELECT doc_id, md5(string_agg(lv || ':' || array_to_string(stack, ' > '), '|' ORDER BY i)) AS md5 FROM r GROUP BY doc_id",
    "phash_dedup": "WITH RECURSIVE e AS (SELECT user_id AS file_id, CAST(event_id AS INTEGER) AS seq, CASE WHEN event_type <> 'view' THEN (CAST(1 AS BIGINT) << (event_id % 60)) - 1 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "r AS (SELECT file_id, k, seq, seq AS rep_seq, CASE WHEN h IS NULL THEN [] ELSE [{'s': seq, 'h': h}] END AS firsts FROM e WHERE k = 1 UNION ALL "
    "SELECT file_id, k, seq, coalesce(f, seq), CASE WHEN h IS NULL OR f IS NOT NULL THEN firsts ELSE list_append(firsts, {'s': seq, 'h': h}) END FROM ("
    "SELECT e.file_id, e.k, e.seq, e.h, r.firsts, CASE WHEN e.h IS NOT NULL THEN list_filter(r.firsts, lambda x: bit_count(xor(x.h, e.h)) <= 10)[1].s END AS f FROM r JOIN e ON e.file_id = r.file_id AND e.k = r.k + 1)) "
    "SELECT file_id, seq, rep_seq FROM r",
    "semantic_merge": "WITH RECURSIVE e AS (SELECT CAST(label AS BIGINT) AS file_id, vec_id, 't' || vec_id AS t, CAST(vec_id % 50 AS INTEGER) AS page, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), "
    "r AS (SELECT file_id, k, t, page, 0 AS g, length(t) AS size, e AS c FROM e WHERE k = 1 UNION ALL "
    "SELECT file_id, k, t, page, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN size + length(t) ELSE length(t) END, CASE WHEN j THEN list_transform(range(1, len(e) + 1), lambda i: (c[i] + e[i]) / 2) ELSE e END FROM ("
    "SELECT e.file_id, e.k, e.t, e.page, e.e, r.g, r.size, r.c, r.size + length(e.t) <= 60 AND list_dot_product(r.c, e.e) / (sqrt(list_dot_product(r.c, r.c)) * sqrt(list_dot_product(e.e, e.e)) + 1e-9) > 0.1 AS j "
    "FROM r JOIN e ON e.file_id = r.file_id AND e.k = r.k + 1)), "
    "p AS (SELECT DISTINCT file_id, g, page FROM r), i AS (SELECT *, page - row_number() OVER (PARTITION BY file_id, g ORDER BY page) AS d FROM p), n AS (SELECT file_id, g, min(page) AS a, max(page) AS b FROM i GROUP BY file_id, g, d), "
    "q AS (SELECT file_id, g, string_agg(CASE WHEN b > a THEN a || '-' || b ELSE CAST(a AS VARCHAR) END, ',' ORDER BY a) AS page_range FROM n GROUP BY file_id, g) "
    "SELECT file_id, g AS seq, md5(string_agg(t, '' ORDER BY k)) AS md5, any_value(page_range) AS page_range, CAST(count(*) AS INTEGER) AS n_merged FROM r JOIN q USING (file_id, g) GROUP BY file_id, g",
    "batch_assign": "WITH RECURSIVE i AS (SELECT source AS user_id, doc_id AS seq, CAST(ceil(length(text) / 450) AS BIGINT) AS n, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), "
    "r AS (SELECT user_id, seq, k, 0 AS batch, n, c FROM i WHERE k = 1 UNION ALL "
    "SELECT i.user_id, i.seq, i.k, r.batch + CASE WHEN r.n >= 50 OR r.c >= 18000 THEN 1 ELSE 0 END, i.n + CASE WHEN r.n >= 50 OR r.c >= 18000 THEN 0 ELSE r.n END, i.c + CASE WHEN r.n >= 50 OR r.c >= 18000 THEN 0 ELSE r.c END "
    "FROM r JOIN i ON i.user_id = r.user_id AND i.k = r.k + 1) SELECT user_id, seq, CAST(batch AS INTEGER) AS batch FROM r",
    "page_ranges": "WITH p AS (SELECT DISTINCT source, lang, CAST(n_chars % 97 AS INTEGER) AS p FROM documents), g AS (SELECT *, p - row_number() OVER (PARTITION BY source, lang ORDER BY p) AS g FROM p), "
    "r AS (SELECT source, lang, min(p) AS a, max(p) AS b FROM g GROUP BY source, lang, g) SELECT source, lang, string_agg(CASE WHEN b > a THEN a || '-' || b ELSE CAST(a AS VARCHAR) END, ',' ORDER BY a) AS ranges FROM r GROUP BY source, lang",
    "page_types": f"SELECT doc_id, {_IMAGES} AS page_type FROM documents",
    "pdf_type": f"WITH t AS (SELECT source AS file_id, {_IMAGES} AS t FROM documents) SELECT file_id, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE 'mixed' END AS pdf_type, count_if(t = 'scan_pdf')::BIGINT AS scan_pdf, count_if(t = 'text_mix_pdf')::BIGINT AS text_mix_pdf, count_if(t = 'text_pdf')::BIGINT AS text_pdf FROM t GROUP BY file_id",
    "chart_rects": f"WITH {_BOXES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM b WHERE w * h > 5000) SELECT doc_id, count(k.n) AS n, CAST(coalesce(sum((x + w) * (y + h)), 0) AS BIGINT) AS s FROM documents LEFT JOIN (SELECT * FROM k WHERE n <= 5) k USING (doc_id) GROUP BY doc_id",
    "block_split": f"WITH {_BOXES} SELECT doc_id, {_BOX_LIST.format('NOT')} AS text_boxes, {_BOX_LIST.format('')} AS image_boxes FROM b GROUP BY doc_id",
    "mixed_pages": "SELECT doc_id, md5(page) AS md5, length(page) AS n FROM (SELECT doc_id, text || chr(10) || chr(10) || lang || ' | ' || chr(10) || source || ' | z' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || '[图表描述]: ' || lang ELSE '' END AS page FROM documents)",
    "mixed_pages_whole": "SELECT doc_id, md5(text || chr(10) || chr(10) || lang || ' | ' || chr(10) || source || ' | z' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || '[图表描述]: ' || lang ELSE '' END) AS md5 FROM documents",
    "exact_dedup": f"WITH {_FILES} SELECT file_id, md5, min(file_id) OVER (PARTITION BY md5) AS first_id, file_id <> min(file_id) OVER (PARTITION BY md5) AS duplicate FROM f",
    "duplicate_files": f"WITH {_FILES} SELECT user_id, file_id, md5, min(file_id) OVER (PARTITION BY user_id, md5) AS first_id, file_id <> min(file_id) OVER (PARTITION BY user_id, md5) AS duplicate FROM f",
    "validate_upload": f"WITH n AS (SELECT doc_id, n_chars * 30000 AS size, 'd/f.' || {_pick(ENDINGS)} AS name FROM documents) SELECT doc_id, CASE WHEN size > 104857600 THEN 'size_exceeded' WHEN NOT {_OK} THEN 'unsupported_format' ELSE 'ok' END AS verdict FROM n",
    "archive_limits": f"WITH n AS (SELECT source AS archive_id, n_chars * 3000 AS size, 'd/f.' || {_pick(ENDINGS)} AS name FROM documents) SELECT archive_id, count_if({_OK})::BIGINT AS n_valid, count_if(NOT {_OK})::BIGINT AS n_skipped, CAST(sum(CASE WHEN {_OK} THEN size ELSE 0 END) AS BIGINT) AS bytes, sum(CASE WHEN {_OK} THEN size ELSE 0 END) <= 209715200 AS fits FROM n GROUP BY archive_id",
    "magic_diagnosis": f"SELECT doc_id, CASE {_pick(HEADS)} WHEN '' THEN 'empty_file' WHEN '25504446' THEN 'parse_error' WHEN '68656C6C' THEN 'unknown_format' ELSE 'unsupported_format' END AS status FROM documents",
    "media_types": f"SELECT doc_id, CASE {_pick(HEADS)} WHEN '' THEN 'application/x-empty' WHEN '25504446' THEN 'application/pdf' WHEN '89504E47' THEN 'image/png' WHEN 'FFD8FFE0' THEN 'image/jpeg' WHEN '47494638' THEN 'image/gif' WHEN 'D0CF11E0' THEN 'application/x-ole-storage' ELSE 'text/plain' END AS of_head, CASE WHEN text = '' THEN 'application/x-empty' ELSE 'text/plain' END AS of_text FROM documents",
    "error_triage": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'No module named x' WHEN doc_id % 2 = 0 THEN '文件已加密' ELSE 'fitz' END AS error FROM documents",
    "classify_error": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'duplicate' WHEN event_id % 5 < 2 THEN 'empty_content' WHEN event_id % 5 < 4 THEN 'size_exceeded' ELSE 'parse_failed' END AS error_type FROM events",
    "encoding_fallback": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g') END) AS md5 FROM documents",
}
