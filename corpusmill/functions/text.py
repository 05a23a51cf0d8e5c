"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

#: What Python counts as white space, for Java patterns with (?U).
_SPACE = r"[\s\x1c-\x1f]"
#: The same as characters.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# A line that fits one of these belongs to a table of contents.
TOC_LINES = (r"^目\s*录\s*$", r"[.…]{3,}\s*\d{1,4}\s*$", r"\t{1,3}\d{1,4}\s*$", r"[（(]\d{1,4}[）)]\s*$")
# Page marks that cleaning takes out.
PAGE_MARKS = (r"第\s*\d+\s*页\s*/\s*共\s*\d+\s*页", r"^\d{1,4}$", r"---\s*Page\s*\d+\s*---")
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Markup of a line and what stays of it, in order.
MARKUP = (
    (r"!\[[^\]]*\]\([^)]*\)", "[图]"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"),
    (r"(?<!_)_([^_\n]+)_(?!_)", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"^#{1,6}\s+", ""),
    (r"^>\s?", ""),
    (r"^[\-\*\+]\s+", ""),
    (r"^\d+\.\s+", ""),
    (r"^[\-\*\_]{3,}\s*$", ""),
    (r"<[^>]*>", ""),
)


def strip(c: Column) -> Column:
    """Without white space at either end, as Python sees white space."""
    return F.trim(c, F.lit(_BLANKS))


def words(c: Column) -> Column:
    """Split at white space, case kept."""
    return F.filter(F.split(c, rf"(?U){_SPACE}+"), lambda w: w != "")


def is_toc_line(line: Column) -> Column:
    """Stripped once, and looked at closely only where the last character can end such a line."""

    def fits(stripped: Column) -> Column:
        found = F.lit(False)
        for p in TOC_LINES:
            found = found | stripped.rlike(f"(?Ud){p}")
        return F.substring(stripped, -1, 1).rlike(r"(?U)[\d)）录]") & found

    return F.exists(F.array(strip(line)), fits)


def drop_toc_lines(c: Column) -> Column:
    """Lines of a table of contents go, each judged by itself."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_toc_line(x)), "\n")


def clean(c: Column) -> Column:
    """Control characters, runs of blanks, page marks and tables of contents go; null if nothing is left."""
    c = F.regexp_replace(c, CONTROLS, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")
    c = F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n")
    for p in PAGE_MARKS:
        c = F.regexp_replace(c, f"(?Umd){p}", "")
    return F.nullif(strip(drop_toc_lines(c)), F.lit(""))


def strip_markup(c: Column) -> Column:
    """Markdown markup out of every line, at most one blank line in a row."""

    def line(x: Column) -> Column:
        for pattern, stays in MARKUP:
            x = F.regexp_replace(x, f"(?Ud){pattern}", stays)
        return x

    text = F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def title(c: Column, p: Params = DEFAULT) -> Column:
    """At most so many characters, with three dots behind what was cut."""
    return F.when(F.length(c) > p.title_length, F.concat(F.substring(c, 1, p.title_length), F.lit("..."))).otherwise(c)


def display_title(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def preview(c: Column, n: int = 120) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def summary_bypass(c: Column, n: int = 500) -> Column:
    """Short texts as they are, others cut with three dots, as where no model answers."""
    return F.when(F.length(c) < n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def chunk_id(user: Column, md5: Column, index: Column, p: Params = DEFAULT) -> Column:
    return F.format_string(f"%s_%s_%0{p.chunk_id_digits}d", user, md5, index)


def table_row(cells: Column) -> Column:
    """Cells of a table in a line; null cells are empty."""
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")


def page_ranges(pages: Column) -> Column:
    """[1, 2, 3, 5] as "1-3,5"; sorted and distinct first, nulls left out. Runs begin and end where a neighbour is missing, so time grows with the pages."""
    run = lambda s, e: F.when(e > s, F.concat(s.cast("string"), F.lit("-"), e.cast("string"))).otherwise(s.cast("string"))

    def ranges(own: Column) -> Column:
        first = F.filter(own, lambda p, i: (i == 0) | (F.get(own, i - 1) != p - 1))
        last = F.filter(own, lambda p, i: (i == F.size(own) - 1) | (F.get(own, i + 1) != p + 1))
        return F.array_join(F.zip_with(first, last, run), ",")

    # bound to a variable: an expression would be worked out again for every page
    return F.get(F.transform(F.array(F.array_sort(F.array_distinct(F.array_compact(pages)))), ranges), 0)


#: Items that a scan folds at a time.
SCANNED = 512


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], row: str) -> Column:
    """A row for each item: step(state, item) tells the next state and the row, whose type is named.

    A fold that appends to an array copies it each time. Here stretches of
    items are folded by themselves, so that only short arrays are copied, and
    what the stretches give is joined once in the end.
    """

    def stretch(state: Column, part: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, told = step(a["s"], x)
            return F.struct(after.alias("s"), F.array_append(a["out"], told).alias("out"))

        return F.aggregate(part, F.struct(state.alias("s"), F.array().cast(f"array<{row}>").alias("out")), one)

    def add(a: Column, part: Column) -> Column:
        # bound to a variable: an expression would be worked out once for each use
        return F.get(F.transform(F.array(stretch(a["s"], part)), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["outs"], r["out"]).alias("outs"))), 0)

    def whole(own: Column) -> Column:
        last = F.floor(F.greatest(F.size(own) - 1, F.lit(0)) / SCANNED).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * SCANNED + 1, F.lit(SCANNED)))
        begin = F.struct(start.alias("s"), F.array().cast(f"array<array<{row}>>").alias("outs"))
        return F.when(own.isNotNull(), F.flatten(F.aggregate(parts, begin, add, lambda a: a["outs"])))

    return F.get(F.transform(F.array(items), whole), 0)


def toc_paths(headings: Column) -> Column:
    """array<struct<level, text>> with the path of each heading: levels below 1 count as 1, a skipped level is no step."""

    def step(stack: Column, h: Column) -> tuple[Column, Column]:
        level = F.greatest(h["level"], F.lit(1))
        stack = F.array_append(F.slice(stack, F.lit(1), level - 1), h["text"])
        return stack, F.struct(level.cast("int").alias("level"), h["text"].alias("text"), F.array_join(stack, " > ").alias("path"))

    return scan(headings, F.array().cast("array<string>"), step, "struct<level:int,text:string,path:string>")


def reference_label(source: Column, page: Column, chapter: Column) -> Column:
    page, chapter = F.nullif(page.cast("string"), F.lit("")), F.nullif(chapter, F.lit(""))
    return F.concat(F.coalesce(source, F.lit("未知")), F.coalesce(F.concat(F.lit(" (第"), page, F.lit("页)")), F.lit("")), F.coalesce(F.concat(F.lit(" ["), chapter, F.lit("]")), F.lit("")))


def context_block(source: Column, page: Column, chapter: Column, text: Column, p: Params = DEFAULT) -> Column:
    """A header with the place of a text, and its beginning."""
    page, chapter = F.nullif(page.cast("string"), F.lit("")), F.nullif(chapter, F.lit(""))
    head = F.concat(F.lit("[来源: "), F.coalesce(source, F.lit("未知")), F.coalesce(F.concat(F.lit(", 第"), page, F.lit("页")), F.lit("")), F.coalesce(F.concat(F.lit(", "), chapter), F.lit("")), F.lit("]\n"))
    return F.concat(head, F.substring(text, 1, p.chunk_size))


def image_path(path: Column, p: Params = DEFAULT) -> Column:
    """With forward slashes and without the folder of extracted images."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(path.startswith(p.image_prefix), F.substring(path, len(p.image_prefix) + 1, 1 << 20)).otherwise(path)


def image_markdown(label: Column, path: Column, p: Params = DEFAULT) -> Column:
    return F.concat(F.lit("!["), F.coalesce(label, F.lit("未知")), F.lit(f"]({p.server_url}/images/"), image_path(path, p), F.lit(")"))


def role_prefix(role: Column) -> Column:
    return F.when(role == "human", "用户").when(role == "ai", "助手").otherwise(role)


def history(messages: Column, strip_marks: bool = True) -> Column:
    """array<struct<type, content>> as lines; none as the word for none."""
    content = lambda m: F.regexp_replace(m["content"], r"\[文档\d+\]", "") if strip_marks else m["content"]
    lines = F.transform(messages, lambda m: F.concat(role_prefix(m["type"]), F.lit(": "), content(m)))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "无").otherwise(F.array_join(lines, "\n"))


def simple_rewrite(query: Column, past: Column) -> Column:
    return F.when(past.isNull() | (past == "无"), query).otherwise(F.concat(F.lit("对话历史："), past, F.lit("\n当前问题："), query))


def accept_rewrite(query: Column, rewritten: Column, p: Params = DEFAULT) -> Column:
    """The rewritten query unless it is blank or too short."""
    r = strip(rewritten)
    return F.when(F.length(r) >= p.rewrite_min_len, r).otherwise(query)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Names in braces are filled in; with a name left over, the raw template."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    left = F.regexp_replace(template, r"\{(" + "|".join([*values, "\x00"]) + r")\}", "")
    return F.when(left.rlike(r"\{[A-Za-z_]\w*\}"), template).otherwise(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, with a guard against null vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda n, v: n + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def time_stamp(at: Column) -> Column:
    """A time in the form that ledgers, catalogues and conversations have, in whole seconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def scaled_size(width: Column, height: Column, most: int = 2048) -> Column:
    """Size of an image whose longer side is at most so many pixels."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * ratio)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * ratio)).cast("int").alias("height"))
