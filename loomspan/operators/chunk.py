"""Book chapters to addressable fragments: a line table, windows for state, folds for packing.

Every line is classified once; what the heading before it says (anchor,
section, example) is carried by windows over (chapter, line). Only the greedy
folds, merging and packing, are array aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_CHARS, MAX_CHARS, TARGET_CHARS, OVERLAP = 200, 6000, 2000, 400

# The headings that end, mark or number the parts of a chapter.
PROBLEM_ZONE = (r"(?i)^(?:problems?|exercises?|questions?|supplementary\s+problems?|additional\s+problems?|practice|chapter\s+\d+\s+exercises?|"
                r"answers?\s+to\s+(?:odd(?:-numbered)?\s+)?problems?|multiple\s+choice\s+questions?)\s*:?\s*$")  # fmt: skip
NOISE = (r"(?i)^(?:part(?:\s+[ivxlc0-9]+)?|chapter(?:\s+\d+)?|chapter\s+\d+\s*\.?\s*[a-z ]{0,60}|table\s*[\d.\-]*.*|fig(?:ure)?\.?\s*[\d.\-]*.*|references?|"
         r"acknowledge?ments?|suggested\s+reading|bibliography|index|appendix(?:\s+[a-z0-9]+)?.*|contents|preface|notation|box\s*[\d.\-]*.*|chapter\s+summary|"
         r"chapter\s+checklist|summary|introduction\s+to\s+the\s+exercises|general|technical|remarks?:?|historical\s+notes?)\s*:?\s*$")  # fmt: skip
SOLUTION = r"(?i)^solutions?\s*:?\s*$"
INLINE_SOLUTION = r"^Solutions?\s*:\s*$"
SECTION_DOT = r"^(\d+)\.(\d+)(?:\.(\d+))?\s*[■.]?\s*(.+?)\s*$"
SECTION_DASH = r"^(\d+)-(\d+)\s+(.+?)\s*$"
SECTION_ALT = r"^(\d{1,3})\s+([A-Za-z][A-Za-z0-9 ,;:\-'—–]{6,120})\s*$"
EXAMPLE = (r"(?i)^(?:example\s*(?:\d+(?:\.\d+)*)?\s*(?:\(.*?\))?\s*[:.\-]?\s*(.*)|worked\s*example\s*(?:\d+(?:\.\d+)*)?\s*[:.\-]?\s*(.*)|"
           r"sample\s*problem\s*\d+[\-.]?\d*\s*(.*)|solved\s*problems?\s*(.*))$")  # fmt: skip
INLINE_EXAMPLES = [
    r"^Example\s*\(([^)]+)\)\s*:",
    r"^Example\s+\d+(?:\.\d+)*\s+([A-Z][^\n]{2,100})?",
    r"^Worked\s+Example\s+\d+(?:\.\d+)*\s*[:\-.]\s*(.*)",
    r"^SAMPLE\s+PROBLEM\s+\d+[\-.]?\d*\s*([A-Z][^\n]{0,120})?",
    r"^EXAMPLE\s+\d+(?:\.\d+)*\s*[:\-.]?\s*(.*)",
]


def heading_class(h: Column) -> Column:
    """problem_zone, noise, solution, section, example, subsection: the first that fits. A section's title is more than digits."""
    titled = lambda p, g: h.rlike(p) & ~F.regexp_extract(h, p, g).rlike(r"^\d+$")
    section = titled(SECTION_DOT, 4) | titled(SECTION_DASH, 3) | h.rlike(SECTION_ALT)
    return (
        F.when(h.rlike(PROBLEM_ZONE), "problem_zone").when(h.rlike(NOISE), "noise").when(h.rlike(SOLUTION), "solution")
        .when(section, "section").when(h.rlike(EXAMPLE), "example").otherwise("subsection")
    )


def section_anchor(h: Column) -> Column:
    third = F.regexp_extract(h, SECTION_DOT, 3)
    dot = F.concat(F.regexp_extract(h, SECTION_DOT, 1), F.lit("."), F.regexp_extract(h, SECTION_DOT, 2), F.when(third != "", F.concat(F.lit("."), third)).otherwise(""))
    dash = F.concat(F.regexp_extract(h, SECTION_DASH, 1), F.lit("-"), F.regexp_extract(h, SECTION_DASH, 2))
    return (
        F.when(h.rlike(SECTION_DOT) & ~F.regexp_extract(h, SECTION_DOT, 4).rlike(r"^\d+$"), dot)
        .when(h.rlike(SECTION_DASH) & ~F.regexp_extract(h, SECTION_DASH, 3).rlike(r"^\d+$"), dash)
        .otherwise(F.regexp_extract(h, SECTION_ALT, 1))
    )


def section_title(h: Column) -> Column:
    title = (
        F.when(h.rlike(SECTION_DOT) & ~F.regexp_extract(h, SECTION_DOT, 4).rlike(r"^\d+$"), F.regexp_extract(h, SECTION_DOT, 4))
        .when(h.rlike(SECTION_DASH) & ~F.regexp_extract(h, SECTION_DASH, 3).rlike(r"^\d+$"), F.regexp_extract(h, SECTION_DASH, 3))
        .otherwise(F.regexp_extract(h, SECTION_ALT, 2))
    )
    return F.concat_ws(" ", section_anchor(h), T.strip(title))


def _edge_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ :.\-]+|[ :.\-]+$", "")


def lines(chapters: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, n, line, is_heading, cls, heading, inline): one row per line, up to the first problem zone."""
    rows = chapters.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?|[\x0b\x0c\x1c-\x1e\u0085  ]", "\n"), "\n", -1)).alias("n", "line"))
    heading = T.strip(F.regexp_extract("line", r"^#\s+(.+?)\s*$", 1))
    rows = rows.withColumn("is_heading", F.col("line").rlike(r"^#\s+(.+?)\s*$")).withColumn("heading", heading)
    rows = rows.withColumn("cls", F.when(F.col("is_heading"), heading_class(F.col("heading"))))
    w = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("gated", F.max((F.coalesce("cls", F.lit("")) == "problem_zone").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rows = rows.where(~F.col("gated")).drop("gated")
    said = T.strip("line")
    # A paragraph starts at the file's start, after a blank line and after a heading.
    starts = F.coalesce(F.lag((said == "") | F.col("is_heading")).over(w), F.lit(True)) & ~F.col("is_heading") & (said != "")
    title = F.coalesce(*(F.when(said.rlike(p), _edge_trim(F.regexp_extract(said, p, 1))) for p in INLINE_EXAMPLES))
    return rows.withColumn("inline", F.when(starts & title.isNotNull(), "example").when(starts & said.rlike(INLINE_SOLUTION), "solution")).withColumn("inline_title", title)


def chapter_titles(chapters: DataFrame, key: str = "path", text: str = "text", fallback: str = "chapter") -> DataFrame:
    """key, chapter_title: the leading headings before the first part, without 'Chapter N' and bare numbers, at most 200 characters."""
    rows = chapters.select(key, fallback, F.posexplode(F.filter(F.split(text, "\n", -1), lambda x: T.strip(x) != "")).alias("n", "line"))
    h = T.strip(F.regexp_extract("line", r"^#\s+(.+?)\s*$", 1))
    label = F.lower(h).rlike(r"^(?:part|chapter)\s*[ivxlc0-9]*\s*$") | h.rlike(r"^\d+$")
    stop = ~F.col("line").rlike(r"^#\s+(.+?)\s*$") | (~label & heading_class(h).isin("section", "example", "problem_zone")) | (label & h.rlike(SECTION_DOT))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("h", h).withColumn("label", label).withColumn("stopped", F.max(stop.cast("int")).over(w)).where("stopped = 0 AND NOT label")
    picked = kept.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "h"))), 1, 6).alias("t"))
    title = F.left(T.strip(F.regexp_replace(F.array_join(F.transform("t", lambda x: x["h"]), " "), r"\s+", " ")), F.lit(200))
    return chapters.select(key, fallback).join(picked.select(key, title.alias("t")), key, "left").select(key, F.coalesce("t", F.col(fallback)).alias("chapter_title"))


def raw_fragments(chapters: DataFrame, key: str = "path", manual: str | None = None) -> DataFrame:
    """(key, seq, anchor, section_path, kind, heading, example_title, text): non-empty runs of lines between the marks."""
    ls = lines(chapters, key)
    w = Window.partitionBy(key).orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    opens_example = (F.col("cls") == "example") | (F.col("inline") == "example")
    opens_text = F.col("cls").isin("section", "subsection")
    solves = (F.col("cls") == "solution") | (F.col("inline") == "solution")
    # A solution mark opens an example unless one is open: the last opening mark before it decides.
    mark = F.when(opens_example, "example").when(opens_text, "exposition").when(solves, "solution")
    before = F.last(F.when(mark.isin("example", "exposition", "solution"), F.when(mark == "exposition", "exposition").otherwise("example")), ignorenulls=True)
    ls = ls.withColumn("mark", mark).withColumn("open_kind", F.coalesce(before.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("exposition")))
    flush = opens_example | opens_text | (solves & (F.col("open_kind") != "example"))
    ls = ls.withColumn("flush", F.coalesce(flush, F.lit(False)))
    section = F.col("cls") == "section"
    ls = ls.withColumns({
        "anchor": F.coalesce(F.last(F.when(section, section_anchor(F.col("heading"))), ignorenulls=True).over(so_far), F.lit("")),
        "s1": F.last(F.when(section, section_title(F.col("heading"))), ignorenulls=True).over(so_far),
        "s_no": F.sum(section.cast("int")).over(so_far),
        "seq": F.sum(F.col("flush").cast("int")).over(so_far),
    })
    ls = ls.withColumn("s_no", F.coalesce("s_no", F.lit(0)))
    in_section = Window.partitionBy(key, "s_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("s2", F.last(F.when(F.col("cls") == "subsection", F.col("heading")), ignorenulls=True).over(in_section))
    head = F.when(F.col("cls") == "section", section_title(F.col("heading"))).when(F.col("is_heading"), F.col("heading")).otherwise(F.left(T.strip("line"), F.lit(200)))
    example_title = (
        F.when(F.col("cls") == "example", F.nullif(F.coalesce(*(F.nullif(_edge_trim(F.regexp_extract("heading", EXAMPLE, g)), F.lit("")) for g in (1, 2, 3, 4))), F.lit("")))
        .when(F.col("inline") == "example", F.coalesce(F.nullif("inline_title", F.lit("")), F.left(T.strip("line"), F.lit(200))))
        .when(F.col("mark") == "solution", "(Solution)")
    )
    # Headings that open a fragment are not part of its text; every other line is.
    body = F.when(~F.col("is_heading") | F.col("cls").isin("noise", "solution"), F.col("line"))
    opening = F.struct("n", "flush", "mark", head.alias("head"), example_title.alias("title"), "anchor", "s1", "s2")
    made = ls.groupBy(key, "seq").agg(F.min_by(opening, F.col("n")).alias("o"), F.array_sort(F.collect_list(F.struct("n", body.alias("b")))).alias("ls"))
    text = F.regexp_replace(F.array_join(F.transform(F.filter("ls", lambda x: x["b"].isNotNull()), lambda x: x["b"]), "\n"), r"(?U)^\s+|\s+\z", "")
    kind = F.when(F.col("o.flush") & (F.col("o.mark") != "exposition"), "example").otherwise("exposition")
    path = F.filter(F.array("o.s1", "o.s2"), lambda x: x.isNotNull())
    out = made.select(key, "seq", F.col("o.anchor").alias("anchor"), path.alias("section_path"), kind.alias("kind"), F.when(F.col("o.flush"), F.col("o.head")).alias("heading"),
                      F.when(F.col("o.flush"), F.col("o.title")).alias("example_title"), text.alias("text")).where("text <> ''")
    if manual:
        flags = chapters.select(key, F.col(manual).alias("__m"))
        out = out.join(flags, key).withColumn("kind", F.when(F.col("__m"), "example").otherwise(F.col("kind")))
        out = out.withColumn("section_path", F.when(F.col("__m"), F.concat(F.array(F.lit("Solution Manual")), "section_path")).otherwise(F.col("section_path"))).drop("__m")
    return out


def merge_tiny(frags: DataFrame, key: str = "path", least: int = MIN_CHARS) -> DataFrame:
    """Fragments under ``least`` characters join the one before them if place and kind agree."""
    w = Window.partitionBy(key).orderBy("seq")
    same = (F.col("anchor") == F.lag("anchor").over(w)) & (F.col("section_path") == F.lag("section_path").over(w)) & (F.col("kind") == F.lag("kind").over(w))
    isle = F.sum(F.when((F.length("text") < least) & F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    packed = frags.withColumn("isle", isle).groupBy(key, "isle").agg(
        F.min_by(F.struct("seq", "anchor", "section_path", "kind", "heading", "example_title"), F.col("seq")).alias("o"),
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"),
    )
    return packed.select(key, "o.*", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def pack_paragraphs(text: Column, target: int = TARGET_CHARS, most: int = MAX_CHARS) -> Column:
    """array<string>: paragraphs filled up to ``target`` in order; a paragraph over ``most`` is cut at sentences first."""
    wrap = lambda p: F.when(F.length(p) > most, F.split(p, r"(?<=[.!?])\s+", -1)).otherwise(F.array(p))
    hard = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int"))), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    units = F.flatten(F.transform(F.flatten(F.transform(F.filter(F.split(text, r"\n\s*\n", -1), lambda p: T.strip(p) != ""), wrap)), hard))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("buf"))

    def step(a, p):
        fits = (a["buf"] == "") | (F.length(a["buf"]) + 2 + F.length(p) <= target)
        joined = F.when(a["buf"] == "", p).otherwise(F.concat(a["buf"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))).alias("out"), F.when(fits, joined).otherwise(p).alias("buf"))

    return F.aggregate(units, start, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def split_oversize(frags: DataFrame, key: str = "path") -> DataFrame:
    """One row per chunk: fragments up to MAX_CHARS whole, longer ones packed, each chunk led by the end of the one before."""
    chunks = F.when(F.length("text") <= MAX_CHARS, F.array("text")).otherwise(pack_paragraphs(F.col("text")))
    each = frags.withColumn("chunks", chunks).select("*", F.posexplode("chunks").alias("part", "chunk"))
    lead = F.when(F.col("part") > 0, F.concat(F.right(F.get("chunks", F.col("part") - 1), F.lit(OVERLAP)), F.lit("\n\n"))).otherwise("")
    w = Window.partitionBy(key).orderBy("seq", "part")
    return each.withColumn("text", F.concat(lead, "chunk")).withColumn("idx", (F.row_number().over(w) - 1).cast("int")).drop("chunks", "chunk")


def fragments(chapters: DataFrame, key: str = "path", manual: str | None = None) -> DataFrame:
    """Chapters (key, book, chapter, text) to fragments with ids, search text and sizes."""
    parts = split_oversize(merge_tiny(raw_fragments(chapters, key, manual), key), key).join(chapters.select(key, "book", "chapter"), key)
    parts = parts.join(chapter_titles(chapters, key), key)
    return parts.select(
        T.fragment_id(F.col("book"), F.col("chapter"), F.col("anchor"), F.col("idx"), F.col("text")).alias("fragment_id"), "book", "chapter", "chapter_title", "anchor",
        "section_path", "kind", F.coalesce("heading", "chapter_title").alias("heading"), "example_title", F.col("text").alias("text_md"),
        T.normalise_for_search("text").alias("text_norm"), F.length("text").cast("long").alias("n_chars"), T.tokens_estimate(F.length("text")).alias("n_tokens_est"), "idx",
    )
