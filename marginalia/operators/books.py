"""Pages out of plain text and markup (SRC20, SRC21, TX35, TX36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.once import evaluated
from marginalia.functions.text import strip

#: The lines before and after a book's text, what starts a chapter's heading, and a line of stars.
START, END = r"(?i)\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG[^*]*\*{3}", r"(?i)\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG[^*]*\*{3}"
HEADING = r"\n[ \t]*(?:CHAPTER|Chapter|LETTER|Letter|PART|Part)[ \t]+[IVXLCDM\d]+[^\n]*"
STARS = r"^\*{3,}$"
#: Shortest paragraph kept, paragraphs of a page, shortest text of a page of markup.
LEAST_PARAGRAPH, PER_PAGE, LEAST_CONTENT = 60, 20, 40


def body_of(x: Column) -> Column:
    """A book's text without what stands before its start and after its end."""
    after = F.when(x.rlike(START), F.element_at(F.split(x, START, 2), 2)).otherwise(x)
    return F.get(F.split(after, END, 2), F.lit(0))


def plain(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "&nbsp;", " "), r"\s+", " "))


def html_page(x: Column) -> tuple[Column, Column, Column]:
    """(text, heading, whether it has content) of a page of markup; '' without a heading."""
    return plain(x), plain(F.regexp_extract(x, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)), F.length(plain(x)) > LEAST_CONTENT


def text_pages(df: DataFrame, id_col: str, text_col: str, title: Column, per_page: int = PER_PAGE) -> DataFrame:
    """(id, chapter, part, label, paragraphs) of every text that isn't blank.

    Headings part chapters if there are two or more, else the text is one chapter,
    number 0, under its title; what stands before the first heading belongs to none.
    Chapters without a long enough paragraph have no page.
    """
    mark = "\x01"
    live = df.filter(F.col(text_col).rlike(r"\S")).select(id_col, title.alias("__title"), body_of(F.col(text_col)).alias("__b"))
    cut = evaluated(live, __x=F.split(F.regexp_replace("__b", f"({HEADING})", f"{mark}$1{mark}"), mark))
    pair = lambda k: F.struct(k.alias("chapter"), F.trim(F.regexp_replace(F.get("__x", 2 * k - 1), r"\s+", " ")).alias("heading"), F.get("__x", 2 * k).alias("body"))
    whole = F.array(F.struct(F.lit(0).alias("chapter"), F.col("__title").alias("heading"), F.array_join("__x", "").alias("body")))
    n = F.floor((F.size("__x") - 1) / 2).cast("int")
    chapters = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pair)).otherwise(whole)
    c = cut.select(id_col, F.inline(chapters))
    paras = F.filter(F.transform(F.split("body", r"\n\n+"), lambda p: strip(F.replace(F.regexp_replace(p, r"[ \t]+", " "), F.lit("\n"), F.lit(" ")))), lambda p: (F.length(p) > LEAST_PARAGRAPH) & ~p.rlike(STARS))
    c = evaluated(c.select(id_col, "chapter", "heading", "body"), __p=paras).filter(F.size("__p") > 0)
    c = c.withColumn("__n", F.ceil(F.size("__p") / per_page).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    label = F.when(F.col("__n") == 1, F.col("heading")).otherwise(F.concat("heading", F.lit(" ("), F.col("part").cast("string"), F.lit("/"), F.col("__n").cast("string"), F.lit(")")))
    return c.select(id_col, "chapter", "part", label.alias("label"), F.slice("__p", (F.col("part") - 1) * per_page + 1, F.lit(per_page)).alias("paragraphs"))
