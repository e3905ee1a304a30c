"""Document structure: pages, tables, headings and summaries from Markdown or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, strip

MARK = "\u0001"


def extract_tables(text: Column) -> Column:
    """Stripped Markdown tables, in order. Each row must end with a newline, so a last row at the very end is left out."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(P.TABLE_BLOCK), F.lit(1)), strip), lambda t: t != "")
    return F.when(~F.contains(text, F.lit("|")), F.array().cast("array<string>")).otherwise(found)


def split_pages(docs: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """(name, page, text, tables): Markdown cut at page marks.

    A mark numbers what follows; what stands before the first is page 1. Rules
    and form feeds are breaks within a page, and a body of digits stays a body.
    Blank pages go; a document without any page is one page, stripped.
    """
    soft = F.replace(F.replace(F.col(text), F.lit("\n---\n"), F.lit("")), F.lit("\f"), F.lit(""))
    marked = F.when(F.contains(soft, F.lit("<!--")), F.regexp_replace(soft, "(?U)" + P.PAGE_MARK, MARK + "$1" + MARK)).otherwise(soft)

    def page(parts: Column, i: Column) -> Column:
        number = F.when(i == 0, F.lit(1)).otherwise(F.get(parts, i - 1).cast("int")).cast("long")
        return let(F.get(parts, i), lambda raw: F.struct(number.alias("page"), strip(raw).alias("text"), extract_tables(raw).alias("tables")))

    def kept(parts: Column) -> Column:
        bodies = F.filter(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda i: strip(F.get(parts, i)) != "")
        return F.transform(bodies, lambda i: page(parts, i))

    whole = F.array(F.struct(F.lit(1).cast("long").alias("page"), strip(F.col(text)).alias("text"), extract_tables(F.col(text)).alias("tables")))
    pages = let(F.split(marked, MARK), kept)
    pages = let(pages, lambda p: F.when(F.coalesce(F.size(p), F.lit(0)) > 0, p).otherwise(whole))
    return docs.select(name, F.inline(pages))


def is_boilerplate(line: Column) -> Column:
    starts = F.lit(False)
    for prefix in P.BOILERPLATE_PREFIXES:
        starts = starts | line.startswith(prefix)
    return starts | line.rlike(P.COMPANY_LINE)


def looks_like_title(line: Column) -> Column:
    """Whether a line of plain text reads as a heading; the first rule that applies decides."""
    n, colon = F.length(line), F.instr(line, "：") - 1
    return (
        F.when((n < 4) | (n > 100) | ~line.rlike("[一-鿿]") | is_boilerplate(line), False)
        .when(F.contains(line, F.lit("。")) | F.contains(line, F.lit("！")) | F.contains(line, F.lit("？")) | line.rlike(P.RUNNING_TEXT) | line.rlike(P.CLAUSE_JOIN) | line.rlike("(?U)" + P.DATA_LINE), False)
        .when(F.contains(line, F.lit("......")) & line.rlike(r"(?U)\.{6,}\s*$"), True)
        .when((colon >= 2) & (colon <= n * 0.5), True)
        .otherwise((n <= 40) & ~line.rlike(r"(?U)\d"))
    )


def titles(pages: DataFrame) -> DataFrame:
    """(filename, page, line, title): headings by line, Markdown ones and plain ones.

    Each line is judged once, within its page's row: a filter behind the explode would judge it again.
    """
    head = lambda x: strip(F.regexp_extract(x, r"(?U)^#{1,4}\s+([^\n]+)", 1))
    bare = lambda x: F.when(F.contains(x, F.lit("...")), strip(F.regexp_replace(x, r"(?U)\s*\.{3,}\s*$", ""))).otherwise(x)
    marked = lambda x: x.startswith("#") & x.rlike("(?U)" + P.MARKDOWN_HEAD)
    title = lambda x: F.when(marked(x), head(x)).when(looks_like_title(x), bare(x))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), let(strip(x), title).alias("title")))
    return pages.select("filename", "page", F.inline(F.filter(lines, lambda s: F.length(s["title"]) > 2)))


def summary(text: Column) -> Column:
    """The first clause of the first line that says something, 200 characters at most; none: empty."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    clause = lambda x: F.get(F.split(x, "[。；，]"), F.lit(0))
    useful = F.filter(
        lines,
        lambda x: ~x.rlike("(?U)" + P.MARKDOWN_HEAD) & (F.length(x) >= 10) & ~x.rlike(r"(?U)^[\d\s|｜\-+]+$") & ~is_boilerplate(x) & ~x.rlike(r"(?U)\.{6,}\s*$") & (F.length(clause(x)) > 5),
    )
    return F.coalesce(F.substring(clause(F.get(useful, F.lit(0))), 1, 200), F.lit(""))


def summaries(pages: DataFrame) -> DataFrame:
    """(filename, page, summary): pages that have one."""
    return pages.select("filename", "page", summary(F.col("text")).alias("summary")).where("summary <> ''")


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))
