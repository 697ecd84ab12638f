"""Manuals as pages: blocks between blank lines, headings of any depth as a stack, chunks.

A heading of level n takes all from the stack that is n deep or deeper, and is put on it. The stack
after any block follows from running values alone: a heading adds one to the depth and cuts it to its level,
so the depth is the least, over the headings so far, of its level plus the headings after it; and what
stands k deep is the last heading that was put there. So no fold over a document is needed; its rows stream by in
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import body_pages

FRONT = "Front Matter"


def text_blocks(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, block (from 0), text with single spaces: what stands between blank lines of a page; nothing of blank pages."""
    each = F.posexplode(F.filter(F.transform(F.split(text, r"\R\s*\R"), T.squeeze), lambda b: b != ""))
    return pages.select(doc, page, each.alias("block", "text"))


def titled(x: Column) -> Column:
    """A heading's name: a chapter without a title in title case, one with a title by that alone, others cleaned."""
    c = T.clean_heading(x)
    title = F.trim(F.regexp_extract(c, r"(?i)^(chapter|unit)\s+\d+\s+(.*)$", 2))
    return F.when(T.is_chapter_alone(c), F.initcap(c)).when(F.rlike(c, F.lit(r"(?i)^(chapter|unit)\s+\d+\s+(.*)$")), title).otherwise(c)


def stacked(rows: DataFrame, doc: str, order: list[str], level: str, name: str, deepest: int = 3) -> DataFrame:
    """rows with path (array): the stack after each row; rows whose level is null change nothing.

    deepest: the highest level that occurs.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    rows = rows.withColumn("__t", F.count(level).over(w)).withColumn("__slack", F.when(F.col(level).isNotNull(), F.col(level) - F.col("__t")))
    rows = rows.withColumn("__depth", F.col("__t") + F.least(F.lit(0), F.min("__slack").over(w)))
    for k in range(1, deepest + 1):
        rows = rows.withColumn(f"__{k}", F.last(F.when(F.col(level).isNotNull() & (F.col("__depth") == k), F.col(name)), ignorenulls=True).over(w))
    path = F.slice(F.array(*[f"__{k}" for k in range(1, deepest + 1)]), 1, F.col("__depth").cast("int"))
    return rows.withColumn("path", path).drop("__t", "__slack", "__depth", *[f"__{k}" for k in range(1, deepest + 1)])


def outline(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, page, block, text) with head (whether the block is a heading that opens a section) and path.

    A chapter's label alone waits for the next block of its page: before a heading it is put in front of it,
    before text it becomes the whole stack; at the end of a page it counts only if nothing came before. Text before
    any heading stands under Front Matter.
    """
    w, on_page = Window.partitionBy(doc).orderBy("page", "block"), Window.partitionBy(doc, "page").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = blocks.withColumn("__c", T.clean_heading(F.col("text")))
    rows = rows.withColumn("__heading", sure(T.is_heading(F.col("__c")))).withColumn("__alone", F.col("__heading") & T.is_chapter_alone(F.col("__c")))
    rows = rows.withColumns({"head": F.col("__heading") & ~F.col("__alone"), "__name": titled(F.col("text"))})
    rows = rows.withColumn("__label", F.lag(F.when(F.col("__alone"), F.col("__name"))).over(on_page))
    rows = rows.withColumn("__seen", sure(F.max(~F.col("__alone")).over(before)))
    rows = rows.withColumn("__last", F.col("__alone") & F.lead("block").over(on_page).isNull() & ~F.col("__seen"))
    rows = rows.withColumn("__had", sure(F.max("__last").over(before)))
    text = ~F.col("__heading")
    named = F.when(F.col("head"), F.when(F.col("__label").isNotNull(), titled(F.concat_ws(" ", "__label", "__name"))).otherwise(F.col("__name")))
    named = named.when(text & F.col("__label").isNotNull(), F.col("__label")).when(text & ~F.col("__seen") & ~F.col("__had"), FRONT).when(F.col("__last") & ~F.col("__had"), F.col("__name"))
    level = F.when(F.col("head"), T.heading_level(F.col("__c"))).otherwise(1)
    rows = rows.withColumn("__name", named).withColumn("__level", F.when(F.col("__name").isNotNull(), level))
    rows = stacked(rows, doc, ["page", "block"], "__level", "__name")
    return rows.withColumn("__text", text).filter("head OR __text").drop("__c", "__heading", "__alone", "__name", "__label", "__seen", "__last", "__had", "__level", "__text")


def chunks(pages: DataFrame, doc: str, page: str, text: str, start: Column, short: Column, domain: Column) -> DataFrame:
    """doc, n (from 1), chunk_id, path, text, page_start, page_end, domain, tags: the text of each section of a document.

    Pages before start and tables of contents are left out. A section goes from one heading to the next,
    which may be some pages on; its path is the stack at its first text. short: the document's short
    name for ids; domain: that of paths without a keyword. All three are columns of pages.
    """
    rows = pages.withColumnRenamed(page, "page") if page != "page" else pages
    about = rows.groupBy(doc).agg(F.max("page").alias("last_page"), F.min(short).alias("short"), F.min(domain).alias("default_domain"))
    found = outline(text_blocks(body_pages(rows, "page", text, start), doc, "page", text), doc)
    w = Window.partitionBy(doc).orderBy("page", "block")
    found = found.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    at = F.struct("page", "block")
    body = F.when(~F.col("head"), F.struct("page", "block", "text"))
    by_section = found.groupBy(doc, "section").agg(
        F.min(F.when(F.col("head"), F.col("page"))).alias("opened"), F.min_by("path", F.when(~F.col("head"), at)).alias("path"), F.sort_array(F.collect_list(body)).alias("body")
    )
    by_section = by_section.withColumn("closed", F.lead("opened").over(Window.partitionBy(doc).orderBy("section"))).filter(F.size("body") > 0)
    by_section = by_section.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("section"))).join(about, doc)
    path = F.array_join("path", " > ")
    slug = F.coalesce(F.nullif(T.slug(F.element_at("path", -1)), F.lit("")), F.concat(F.lit("section_"), F.lpad("n", 2, "0")))
    number = F.when(F.col("n") < 10, F.lpad("n", 2, "0")).otherwise(F.col("n").cast("string"))
    out = by_section.select(
        doc, "n", F.concat_ws("_", "short", slug, number).alias("chunk_id"), path.alias("path"), T.squeeze(F.array_join("body.text", "\n")).alias("text"),
        F.col("body.page")[0].alias("page_start"), F.coalesce("closed", "last_page").alias("page_end"), "default_domain",
    )
    out = out.withColumn("domain", T.first_match(F.col("path"), T.DOMAINS, F.col("default_domain"))).drop("default_domain")
    return out.withColumn("tags", T.topic_tags(F.col("path"), F.col("text"), F.col("domain")))
