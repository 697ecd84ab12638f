"""Reports and manuals as lines: sections, heading paths, chunks, labelled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import folds


def lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, line, text: trimmed lines that aren't blank."""
    rows = pages.select(doc, page, F.posexplode(F.split(text, r"\R")).alias("line", "text"))
    return rows.withColumn("text", F.trim("text")).filter("text <> ''")


def body_pages(pages: DataFrame, page: str, text: str, start: Column) -> DataFrame:
    """Pages from the start page of their document on that aren't tables of contents."""
    return pages.filter((F.col(page) >= start) & ~T.is_contents(F.col(text)))


def canonical(x: Column) -> Column:
    """A heading without leading numerals and trailing colons, in lower case."""
    return F.lower(F.rtrim(F.regexp_replace(T.squeeze(x), r"^[0-9IVXivx.\-() ]+", ""), F.lit(":")))


def heading_of(x: Column, aliases: dict[str, list[str]]) -> Column:
    """The first section whose name the line is, or one of whose aliases it is or starts with; null for other lines."""
    c = canonical(x)
    out = None
    for section, names in aliases.items():
        test = c == section.lower()
        for n in names:
            test = test | (c == n) | F.startswith(c, F.lit(f"{n} "))
        out = F.when(test, section) if out is None else out.when(test, section)
    return out


def sections(rows: DataFrame, doc: str, aliases: dict[str, list[str]], default: str = "Incident Overview") -> DataFrame:
    """doc, number, section, text, page_start, page_end from lines (doc, page, line, text).

    A heading opens a section; sections without lines go. Running numbers come from one window for
    each document.
    """
    order = Window.partitionBy(doc).orderBy("page", "line")
    marked = rows.withColumn("heading", heading_of(F.col("text"), aliases))
    marked = marked.withColumn("number", F.sum(F.col("heading").isNotNull().cast("int")).over(order))
    body = F.sort_array(F.collect_list(F.when(F.col("heading").isNull(), F.struct("page", "line", "text"))))
    out = marked.groupBy(doc, "number").agg(F.max("heading").alias("section"), body.alias("body"), F.min(F.when(F.col("heading").isNotNull(), F.col("page"))).alias("opened"))
    out = out.filter(F.size("body") > 0)
    return out.select(doc, "number", F.coalesce("section", F.lit(default)).alias("section"), F.array_join("body.text", "\n").alias("text"), F.coalesce("opened", F.lit(1)).alias("page_start"), F.element_at("body.page", -1).alias("page_end"))


def heading_paths(rows: DataFrame, doc: str) -> DataFrame:
    """lines with level (of headings) and path: the last heading of each level that no higher one has closed."""
    level = F.when(T.is_heading(T.clean_heading(F.col("text"))), T.heading_level(T.clean_heading(F.col("text"))))
    rows = rows.withColumn("level", level).withColumn("heading", F.when(F.col("level").isNotNull(), T.clean_heading(F.col("text"))))
    keys = [doc]
    for depth in (1, 2, 3):
        w = Window.partitionBy(*keys).orderBy("page", "line")
        rows = rows.withColumn(f"__h{depth}", F.last(F.when(F.col("level") == depth, F.col("heading")), ignorenulls=True).over(w))
        rows = rows.withColumn(f"__n{depth}", F.sum(F.coalesce((F.col("level") == depth).cast("int"), F.lit(0))).over(w))
        keys.append(f"__n{depth}")
    path = F.concat_ws(" > ", "__h1", "__h2", "__h3")
    return rows.withColumn("path", path).withColumn("section", F.concat_ws(".", "__n1", "__n2", "__n3")).drop(*[f"__{x}{d}" for x in "hn" for d in (1, 2, 3)])


def chunks(rows: DataFrame, doc: str, most: int = 1800, domain: str = "doctrine") -> DataFrame:
    """Text of each heading path, packed into chunks: doc, path, n, text, page_start, page_end, domain, tags."""
    body = heading_paths(rows, doc).filter("level IS NULL")
    grouped = body.groupBy(doc, "section", "path").agg(F.sort_array(F.collect_list(F.struct("page", "line", "text"))).alias("body"))
    packed = grouped.withColumn("parts", F.transform("body.text", lambda t: T.squeeze(t))).withColumn("packed", folds.pack("parts", most, "  "))
    out = packed.select(doc, "path", "section", F.posexplode("packed").alias("n", "text"), F.col("body.page")[0].alias("page_start"), F.element_at("body.page", -1).alias("page_end"))
    out = out.withColumn("domain", T.first_match(F.col("path"), T.DOMAINS, F.lit(domain)))
    return out.withColumn("tags", T.topic_tags(F.col("path"), F.col("text"), F.col("domain")))


def profile(text: Column, section: dict[str, Column], file: Column) -> list[Column]:
    """The facts of a report as columns; a fact that isn't found is empty.

    text: all pages; section: the text of each section (null or empty: none); file: the report's name, without its
    ending. A fact comes from a label in the text, from the line after such a label, or from a section, in an order of its own.
    """
    labels = {key: names for key, _, names in T.FACTS}
    said = lambda key: label_value(text, labels[key])
    beside = lambda key: adjacent_value(text, labels[key])
    part = lambda *names: T.first_text(*[section[n] for n in names])
    first = lambda *found: F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))
    safety, operations = first(part("Safety Concerns"), said("safety_concerns")), first(part("Operations Plan", "Objectives"), said("strategy_tactics"))
    facts = {
        "incident_name": first(said("incident_name"), F.translate(file, "_", " ")),
        "operational_period": first(said("operational_period"), beside("operational_period")),
        "location": first(said("location"), beside("location"), part("Incident Overview")),
        "overall_risk_level": first(said("overall_risk_level"), beside("overall_risk_level")),
        "current_fire_behavior": first(part("Current Situation"), said("current_fire_behavior")),
        "containment": first(said("containment")),
        "weather": first(part("Weather"), said("weather")),
        "fuels": first(part("Fuels"), said("fuels")),
        "terrain": first(part("Terrain"), said("terrain")),
        "values_at_risk": first(part("Values at Risk"), said("values_at_risk")),
        "strategy_tactics": operations,
        "assigned_resources": first(part("Resources"), said("assigned_resources")),
        "safety_concerns": safety,
        "command_structure": first(part("Command Structure"), said("command_structure")),
        "unresolved_risks": first(safety, operations),
    }
    return [facts[key].alias(key) for key, _, _ in T.FACTS]


def ingest(pages: DataFrame, doc: str, page: str, text: str, file: str, day: Column, most: int = 1800) -> tuple[DataFrame, DataFrame]:
    """(profiles, chunks) of reports, whose pages are rows (doc, page from 1, text, file name without its ending).

    profiles: doc, incident_id, facts. chunks: doc, n (from 1), chunk_id, section, text, page_start, page_end:
    each section's paragraphs packed to at most `most` characters. day: of the ingest, a column of pages. Lines that
    match an injection pattern are replaced first; of sections of one name the last gives facts.
    """
    rows = pages.select(doc, F.col(page).alias("page"), T.sanitize(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(file).alias("file"), day.alias("day"))
    parts = written(sections(lines(rows, doc, "page", "text"), doc, T.SECTIONS))
    whole = rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("page", "text")))), lambda p: p["text"]), "\n").alias("whole"), F.min("file").alias("file"), F.min("day").alias("day"))
    last = parts.groupBy(doc, F.col("section").alias("name")).agg(F.max_by("text", "number").alias("said"))
    by_name = last.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("name", "said"))).alias("said"))  # as many as there are names
    told = whole.join(by_name, doc, "left")
    facts = profile(F.col("whole"), {n: F.try_element_at("said", F.lit(n)) for n in T.SECTIONS}, F.col("file"))
    told = told.select(doc, *facts, F.col("day"))
    profiles = told.withColumn("incident_id", T.incident_id(F.col("incident_name"), F.col("day"))).drop("day")
    blocks = parts.withColumn("__text", F.col("text")).select(doc, "number", "section", "page_start", "page_end", F.posexplode(folds.semantic_blocks("__text", most)).alias("at", "text"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy("number", "at"))
    blocks = blocks.withColumn("n", n).join(profiles.select(doc, "incident_id", "incident_name", "operational_period"), doc)
    number = F.when(F.col("n") < 10, F.lpad("n", 2, "0")).otherwise(F.col("n").cast("string"))
    return profiles, blocks.select(doc, "n", F.concat_ws("_", "incident_id", T.slug(F.col("section")), number).alias("chunk_id"), "incident_name", "operational_period", "section", "text", "page_start", "page_end")


def label_value(x: Column, labels: list[str]) -> Column:
    """The rest of the first line that starts with a label and : or -; null if none does."""
    found = F.lit(None).cast("string")
    rows = F.filter(F.transform(F.split(x, r"\R"), lambda line: F.trim(line)), lambda line: line != "")

    def value(line):
        out = None
        for label in labels:
            for mark in (":", "-"):
                start = f"{label}{mark}" if mark == ":" else f"{label} -"
                hit = F.startswith(F.lower(line), F.lit(start))
                rest = T.squeeze(F.get(F.split(line, mark, 2), F.lit(1)))
                out = F.when(hit, rest) if out is None else out.when(hit, rest)
        return out

    values = F.filter(F.transform(rows, value), lambda v: v.isNotNull())
    return F.coalesce(F.get(values, F.lit(0)), found)


def adjacent_value(x: Column, labels: list[str]) -> Column:
    """The line after the first one that is a label, unless it is a column title; null if there is none."""
    rows = F.filter(F.transform(F.split(x, r"\R"), lambda line: F.trim(line)), lambda line: line != "")
    pairs = F.arrays_zip(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))).alias("a"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("b"))

    def fits(p):
        low, test = F.lower(p["a"]), F.lit(False)
        for label in labels:
            test = test | (low == label) | F.startswith(low, F.lit(f"{label}:")) | F.startswith(low, F.lit(f"{label} -"))
        return test & ~F.lower(p["b"]).isin("value", "field", "parameter", "metric")

    return T.squeeze(F.get(F.filter(pairs, fits), F.lit(0))["b"])
