"""Pages: repeated lines, offsets, assembly, and the page of a character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx


def repeated_lines(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(doc, line, n): stripped lines under 80 characters that stand on 40 % of a document's pages, two at least.

    A line counts once for each distinct raw form on a page. Counts are partial before the shuffle."""
    lines = pages.select(doc, page, F.explode(F.array_distinct(F.split(text, "\n"))).alias("raw")).withColumn("line", tx.strip(F.col("raw")))
    lines = lines.filter((F.col("line") != "") & (F.length("line") < config.REPEAT_LINE_CHARS))
    counts = lines.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= config.REPEAT_LEAST)
    totals = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(totals, doc).filter(F.col("n") >= F.greatest(F.lit(float(config.REPEAT_LEAST)), F.col("n_pages") * config.REPEAT_SHARE)).select(doc, "line", "n", "n_pages")


def strip_repeated(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """``pages`` without repeated lines, in documents of more than two pages. The repeated lines of one document are few
    (at most 2.5 to a line of a page), so they come along as an array."""
    repeated = repeated_lines(pages, doc, page, text).filter("n_pages > 2").groupBy(doc).agg(F.collect_list("line").alias("__lines"))
    joined = pages.join(repeated, doc, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("__lines"), tx.strip(x))), "\n")
    return joined.withColumn(text, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(kept)).select(*pages.columns)


def offsets(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text", skip_blank: bool = False) -> DataFrame:
    """``pages`` with char_start, char_end, word_count and is_empty. With ``skip_blank`` blank pages take no room, as in the
    document's text; else every page has a separator."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    room = F.length(text) + 1
    if skip_blank:
        room = F.when(tx.strip(F.col(text)) != "", room).otherwise(0)
    start = F.coalesce(F.sum(room).over(before), F.lit(0)).cast("int")
    out = pages.withColumn("char_start", start).withColumn("char_end", (F.col("char_start") + F.length(text)).cast("int"))
    return out.withColumns({"word_count": tx.word_count(F.col(text)), "is_empty": F.length(tx.strip(F.col(text))) < config.MIN_PAGE_CHARS})


def assemble(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text", keep_blank: bool = False) -> DataFrame:
    """One row per document: full_text of its (non-blank) pages, page_count, char_count, has_text, empty_pages, ocr_pages
    (where pages have ocr_used) and warnings."""
    ocr = F.col("ocr_used") if "ocr_used" in pages.columns else F.lit(False)
    one = F.struct(F.col(page).alias("page"), F.col(text).alias("text"), ocr.alias("ocr"))
    rows = pages.groupBy(doc).agg(F.sort_array(F.collect_list(one)).alias("p"))
    shown = F.col("p") if keep_blank else F.filter("p", lambda x: tx.strip(x.text) != "")
    full = F.array_join(F.transform(shown, lambda x: x.text), "\n")
    empty = F.transform(F.filter("p", lambda x: F.length(tx.strip(x.text)) < config.MIN_PAGE_CHARS), lambda x: x.page)
    scanned = F.transform(F.filter("p", lambda x: x.ocr), lambda x: x.page)
    out = rows.select(doc, full.alias("full_text"), F.size("p").alias("page_count"), empty.alias("empty_pages"), scanned.alias("ocr_pages"))
    out = out.withColumns({"char_count": F.length("full_text"), "has_text": tx.strip(F.col("full_text")) != ""})
    notes = F.filter(
        F.array(
            F.when(~F.col("has_text"), "No text extracted."),
            F.when(F.size("ocr_pages") > 0, F.concat(F.lit("Text recognised on pages ["), F.array_join(F.col("ocr_pages").cast("array<string>"), ", "), F.lit("]."))),
            F.when(F.size("empty_pages") > 0, F.concat(F.lit("Empty pages: ["), F.array_join(F.col("empty_pages").cast("array<string>"), ", "), F.lit("]"))),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("warnings", notes)


def page_array(pages: DataFrame, doc: str = "document_id", page: str = "page_number") -> DataFrame:
    """(doc, pages): a document's pages with offsets as one sorted array, for ``page_of``."""
    one = F.struct(F.col("char_start"), F.col("char_end"), F.col(page).cast("int").alias("page"))
    return pages.groupBy(doc).agg(F.sort_array(F.collect_list(one)).alias("pages"))


def page_of(position: Column, pages: Column) -> Column:
    """The page whose offsets hold a position; else the last page, or 1 without pages."""
    hit = F.filter(pages, lambda p: position.between(p.char_start, p.char_end))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["page"], F.try_element_at(pages, F.lit(-1))["page"], F.lit(1))


def locate(positions: DataFrame, pages: DataFrame, doc: str = "document_id", position: str = "position", page: str = "page_number", span: int = 4096) -> DataFrame:
    """``positions`` with ``page_number`` by a range join: both sides are cut into spans of characters, so that a document
    with many pages joins on (document, span) and not on the document alone."""
    cells = pages.select(doc, page, "char_start", "char_end", F.explode(F.sequence(F.floor(F.col("char_start") / span), F.floor(F.col("char_end") / span))).alias("__cell"))
    keyed = positions.withColumn("__row", F.monotonically_increasing_id()).withColumn("__cell", F.floor(F.col(position) / span))
    met = keyed.join(cells, [doc, "__cell"], "left").withColumn(page, F.when(F.col(position).between(F.col("char_start"), F.col("char_end")), F.col(page)))
    best = met.groupBy("__row", *positions.columns).agg(F.min(page).alias(page))
    last = pages.groupBy(doc).agg(F.max(page).alias("__last"))
    return best.join(last, doc, "left").withColumn(page, F.coalesce(page, "__last", F.lit(1))).select(*positions.columns, page)
