"""Cutting documents into searchable sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed_values import SECTION_MIN_CHARS
from ..session import materialize
from ..sources.pages import assemble_pages, up_to

SECTION_COLUMNS = ["doc_id", "section_id", "page_number", "text", "word_count"]


def _word_count() -> Column:
    return F.size(T.word_tokens(F.col("text"))).cast("long").alias("word_count")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sections of whole texts, row-local.

    A section is a paragraph of more than 15 characters. Its id is the position
    of the paragraph, so ids have gaps. A text without such a paragraph becomes
    one section; a blank text gives none.
    """
    cleaned = docs.select("doc_id", T.clean_text(F.col(text)).alias("_clean"))
    numbered = F.transform(
        T.paragraphs(F.col("_clean")), lambda p, i: F.struct((i + 1).alias("id"), p.alias("text"))
    )
    long_ones = cleaned.withColumn("_long", F.filter(numbered, lambda s: F.length(s["text"]) > SECTION_MIN_CHARS))
    whole = F.array(F.struct(F.lit(1).alias("id"), F.col("_clean").alias("text")))
    chosen = F.when(F.size("_long") > 0, F.col("_long")).when(F.col("_clean") != "", whole)
    return long_ones.select("doc_id", F.explode(chosen).alias("_s")).select(
        "doc_id",
        F.col("_s.id").cast("long").alias("section_id"),
        F.lit(1).cast("long").alias("page_number"),
        F.col("_s.text").alias("text"),
    ).withColumn("word_count", _word_count())


def sections_paged(pages: DataFrame, page_cap: int | None = None, page_block: int = 1000) -> DataFrame:
    """Sections of paged documents, numbered without gaps through the kept ones.

    The pages are cut where they lie and stored. Numbers run within blocks of
    ``page_block`` page numbers; a document's blocks are added up as numbers, so a
    document may have any number of pages. A text is put together only for
    documents none of whose pages has a section.
    """
    kept = up_to(pages, page_cap).select("doc_id", "page_number", "text")
    page_text = kept.select("doc_id", "page_number", T.strip(F.col("text")).alias("_page"))
    pieces = T.paragraphs(T.clean_text(F.col("_page")))
    usable = F.when(F.size(pieces) > 0, pieces).otherwise(F.array("_page"))
    cut = page_text.select(
        "doc_id", "page_number", F.floor(F.col("page_number") / page_block).alias("_block"),
        F.filter(usable, lambda p: F.length(p) > SECTION_MIN_CHARS).alias("_long"),
    )
    cut = materialize(cut.withColumn("_n", F.coalesce(F.size("_long"), F.lit(0)).cast("long")), "cut-pages")
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("doc_id", "_block").agg(F.sum("_n").alias("_sum"), F.max("_n").alias("_most"))
    blocks = materialize(blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long"))), "page-blocks")
    inside = Window.partitionBy("doc_id", "_block").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.where("_n > 0").withColumn("_offset", F.coalesce(F.sum("_n").over(inside), F.lit(0).cast("long")))
    later = blocks.where("_before > 0").select(F.col("doc_id").alias("_doc"), F.col("_block").alias("_b"), "_before")
    numbered = (
        placed.join(later, placed["doc_id"].eqNullSafe(later["_doc"]) & placed["_block"].eqNullSafe(later["_b"]), "left")
        .select("doc_id", "page_number", (F.col("_offset") + F.coalesce("_before", F.lit(0))).alias("_offset"), F.posexplode("_long").alias("_i", "text"))
        .select(
            "doc_id",
            (F.col("_offset") + F.col("_i") + 1).cast("long").alias("section_id"),
            F.col("page_number").cast("long").alias("page_number"),
            "text",
        )
    )
    without = blocks.groupBy("doc_id").agg(F.max("_most").alias("_n")).where(F.col("_n") == 0)
    short = kept.join(without.select("doc_id"), "doc_id", "left_semi")
    whole = assemble_pages(short, page_cap).select("doc_id", T.clean_text(F.col("raw_text")).alias("text")).where(
        F.col("text") != ""
    ).select("doc_id", F.lit(1).cast("long").alias("section_id"), F.lit(1).cast("long").alias("page_number"), "text")
    return numbered.unionByName(whole).withColumn("word_count", _word_count())


def section_counts(sections: DataFrame) -> DataFrame:
    """Sections per document; counts combine before they are dealt."""
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("section_count"))
