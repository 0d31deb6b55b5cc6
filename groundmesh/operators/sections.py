"""Section tree, text chunks and image chunks from the element stream: windows over (source_file, pos).

All windows and groupings carry source_file first, so one shuffle of the element stream serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.functions.text import clean_text, concept_id, infer_type, slug, stable_id, text

LEVELS = (0, 1, 2, 3, 4)
FILE_STEM = r"(?<=.)\.[^.]*$"


def _stack(value: str) -> list[Column]:
    """Running last ``value`` of the headings of each level, in page order."""
    so_far = W.partitionBy("source_file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return [F.last(F.when(F.col("open_level") == level, F.col(value)), ignorenulls=True).over(so_far) for level in LEVELS]


def assign_sections(elements: DataFrame) -> DataFrame:
    """Add the open section of every element: section_pos, level, title, breadcrumb and parent of that section.

    The heading stack is a window: after a heading of level L the open ancestors are, for each smaller level, the nearest
    earlier heading of it, as long as none of a still smaller level came later.
    """
    heading = F.col("level").isNotNull() & (text(F.col("text")) != "")
    rows = elements.where("level IS NULL OR is_visual OR text <> ''").withColumn("open_level", F.when(heading, F.col("level"))).withColumn("open_title", F.when(heading, clean_text(F.col("text"))))
    so_far = W.partitionBy("source_file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("section_pos", F.last(F.when(heading, F.col("pos")), ignorenulls=True).over(so_far)).withColumn("section_level", F.last("open_level", ignorenulls=True).over(so_far))
    rows = rows.withColumn("_at", F.array(*_stack("pos"))).withColumn("_title", F.array(*_stack("open_title")))
    levels = F.sequence(F.lit(0), F.lit(len(LEVELS) - 1))
    # a level is open if it is not deeper than the section and no shallower heading came after its last one
    shallower = lambda i: F.array_max(F.slice(F.col("_at"), F.lit(1), i))
    is_open = lambda i: (i <= F.col("section_level")) & F.get("_at", i).isNotNull() & ((i == 0) | (F.get("_at", i) > shallower(i)))
    rows = rows.withColumn("_open", F.filter(levels, is_open))
    rows = rows.withColumn("breadcrumb", F.transform("_open", lambda i: F.get("_title", i))).withColumn("_path", F.transform("_open", lambda i: F.get("_at", i)))
    return rows.select(
        *elements.columns, "section_pos", "section_level", "breadcrumb",
        F.element_at("breadcrumb", -1).alias("section_title"),
        F.try_element_at("breadcrumb", F.lit(-2)).alias("parent_title"), F.try_element_at("_path", F.lit(-2)).alias("parent_pos"),
    )


def content_elements(elements: DataFrame) -> DataFrame:
    """Content elements outside headings, less those that repeat their list item's or cell's text."""
    repeats = F.col("parent_tag").isin("li", "td", "th") & (F.col("parent_text") == F.col("text"))
    return elements.where(F.col("is_content") & ~F.col("in_heading") & (text(F.col("text")) != "") & ~F.coalesce(repeats, F.lit(False)))


def section_tree(assigned: DataFrame) -> DataFrame:
    """source_file, pos, level, title, section_id, parent_pos, parent_title, breadcrumb, child_titles, content per section.

    ``assigned`` is the output of assign_sections(). The root is the page, at -1.
    """
    sections = assigned.where("section_pos = pos").select("source_file", "pos", F.col("section_level").alias("level"), F.col("section_title").alias("title"), "parent_pos", "parent_title", "breadcrumb")
    base = F.when(F.col("level") == 0, slug(F.col("title"), "section")).otherwise(F.concat(F.regexp_replace("source_file", FILE_STEM, ""), F.lit("-"), slug(F.col("title"), "section")))
    repeat = F.row_number().over(W.partitionBy("source_file", "_base", F.col("level") == 0).orderBy("pos"))
    sections = sections.withColumn("_base", base).withColumn("_repeat", repeat)
    sections = sections.withColumn("section_id", F.when(F.col("_repeat") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_repeat")))).drop("_base", "_repeat")
    parts = content_elements(assigned).groupBy("source_file", F.col("section_pos").alias("pos")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), clean_text(F.col("text")).alias("part")))).alias("_parts"))
    children = sections.where("parent_pos IS NOT NULL").groupBy("source_file", F.col("parent_pos").alias("pos")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "title"))).alias("_children"))
    joined = sections.join(parts, ["source_file", "pos"], "left").join(children, ["source_file", "pos"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *sections.columns,
        F.coalesce(F.transform("_children", lambda c: c["title"]), none).alias("child_titles"),
        clean_text(F.array_join(F.coalesce(F.transform("_parts", lambda p: p["part"]), none), "\n")).alias("content"),
    )


def text_chunks(sections: DataFrame, cfg: Config) -> DataFrame:
    """A chunk for every section below the root that has content of its own; the first of each id."""
    whole = clean_text(F.concat_ws("\n", "title", "content"))
    rows = sections.where((F.col("level") > 0) & (F.col("content") != "")).select(
        stable_id(F.col("source_file"), F.col("section_id"), F.col("title"), whole).alias("id"),
        whole.alias("content"), "title", text(F.col("parent_title")).alias("parent_title"), concept_id(F.col("title")).alias("concept_id"), "section_id", "source_file",
        infer_type(F.col("title"), whole, cfg).alias("type"),
        F.struct("level", "breadcrumb", "child_titles", F.length(whole).alias("content_length")).alias("metadata"), "pos",
    )
    first = W.partitionBy("source_file", "id").orderBy("pos")  # ids hold the file, so this stays in its partitioning
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1 AND title <> '' AND content <> ''").drop("_n", "pos")


def image_description(title: Column, parent: Column, file: Column, caption: Column, labels: Column) -> Column:
    described = clean_text(F.concat_ws(
        " ", F.concat(F.lit("Diagram under: "), title, F.lit(".")), F.when(caption != "", F.concat(F.lit("Caption: "), caption, F.lit("."))),
        F.when(F.size(labels) > 0, F.concat(F.lit("Visible labels: "), F.array_join(labels, "; "), F.lit("."))),
        F.concat(F.lit("Context: "), F.when(text(parent) == "", "root").otherwise(parent), F.lit(" / "), file, F.lit(".")),
    ))
    bare = F.concat(F.lit('Diagram attached to section "'), title, F.lit('" in "'), file, F.lit('".'))
    return F.when((caption != "") | (F.size(labels) > 0), described).otherwise(bare)


def visuals(assigned: DataFrame, sections: DataFrame) -> DataFrame:
    """Visual elements with their order in the file, section and image_id; the raw markup is kept."""
    order = F.row_number().over(W.partitionBy("source_file").orderBy("pos"))
    rows = assigned.where("is_visual").withColumn("order_in_file", order)
    ids = sections.select("source_file", F.col("pos").alias("section_pos"), "section_id")
    labels, caption = F.coalesce("labels", F.array().cast("array<string>")), text(F.col("caption"))
    rows = rows.join(ids, ["source_file", "section_pos"]).withColumn("labels", labels).withColumn("caption", caption)
    return rows.withColumn("image_id", stable_id(F.col("source_file"), F.col("section_id"), F.col("order_in_file"), F.col("tag"), F.array_join("labels", "|"), F.col("caption")))


def image_chunks(visual_rows: DataFrame) -> DataFrame:
    """Image chunks with their retrieval description; rows without id or description go, the first of each id stays."""
    title, parent, file = F.col("section_title"), F.col("parent_title"), F.col("source_file")
    rows = visual_rows.select(
        "image_id", clean_text(image_description(title, parent, file, F.col("caption"), F.col("labels"))).alias("description"), title.alias("title"), text(parent).alias("parent_title"),
        concept_id(title).alias("concept_id"), "section_id", "source_file", F.col("tag").alias("type"),
        F.struct(
            F.col("section_id").alias("linked_text_section_id"), "caption", F.col("labels").alias("svg_text_labels"), text(F.col("view_box")).alias("view_box"), "order_in_file",
            F.when(F.col("tag") == "svg", F.substring(clean_text(F.col("raw")), 1, 500)).otherwise("").alias("raw_svg_excerpt"), "breadcrumb",
        ).alias("metadata"),
    )
    first = W.partitionBy("source_file", "image_id").orderBy("metadata.order_in_file")
    return rows.where("image_id <> '' AND description <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def svg_assets(visual_rows: DataFrame) -> DataFrame:
    """image_id, svg: the whole markup of every svg, to be joined with requested ids."""
    return visual_rows.where("tag = 'svg'").select("image_id", F.col("raw").alias("svg"))
