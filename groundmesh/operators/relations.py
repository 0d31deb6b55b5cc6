"""Sheets to relation edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.functions.text import concept_id, evidence_text, split_list, stable_id, text


@dataclass(frozen=True)
class SheetSpec:
    """One kind of edge that a sheet gives; ``listed``: the target column is a comma list, one edge a part."""

    source: str
    target: str
    relation_type: str
    listed: bool = False


#: Sheet name -> its edges. Other sheets give none.
SHEETS = {
    "FG & PWO": (
        SheetSpec("Functional Group (FG)", "Primary Work Object (PWO)", "has_pwo"),
        SheetSpec("Primary Work Object (PWO)", "Dependency Links", "depends_on", listed=True),
    ),
    "SWO": (SheetSpec("PWO", "Secondary Work Object (SWO)", "has_swo"),),
    "Skills": (SheetSpec("SWO", "Skill", "has_skill"),),
    "Tasks": (SheetSpec("Skill", "Task", "has_task"),),
    "Control Point": (SheetSpec("Task", "Control Point", "has_control_point"),),
}


def edges_from_sheet(sheet: DataFrame, sheet_name: str, source_file: str) -> DataFrame:
    """Edges of one sheet as read by read_sheet (row_number and named cells, both clean text); a column that is missing is blank.

    An edge's id holds its sheet and row, so only the parts of one cell can repeat; they are made distinct there.
    """
    cells = [c for c in sheet.columns if c != "row_number"]
    cell = lambda name: text(F.col(f"`{name}`")) if name in cells else F.lit("")
    evidence = evidence_text([(c, F.col(f"`{c}`")) for c in cells], cleaned=True)
    parts = []
    for spec in SHEETS.get(sheet_name, ()):
        target: Column = F.explode(F.array_distinct(split_list(cell(spec.target)))) if spec.listed else cell(spec.target)
        parts.append(sheet.select("row_number", evidence.alias("evidence"), cell(spec.source).alias("source_label"), target.alias("target_label"), F.lit(spec.relation_type).alias("relation_type")))
    if not parts:
        parts = [sheet.select("row_number", *(F.lit("").alias(c) for c in ("evidence", "source_label", "target_label", "relation_type"))).limit(0)]
    name, file = F.lit(sheet_name), F.lit(source_file)
    label = F.replace("relation_type", F.lit("_"), F.lit(" "))
    return reduce(DataFrame.unionByName, parts).select(
        stable_id(file, name, F.col("row_number"), F.col("source_label"), F.col("target_label"), F.col("relation_type")).alias("relation_id"),
        concept_id(F.col("source_label"), cleaned=True).alias("source_id"),
        concept_id(F.col("target_label"), cleaned=True).alias("target_id"),
        "relation_type",
        F.trim(F.concat("source_label", F.lit(" "), label, F.lit(" "), "target_label", F.lit("."))).alias("description"),
        F.struct(file.alias("source_file"), name.alias("sheet_name"), "row_number", "source_label", "target_label", "evidence", F.lit(False).alias("placeholder")).alias("metadata"),
    )


def relation_chunks(edges: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """The first row of each relation_id, rows with a blank required field left out.

    Blanks are looked for after the shuffle by id, where the fields are values: pushed below it, each check would compute them again.
    """
    blank = reduce(lambda a, b: a | b, (text(F.col(c)) == "" for c in ("source_id", "target_id", "relation_type", "description")))
    if drop_unknown:
        blank = blank | (F.col("source_id") == "unknown") | (F.col("target_id") == "unknown")
    first = W.partitionBy("relation_id").orderBy(blank, "metadata.sheet_name", "metadata.row_number")
    rows = edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.where(~blank & (text(F.col("relation_id")) != ""))


def workbook_relations(sheets: dict[str, DataFrame], source_file: str) -> DataFrame:
    """All sheets of a workbook, in one table of edges. Ids are distinct and no required field is blank by how edges are made."""
    return reduce(DataFrame.unionByName, (edges_from_sheet(df, name, source_file) for name, df in sheets.items()))
