"""Inputs of the registered queries, derived from the star schema, documents, pages and embeddings tables."""

from __future__ import annotations

import io
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from groundmesh.config import Config, Phrase
from groundmesh.functions.text import clean_text, concept_id, infer_type, stable_id, text
from groundmesh.operators.relations import workbook_relations
from groundmesh.sources.readers import read_sheet

#: Terms that occur in the synthetic texts, so that every scoring rule is exercised.
SYNTHETIC = Config(
    operational_terms=("the", "and", "of", "with", "der", "und", "les", "que"),
    generic_phrases=("the the", "and the", "of the", "licensed under"),
    risk_terms=("worthless", "license"),
    procedure_terms=("with", "from"),
    phrases=(Phrase(("the", "and"), 0.3, True), Phrase(("that", "with"), 0.18)),
)
WORKBOOK = "star.xlsx"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str, cfg: Config = SYNTHETIC) -> DataFrame:
    """A text chunk per document: the first line's first eight words are the title."""
    docs = table(spark, sf_dir, "documents")
    title = clean_text(F.array_join(F.slice(F.split(F.split_part(text(F.col("text")), F.lit("\n"), F.lit(1)), " "), 1, 8), " "))
    rows = docs.select(title.alias("title"), text(F.col("text")).alias("content"), F.col("source").alias("source_file"), F.col("doc_id").cast("string").alias("section_id"))
    return rows.select(
        stable_id(F.col("source_file"), F.col("section_id"), F.col("title"), F.col("content")).alias("id"), "content", "title", concept_id(F.col("title")).alias("concept_id"),
        "section_id", "source_file", infer_type(F.col("title"), F.col("content"), cfg).alias("type"),
    )


def page_sources(spark: SparkSession, sf_dir: str, with_figures: bool = False) -> DataFrame:
    """Pages as HTML sources; with_figures adds a drawing of the page's address, as the tables' pages have none."""
    figure = F.concat(F.lit('<h2>Map</h2><figure><svg viewBox="0 0 9 9"><text>'), F.col("url"), F.lit("</text><text>page</text></svg><figcaption>Map of "), F.col("page_id"), F.lit("</figcaption></figure>"))
    html = F.concat(text(F.col("html")), figure) if with_figures else F.col("html")
    return table(spark, sf_dir, "pages").select(F.format_string("page-%d.html", "page_id").alias("source_file"), html.alias("html"))


def markup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages followed by a section of nested lists and a table, and one out of a template string, all about the page."""
    n = F.col("page_id").cast("string")
    listed = F.concat(F.lit("<h2>Parts</h2><ul><li>part "), n, F.lit("<ul><li>inner <b>"), n, F.lit("</b></li></ul></li></ul>"))
    grid = F.concat(F.lit("<table><tr><th>page</th><td>"), n, F.lit("</td></tr><tr><td><p>cell</p></td><td> </td></tr></table>"))
    made = F.concat(F.lit("<script>x = {html:`<h2>Made</h2><p>inside "), n, F.lit("</p><button>no</button>`}</script>"))
    return table(spark, sf_dir, "pages").select(F.format_string("page-%d.html", "page_id").alias("source_file"), F.concat(text(F.col("html")), listed, grid, made).alias("html"))


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five relation sheets out of the star schema, rows numbered as in a workbook.

    FG & PWO has a row a nation and a row a part, whose list of dependencies is made of its attributes.
    """
    t = lambda name: table(spark, sf_dir, name)
    region, nation, supplier = t("region"), t("nation"), t("supplier")
    pwo = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    pwo = pwo.select(F.col("n_nationkey").alias("o"), F.col("r_name").alias("Functional Group (FG)"), F.col("n_name").alias("Primary Work Object (PWO)"), F.concat(F.col("r_name"), F.lit(", , "), F.col("n_name"), F.lit(" base")).alias("Dependency Links"))
    made_of = F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(",, size "), F.col("p_size"))
    parts = t("part").select((F.col("p_partkey") + 1000).alias("o"), F.col("p_brand").alias("Functional Group (FG)"), F.concat("p_name", F.lit("#"), F.col("p_partkey")).alias("Primary Work Object (PWO)"), made_of.alias("Dependency Links"))
    pwo = pwo.withColumn("o", F.col("o").cast("long")).unionByName(parts)
    swo = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("o"), F.col("n_name").alias("PWO"), F.col("s_name").alias("Secondary Work Object (SWO)"))
    # all lines of a part meet in one place, where its name is too
    pairs = t("lineitem").select("l_suppkey", "l_partkey").repartition("l_partkey").distinct()
    named = pairs.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    skills = read_sheet(named.select("l_suppkey", "l_partkey", "s_name", "p_name"), F.col("l_suppkey") * 10_000_000 + F.col("l_partkey"), cells={"SWO": F.col("s_name"), "Skill": F.concat("p_name", F.lit("#"), F.col("l_partkey"))})
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    tasks = read_sheet(bought.select("o_orderkey", "c_name"), F.col("o_orderkey"), cells={"Skill": F.col("c_name"), "Task": F.concat(F.lit("order "), F.col("o_orderkey"))})
    raw = {"FG & PWO": pwo, "SWO": swo}
    return {name: read_sheet(df, F.col("o"), ("o",)) for name, df in raw.items()} | {"Skills": skills, "Tasks": tasks, "Control Point": control_point_sheet(spark, sf_dir)}


def control_point_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Control Point sheet, a row per line of an order: the largest sheet."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")  # an order has seven lines at most
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    task = F.concat(F.lit("order "), F.col("l_orderkey"))
    return read_sheet(lines, order, cells={"Task": task, "Control Point": F.concat(task, F.lit(" line "), F.col("l_linenumber"))})


def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook_relations(sheets(spark, sf_dir), WORKBOOK)


#: Rows of one sheet of a derived workbook, at most.
SHEET_ROWS = 10_000


@F.arrow_udf(BinaryType())
def workbook_bytes(rows: pa.Array) -> pa.Array:
    """A workbook of one sheet for each array of (key, nation, name, balance): numbers as numbers, names as inline text."""
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    said = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    out = []
    for sheet in rows.to_pylist():
        lines = ["".join(map(said, ("PWO", "Secondary Work Object (SWO)", "key", "balance")))]
        lines += [f"{said(r['nation'])}{said(r['name'])}<c><v>{r['key']}</v></c><c><v>{r['balance']!r}</v></c>" for r in sheet]
        data = io.BytesIO()
        with ZipFile(data, "w", ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="SWO" sheetId="1" r:id="a"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{x}</row>" for x in lines)}</sheetData></worksheet>')
        out.append(data.getvalue())
    return pa.array(out, pa.binary())


def supplier_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: workbooks of the suppliers of each nation, SHEET_ROWS keys each."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.struct(F.col("s_suppkey").alias("key"), F.col("n_name").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    books = rows.groupBy("n_nationkey", F.floor(F.col("s_suppkey") / SHEET_ROWS).alias("part")).agg(F.sort_array(F.collect_list(line)).alias("rows"))
    return books.select(F.concat(F.lit("suppliers/"), "n_nationkey", F.lit("-"), "part", F.lit(".xlsx")).alias("path"), workbook_bytes("rows").alias("content"))


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a chunk; the label is the concept."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label-"), F.col("label")).alias("concept_id"), F.col("embedding").alias("vector"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Text chunks (even ids) and image chunks (odd ids) that carry the embeddings; the label is the concept."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label-"), F.col("label")).alias("concept_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 2).alias("odd"))
    return rows.where("odd = 0").drop("odd"), rows.where("odd = 1").drop("odd")


def with_table_vectors(spark: SparkSession, sf_dir: str, df: DataFrame, number: Column) -> DataFrame:
    """df with ``vector``: row number modulo n of the n embeddings, a stand-in for an encoder's."""
    rows = table(spark, sf_dir, "embeddings")
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))  # one row
    numbered = df.crossJoin(n).withColumn("_at", F.pmod(number.cast("long"), F.col("_n"))).drop("_n")
    return numbered.join(rows.select(F.col("vec_id").alias("_at"), F.col("embedding").alias("vector")), "_at").drop("_at")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text(F.col("text")).alias("query"))
