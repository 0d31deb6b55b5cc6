"""Pages that keep arriving: each micro-batch is chunked whole and merged into a stored table of chunks.

Section windows need all elements of a page, and a page is one row, so a micro-batch is complete in itself: foreachBatch
runs the batch job on it. The table has a row a file, its key, with the chunks of the page's latest version; a page that arrives again takes the
place of its old chunks, all of them, in the same commit. A batch is committed under its number, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundmesh.config import Config
from groundmesh.operators.elements import page_elements
from groundmesh.operators.sections import assign_sections, section_tree, text_chunks
from groundmesh.sources.snapshots import StoredTable, one_per_key


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row of each source_file: that with the greatest ``version`` if pages have one, else any one, always the same."""
    if "version" not in pages.columns:
        return one_per_key(pages, "source_file")
    rows = pages.groupBy("source_file").agg(F.max(F.struct("version", "html")).alias("p"))
    return rows.select("source_file", "p.html", "p.version")


def merge_pages(pages: DataFrame, table: StoredTable, cfg: Config, batch: str | None = None) -> None:
    """Put the chunks of pages (source_file, html, and version where there is one) into a table keyed by source_file.

    A page without chunks stays as a file without any; one whose version is below the stored one is late, and changes nothing.
    """
    new = latest_pages(pages.where("source_file IS NOT NULL"))
    versioned = "version" in new.columns
    if versioned and (old := table.read()) is not None:
        stored = old.select("source_file", F.col("version").alias("_stored"))
        new = new.join(stored, "source_file", "left").where("_stored IS NULL OR version >= _stored").drop("_stored")
    chunks = text_chunks(section_tree(assign_sections(page_elements(new.select("source_file", "html")))), cfg)
    grouped = chunks.groupBy("source_file").agg(F.collect_list(F.struct(*chunks.columns)).alias("chunks"))  # no more than the page holds
    names = new.select("source_file", *(["version"] if versioned else []))
    table.upsert(names.join(grouped, "source_file", "left"), batch)


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame | None:
    """The chunks of the latest version of every page."""
    rows = StoredTable(spark, folder).read()
    return None if rows is None else rows.select(F.explode("chunks").alias("c")).select("c.*")


def chunk_stream(pages: DataFrame, folder: str, checkpoint: str, cfg: Config) -> StreamingQuery:
    """Start a query that merges the text chunks of streaming pages (source_file, html, version) into the table under ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        merge_pages(batch, StoredTable(batch.sparkSession, folder, "source_file"), cfg, f"{checkpoint}#{number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
