"""Text and JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.sources.document_files import write_files


def match_filename(match_id: Column, idx: Column, request_id: Column) -> Column:
    """One name per document: a match may have many focal players, and a player many requests."""
    return F.concat(F.concat_ws("_", match_id.cast("string"), idx.cast("string"), request_id.cast("string")), F.lit(".txt"))


def profile_filename(account_id: Column, analyzed: Column, *request_id: Column) -> Column:
    parts = [c.cast("string") for c in (account_id, analyzed, *request_id)]
    return F.concat(F.concat_ws("_", F.lit("profile"), *parts), F.lit(".txt"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents with their file name, as one table of files."""
    documents.select("filename", "document").write.mode("overwrite").parquet(path)


def write_text_files(documents: DataFrame, path: str) -> None:
    """One text file per document, of its own name."""
    write_files(documents, path)


def json_line(*columns: str) -> Column:
    """One row as a JSON object, fields without a value left out."""
    return F.to_json(F.struct(*columns))


def write_json_lines(rows: DataFrame, path: str, batch: int | str | None = None) -> None:
    """One JSON object per line. A named batch has its own folder, which its replay overwrites; without one rows are appended."""
    lines = rows.select(json_line("*").alias("value"))
    if batch is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch={batch}")
