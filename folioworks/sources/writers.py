"""Files out: texts as the bytes of each format with sidecars, and exports of bounded files."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioworks.sources.exports import ENTRY
from folioworks.sources.readers import extension, to_markdown

#: Bytes of an exported file, about, and what ends a record in a text file of many documents.
FILE_BYTES, RECORD_END = 128 << 20, "\x1e"


def write_plain(text: str) -> bytes:
    return text.encode()


def write_html(text: str) -> bytes:
    """A paragraph a line."""
    return f"<html><body><p>{html.escape(text).replace('\n', '</p><p>')}</p></body></html>".encode()


def write_docx(text: str) -> bytes:
    """The least that a word processor opens, a paragraph a line; equal texts give equal bytes."""
    space, begin, end = "http://schemas.openxmlformats.org", '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{space}/wordprocessingml/2006/main"><w:body>{begin}{html.escape(text).replace(chr(10), end + begin)}{end}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), xml)
    return out.getvalue()


#: Writers by extension, as readers have them; any other extension gets plain bytes.
WRITERS = {".html": write_html, ".htm": write_html, ".docx": write_docx}


@F.pandas_udf(T.BinaryType())
def _encoded(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else WRITERS.get(k or "", write_plain)(t) for k, t in zip(kinds, texts)], dtype=object)


def file_rows(docs: DataFrame, path: Column, text: Column, at: Column, sidecar: Column | None = None) -> DataFrame:
    """A file for each row, and one with its sidecar where that struct isn't null, as Spark's
    binaryFile source shows files: path, modificationTime, length, content. The path's
    extension decides on the format; a null text is a file without bytes."""
    side = F.lit(None).cast("string") if sidecar is None else F.to_json(sidecar)
    named = docs.select(path.alias("path"), text.alias("text"), at.cast("timestamp").alias("modificationTime"), side.alias("side"))
    kind = extension(F.col("path"))
    made = _encoded(kind, F.when(kind.isin(*WRITERS), F.col("text")))  # plain bytes need no Python
    own = named.select("path", "modificationTime", F.coalesce(made, F.col("text").cast("binary"), F.lit(b"")).alias("content"))
    beside = named.where("side is not null").select(F.concat("path", F.lit(".json")).alias("path"), "modificationTime", F.col("side").cast("binary").alias("content"))
    return own.unionByName(beside).select("path", "modificationTime", F.length("content").cast("long").alias("length"), "content")


def _dealt(rows: DataFrame, size: Column, keys: list[str], file_bytes: int) -> DataFrame:
    """Rows dealt over tasks so that each key's files hold about ``file_bytes``: a frequent key
    is spread over as many tasks as it fills files."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    return rows.repartition(files, *(F.col(k) for k in keys), F.pmod(F.xxhash64(*rows.columns), F.lit(files))) if files > 1 else rows.coalesce(1)


def write_markdown(docs: DataFrame, path: str, outcome: str = "outcome", file_bytes: int = FILE_BYTES) -> None:
    """S-10: canonical documents as markdown, a folder an outcome, many documents to a file,
    each closed by RECORD_END (which a body's own ones become spaces for)."""
    rows = docs.select(F.translate(to_markdown(docs), RECORD_END, " ").alias("value"), F.col(outcome).alias("outcome"))
    _dealt(rows, F.octet_length("value"), ["outcome"], file_bytes).write.partitionBy("outcome").option("lineSep", RECORD_END).text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Documents as ``write_markdown`` leaves them: outcome, source_name, source_format,
    source_sha256, normalizer_version, warnings, body."""
    rows = spark.read.option("lineSep", RECORD_END).text(path)
    head, body = r"(?s)\A---\n(.*?)\n---\n", r"(?s)\A---\n.*?\n---\n\n(.*)\z"
    front = F.regexp_extract("value", head, 1)
    field = lambda k: F.regexp_extract(front, rf"(?m)^{k}: (.*)$", 1).alias(k)
    warnings = F.regexp_extract_all(front, F.lit(r"(?m)^  - (.*)$"), F.lit(1)).alias("warnings")
    return rows.select("outcome", field("source_name"), field("source_format"), field("source_sha256"), field("normalizer_version").cast("int").alias("normalizer_version"), warnings, F.regexp_extract("value", body, 1).alias("body"))


def write_entries(entries: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """S-15: entries as JSON lines, in files of a bounded size."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    rows = entries.select(*(F.col(c) if c in entries.columns else F.lit(None).alias(c) for c in names)).select(F.to_json(F.struct("*")).alias("value"))
    _dealt(rows, F.octet_length("value"), [], file_bytes).write.text(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(path)


