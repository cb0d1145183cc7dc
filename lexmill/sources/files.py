"""Text, DOCX, JSONL, CSV and TSV scans, and directory listing."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.strings import strip, term_key
from lexmill.operators.rows import numbered

SUFFIXES = {"pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image"}
#: How a card file names its columns.
COLUMNS_LINE = "#columns:"
EXAMPLE = "array<struct<target:string,english:string>>"
GRAMMAR = f"pattern string, meaning string, explanation string, hanja string, examples {EXAMPLE}"
AUDIT = (
    "guid string, nid long, mid long, model string, lang string, deck_id long, deck_name string, fields map<string,string>, "
    "field_order array<string>, resolved struct<headword:string,secondary:string,english:string,sentence:string>, "
    "reasons array<struct<code:string,detail:string>>"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term): the non-blank, stripped lines of a file or folder in order of path and line.

    Files are read in splits; path, split and the place within the split order the lines.
    """
    split = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), strip(F.col("value")).alias("term"))
    return numbered(split.filter("term <> ''"), "path", "block", "at").select("ord", "term")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(ord, path, kind, modified, content) of supported files in path order; hidden and lock files left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = found.withColumn("kind", file_kind(F.col("path"))).filter(F.col("kind").isNotNull() & ~name.rlike("^[.~]"))
    order = numbered(kept.select(F.col("path").alias("__path")), "__path")  # paths alone; contents stay where they are
    return kept.join(order, F.col("path") == F.col("__path")).select("ord", "path", "kind", F.col("modificationTime").alias("modified"), "content")


def file_kind(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1)))


def checked_kind(path: Column) -> Column:
    return F.coalesce(file_kind(path), F.raise_error(F.concat(F.lit("unsupported file type: "), path)).cast("string"))


def docx_text(content: bytes, headings: bool = False) -> str:
    """Paragraphs, then table rows with their non-empty cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for p in body.findall(f"{_W}p"):
        text = words(p).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"Heading ?([1-3])", style.get(f"{_W}val", "")) if style is not None else None
        if text:
            out.append(f"[H{level[1]}] {text}" if headings and level else text)
    for row in body.iter(f"{_W}tr"):
        cells = [c for c in (" ".join(words(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) if c]
        if cells:
            out.append(" | ".join(cells))
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    import pypdf  # optional: needed only where PDF files are read

    pages = (page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)
    return "\n\n".join(p.strip() for p in pages if p.strip())


def extract_text(files: DataFrame, headings: bool = False, image_reader=None) -> DataFrame:
    """(ord, path, text, error): a file that can't be read keeps its error and stops nothing.

    image_reader: (bytes, media type) to text; images without one give an error.
    """

    def one(kind: str, path: str, content: bytes) -> str:
        if kind == "docx":
            return docx_text(content, headings)
        if kind == "pdf":
            return pdf_text(content)
        if image_reader is None:
            raise ValueError("no image reader")
        return image_reader(content, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows.append((r.ord, r.path, one(r.kind, r.path, bytes(r.content)), None))
                except Exception as error:  # noqa: BLE001 - the row carries its error
                    rows.append((r.ord, r.path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["ord", "path", "text", "error"])

    return files.select("ord", "path", "kind", "content").mapInPandas(run, "ord long, path string, text string, error string")


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Grammar items; rows that aren't JSON or lack pattern or meaning are skipped."""
    rows = spark.read.schema(GRAMMAR + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    kept = rows.filter("_corrupt_record IS NULL AND pattern IS NOT NULL AND meaning IS NOT NULL").drop("_corrupt_record")
    return kept.withColumns({"explanation": F.coalesce("explanation", F.lit("")), "hanja": F.coalesce("hanja", F.lit("")), "examples": F.coalesce("examples", F.array().cast(EXAMPLE))})


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audited notes as a user may have edited them; a missing language is ko, missing roles are defaults."""
    from lexmill.operators.audit import DEFAULTS, ROLES

    rows = spark.read.schema(AUDIT + ", _corrupt_record string").json(path).filter("_corrupt_record IS NULL AND guid IS NOT NULL")
    rows = rows.drop("_corrupt_record").withColumn("lang", F.coalesce("lang", F.lit("ko"))).filter(F.col("lang").isin("ko", "zh"))
    role = lambda r: F.coalesce(F.col(f"resolved.{r}"), F.when(F.col("lang") == "ko", DEFAULTS["ko"][r]).otherwise(DEFAULTS["zh"][r]))
    return rows.withColumn("resolved", F.struct(*[role(r).alias(r) for r in ROLES]))


def peek_lang(spark: SparkSession, path: str) -> str | None:
    """The language of the first row that has one."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    first = rows.withColumn("lang", F.get_json_object("line", "$.lang")).filter(F.col("lang").isin("ko", "zh")).orderBy("ord").first()
    return first["lang"] if first else None


def completed_csv_keys(spark: SparkSession, path: str, column: str, columns: list[str]) -> DataFrame:
    """(key): terms that a card file holds already.

    The file's own #columns directive names its columns, ``columns`` those of a file without one. A
    quoted cell may hold line breaks; lines outside of cells that begin with # are directives.
    """
    named = spark.read.text(path).filter(F.startswith("value", F.lit(COLUMNS_LINE))).first()
    names = named["value"][len(COLUMNS_LINE) :].split(",") if named else columns
    if column not in names:
        raise ValueError(f"no column {column!r} in {path}: {', '.join(names)}")
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("comment", "#").csv(path)
    return rows.select(term_key(F.col(f"`{column}`")).alias("key")).filter(F.col("key") != "").distinct()


def completed_guids(spark: SparkSession, pattern: str) -> DataFrame:
    """(guid): third columns of update files."""
    lines = spark.read.text(pattern).filter(~F.startswith("value", F.lit("#")))
    return lines.select(F.get(F.split("value", "\t"), F.lit(2)).alias("guid")).filter("guid <> ''").distinct()
