"""Line-oriented outputs: word lists, card and update files with directive headers, JSONL, reports.

Lines are columns of a DataFrame, so a run writes them in parallel; ``write_single`` makes the one
file with its header lines first that note programs import.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.patterns import pattern_key
from lexmill.functions.strings import blank_if_null, slug
from lexmill.operators.rows import append_unseen, exclude

# Columns of the card files and of the similarity report.
CARD_COLUMNS = {
    ("zh", "vocab"): ["Hanzi", "Pinyin", "Jyutping", "English", "Sentence"],
    ("ko", "vocab"): ["Korean", "Hanja", "English", "Comment"],
    ("any", "grammar"): ["Pattern", "Hanja", "Meaning", "Examples"],
}
REPORT_COLUMNS = ["word_a", "word_b", "reason", "score", "source"]


def csv_header(columns: list[str]) -> list[str]:
    """Directive lines of a card file."""
    return ["#separator:comma", "#html:true", f"#columns:{','.join(columns)}", f"#{','.join(columns)}"]


def tsv_header(columns: list[str]) -> list[str]:
    """Directive lines of an update file, whose first three columns are note type, deck and guid."""
    return ["#separator:tab", "#html:true", "#notetype column:1", "#deck column:2", "#guid column:3", "#columns:" + "\t".join(["notetype", "deck", "guid", *columns])]


def csv_line(*values: Column) -> Column:
    """One CSV line with quotes where a value needs them."""

    def cell(v: Column) -> Column:
        v = blank_if_null(v.cast("string"))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[cell(v) for v in values])


def write_single(lines: DataFrame, header: list[str], path: str, order: str = "ord", mode: str = "errorifexists") -> None:
    """Header lines, then ``line`` in order, as one text file in the folder ``path``."""
    spark = lines.sparkSession
    top = spark.createDataFrame([(k - len(header), h) for k, h in enumerate(header)], "ord long, line string")
    body = lines.select(F.col(order).cast("bigint").alias("ord"), "line")
    top.unionByName(body).repartition(1).sortWithinPartitions("ord").select("line").write.mode(mode).text(path)


def append_words(new: DataFrame, existing: DataFrame, path: str, key: Column | None = None, order: str = "ord") -> None:
    """Appends terms that the list doesn't have; ``key`` makes both sides comparable."""
    key = F.col("term") if key is None else key
    append_unseen(new, existing, key, key, order).orderBy(order).select("term").write.mode("append").text(path)


def append_grammar(new: DataFrame, existing: DataFrame, path: str, lang: str = "ko") -> None:
    """Appends items whose pattern the file doesn't have; the batch itself keeps its repeats."""
    key = pattern_key(F.col("pattern"), lang)
    exclude(new, existing, key, key).write.mode("append").json(path)


def write_audit(audited: DataFrame, decks: DataFrame, path: str) -> None:
    """Audited notes as JSON lines, with deck names where the ids are known."""
    names = decks.select(F.col("did").alias("deck_id"), F.col("name").alias("deck_name"))
    rows = audited.drop("deck_name").join(names, "deck_id", "left").withColumn("deck_name", F.coalesce("deck_name", F.lit("")))
    rows.select("guid", "nid", "mid", F.col("model_name").alias("model"), "lang", "deck_id", "deck_name", "fields", "field_order", "resolved", "reasons").write.mode("overwrite").json(path)


def write_updates(repaired: DataFrame, line: Column, folder: str, mode: str = "overwrite") -> None:
    """Update lines in a folder a note type, each file beginning with the directive lines of its type.

    The lines of a type are dealt to sorted runs; the fields of its notes (``field_order``, if there)
    name its columns.
    """
    lines = repaired.select(slug(F.col("model_name"), "model").alias("notetype"), (F.array_join("field_order", "\t") if "field_order" in repaired.columns else F.lit("")).alias("names"), line.alias("line"))
    names = tsv_header(["%s"])
    head = F.concat(F.lit("\n".join(names).replace("%s", "")), F.col("names"))
    # one file a (type, task): the header is the first row of each
    runs = lines.repartition("notetype", "names", F.pmod(F.xxhash64("line"), F.lit(64))).sortWithinPartitions("notetype", "names", "line")

    def headed(batches):
        last = None
        for batch in batches:
            out = []
            for kind, top, text in zip(*(batch.column(n).to_pylist() for n in ("notetype", "top", "line")), strict=True):
                if (kind, top) != last:
                    last = (kind, top)
                    out.append((kind, top))
                out.append((kind, text))
            if out:
                kinds, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["notetype", "line"])

    made = runs.select("notetype", head.alias("top"), "line").mapInArrow(headed, "notetype string, line string")
    made.write.mode(mode).partitionBy("notetype").text(folder)


def report_lines(pairs: DataFrame) -> DataFrame:
    """(line) of the similarity report."""
    return pairs.select(csv_line(F.col("a"), F.col("b"), F.col("reason"), F.col("score"), F.col("source")).alias("line"))


def default_path(root: str, lang: str, date: str, kind: str, suffix: str) -> str:
    """inputs/<lang>/<date>_<kind>.<suffix> and the like; the date is a literal, so runs are repeatable."""
    return f"{root.rstrip('/')}/{lang}/{date}{'_' + kind if kind else ''}.{suffix}"
