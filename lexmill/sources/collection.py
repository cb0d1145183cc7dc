"""A Python data source for note collections: SQLite files and zip packages that hold one.

    spark.dataSource.register(CollectionSource)
    spark.read.format("notecollection").option("path", p).option("table", "notes").load()

A missing, locked or unknown file yields no rows and a warning. Reads take one partition a table.
"""

from __future__ import annotations

import logging
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

log = logging.getLogger(__name__)

TABLES = {
    "notes": "id long, guid string, mid long, flds string",
    "cards": "nid long, did long",
    "decks": "did long, name string",
    "col": "models string, decks string",
    "notetypes": "id long, name string",
    "fields": "ntid long, ord long, name string",
}
# Column expressions that read each table, and members of a package, the newer first.
SELECTS = {
    "notes": "SELECT id, guid, mid, flds FROM notes",
    "cards": "SELECT nid, did FROM cards",
    "decks": "SELECT id, CAST(name AS TEXT) FROM decks",
    "col": "SELECT models, decks FROM col",
    "notetypes": "SELECT id, CAST(name AS TEXT) FROM notetypes",
    "fields": "SELECT ntid, ord, CAST(name AS TEXT) FROM fields",
}
MEMBERS = ("collection.anki21", "collection.anki2")


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notecollection"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path.removeprefix("file://"), table

    def read(self, partition) -> Iterator[tuple]:
        path = self.path
        with tempfile.TemporaryDirectory() as folder:
            try:
                if path.lower().endswith((".apkg", ".colpkg", ".zip")):
                    with zipfile.ZipFile(path) as z:
                        path = z.extract(next(m for m in MEMBERS if m in z.namelist()), folder)
                if not os.path.isfile(path):
                    raise OSError(f"no such file: {path}")
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    con.create_collation("unicase", lambda a, b: (a.casefold() > b.casefold()) - (a.casefold() < b.casefold()))
                    yield from con.execute(SELECTS[self.table])
            except (OSError, StopIteration, sqlite3.Error, zipfile.BadZipFile) as error:
                log.warning("collection %s, table %s: %s", self.path, self.table, error)


def read_collection(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a collection; those it lacks are empty."""
    spark.dataSource.register(CollectionSource)
    return {t: spark.read.format("notecollection").option("path", path).option("table", t).load() for t in TABLES}
