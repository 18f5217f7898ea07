"""Readers as a Spark data source: spark.read.format("granary").option("path", folder).load(), a task for each file."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.operators.jobs import READERS

from .files import CELLS, csv_cells, xlsx_cells


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class CellReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[File]:
        if os.path.isfile(self.root):
            return [File(self.root)]
        found = [os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names]
        return [File(f) for f in sorted(found) if READERS.get(os.path.splitext(f)[1].lower()) == "spreadsheet"] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        path = partition.value
        if not path:
            return
        ext = os.path.splitext(path)[1].lower()
        try:
            with open(path, "rb") as f:
                raw = f.read()
            rows = [(path, *cell, None) for cell in (csv_cells(raw, ext) if ext in (".csv", ".tsv") else xlsx_cells(raw))]
        except Exception as e:  # one bad file doesn't stop the others  # noqa: BLE001
            rows = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        yield from rows


class Sheets(DataSource):
    """The cells of the sheets in a folder that all executors have mounted; sources.files.read_cells reads any store."""

    @classmethod
    def name(cls) -> str:
        return "granary"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(Sheets)


#: A sheet to try things with.
SAMPLE_CSV = "date,category,item,amount\n2026-01-05,food,bread,3.20\n2026-01-06,travel,train,18.00\n2026-01-06,food,apples,2.75\n2026-01-09,home,lamp,24.90\n2026-01-11,travel,bus,2.40\n"
