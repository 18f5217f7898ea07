"""Sparse spreadsheet grids as long-form cells: blocks, their kinds, their records and their Markdown.

cells: file_id, sheet_idx, sheet_name, row, col, value (non-empty strings, positions from 0). A sheet is the unit of
work; only the search for connected cells runs in Python, one sheet at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as tx

SHEET = ["file_id", "sheet_idx"]
#: When a block is a table, pairs of keys and values, or a note.
GAP, TABLE_SIDE = 1, 3
PAIR_FILL, PAIR_FILL_SURE, NOTE_CONFIDENCE, PENALTY = 0.8, 0.9, 0.8, 0.1
HEADER_FILL, HEADER_FILL_SURE, SPREAD, SPREAD_SURE = 0.6, 0.7, 0.3, 0.2


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """merges: file_id, sheet_idx, top, left, bottom, right. The first cell's value fills the range; all
    but the first are marked merged. A range whose first cell is empty has no cells."""
    area = merges.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    master = cells.select(*SHEET, "sheet_name", F.col("row").alias("top"), F.col("col").alias("left"), "value")
    filled = area.join(master, [*SHEET, "top", "left"]).select(*SHEET, "sheet_name", "row", "col", "value", ((F.col("row") != F.col("top")) | (F.col("col") != F.col("left"))).alias("merged"))
    plain = cells.join(area.select(*SHEET, "row", "col"), [*SHEET, "row", "col"], "left_anti")
    return plain.select(*SHEET, "sheet_name", "row", "col", "value", F.lit(False).alias("merged")).unionByName(filled)


def connected(cells: DataFrame, gap: int = GAP) -> DataFrame:
    """cells with component: cells are connected over up to gap blank rows or columns."""
    schema = cells.select(*SHEET, "row", "col").schema.add("component", T.IntegerType())

    def sheet(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["row"].tolist(), pdf["col"].tolist()))}
        parent = list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        reach = range(-gap - 1, gap + 2)
        steps = [(a, b) for a in reach for b in reach if (a, b) > (0, 0)]
        for (r, c), i in at.items():
            for a, b in steps:
                j = at.get((r + a, c + b))
                if j is not None:
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
        return pdf.assign(component=[root(at[k]) for k in zip(pdf["row"].tolist(), pdf["col"].tolist())])

    return cells.join(cells.select(*SHEET, "row", "col").distinct().groupBy(*SHEET).applyInPandas(sheet, schema), [*SHEET, "row", "col"])


def classify(cells: DataFrame) -> DataFrame:
    """Cells with component: one row a block with its box, kind and confidence; block_index counts within the file."""
    unit = [*SHEET, "component"]
    box = cells.groupBy(*unit).agg(F.first("sheet_name").alias("sheet_name"), F.min("row").alias("top_row"), F.min("col").alias("left_col"), F.max("row").alias("bottom_row"), F.max("col").alias("right_col"))
    rows = cells.groupBy(*unit, "row").agg(F.count("*").alias("n"), F.min("col").alias("first_col"))
    width, height = F.col("right_col") - F.col("left_col") + 1, F.col("bottom_row") - F.col("top_row") + 1
    fill = F.col("n") / width
    stats = rows.join(box, unit).groupBy(*unit).agg(
        F.max(F.when(F.col("row") == F.col("top_row"), fill)).alias("head"),
        F.count_if(F.col("row") > F.col("top_row")).alias("data_rows"),
        F.coalesce(F.stddev_samp(F.when(F.col("row") > F.col("top_row"), fill)), F.lit(0.0)).alias("spread"),
        (F.count_if(F.col("first_col") == F.col("left_col")) / F.max(height)).alias("keys"),
    )
    b = box.join(stats, unit)
    table = (width >= TABLE_SIDE) & (height >= TABLE_SIDE) & (F.col("head") >= HEADER_FILL) & (F.col("data_rows") > 0) & (F.col("spread") < SPREAD)
    pairs = (width == 2) & (height >= 2) & (F.col("keys") >= PAIR_FILL)
    sure = F.lit(1.0) - F.when(F.col("head") < HEADER_FILL_SURE, PENALTY).otherwise(0.0) - F.when(F.col("spread") > SPREAD_SURE, PENALTY).otherwise(0.0)
    kind = F.when(table, "table").when(pairs, "kv_pair").otherwise("note")
    confidence = F.when(table, sure).when(pairs, F.when(F.col("keys") >= PAIR_FILL_SURE, 1.0).otherwise(1.0 - PENALTY)).otherwise(NOTE_CONFIDENCE)
    order = Window.partitionBy("file_id").orderBy("sheet_idx", "top_row", "left_col", "component")
    return b.select(*unit, "sheet_name", "top_row", "left_col", "bottom_row", "right_col", kind.alias("block_type"), confidence.alias("confidence"), (F.row_number().over(order) - 1).alias("block_index"), table.alias("has_header"))


def inside(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Blocks with every cell of the sheet in their box, another block's too."""
    b, c = blocks.alias("b"), cells.select(*SHEET, "row", "col", "value").alias("c")
    on = (F.col("b.file_id") == F.col("c.file_id")) & (F.col("b.sheet_idx") == F.col("c.sheet_idx")) & F.col("row").between(F.col("top_row"), F.col("bottom_row")) & F.col("col").between(F.col("left_col"), F.col("right_col"))
    return b.join(c, on).select("b.*", "row", "col", "value")


def distinct_headers(headers: Column) -> Column:
    """The second of a name gets _1, the third _2."""
    n = lambda x, i: F.size(F.filter(F.slice(headers, 1, i), lambda y: y == x))
    return F.transform(headers, lambda x, i: F.when(n(x, i) == 0, x).otherwise(F.concat(x, F.lit("_"), n(x, i).cast("string"))))


def table_rows(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """file_id, block_index, row_index, headers, values, fields: of tables, rows that aren't empty."""
    unit = ["file_id", "block_index"]
    found = inside(blocks.where("block_type = 'table'"), cells)
    width = F.col("right_col") - F.col("left_col") + 1
    line = found.groupBy(*unit, "top_row", "left_col", "right_col", "row").agg(F.map_from_entries(F.collect_list(F.struct((F.col("col") - F.col("left_col")).alias("i"), "value"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    heads = line.where("row = top_row").select(*unit, distinct_headers(F.transform(at, lambda v, i: F.when(v == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(v))).alias("headers"))
    rows = line.where("row > top_row").select(*unit, "row", at.alias("values")).join(heads, unit, "left").where(F.exists("values", lambda v: v != ""))
    plain = F.transform(F.col("values"), lambda v, i: F.concat(F.lit("col_"), i.cast("string")))
    rows = rows.withColumn("headers", F.coalesce("headers", plain))
    pairs = F.arrays_zip(F.col("headers"), F.col("values"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice("headers", i + 2, F.size("headers")), p["headers"]))
    order = Window.partitionBy(*unit).orderBy("row")
    return rows.select(*unit, (F.row_number().over(order) - 1).alias("row_index"), "headers", "values", F.map_from_entries(F.transform(last, lambda p: F.struct(p["headers"], p["values"]))).alias("fields"))


def kv_items(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """file_id, block_index, row, key, value of pairs with a key; a value may be empty."""
    found = inside(blocks.where("block_type = 'kv_pair'"), cells)
    side = lambda i: F.coalesce(F.max(F.when(F.col("col") - F.col("left_col") == i, tx.strip(F.col("value")))), F.lit(""))
    return found.groupBy("file_id", "block_index", "row").agg(side(0).alias("key"), side(1).alias("value")).where("key <> ''")


def notes(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """file_id, block_index, text of notes, row by row."""
    found = inside(blocks.where("block_type = 'note'"), cells).withColumn("value", tx.strip(F.col("value"))).where("value <> ''")
    each = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return found.groupBy("file_id", "block_index").agg(F.array_join(F.transform(each, lambda x: x["value"]), " ").alias("text"))


def render(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """blocks with content: Markdown under a heading that says where the block is; empty blocks are left out."""
    unit = ["file_id", "block_index"]
    bar = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    last = lambda p: F.coalesce(F.try_element_at("fields", p), F.lit(""))
    names = F.array_distinct("headers")
    rows = table_rows(blocks, cells).select(*unit, "row_index", bar(names).alias("h"), bar(F.transform(names, lambda _: F.lit("---"))).alias("rule"), bar(F.transform(names, last)).alias("line"))
    lines = lambda c, key: F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c])
    tables = rows.groupBy(*unit).agg(F.concat(F.array(F.first("h"), F.first("rule")), lines("line", "row_index")).alias("body"))
    pairs = kv_items(blocks, cells).withColumn("line", F.concat(F.lit("- "), "key", F.lit(": "), "value")).groupBy(*unit).agg(lines("line", "row").alias("body"))
    texts = notes(blocks, cells).select(*unit, F.array("text").alias("body"))
    kind = F.when(F.col("block_type") == "table", "Table").when(F.col("block_type") == "kv_pair", "Key-Value").otherwise("Note")
    head = F.concat(F.lit("### "), kind, F.lit(" (rows "), (F.col("top_row") + 1).cast("string"), F.lit("-"), (F.col("bottom_row") + 1).cast("string"), F.lit(", cols "), tx.column_letter(F.col("left_col")), F.lit("-"), tx.column_letter(F.col("right_col")), F.lit(")"))
    return blocks.join(tables.union(pairs).union(texts), unit).withColumn("content", F.concat(head, F.lit("\n"), F.array_join("body", "\n"))).drop("body")


def tables_of(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """file_id, block_index, headers, rows of every table; a table without rows has no headers."""
    rows = table_rows(blocks, cells).groupBy("file_id", "block_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.struct("headers", "values").alias("r")))), lambda x: x["r"]).alias("r"))
    found = blocks.where("block_type = 'table'").select("file_id", "block_index").join(rows, ["file_id", "block_index"], "left")
    none = F.array().cast("array<array<string>>")
    return found.select("file_id", "block_index", F.coalesce(F.get("r", F.lit(0))["headers"], F.array().cast("array<string>")).alias("headers"), F.coalesce(F.transform("r", lambda x: x["values"]), none).alias("rows"))


def documents(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Rendered blocks as documents with an id that depends on the file and the block alone."""
    meta = F.struct("block_type", "sheet_name", "top_row", "bottom_row", "left_col", "right_col", "confidence", "block_index")
    out = render(blocks, cells)
    return out.select(F.concat(F.lit("spreadsheet-"), F.substring(F.sha2(F.concat_ws("/", F.col("file_id").cast("string"), F.col("block_index").cast("string")), 256), 1, 16)).alias("doc_id"), "content", F.lit("spreadsheet").alias("source_type"), F.col("file_id").alias("source_name"), meta.alias("metadata"))


def parse(cells: DataFrame) -> DataFrame:
    """The blocks of all sheets."""
    return classify(connected(cells))
