"""Pages as documents: tables with and without rulings, the text around them, and the headings that both stand under.

pages: a row each, with file_id, page_no, text (the whole page's), words (an array of x0, x1, top, bottom, text) and
tables (an array of x0, top, x1, bottom, cells: rows of strings, and columns: x0 and x1 of the first row's cells), as
sources.files.read_pages gives them. What a page holds is worked out in its row, in the JVM; only headings, which go on
from page to page, need a file's pages together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx

from . import pages as pg

PAGE = ["file_id", "page_no"]
#: Words whose heights differ no more than that are in one line of text.
LINE = 3.0
WORD = "struct<x0:double,top:double,x1:double,bottom:double,text:string>"
CELL = "struct<x0:double,x1:double,text:string>"
ROW = f"struct<top:double,bottom:double,cells:array<{CELL}>>"
TABLE = "struct<x0:double,top:double,x1:double,bottom:double,cells:array<array<string>>,external:array<string>>"


def _replaced(array: Column, last: Column) -> Column:
    return F.array_append(F.slice(array, F.lit(1), F.size(array) - 1), last)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: no filter or projection above is moved through a generator, which
    would repeat its expression for each use."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()], F.explode(F.array(value)).alias(name))


def sorted_words(words: Column) -> Column:
    """Words from the left, those without a place left out."""
    whole = F.filter(words, lambda w: w["x0"].isNotNull() & w["x1"].isNotNull() & w["top"].isNotNull() & w["bottom"].isNotNull())
    return F.array_sort(F.transform(whole, lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["x1"].alias("x1"), w["bottom"].alias("bottom"), w["text"].alias("text")))).cast(f"array<{WORD}>")


def banded(words: Column, within: float) -> Column:
    """Sorted words as arrays of those about as high, from the top (pages.bands)."""
    begin = lambda acc, top: F.when((F.size(acc) == 0) | (top - F.element_at(acc, -1) > within), F.array_append(acc, top)).otherwise(acc)
    first = F.aggregate(F.array_sort(F.array_distinct(F.transform(words, lambda w: w["top"]))), F.array().cast("array<double>"), begin)
    below = lambda at, i, w: F.coalesce(w["top"] < F.get(at, i + 1), F.lit(True))
    return tx.bind(first, lambda at: F.transform(at, lambda t, i: F.filter(words, lambda w: (w["top"] >= t) & below(at, i, w))))


def cells_of(band: Column) -> Column:
    """A band's cells: a new one after a gap."""

    def step(acc, w):
        last = F.element_at(acc, -1)
        longer = F.struct(last["x0"].alias("x0"), w["x1"].alias("x1"), F.concat(last["text"], F.lit(" "), w["text"]).alias("text"))
        fresh = F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))
        return F.when((F.size(acc) == 0) | (w["x0"] - last["x1"] > pg.CELL_GAP), F.array_append(acc, fresh)).otherwise(_replaced(acc, longer))

    return F.aggregate(band, F.array().cast(f"array<{CELL}>"), step)


def shown_tables(words: Column) -> Column:
    """Tables that their words' places show (pages.stream_tables), of a page's sorted words."""
    row = lambda b: F.struct(F.array_min(F.transform(b, lambda w: w["top"])).alias("top"), F.array_max(F.transform(b, lambda w: w["bottom"])).alias("bottom"), cells_of(b).alias("cells"))
    rows = F.filter(F.transform(banded(words, pg.BAND), row), lambda r: F.size(r["cells"]) >= pg.MIN_COLUMNS).cast(f"array<{ROW}>")

    def group(acc, r):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (r["top"] - F.element_at(last, -1)["bottom"] > pg.ROW_GAP), F.array_append(acc, F.array(r))).otherwise(_replaced(acc, F.array_append(last, r)))

    groups = F.filter(F.aggregate(rows, F.array().cast(f"array<array<{ROW}>>"), group), lambda g: F.size(g) >= pg.MIN_ROWS)
    middle = lambda c: (c["x0"] + c["x1"]) / 2

    def chain(acc, x):
        last = F.element_at(acc, -1)
        fresh = F.struct(x.alias("last"), x.alias("sum"), F.lit(1).alias("n"))
        return F.when((F.size(acc) == 0) | (x - last["last"] > pg.COLUMN), F.array_append(acc, fresh)).otherwise(_replaced(acc, F.struct(x.alias("last"), (last["sum"] + x).alias("sum"), (last["n"] + 1).alias("n"))))

    centres = lambda g: F.transform(F.aggregate(F.array_sort(F.flatten(F.transform(g, lambda r: F.transform(r["cells"], middle)))), F.array().cast("array<struct<last:double,sum:double,n:int>>"), chain), lambda c: c["sum"] / c["n"])
    with_centres = F.filter(F.transform(groups, lambda g: F.struct(g.alias("g"), centres(g).alias("m"))), lambda t: F.size(t["m"]) >= pg.MIN_COLUMNS)

    def table(t):
        g, m = t["g"], t["m"]
        nearest = lambda c: F.array_min(F.transform(m, lambda x, i: F.struct(F.abs(x - middle(c)).alias("d"), i.alias("i"))))["i"]
        placed = lambda r: tx.bind(F.transform(r["cells"], lambda c: F.struct(nearest(c).alias("i"), c["text"].alias("t"))), lambda cs: F.transform(m, lambda _x, i: F.array_join(F.transform(F.filter(cs, lambda c: c["i"] == i), lambda c: c["t"]), " ")))
        y0, y1 = F.get(g, F.lit(0))["top"], F.element_at(g, -1)["bottom"]
        near = F.filter(words, lambda w: w["top"].between(y0 - pg.EDGE, y1 + pg.EDGE))
        return F.struct(F.array_min(F.transform(near, lambda w: w["x0"])).alias("x0"), y0.alias("top"), F.array_max(F.transform(near, lambda w: w["x1"])).alias("x1"), y1.alias("bottom"), F.transform(g, placed).alias("cells"), F.lit(None).cast("array<string>").alias("external"))

    return F.transform(with_centres, table).cast(f"array<{TABLE}>")


def labels_above(words: Column, table: Column) -> Column:
    """Column labels that stand above a ruled table (pages.headers_above), or null."""
    columns = table["columns"]
    strip = F.filter(words, lambda w: (w["x0"] >= table["x0"]) & (w["x1"] <= table["x1"]) & (w["bottom"] <= table["top"]) & (w["top"] >= F.greatest(F.lit(0.0), table["top"] - pg.ABOVE)))

    def labels(ws):
        near = F.filter(ws, lambda w: table["top"] - w["bottom"] <= pg.CLOSE)
        chosen = F.array_sort(F.transform(F.when(F.size(near) > 0, near).otherwise(ws), lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), ((w["x0"] + w["x1"]) / 2).alias("c"), w["text"].alias("t"))))
        holds = lambda w: F.get(F.filter(F.transform(columns, lambda c, i: F.when(w["c"].between(c["x0"], c["x1"]), i)), lambda i: i.isNotNull()), F.lit(0))
        closest = lambda w: F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs((c["x0"] + c["x1"]) / 2 - w["c"]).alias("d"), i.alias("i"))))["i"]
        placed = F.transform(chosen, lambda w: F.struct(F.coalesce(holds(w), closest(w)).alias("i"), w["t"].alias("t")))
        return tx.bind(placed, lambda ps: F.transform(columns, lambda _c, i: F.array_join(F.transform(F.filter(ps, lambda x: x["i"] == i), lambda x: x["t"]), " ")))

    def judged(heads):
        filled = F.filter(heads, lambda h: ~tx.is_blank(h))
        return F.when((F.size(filled) >= F.greatest(F.lit(1), F.floor(F.size(heads) / 2))) & pg.is_header_row(heads), heads)

    some = (F.coalesce(F.size(columns), F.lit(0)) > 0) & (F.size(strip) > 0)
    return F.when(some, tx.bind(tx.bind(strip, labels), judged))


def ruled_tables(words: Column, tables: Column) -> Column:
    """Ruled tables with cells stripped and the labels above them, without those that are empty."""
    clean = lambda t: F.transform(t["cells"], lambda r: F.transform(r, lambda c: tx.strip(F.coalesce(c, F.lit("")))))
    full = F.filter(F.coalesce(tables, F.array().cast("array<struct<x0:double,top:double,x1:double,bottom:double,cells:array<array<string>>,columns:array<struct<x0:double,x1:double>>>>")), lambda t: F.exists(clean(t), lambda r: F.exists(r, lambda c: c != "")))
    return F.transform(full, lambda t: F.struct(t["x0"].alias("x0"), t["top"].alias("top"), t["x1"].alias("x1"), t["bottom"].alias("bottom"), clean(t).alias("cells"), labels_above(words, t).alias("external"))).cast(f"array<{TABLE}>")


def outside(words: Column, tables: Column, edge: float = pg.EDGE) -> Column:
    """Words that no table's box holds."""
    held = lambda w, t: (w["x0"] >= t["x0"] - edge) & (w["x1"] <= t["x1"] + edge) & (w["top"] >= t["top"] - edge) & (w["bottom"] <= t["bottom"] + edge)
    return F.filter(words, lambda w: ~F.exists(tables, lambda t: held(w, t)))


def page_lines(words: Column) -> Column:
    """The text of sorted words, line by line."""
    return F.array_join(F.transform(banded(words, LINE), lambda b: F.array_join(F.transform(b, lambda w: w["text"]), " ")), "\n")


def segmented(pages: DataFrame) -> DataFrame:
    """pages with sorted words, found (their tables: ruled ones, or those shown where there are none) and rest: the text
    that came with a page without tables, that of the words outside them of others."""
    p = once(pages, "words", sorted_words(F.coalesce("words", F.array().cast("array<struct<x0:double,x1:double,top:double,bottom:double,text:string>>"))))
    p = once(p, "found", tx.bind(ruled_tables(F.col("words"), F.col("tables")), lambda t: F.when(F.size(t) > 0, t).otherwise(shown_tables(F.col("words")))))
    return once(p, "rest", F.when(F.size("found") > 0, page_lines(outside(F.col("words"), F.col("found")))).otherwise(F.coalesce("text", F.lit(""))))


def blocks(pages: DataFrame) -> DataFrame:
    """file_id, page_no, block_no, kind, cells, external, text, headings: on each page its tables, then its text. Headings
    are those in force, across pages, after the block."""
    block = "struct<kind:string,cells:array<array<string>>,external:array<string>,text:string>"
    tables = F.transform("found", lambda t: F.struct(F.lit("table").alias("kind"), t["cells"].alias("cells"), t["external"].alias("external"), F.lit(None).cast("string").alias("text"))).cast(f"array<{block}>")
    texts = F.transform(pg.text_blocks(F.col("rest")), lambda b: F.struct(b["kind"].alias("kind"), F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(None).cast("array<string>").alias("external"), b["text"].alias("text"))).cast(f"array<{block}>")
    each = once(segmented(pages), "b", F.concat(tables, texts)).select(*PAGE, F.posexplode("b").alias("block_no", "b")).select(*PAGE, "block_no", "b.*")
    heads = F.filter(F.transform(F.transform(F.coalesce(tx.lines(F.col("text")), F.array().cast("array<string>")), tx.strip), lambda line: F.struct(pg.heading_depth(line).alias("d"), line.alias("t"))), lambda h: h["d"].isNotNull())
    each = once(each, "heads", heads)
    at = F.struct("page_no", "block_no")
    lines = each.where(F.size("heads") > 0).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("n"), "heads"))).alias("hs"))
    flat = F.flatten(F.transform("hs", lambda x: F.transform(x["heads"], lambda h: F.struct(x["n"].alias("n"), h["d"].alias("d"), h["t"].alias("t")))))
    states = lines.select("file_id", pg.heading_states(flat, "struct<page_no:int,block_no:int>").alias("states"))
    before = F.filter("states", lambda s: s["n"] <= F.struct(F.col("page_no").cast("int").alias("page_no"), F.col("block_no").alias("block_no")))
    path = F.coalesce(F.element_at(F.when(F.size(before) > 0, before), -1)["path"], F.array().cast("array<string>"))
    return each.join(states, "file_id", "left").withColumn("headings", path).select(*PAGE, "block_no", "kind", "cells", "external", "text", "headings")


def with_records(found: DataFrame) -> DataFrame:
    """Blocks with columns and rows (arrays of strings) for tables that have any."""
    r = pg.table_records(F.col("cells"), F.col("external"))
    return once(found, "__r", F.when(F.col("kind") == "table", r)).withColumn("columns", F.col("__r")["headers"]).withColumn("rows", F.col("__r")["rows"]).drop("__r")


def row_maps(columns: Column, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.map_from_arrays(columns, r))


def documents(found: DataFrame) -> DataFrame:
    """A document for each block that holds anything: doc_id (of the file, page and block alone), content in Markdown,
    and for tables columns, rows (maps) and the heading they stand under as their label."""
    b = with_records(found)
    content = pg.render(F.col("kind"), F.col("page_no"), F.col("columns"), F.col("rows"), F.col("text"))
    ident = F.concat(F.lit("pdf_"), F.substring(F.sha2(F.concat_ws("/", F.col("file_id").cast("string"), F.col("page_no").cast("string"), F.col("block_no").cast("string")), 256), 1, 16))
    label = F.when(F.col("columns").isNotNull(), F.element_at(F.when(F.size("headings") > 0, F.col("headings")), -1))
    out = once(b, "content", content).where("content is not null and content <> ''")
    return out.select("file_id", "page_no", "block_no", ident.alias("doc_id"), "content", F.lit("pdf").alias("source_type"), F.col("kind").alias("block_type"), "headings", F.col("columns").alias("table_columns"), row_maps(F.col("columns"), F.col("rows")).alias("table_rows"), label.alias("table_label"))


def extract_tables(found: DataFrame) -> DataFrame:
    """file_id, page_no, block_no, headers, rows: what sheets give as well, for typed tables."""
    return with_records(found).where("columns is not null").select(*PAGE, "block_no", F.col("columns").alias("headers"), "rows")
