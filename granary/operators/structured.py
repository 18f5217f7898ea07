"""Typed tables from rows of strings: names, type inference, loading, type changes and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx

SAMPLE_ROWS = 100
#: The types that a column may have, and what they are here.
TYPES = {"TEXT": "string", "BIGINT": "bigint", "NUMERIC": "double", "DATE": "date", "TIMESTAMPTZ": "timestamp", "BOOLEAN": "boolean"}
INTEGER = r"(?U)^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT = r"(?iU)^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|\d+(_\d+)*\.(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
#: The shapes of ISO dates and times, whether or not such a day is in the calendar.
DATE = r"^\d{4}(-\d\d){2}$"
DATETIME = r"^\d{4}(-\d\d){2}[T ]\d\d(:\d\d){1,2}$"
#: A database's type names as the wire has them.
WIRE_TYPES = {
    "integer": "BIGINT", "bigint": "BIGINT", "smallint": "BIGINT", "numeric": "NUMERIC", "real": "NUMERIC", "double precision": "NUMERIC",
    "text": "TEXT", "character varying": "TEXT", "character": "TEXT", "varchar": "TEXT", "date": "DATE",
    "timestamp with time zone": "TIMESTAMPTZ", "timestamp without time zone": "TIMESTAMPTZ", "boolean": "BOOLEAN",
}


def wire_type(name: Column) -> Column:
    pairs = [F.lit(x) for kv in WIRE_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(name)), F.lit("TEXT"))


def inferred(value: Column) -> Column:
    """An aggregate: the tightest type that all values but the empty ones have by their shape; TEXT for none."""
    v = F.nullif(value, F.lit(""))
    every = lambda pattern: F.coalesce(F.bool_and(v.rlike(pattern)), F.lit(False))
    return F.when(every(INTEGER), "BIGINT").when(every(FLOAT), "NUMERIC").when(every(DATETIME), "TIMESTAMPTZ").when(every(DATE), "DATE").otherwise("TEXT")


def long_form(rows: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """row_index, column, value of the first SAMPLE_ROWS rows in order: what inference looks at."""
    first = rows.orderBy(order).limit(SAMPLE_ROWS)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in columns])
    return first.select(F.inline(pairs))


def infer_types(rows: DataFrame, order: Column, columns: list[str] | None = None) -> DataFrame:
    """column, name (unique and safe), type for each of the columns of a table of strings."""
    columns = columns or rows.columns
    names = unique_names(rows.sparkSession, columns)
    found = long_form(rows, order, columns).groupBy("column").agg(inferred(F.col("value")).alias("type"))
    return F.broadcast(names).join(found, "column", "left").select("position", "column", "name", F.coalesce("type", F.lit("TEXT")).alias("type"))


def unique_names(spark: SparkSession, headers: list[str]) -> DataFrame:
    """position, column, name: safe names; the second of a kind gets _1, the third _2."""
    df = spark.createDataFrame(list(enumerate(headers)), "position int, column string").withColumn("safe", tx.safe_name(F.col("column")))
    return with_occurrence(df, "safe", "position", "name").select("position", "column", "name")


def with_occurrence(df: DataFrame, name: str, order: str, out: str, *within: str) -> DataFrame:
    """out: the name, with _n behind it for its n-th repetition in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*within, name).orderBy(order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def typed(value: Column, kind: str) -> Column:
    """A string as its type; blanks are null, and so is what doesn't fit."""
    v = F.nullif(tx.strip(value), F.lit(""))
    if kind in ("BIGINT", "NUMERIC"):
        v = F.regexp_replace(v, "_", "")
    return v if kind == "TEXT" else v.try_cast(TYPES[kind])


def load(rows: DataFrame, types: list[tuple[str, str, str]], key: Column | None = None) -> DataFrame:
    """Rows with typed columns. types: (column, name, type); _row_id is a hash of the row, or of key."""
    key = key if key is not None else F.struct(*[F.col(f"`{c}`") for c, *_ in types])
    return rows.select(F.sha2(F.to_json(F.struct(key.alias("k"))), 256).alias("_row_id"), *[typed(F.col(f"`{c}`").cast("string"), kind).alias(name) for c, name, kind in types])


def create_table(rows: DataFrame, name: str, types: list[tuple[str, str, str]], order: Column | None = None) -> None:
    """A managed table in place of any before."""
    load(rows, types).write.mode("overwrite").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def misfits(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """For each column and new type: how many values the change would lose. A change goes ahead if all are 0."""
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNotNull() & typed(F.col(c).cast("string"), t).isNull()).alias("lost")) for c, t in sorted(changes.items())]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def change_types(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """All changes or none: unknown columns and types are left out; a value that doesn't fit raises ValueError."""
    known = {c: t for c, t in changes.items() if c in df.columns and t in TYPES}
    bad = [r["column"] for r in misfits(df, known).where("lost > 0").collect()] if known else []
    if bad:
        raise ValueError(f"values don't fit the new types of {', '.join(bad)}")
    return df.withColumns({c: typed(F.col(c).cast("string"), t) for c, t in known.items()})


def sample_rows(df: DataFrame, order: Column, n: int = 5) -> DataFrame:
    """The first n rows as strings, nulls as empty ones, without _row_id."""
    kept = [c for c in df.columns if c != "_row_id"]
    return df.orderBy(order).limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept])


def table_name(domain: Column, filename: Column) -> Column:
    return F.concat(F.lit("sd_"), F.substring(domain, 1, 8), F.lit("_"), F.substring(tx.safe_name(tx.stem(filename)), 1, 32))


def table_label(domain: Column, name: Column, strip_dashes: bool = False) -> Column:
    """A table's name without its domain's prefix."""
    d = F.regexp_replace(domain, "-", "") if strip_dashes else domain
    prefix = F.concat(F.lit("sd_"), F.substring(d, 1, 8), F.lit("_"))
    return F.when(F.startswith(name, prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)


def known_descriptions(found: Column, columns: Column) -> Column:
    """A model's descriptions by column, less those of columns that aren't there."""
    return F.map_filter(found, lambda k, v: F.array_contains(columns, k) & v.isNotNull())


def guarded(name: str, domain: str) -> str:
    """A table's name, if it is one of the domain's; anything else raises ValueError."""
    prefix = f"sd_{domain[:8]}_"
    if not domain or not name.startswith(prefix) or not name.replace("_", "").isalnum():
        raise ValueError(f"{name} is no table of {domain}")
    return name


def columns_of(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(column, type) in order, with the types' names on the wire, without _row_id."""
    ours = {v: k for k, v in TYPES.items()}
    return [(f.name, ours.get(f.dataType.simpleString(), "TEXT")) for f in spark.table(name).schema.fields if f.name != "_row_id"]


def catalogue(spark: SparkSession, prefix: str, annotations: DataFrame) -> DataFrame:
    """table_name, n_columns, n_rows, columns (name and type), description of the managed tables with a prefix, with
    what annotations say of them. A table that can't be counted has 0 rows."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    rows = []
    for name in names:
        try:
            rows.append((name, columns_of(spark, name), spark.table(name).count()))
        except Exception:  # its files may be gone  # noqa: BLE001
            rows.append((name, [], 0))
    tables = spark.createDataFrame(rows, "table_name string, columns array<struct<name:string,type:string>>, n_rows long")
    return tables.join(annotations, "table_name", "left").select("table_name", F.size("columns").alias("n_columns"), "n_rows", "columns", F.coalesce("description", F.lit("")).alias("description")).orderBy("table_name")
