"""What an application or an agent calls to look things up: searches bound to a user, and tools that return text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, structured

FILTERS = ("domain_id", "filename")
#: What a hit's metadata may tell besides, for callers that show pages and tables.
DETAILS = ("block_type", "page_number", "table_label")


@dataclass
class Knowledge:
    """Searches of a store in words: embed makes a text column's vectors."""

    spark: SparkSession
    store: store.SearchableStore
    embed: Callable[[Column], Column]
    top_k: int = 5

    def vector(self, query: str) -> list[float]:
        v = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]
        return [float(x or 0.0) for x in v]

    def valid_filters(self) -> set[str]:
        return set(FILTERS)

    def context(self) -> str:
        """What an agent should know of the tool."""
        return f"search_knowledge looks through the user's documents. Give domain_id to search one domain, or leave it empty. Results can be filtered by {' and '.join(FILTERS)}."

    def retrieve(self, query: str, user_id: str = "", domain_id: str = "", filters: dict | None = None) -> DataFrame:
        """id, name, content, meta_data, score of the nearest. What isn't given comes from filters; a file's name in them
        is filtered by as well, and any other key raises ValueError."""
        filters = dict(filters or {})
        user_id, domain_id = user_id or filters.pop("user_id", ""), domain_id or filters.get("domain_id", "")
        unknown = set(filters) - self.valid_filters() - {"user_id"}
        if unknown:
            raise ValueError(f"no filter {', '.join(sorted(unknown))}")
        vector = self.vector(query)
        if filters.get("filename"):  # before the nearest are cut off
            rows = self.store.read(user_id).where(F.col("filename") == filters["filename"])
            hits = store.search(rows, vector, user_id, domain_id, self.top_k)
        else:
            hits = self.store.search(vector, user_id, domain_id, self.top_k)
        name = F.coalesce("filename", F.lit("chunk"))
        return hits.select("id", name.alias("name"), "content", F.col("metadata").alias("meta_data"), "score").orderBy(F.desc("score"), "id")

    def search_tool(self, user_id: str, details: tuple[str, ...] = ()) -> Callable[..., str]:
        """search_knowledge(query, domain_id) for one user, whom a caller can't change: JSON of the hits."""

        def search_knowledge(query: str, domain_id: str = "") -> str:
            """Look through the user's documents for what answers the query."""
            hits = self.store.search(self.vector(query), user_id, domain_id, self.top_k)
            extra = hits.withColumns({d: F.try_element_at("metadata", F.lit(d)) for d in details})
            return store.search_json(extra, details).first()["json"]

        return search_knowledge


def of_source_types(df: DataFrame, types: str, column: str = "source_type") -> DataFrame:
    """Rows of the types in a list with commas, spelled as they are in it; all rows for an empty list."""
    wanted = [t for t in types.split(",") if t]
    return df.where(F.col(column).isin(wanted)) if wanted else df


def table_tools(spark: SparkSession, domain_id: str, annotations: DataFrame, rows: int = 100, seconds: float = 5.0) -> dict[str, Callable[..., str]]:
    """Tools over a domain's typed tables, by name: each takes text and returns JSON, errors too."""
    from granary.plans.sql import run_sql

    def told(f: Callable[[], object]) -> str:
        try:
            return json.dumps(f(), default=str, ensure_ascii=False)
        except Exception as e:  # an agent reads the error  # noqa: BLE001
            return json.dumps({"error": str(e)[:500]})

    def list_tables() -> str:
        return told(lambda: {"tables": [{"name": r.table_name, "rows": r.n_rows, "description": r.description} for r in structured.catalogue(spark, f"sd_{domain_id[:8]}_", annotations).collect()]})

    def describe_table(name: str) -> str:
        def work():
            table = structured.guarded(name, domain_id)
            sample = spark.table(table).limit(5)
            return {"columns": [{"name": c, "type": t} for c, t in structured.columns_of(spark, table)], "rows": [r.asDict() for r in structured.sample_rows(sample, F.lit("")).collect()]}

        return told(work)

    def query_tables(sql: str) -> str:
        return told(lambda: {"rows": [r.asDict() for r in run_sql(spark, f"SELECT * FROM ({sql.strip().rstrip(';')}) LIMIT {rows}", seconds)]})

    return {"list_tables": list_tables, "describe_table": describe_table, "query_tables": query_tables}
