"""The knowledge table: hashing, deduplication, scoped nearest and keyword search, merging of metadata, deletes.

Rows: id, user_id, domain_id, filename, content, content_hash, embedding, metadata (a map). Reads and writes are scoped
by user: an empty user is refused. Upserts are one batched write of the newest row for each key.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

SCOPE = ("user_id", "domain_id", "filename")
EXCERPT = 400
#: Rows of queries that a batch search may broadcast; more are joined block by block.
QUERY_ROWS = 4_096


def content_hash(domain: Column, content: Column) -> Column:
    return F.md5(F.concat(F.coalesce(domain, F.lit("")), F.lit(":"), F.coalesce(content, F.lit(""))))


def with_ids(chunks: DataFrame) -> DataFrame:
    """content_hash, and an id of the hash and the scope where there is none."""
    h = content_hash(F.col("domain_id"), F.col("content"))
    made = F.concat(F.lit("kc_"), F.substring(F.sha2(F.concat_ws("/", "user_id", "domain_id", h), 256), 1, 16))
    return chunks.withColumn("content_hash", h).withColumn("id", F.coalesce(F.col("id"), made) if "id" in chunks.columns else made)


def dedupe(chunks: DataFrame, order: Column | None = None) -> DataFrame:
    """One row of each content in a user's domain: the last in order, or any. Spark combines before it shuffles."""
    keys = ["user_id", "domain_id", "content_hash"]
    rest = [c for c in chunks.columns if c not in keys]
    row = F.struct(*rest)
    best = F.max_by(row, order) if order is not None else F.first(row)
    return chunks.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*chunks.columns)


def merge_metadata(caller: Column, reader: Column) -> Column:
    """The reader's values win, but for the scope, which is the caller's where it has one."""
    scope = F.map_filter(caller, lambda k, v: k.isin(*SCOPE))
    mine = F.map_filter(caller, lambda k, v: ~F.map_contains_key(reader, k) | k.isin(*SCOPE))
    theirs = F.map_filter(reader, lambda k, v: ~F.map_contains_key(scope, k))
    return F.map_concat(mine, theirs)


def upsert(table: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """table with new rows in place of those with their key; of new rows with one key, the last in order."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("__r")).select("__r.*")
    return table.join(new.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def delete(table: DataFrame, **where: str) -> DataFrame:
    """table less the rows that fit all of where (id, domain_id, filename, user_id)."""
    hit = F.lit(True)
    for c, v in where.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return table.where(~hit)


# --- nearness ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearness(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine, inner product, or the negative of the distance."""
    if metric == "cosine":
        return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    if metric == "inner":
        return dot(a, b)
    if metric == "l2":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric}")


def search(table: DataFrame, vector: list[float], user_id: str, domain_id: str = "", top_k: int = 5, metric: str = "cosine") -> DataFrame:
    """The top_k nearest rows of a user, in one domain if one is named. The scope is filtered at the scan."""
    if not user_id:
        raise ValueError("a search needs a user_id")
    rows = table.where(F.col("user_id") == user_id)
    rows = rows.where(F.col("domain_id") == domain_id) if domain_id else rows
    q = F.array(*[F.lit(float(x)) for x in vector])
    return rows.withColumn("score", F.coalesce(nearness(metric, F.col("embedding"), q), F.lit(0.0))).orderBy(F.desc("score"), "id").limit(top_k)


def search_batch(table: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, score for queries (query_id, user_id, domain_id, vector): each against its own scope.

    The join is on the scope; up to QUERY_ROWS queries are broadcast, so that the table isn't shuffled."""
    n = queries.limit(QUERY_ROWS + 1).count()
    q = F.broadcast(queries) if n <= QUERY_ROWS else queries
    hit = table.join(q, ["user_id", "domain_id"]).withColumn("score", F.coalesce(nearness(metric, F.col("embedding"), F.col("vector")), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def search_json(hits: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row: {"chunks": [{id, domain_id, excerpt, score, filename, ...}]} of a search's result, nearest first."""
    cols = [F.col("id"), F.col("domain_id"), F.substring("content", 1, EXCERPT).alias("excerpt"), F.col("score"), F.col("filename"), *[F.col(c) for c in extra]]
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("id").alias("i"), F.struct(*cols).alias("c")))), lambda x: x["c"])
    return hits.agg(F.to_json(F.struct(each.alias("chunks"))).alias("json"))


def keyword_search(table: DataFrame, query: Column, user_id: str | None = None) -> DataFrame:
    """Rows that hold the query in any letter case."""
    rows = table if user_id is None else table.where(F.col("user_id") == user_id)
    return rows.where(F.contains(F.lower("content"), F.lower(query)))


class SearchableStore(Protocol):
    """What retrieval needs of a store."""

    def search(self, vector: list[float], user_id: str, domain_id: str = "", top_k: int = 5) -> DataFrame: ...


class MemoryStore(SearchableStore, Protocol):
    """What ingestion needs of one."""

    def upsert(self, chunks: DataFrame) -> None: ...

    def delete(self, **where: str) -> None: ...


#: Buckets that a store's users are dealt to, how often a write starts over, and seconds to wait for another's version.
BUCKETS, TRIES, PATIENCE = 64, 5, 2.0


class KnowledgeStore:
    """A knowledge table in a folder. Users are dealt to buckets; a bucket's rows stand in one segment, a folder of
    Parquet files. A version is a small file that names each bucket's segment.

    A write makes a segment for the buckets that it touches and no others, then the version with the next number. That
    file can be created once: of two writers the later one starts over from the other's version. What a failed write
    leaves is named by no version, and vacuum() deletes it. Readers of the version before the newest go on."""

    SCHEMA = "id string, user_id string, domain_id string, filename string, content string, content_hash string, embedding array<float>, metadata map<string,string>, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._empty = spark.createDataFrame([], self.SCHEMA)
        self.columns = self._empty.columns

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def _version(self, number: int) -> dict[int, str] | None:
        """Segments by bucket; None if the file isn't whole."""
        fs, path = self._fs()
        try:
            stream = fs.open(path(f"{self.path}/versions/{number}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return {int(b): s for b, s in json.loads(text).items()}
        except Exception:  # half written, or deleted meanwhile  # noqa: BLE001
            return None

    def _newest(self) -> tuple[int, dict[int, str]]:
        """The next version's number, and the segments of the newest whole one."""
        numbers, began = self._numbers(), time.time()
        while numbers and self._version(numbers[-1]) is None and time.time() - began < PATIENCE:
            time.sleep(PATIENCE / 10)  # another writer is at it
        for n in reversed(numbers):
            segments = self._version(n)
            if segments is not None:
                return numbers[-1] + 1, segments
        return (numbers[-1] + 1 if numbers else 0), {}

    @staticmethod
    def bucket(user_id: str) -> int:
        return zlib.crc32(user_id.encode()) % BUCKETS

    def _read(self, segments: dict[int, str]) -> DataFrame:
        if not segments:
            return self._empty
        paths = [f"{self.path}/segments/{s}/bucket={b}" for b, s in sorted(segments.items())]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def read(self, user_id: str | None = None) -> DataFrame:
        """All rows, or a user's: then from their bucket alone."""
        segments = self._newest()[1]
        if user_id is None:
            return self._read(segments)
        return self._read({b: s for b, s in segments.items() if b == self.bucket(user_id)}).where(F.col("user_id") == user_id)

    def _replace(self, touched: list[int], change) -> None:
        """New segments for buckets: change makes their rows of the rows before."""
        for _ in range(TRIES):
            number, segments = self._newest()
            name = f"{number:08d}-{uuid.uuid4().hex}"
            rows = change(self._read({b: s for b, s in segments.items() if b in touched}))
            bucket = F.pmod(F.crc32(F.col("user_id").cast("binary")), F.lit(BUCKETS)).cast("int")
            # a hot user's rows are cut into several tasks
            rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/segments/{name}")
            made = {int(n.split("=")[1]) for n in self._names(f"segments/{name}") if n.startswith("bucket=")}
            new = {b: s for b, s in segments.items() if b not in touched} | dict.fromkeys(made, name)
            if self._commit(number, new):
                return
            work.remove(self.spark, f"{self.path}/segments/{name}")
        raise RuntimeError(f"others write to {self.path} all the time")

    def _commit(self, number: int, segments: dict[int, str]) -> bool:
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.path}/versions/{number}.json"), False)
        except Exception:  # another writer has this number  # noqa: BLE001
            return False
        try:
            out.write(bytearray(json.dumps(segments).encode()))
        finally:
            out.close()
        old = [n for n in self._numbers() if n < number - 1]
        live = set(segments.values()) | set((self._version(number - 1) or {}).values())
        for n in old:
            for s in set((self._version(n) or {}).values()) - live:
                work.remove(self.spark, f"{self.path}/segments/{s}")
            fs.delete(path(f"{self.path}/versions/{n}.json"), False)
        return True

    def vacuum(self) -> None:
        """Delete segments that no version names: what failed writes left. Not while another writes."""
        live = {s for n in self._numbers() for s in (self._version(n) or {}).values()}
        for s in set(self._names("segments")) - live:
            work.remove(self.spark, f"{self.path}/segments/{s}")

    def upsert(self, chunks: DataFrame, staged: bool = False) -> None:
        """staged: chunks are a table of files already, so they needn't be written to be worked out once."""
        staging = None
        if not staged:
            staging = work.work_dir(self.spark, "upsert")
            chunks = work.written(chunks, staging)
        try:
            if chunks.where("user_id is null or user_id = ''").limit(1).count():
                raise ValueError("every chunk needs a user_id")
            new = dedupe(with_ids(chunks), F.col("seq")).select(*self.columns)
            bucket = F.pmod(F.crc32(F.col("user_id").cast("binary")), F.lit(BUCKETS)).cast("int")
            touched = [r[0] for r in chunks.select(bucket).distinct().collect()]
            if touched:
                self._replace(touched, lambda before: upsert(before, new))
        finally:
            if staging:
                work.remove(self.spark, staging)

    def delete(self, **where: str) -> None:
        segments = self._newest()[1]
        if "user_id" in where:
            segments = {b: s for b, s in segments.items() if b == self.bucket(where["user_id"] or "")}
        hit = F.lit(True)
        for c, v in where.items():
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        bucket = F.pmod(F.crc32(F.col("user_id").cast("binary")), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in self._read(segments).where(hit).select(bucket).distinct().collect()]
        if touched:
            self._replace(touched, lambda before: delete(before, **where))

    def search(self, vector: list[float], user_id: str, domain_id: str = "", top_k: int = 5) -> DataFrame:
        if not user_id:
            raise ValueError("a search needs a user_id")
        return search(self.read(user_id), vector, user_id, domain_id, top_k)
