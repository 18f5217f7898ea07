"""Shared helpers of the training-data operators: scratch tables in the cluster's shared folder, tokens, packing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset on one machine, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="granary-")
    return base.rstrip("/")


@contextlib.contextmanager
def used_once(spark: SparkSession):
    """Within it, an execution's shuffle files go as soon as it ends: its frames must not be executed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    save() writes and returns a frame that reads the files; drop() deletes tables that later steps
    no longer need; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        atexit.register(self.drop)

    def path(self) -> str:
        p = f"{shared_dir(self.spark)}/granary-{uuid.uuid4().hex}"
        self.paths[p] = True
        return p

    def save(self, df: DataFrame) -> DataFrame:
        p = self.path()
        with used_once(self.spark):
            df.write.option("compression", "zstd").parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out.scratch_path = p
        return out

    def drop(self, *frames: DataFrame) -> None:
        for p in [f.scratch_path for f in frames] if frames else list(self.paths):
            self._delete(p)

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        for p in set(self.paths) - {f.scratch_path for f in frames}:
            self._delete(p)

    def _delete(self, p: str) -> None:
        if self.paths.pop(p, None):
            try:
                hp = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                hp.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hp, True)
            except Exception:  # the session may have ended before the interpreter  # noqa: BLE001
                return


class Carried:
    """A frame under positional names: none of its columns can clash with an operator's own, whatever they are called.

    Columns named in `replaced`, in any letter case, are those that the operator returns itself.
    """

    def __init__(self, df: DataFrame, *replaced: str):
        self.names, low = df.columns, {r.lower() for r in replaced}
        self.df = df.toDF(*[f"_c{i}" for i in range(len(self.names))])
        self.kept = [f"_c{i}" for i, n in enumerate(self.names) if n.lower() not in low]

    def at(self, name: str) -> str:
        """The positional name of a column: the one spelled like that, else in any letter case."""
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {', '.join(self.names)}")
        return f"_c{found[0]}"

    def with_text(self, name: str) -> tuple[DataFrame, str]:
        """The kept columns, and the name of the one with the text; a text that isn't kept comes after them."""
        at = self.at(name)
        return (self.df.select(*self.kept), at) if at in self.kept else (self.df.select(*self.kept, F.col(at).alias("_t")), "_t")

    def back(self, out: DataFrame, *new: Column | str) -> DataFrame:
        """The kept columns under their own names, and new ones."""
        return out.select(*[F.col(c).alias(self.names[int(c[2:])]) for c in self.kept], *new)


#: Rows of one key that a join leaves to one task, and keys beyond it at most: of n rows, fewer than n / most can be.
ROWS_OF_KEY, HEAVY_KEYS = 500, 10_000


def lookups(rows: DataFrame, joins: list[tuple[str, DataFrame]], how: str = "left", most: int = ROWS_OF_KEY, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with frames that have a key once: (key, frame) in turn. Rows of a key that has many are dealt over
    several tasks, each of which gets the frame's row: no key makes a task large. rows must be a written table, or made
    of one row by row: they are read twice, and their places deal them. Null keys meet nothing (how: left keeps them).
    counts: a written table of key and count, where rows needn't be counted."""
    spark = rows.sparkSession
    n = rows.count() if counts is None else counts.agg(F.sum("count")).first()[0] or 0
    most = max(most, n // HEAVY_KEYS)
    rights, place, split = [], F.monotonically_increasing_id(), False
    for i, (key, right) in enumerate(joins):
        heavy = rows.where(F.col(key).isNotNull()).groupBy(key).count() if counts is None else counts
        heavy = heavy.where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias(f"_parts{i}"))
        found = heavy.collect()  # HEAVY_KEYS at most
        parts = F.broadcast(spark.createDataFrame(found, heavy.schema)) if found else None
        rights.append((key, right, parts))
    if any(parts is not None for *_, parts in rights):
        rows, split = rows.withColumn("_place", place), True
    for i, (key, right, parts) in enumerate(rights):
        if parts is not None:
            dealt = F.when(F.col(key).isNull(), F.pmod("_place", F.lit(1 << 20))).otherwise(F.pmod("_place", F.coalesce(f"_parts{i}", F.lit(1)))).cast("int")
            rows = rows.join(parts, key, "left").withColumn(f"_part{i}", dealt).drop(f"_parts{i}")
    rows = rows.drop("_place") if split else rows
    for i, (key, right, parts) in enumerate(rights):
        if parts is None:
            rows = rows.join(right, key, how)
        else:
            each = F.explode(F.sequence(F.lit(0), F.coalesce(f"_parts{i}", F.lit(1)) - 1))
            copies = right.join(parts, key, "left").withColumn(f"_part{i}", each).drop(f"_parts{i}")
            rows = rows.join(copies, [key, f"_part{i}"], how).drop(f"_part{i}")
    return rows


def lookup(rows: DataFrame, right: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    return lookups(rows, [(key, right)], how, counts=counts)


def trim() -> None:
    """Give memory that a large group has left free back to the system: workers live on, and two share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f):
    """f, which makes one table of one group's, or of two, with trim() after it."""

    # Spark tells functions of one and of two tables apart by their parameters
    if len(inspect.signature(f).parameters) == 1:

        def g(t):
            out = f(t)
            trim()
            return out
    else:

        def g(t, u):
            out = f(t, u)
            trim()
            return out

    return g


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, t (a null text is empty) and th, its hash: what tells rows apart where keys are null or repeated."""
    c = Carried(docs)
    return c.df.select(F.col(c.at(key)).cast("long").alias("doc_id"), text_column(c.at(text)).alias("t")).withColumn("th", F.xxhash64("t"))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, by: Column, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes (all, if fewer). A threshold set from the number of rows goes first,
    so that the task that orders what is left reads about `most` rows, however many partitions there are."""
    n = df.count()
    if n > 2 * most:
        df = df.where(F.pmod(by, F.lit(1 << 40)) < int((1 << 40) * (1.2 * most + 1000) / n))
    return df.orderBy(F.pmod(by, F.lit(1 << 40)), by).limit(most)


# --- tokens --------------------------------------------------------------------------------------


def as_array(x) -> pa.Array:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def words(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, vocabulary) of the words [^\\x20\\x09-\\x0D]+ of texts with A-Z lower-cased if asked.

    Text i has codes[offsets[i]:offsets[i + 1]]; a null text has none.
    """
    arr = pc.fill_null(as_array(texts), "")
    arr = pc.ascii_lower(arr) if lower else arr  # before the cast: after it, Arrow 23 misreads slices
    lists = pc.ascii_split_whitespace(arr.cast(pa.large_string()))
    offs = lists.offsets.to_numpy().astype(np.int64)
    d = lists.flatten().dictionary_encode()
    d = as_array(d)
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offs = offs - offs[0]
    vocab = d.dictionary
    empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        seen = np.concatenate(([0], np.cumsum(keep)))
        offs, codes = seen[offs], codes[keep]
    return codes, offs, vocab


def strings(a: pa.Array) -> list[str]:
    """As to_pylist() of an array of strings, several times faster."""
    return a.to_numpy(zero_copy_only=False).tolist()


def word_hashes(vocab: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, strings(vocab)), U64, len(vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words, so that high bits are evenly spread."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


# --- packed arrays -------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Any integer array as zstd-compressed byte planes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as packed differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def bucket_edges(keys: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ascending keys: where each of n equal ranges of the 64-bit space begins and ends; of those from first to last,
    where all keys are in them."""
    bounds = np.array([(i << 64) // n for i in range(first + 1, n if last is None else last)], dtype=U64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def blocks_for(df: DataFrame, text: str, chars: int) -> int:
    """How many blocks of about so many characters hold df's texts: grows with the input, whatever the cluster."""
    total = df.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    return max(1, -(-total // chars))


def by_chars(batches, column: str, chars: int = 4_000_000):
    """The same rows in record batches of about so many characters at most, so that a task's memory stays bounded."""
    for b in batches:
        size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.utf8_length(b.column(column).cast(pa.string())), 0).to_numpy(zero_copy_only=False))))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + chars, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
