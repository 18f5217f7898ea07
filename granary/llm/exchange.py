"""Global statistics of hashed keys without a row for each occurrence.

Documents are dealt to blocks of bounded size by a hash of their key and text. A block sends its distinct 64-bit keys, sorted,
with a value or two each, as packed arrays: one row for each of the equal ranges of the key space ("buckets"). A
bucket's task joins the arrays of all blocks, works out what belongs to each key, and answers each block in the
block's own key order, so that an answer needs no keys. However often a key occurs, a bucket gets it once from each
block: no key makes a task large. Both blocks and buckets grow in number, not in size, with the input.

With n blocks that is a row for each of n * n pairs of block and bucket. Beyond DIRECT blocks the keys meet in two steps
instead: blocks send to about sqrt(n) wide buckets; for each of those, a group of about sqrt(n) blocks puts its keys
together and sends them on to the fine buckets within; the answers come back the same way. Each step then has about
n * sqrt(n) rows, tasks as large as before, and the same answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, bucket_edges, pack, pack_sorted, trimmed, unpack, unpack_sorted

#: Characters in a block, about, and blocks whose keys meet in one step: 17 million rows at most.
BLOCK_CHARS, DIRECT = 8_000_000, 4_096


def with_block(df: DataFrame, n: int, *of: str) -> DataFrame:
    """df with the block that a hash of columns gives: the key and a hash of the text, so that neither null keys nor a
    key that many texts have make a block large."""
    return df.withColumn("block", F.pmod(F.xxhash64(*of), F.lit(n)).cast("int"))


def send(rows: dict, kind: int, block: int, keys: np.ndarray, values: list[np.ndarray], buckets: int, extra: int = 0, first: int = 0, last: int | None = None) -> None:
    """Append one block's ascending distinct keys, and arrays as long as they, to the columns in rows. first, last: the
    buckets that all keys are in."""
    edges = bucket_edges(keys, buckets, first, last)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]), first):
        if a < b:
            for name, v in zip(("kind", "bucket", "block", "extra", "keys", "values"), (kind, i, block, extra, pack_sorted(keys[a:b]), [pack(np.ascontiguousarray(v[a:b])) for v in values])):
                rows[name].append(v)


SENT = "kind int, bucket int, block int, extra int, keys binary, values array<binary>"


def new_rows() -> dict:
    return {"kind": [], "bucket": [], "block": [], "extra": [], "keys": [], "values": []}


def sent_table(rows: dict) -> pa.Table:
    types = {"kind": pa.int32(), "bucket": pa.int32(), "block": pa.int32(), "extra": pa.int32(), "keys": pa.binary(), "values": pa.list_(pa.binary())}
    return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})


def received(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: the distinct keys' number for each key sent, where each row's keys begin, distinct keys."""
    keys = [unpack_sorted(k) for k in t.column("keys").to_pylist()]
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    distinct, inverse = np.unique(np.concatenate(keys) if keys else np.zeros(0, U64), return_inverse=True)
    return inverse, at, distinct


def stacked(values: list[list[bytes]], dtype) -> list[np.ndarray]:
    """Rows' packed arrays, one after the other, for each place in a row."""
    return [np.concatenate([unpack(row[i], dtype) for row in values]) for i in range(len(values[0]))] if values else []


#: What comes back: arrays in the order of a block's keys in a bucket, and in rows of block -1 a bucket's notes.
ANSWER = "block int, kind int, bucket int, values array<binary>, note array<long>"


def answer_table(t: pa.Table, at: np.ndarray, arrays: list[np.ndarray], note: list[int] | None = None) -> pa.Table:
    """A row for each of t's rows, whose keys begin at `at`."""
    n, more = t.num_rows, 0 if note is None else 1
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    packed = [[pack(np.ascontiguousarray(x[a:b])) for x in arrays] for a, b in zip(at[:-1], at[1:])]
    columns = {"block": t.column("block").to_pylist() + [-1] * more, "kind": [kind] * (n + more), "bucket": [bucket] * (n + more), "values": packed + [None] * more, "note": [None] * n + [note] * more}
    types = {"block": pa.int32(), "kind": pa.int32(), "bucket": pa.int32(), "values": pa.list_(pa.binary()), "note": pa.list_(pa.int64())}
    return pa.table({c: pa.array(v, types[c]) for c, v in columns.items()})


def sums(inverse: np.ndarray, n: int, values: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(inverse, v, n).astype(np.int64) for v in values]


def alike(inverse: np.ndarray, n: int, values: list[np.ndarray], answers: list[np.ndarray]) -> list[np.ndarray]:
    """Every block gets its group's answer."""
    return [a[inverse] for a in answers]


def exchange(send_all: Callable[[int], DataFrame], blocks: int, scratch: Scratch, merge: Callable, answer: Callable, share: Callable = alike, step: int = 1, dtype=np.int64, direct: int = DIRECT) -> DataFrame:
    """The written answers to what blocks send.

    send_all(buckets): the rows that all blocks send to so many buckets. answer(inverse, n, values, extra): from the
    numbers of the distinct keys, how many they are, and for each key sent its values and its row's extra, the arrays to
    answer with and a note. In two steps also: merge(inverse, n, values): a group's values for each distinct key;
    share(inverse, n, values, answers): from the group's answers those for each key that its blocks sent. Blocks of a
    group have one number modulo step."""

    def answered(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.column("block")))
        inverse, at, distinct = received(t)
        arrays, note = answer(inverse, len(distinct), stacked(t.column("values").to_pylist(), np.int64), np.repeat(t.column("extra").to_numpy(), np.diff(at)))
        return answer_table(t, at, [a.astype(dtype) for a in arrays], note)

    if blocks <= direct:
        return scratch.save(send_all(blocks).groupBy("kind", "bucket").applyInArrow(trimmed(answered), ANSWER))

    wide = math.isqrt(blocks - 1) + 1
    fine = -(-blocks // wide)
    group = (F.floor(F.col("block") / (step * wide)) * step + F.col("block") % step).cast("int")
    sent = scratch.save(send_all(wide).withColumn("grp", group))
    key = ["kind", "bucket", "grp"]

    def relay(t: pa.Table) -> pa.Table:
        inverse, _, distinct = received(t)
        out, bucket = new_rows(), t.column("bucket")[0].as_py()
        values = merge(inverse, len(distinct), stacked(t.column("values").to_pylist(), np.int64))
        send(out, t.column("kind")[0].as_py(), t.column("grp")[0].as_py(), distinct, values, wide * fine, t.column("extra")[0].as_py(), bucket * fine, (bucket + 1) * fine)
        return sent_table(out)

    relayed = sent.groupBy(*key).applyInArrow(trimmed(relay), SENT)
    answers = scratch.save(relayed.groupBy("kind", "bucket").applyInArrow(trimmed(answered), ANSWER))
    of_group = answers.where("block >= 0").select("kind", F.floor(F.col("bucket") / fine).cast("int").alias("bucket"), F.col("block").alias("grp"), F.col("bucket").alias("at"), "values")

    def back(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows:
            return answer_table(pa.table({c: pa.array([0], pa.int32()) for c in ("block", "kind", "bucket")}), np.zeros(2, int), []).slice(0, 0)
        t = t.take(pc.sort_indices(t.column("block")))
        inverse, at, distinct = received(t)
        rows = got.take(pc.sort_indices(got.column("at"))).column("values").to_pylist()
        arrays = share(inverse, len(distinct), stacked(t.column("values").to_pylist(), np.int64), stacked(rows, dtype))
        return answer_table(t, at, [a.astype(dtype) for a in arrays])

    returned = sent.groupBy(*key).cogroup(of_group.groupBy(*key)).applyInArrow(trimmed(back), ANSWER)
    out = scratch.save(returned.unionByName(answers.where("block < 0")))
    scratch.drop(sent, answers)
    return out
