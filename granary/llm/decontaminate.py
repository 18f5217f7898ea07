"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to k = floor(rate * m) edits. Cut into k + 1 pieces, one piece at least
is met unchanged, so an Aho-Corasick automaton of all pieces finds every candidate place; Myers' bit-parallel
algorithm then gives the least edit distance between the item and any substring of the window around it. Both sides
are compared lower-cased, with runs of white space as one space.

The items are the small side: they go to the tasks with the code, in groups of at most MAX_ITEM_CHARS characters; a
larger benchmark is matched group by group. Texts are read whole, and only once for each group.

Cases: null or empty texts have no hits, null or empty items match nothing. An item shorter than min_chars once
normalised is met only unchanged and as whole words: such a short run of letters is part of ordinary words. An item
with a null id is reported with that. Equal items with different ids are all reported. Repeated rows get the same hits.
Extra columns are carried along by with_hits(); a column named hits, in any letter case, is replaced.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, by_chars

RATE, MIN_CHARS, MAX_ITEM_CHARS = 0.08, 16, 4_000_000

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())])


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches of a text of m characters, as even as can be."""
    return [(m * i // (k + 1), m * (i + 1) // (k + 1)) for i in range(k + 1)]


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(least distance, end of its first occurrence) of a pattern in text, if it is at most `most`."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
            if not best:
                break
        ph = (ph << 1) & full  # a match may begin anywhere in the text
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return (best, end) if best <= most else None


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items, where = [], {}
        for item_id, raw in items:
            t = normalise(raw)
            if not t:
                continue
            short = len(t) < min_chars
            k = 0 if short else int(rate * len(t))
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            for a, b in pieces(len(t), k):
                where.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((item_id, len(t), k, masks, short))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def hits(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text), the least for each item met."""
        t = normalise(raw)
        if not self.items or not t:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(t):
            for item, offset in at:
                starts.setdefault(item, set()).add(end + 1 - size - offset)
        out = []
        for item, found in starts.items():
            item_id, m, k, masks, short = self.items[item]
            if short:
                alone = [s + m for s in found if not (s and t[s - 1].isalnum() and t[s].isalnum()) and not (t[s + m : s + m + 1].isalnum() and t[s + m - 1].isalnum())]
                if alone:
                    out.append((item_id, 0, min(alone)))
                continue
            best = None
            spans: list[list[int]] = []
            for s in sorted(found):  # starts close together share a window
                if spans and s - spans[-1][1] <= m:
                    spans[-1][1] = s
                else:
                    spans.append([s, s])
            for a, b in spans:
                lo = max(0, a - k)
                got = myers(masks, m, t[lo : b + m + k], k if best is None else best[0] - 1)
                if got:
                    best = (got[0], lo + got[1])
                    if not best[0]:
                        break
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda h: (h[0] is None, h[0] or 0, *h[1:]))


_workers: dict[bytes, Matcher] = {}


def matcher(packed: bytes, rate: float, min_chars: int) -> Matcher:
    """One for each worker and group of items; the last group's only, so that a worker's memory stays bounded."""
    key = hashlib.blake2b(packed + repr((rate, min_chars)).encode()).digest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = Matcher(pickle.loads(packed), rate, min_chars)
    return _workers[key]


def item_groups(items: DataFrame, key: str, text: str, most: int):
    """The items, in groups that fit the driver and the tasks."""
    c = Carried(items)
    rows = c.df.select(F.col(c.at(key)).cast("long").alias("k"), F.col(c.at(text)).cast("string").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield [(r.k, r.t) for r in part.orderBy("k", "t").collect()]


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, most: int = MAX_ITEM_CHARS) -> DataFrame:
    """docs with hits: an array of (item_id, distance, end), one for each item that the text holds."""
    c = Carried(docs, "hits")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
    rows, text = c.with_text(text)
    rows = rows.withColumn("hits", F.array().cast(T.ArrayType(HIT)))
    for group in item_groups(items, item_key, item_text, most):

        def match(batches, packed=pickle.dumps(group)):
            found_by = matcher(packed, rate, min_chars)
            for b in by_chars(batches, text):
                found = [[dict(zip(("item_id", "distance", "end"), h)) for h in found_by.hits(x)] for x in b.column(text).cast(pa.string()).to_pylist()]
                found = [x + y for x, y in zip(b.column("hits").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=b.schema.names)

        rows = rows.mapInArrow(match, rows.schema)
    return c.back(rows, "hits")
