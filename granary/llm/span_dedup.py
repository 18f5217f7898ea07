"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, which end with ".", "!", "?" or a line break. From every sentence a span runs over the
least number of consecutive ones that is at least MIN_UNITS and has at least MIN_WORDS words; spans are hashed with
letter case and white space evened out. All spans of all documents meet (through exchange.py); the first
place of a repeated span, by document key and position, stays, and the sentences that any other place covers are removed.

Where sentences are long or a repeat begins and ends inside them, it may hold no such span. So runs of GRAM words meet
as well, whatever their sentences: of every WINDOW consecutive ones that with the least hash, unless a span lies inside it.
Any repeat of GRAM + WINDOW - 1 = 50 words thus holds a run or a span that all its copies choose; of a longer one fewer
than 50 consecutive words stay. Of a sentence that a run covers in part the other words stay; n_removed counts it.

Cases: null or empty texts, and texts with fewer words than a span, keep their text (null becomes empty) and remove
nothing. A document that only repeats others ends up empty, and stays as a row. A null key comes after all others.
Rows with one key are taken in a fixed order of their texts (by hash, then by letters); of equal rows one keeps its
text. Long texts are read whole. dedup() returns key, text and counts only, so other columns can't clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import U64, Scratch, blocks_for, keyed, mix, trimmed
from .exchange import BLOCK_CHARS, DIRECT, SENT, exchange, new_rows, send, sent_table, stacked, with_block

MIN_UNITS, MIN_WORDS = 3, 20
GRAM, WINDOW = 26, 25
UNIT = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|\Z)")
WORD, SPACE = re.compile(r"\S+"), re.compile(r"\s*")
BASE = 0x9E3779B97F4A7C15
LAST = np.iinfo(np.int64).max
OUT = "doc_id long, text string, n_units long, n_removed long, removed_words long"


def units(text: str, words: list[str] | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where units end, their hashes and their words; units without words join the one before. The words are appended
    to a list that is given."""
    ends, hashes, sizes = [], [], []
    h = xxhash.xxh3_64_intdigest
    for m in UNIT.finditer(text):
        w = m[0].lower().split()
        if w and (len(w) > 1 or any(c.isalnum() for c in w[0])):
            ends.append(m.end())
            hashes.append(h(" ".join(w)))
            sizes.append(len(w))
            if words is not None:
                words += w
        elif ends:
            ends[-1] = m.end()
    return ends, np.array(hashes, U64), np.array(sizes, np.int64)


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of units() begin and end."""
    out = []
    for m in UNIT.finditer(text):
        w = [x.span() for x in WORD.finditer(text, m.start(), m.end())]
        if w and (len(w) > 1 or any(c.isalnum() for c in text[slice(*w[0])].lower())):
            out += w
    return out


def spans(hashes: np.ndarray, sizes: np.ndarray, powers: np.ndarray, min_units: int = MIN_UNITS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): for each unit that a span starts at, the span's hash and the unit after its last."""
    n = len(hashes)
    run = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.maximum(np.searchsorted(run, run[:-1] + min_words), np.arange(n) + min_units)
    starts = np.flatnonzero(ends <= n)
    ends = ends[starts]
    # sum of h[i] * BASE ** i, whose differences are put on one scale by the inverse powers
    prefix = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * powers[0, :n], dtype=U64)))
    body = (prefix[ends] - prefix[starts]) * powers[1, starts]
    return mix(body + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F)), ends


def sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) of every n consecutive elements."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = f(x[:-step], x[step:])
        size += step
    return x


def grams(words: list[str], sizes: np.ndarray, stops: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): the chosen runs of GRAM words in which no span lies. stops: spans()' ends. Only unit ends between
    two words of a run are looked at, so that copies choose alike whatever stands around them."""
    n = len(words)
    m = n - GRAM + 1
    none = np.zeros(0, U64), np.zeros(0, np.int64)
    if m < WINDOW:
        return none
    run = np.concatenate(([0], np.cumsum(sizes)))
    stop = np.concatenate((run[stops], np.full(len(run) - len(stops), n + GRAM)))
    at = np.arange(m)
    free = stop[np.searchsorted(run, at, "right")] >= at + GRAM
    if not free.any():
        return none
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
    prefix = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * powers[0, :n], dtype=U64)))
    keys = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers[1, :m] + U64(0xD6E8FEB86659FD93))
    least = np.pad(sliding(np.minimum, keys, WINDOW), WINDOW - 1)
    starts = np.flatnonzero((sliding(np.maximum, least, WINDOW) == keys) & free)
    return keys[starts], starts


def power_table(n: int) -> np.ndarray:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    out = np.ones((2, n + 1), U64)
    for row, base in zip(out, (BASE, pow(BASE, -1, 1 << 64))):
        row[1:] = np.cumprod(np.full(n, base, U64), dtype=U64)
    return out


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places the ranges cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change[:-1]) > 0


def without(text: str, ends: list[int], sizes: np.ndarray, gone: np.ndarray, runs: np.ndarray) -> tuple[str, np.ndarray, int]:
    """The text without the units that are gone and the runs of words, the units that lost any, and how many words."""
    at, places = np.array([0, *ends]), word_places(text)
    run = np.concatenate(([0], np.cumsum(sizes)))
    first = [places[r][0] for r in runs.tolist()]
    stop = [SPACE.match(text, places[r + GRAM - 1][1]).end() for r in runs.tolist()]
    units_gone = np.flatnonzero(gone)
    chars = covered(len(text), np.concatenate((at[units_gone], first)).astype(np.int64), np.concatenate((at[units_gone + 1], stop)).astype(np.int64))
    words = covered(len(places), np.concatenate((run[units_gone], runs)), np.concatenate((run[units_gone + 1], runs + GRAM)))
    edges = np.flatnonzero(np.diff(chars, prepend=True, append=True)).tolist()
    kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, np.add.reduceat(words, run[:-1], dtype=np.int64) > 0, words.sum()


class Block:
    """The spans of a block's documents, documents in order of key and text."""

    def __init__(self, t: pa.Table, min_units: int, min_words: int):
        keys, texts = t.column("doc_id").to_pylist(), t.column("t").to_pylist()
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, texts[i]))
        self.docs = [keys[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.units, self.span_ends, self.gram_starts, each = [], [], [], []
        powers = power_table(1024)
        for x in self.texts:
            words: list[str] = []
            u = units(x, words)
            if len(words) >= powers.shape[1]:
                powers = power_table(2 * len(words))
            k, ends = spans(u[1], u[2], powers, min_units, min_words)
            g, starts = grams(words, u[2], ends, powers)
            self.units.append(u)
            self.span_ends.append(ends)
            self.gram_starts.append(starts)
            each.append((k, g))
        # spans start at units 0, 1, 2, ... of each document; runs of words come after them
        self.first = np.concatenate(([0], np.cumsum([len(k) + len(g) for k, g in each]))).astype(np.int64)
        flat = np.concatenate([k for both in each for k in both]) if each else np.zeros(0, U64)
        self.keys, self.at, self.inverse = np.unique(flat, return_index=True, return_inverse=True)
        owner = np.searchsorted(self.first, self.at, "right") - 1
        self.owner_key = np.array([LAST if d is None else d for d in self.docs], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)


def least(inverse: np.ndarray, n: int, values: list[np.ndarray]) -> list[np.ndarray]:
    """For each distinct key the smallest document key."""
    out = np.full(n, LAST)
    np.minimum.at(out, inverse, values[0])
    return [out]


def owners(inverse: np.ndarray, n: int, values: list[np.ndarray], _extra=None) -> tuple[list[np.ndarray], None]:
    """Which of the places sent is the first to have its key's smallest document key."""
    ours = np.flatnonzero(values[0] == least(inverse, n, values)[0][inverse])
    winner = np.full(n, -1)
    winner[inverse[ours][::-1]] = ours[::-1]  # the first of them
    return [winner[inverse] == np.arange(len(inverse))], None


def owners_of_group(inverse: np.ndarray, n: int, values: list[np.ndarray], answers: list[np.ndarray]) -> list[np.ndarray]:
    return [owners(inverse, n, values)[0][0] & answers[0][inverse].astype(bool)]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_units: int = MIN_UNITS, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, direct: int = DIRECT) -> DataFrame:
    scratch, rows = Scratch(docs.sparkSession), keyed(docs, key, text)
    blocks = blocks_for(rows, "t", block_chars)
    blocked = with_block(rows, blocks, "doc_id", "th").drop("th").groupBy("block")

    def first_places(t: pa.Table, buckets: int) -> pa.Table:
        b, out = Block(t, min_units, min_words), new_rows()
        send(out, 0, t.column("block")[0].as_py(), b.keys, [b.owner_key], buckets)
        return sent_table(out)

    # rows come in the order of their blocks, so that a key at the end of all others has one owner too
    send_all = lambda buckets: blocked.applyInArrow(trimmed(lambda t: first_places(t, buckets)), SENT)
    answers = exchange(send_all, blocks, scratch, least, owners, owners_of_group, dtype=np.uint8, direct=direct)

    def remove(t: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
        if t.num_rows:
            b = Block(t, min_units, min_words)
            rows_ = got.take(pc.sort_indices(got.column("bucket"))).column("values").to_pylist()
            mine = stacked(rows_, np.uint8)[0].astype(bool) if rows_ else np.zeros(0, bool)
            kept = np.zeros(len(b.inverse), bool)  # the places that stay
            kept[b.at[mine]] = True
            for i, (doc, x, (ends, _, sizes), stops, starts) in enumerate(zip(b.docs, b.texts, b.units, b.span_ends, b.gram_starts)):
                again = np.flatnonzero(~kept[b.first[i] : b.first[i + 1]])
                again, runs = again[again < len(stops)], starts[again[again >= len(stops)] - len(stops)]
                gone = covered(len(ends), again, stops[again])
                n_words = sizes[gone].sum()
                if len(runs):
                    x, gone, n_words = without(x, ends, sizes, gone, runs)
                elif gone.any():
                    at = [0, *ends]
                    x = "".join(x[at[j] : at[j + 1]] for j in np.flatnonzero(~gone).tolist())
                for c, v in zip(out, (doc, x, len(ends), int(gone.sum()), int(n_words))):
                    out[c].append(v)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), types)})

    return blocked.cogroup(answers.where("block >= 0").select("block", "bucket", "values").groupBy("block")).applyInArrow(trimmed(remove), OUT)
