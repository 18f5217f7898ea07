"""Scores of a bigram model by deleted interpolation.

P(w | v) = a(b) c(v w) / c(v) + b(b) c(w) / N + c(b) / (V + 1), with mixture weights for each bucket b of the context's
frequency (powers of two). The weights are learned by expectation-maximisation on held-out counts, each part of the
training documents in turn: the counts of the part that a document belongs to are deleted from the counts that its
own tokens meet, so that all training tokens serve as held-out tokens. The final model has the undeleted counts.

Counts are exact over all documents (keys are 64-bit hashes of the words) and come from exchange.py: a block of
documents learns the counts of its own unigrams and bigrams, never the whole tables. What EM needs is a histogram of
(bucket, bigram estimate, unigram estimate) on fine logarithmic grids with the mean estimates of each cell; the grids
are fixed, so it is bounded whatever the corpus.

Cases: null text is empty, and empty text is the end token alone. A null key belongs to the part of the empty string's
checksum. Repeated rows count and are scored each. Without training documents N = V = 0: every token has probability
1. Texts of any length are read whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, blocks_for, keyed, mix, remainder, trimmed, used_once, word_hashes, words
from .exchange import BLOCK_CHARS, DIRECT, SENT, exchange, new_rows, send, sent_table, stacked, sums, with_block

#: The end token's place among the word hashes; no word gives it but with the odds of a hash collision.
END = U64(0x5BD1E9955BD1E995)
PARTS = 7
BUCKETS_OF_FREQUENCY = 48
P2_STEPS, P1_STEPS = 8, 4
EM_ROUNDS, PSEUDO = 200, 0.5
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Block:
    """The distinct unigrams and bigrams of a block's documents, keys ascending."""

    def __init__(self, texts):
        codes, offs, vocab = words(texts)
        n, end = len(offs) - 1, len(vocab)
        self.ends = offs[1:] + np.arange(1, n + 1)  # where each document's tokens stop, with its end token
        seq = np.insert(codes, offs[1:], end)
        prev = np.concatenate(([end], seq[:-1]))
        hashes = np.concatenate((word_hashes(vocab), [END])).astype(U64)
        scrambled = mix(hashes)
        order = np.argsort(scrambled, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.uni_keys = scrambled[order]
        self.uni = rank[seq]  # each token's unigram
        self.uni_counts = np.bincount(self.uni, minlength=len(order))
        pair = prev * (end + 1) + seq
        distinct, where, counts = np.unique(pair, return_inverse=True, return_counts=True)
        v, w = distinct // (end + 1), distinct % (end + 1)
        keys = mix(hashes[v] * U64(0x9E3779B97F4A7C15) + mix(hashes[w]))
        order2 = np.argsort(keys, kind="stable")
        rank2 = np.empty(len(order2), np.int64)
        rank2[order2] = np.arange(len(order2))
        self.bi_keys, self.bi_counts = keys[order2], counts[order2]
        self.bi = rank2[where]
        self.bi_context, self.bi_word = rank[v[order2]], rank[w[order2]]


def _answers(t: pa.Table, kind: int) -> list[np.ndarray]:
    t = t.filter(pc.equal(t.column("kind"), kind))
    rows = t.take(pc.sort_indices(t.column("bucket"))).column("values").to_pylist()
    return stacked(rows, np.int64) or [np.zeros(0, np.int64)] * 2


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS_OF_FREQUENCY - 1), 0)


def em(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights [bucket, (bigram, unigram, uniform)] from rows (bucket, n, bigram estimate, unigram estimate)."""
    weights = np.tile([0.0, 0.0, 1.0], (BUCKETS_OF_FREQUENCY, 1))
    if not len(cells):
        return weights
    seen = sorted(set(cells[:, 0].astype(int)))
    for b in seen:
        mine = cells[cells[:, 0] == b]
        n = mine[:, 1]
        p = np.column_stack((mine[:, 2], mine[:, 3], np.full(len(mine), 1.0 / (vocabulary + 1))))
        lam = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(EM_ROUNDS):
            share = p * lam
            total = share.sum(1, keepdims=True)
            got = (n[:, None] * share / np.where(total > 0, total, 1)).sum(0) + PSEUDO
            new = got / got.sum()
            done = np.abs(new - lam).max() < 1e-9
            lam = new
            if done:
                break
        weights[b] = lam
    for b in range(BUCKETS_OF_FREQUENCY):  # frequencies that no held-out token met: as the nearest that one did
        if b not in seen:
            weights[b] = weights[min(seen, key=lambda x: (abs(x - b), x))]
    weights[0] = weights[0] * [0, 1, 1] / max(weights[0][1:].sum(), 1e-300)  # an unseen context has no bigram estimate
    return weights


def score(docs: DataFrame, held: int = 2, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, direct: int = DIRECT) -> DataFrame:
    """Scores of all documents by the model of those whose checksum's remainder (modulo 7) is not `held`."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = keyed(docs, key, text).withColumn("part", remainder("doc_id", PARTS).cast("int"))
    blocks = blocks_for(rows, "t", block_chars)
    # a block's documents are all of one part, so that one part's counts answer for it
    rows = with_block(rows, max(1, -(-blocks // PARTS)), "doc_id", "th").withColumn("block", F.col("block") * PARTS + F.col("part")).drop("th")
    blocked = rows.groupBy("block")

    def count(t: pa.Table, buckets: int) -> pa.Table:
        b, part, block, out = Block(t.column("t")), t.column("part")[0].as_py(), t.column("block")[0].as_py(), new_rows()
        train = part != held
        send(out, 0, block, b.uni_keys, [b.uni_counts.astype(np.int64) * train], buckets, part)
        send(out, 1, block, b.bi_keys, [b.bi_counts.astype(np.int64) * train], buckets, part)
        return sent_table(out)

    def total(inverse: np.ndarray, n: int, values: list, part: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Of each key its count, and its count in the part that asks; noted: distinct keys, and tokens by part."""
        (counts,) = values
        whole, own, by_part = np.bincount(inverse, counts, n).astype(np.int64), np.zeros(len(inverse), np.int64), []
        for p in range(PARTS):
            mine = np.flatnonzero(part == p)
            of_part = np.bincount(inverse[mine], counts[mine], n).astype(np.int64)
            own[mine] = of_part[inverse[mine]]
            by_part.append(int(of_part.sum()))
        return [whole[inverse], own], [int((whole > 0).sum()), *by_part]

    answers = exchange(lambda buckets: blocked.applyInArrow(trimmed(lambda t: count(t, buckets)), SENT), blocks, scratch, sums, total, step=PARTS, direct=direct)
    noted = answers.where("block = -1 and kind = 0").agg(*[F.sum(F.col("note")[i]).alias(f"n{i}") for i in range(PARTS + 1)]).first()
    vocabulary, *by_part = (int(x or 0) for x in noted)
    n_train = sum(by_part)
    replies = answers.where("block >= 0").select("block", "kind", "bucket", "values").groupBy("block")

    def held_out(docs_: pa.Table, got: pa.Table) -> pa.Table:
        part = docs_.column("part")[0].as_py() if docs_.num_rows else held
        cells = np.zeros((0, 3), np.int64)
        sums_ = np.zeros((0, 3))
        if part != held:
            b = Block(docs_.column("t"))
            uni, uni_own = _answers(got, 0)
            bi, bi_own = _answers(got, 1)
            uni, bi, left = uni - uni_own, bi - bi_own, n_train - by_part[part]
            cv, cw, n = uni[b.bi_context], uni[b.bi_word], b.bi_counts
            p2 = np.where(cv > 0, bi / np.maximum(cv, 1), 0.0)
            p1 = cw / max(left, 1)
            grid = lambda p, steps: np.where(p > 0, 1 + (-np.log2(np.where(p > 0, p, 1)) * steps).astype(np.int64), 0)
            cell = frequency_bucket(cv) << 32 | grid(p2, P2_STEPS) << 16 | grid(p1, P1_STEPS)
            cell, where = np.unique(cell, return_inverse=True)
            cells = np.column_stack((cell >> 32, cell >> 16 & 0xFFFF, cell & 0xFFFF))
            sums_ = np.column_stack([np.bincount(where, x, len(cells)) for x in (n, n * p2, n * p1)])
        names = ["b", "i2", "i1"], ["n", "s2", "s1"]
        return pa.table({**{k: pa.array(cells[:, i], pa.int32()) for i, k in enumerate(names[0])}, **{k: pa.array(sums_[:, i], pa.float64()) for i, k in enumerate(names[1])}})

    grid = blocked.cogroup(replies).applyInArrow(trimmed(held_out), "b int, i2 int, i1 int, n double, s2 double, s1 double").groupBy("b", "i2", "i1").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")])
    with used_once(spark):
        cells = np.array([(r.b, r.n, r.s2 / r.n, r.s1 / r.n) for r in sorted(grid.collect())]).reshape(-1, 4)
    weights = em(cells, vocabulary)

    def final(docs_: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(docs_.column("t"))
        uni, _ = _answers(got, 0)
        bi, _ = _answers(got, 1)
        cv, cw = uni[b.bi_context], uni[b.bi_word]
        lam = weights[frequency_bucket(cv)]
        p = lam[:, 0] * bi / np.maximum(cv, 1) + lam[:, 1] * cw / max(n_train, 1) + lam[:, 2] / (vocabulary + 1)
        logs, base, known = np.log10(p)[b.bi], np.log10((uni + 1) / (n_train + vocabulary + 1))[b.uni], (uni > 0)[b.uni].astype(np.int64)
        first = np.concatenate(([0], b.ends[:-1]))
        n = docs_.num_rows
        each = lambda x: np.add.reduceat(x, first) if n else x  # noqa: E731  every document has its end token
        return pa.table(
            {
                "doc_id": docs_.column("doc_id"), "held_out": pa.array([docs_.column("part")[0].as_py() == held] * n, pa.bool_()) if n else pa.array([], pa.bool_()),
                "n_tokens": pa.array(b.ends - first), "n_known": pa.array(each(known)), "train_tokens": pa.array(np.full(n, n_train)), "base_score": pa.array(each(base)), "score": pa.array(each(logs)),
            }
        )

    return blocked.cogroup(replies).applyInArrow(trimmed(final), OUT)
