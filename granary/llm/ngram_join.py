"""Similarity join of documents on word shingles, by signature trees.

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles is at least 0.8. The join is
exact: every pair of different sets that links ends up in one component, and no pair is taken for a link untested.

1. Documents with equal sets are one class, numbered on writing; of its rows that with the smallest key stands for it.
2. Through exchange.py each class learns in how many classes each of its shingles is. Shingles of one class alone can't
   be shared, so a class with under 80 % of others has no link; the rest keep their rarest shingles (a prefix of
   n - ceil(0.8 n) + 1 in order of frequency), one of which any partner must share.
3. First the cheap links: each prefix shingle has a hub, the class with the fewest shingles of its own, and the others
   are tested against it. This joins groups of near copies in as many tests as they have members.
4. Then the signature tree, for what isn't joined yet: (shingle, class) entries in order of shingle and size are the
   leaves of a tree whose nodes hold the OR of their entries' bitmaps (of the shingles that they stand for, and of
   their whole sets), their range of sizes, the most shingles that any of them could share, and their component where
   it is one. The dual traversal of the tree with itself drops node pairs without a common shingle, of sizes too far
   apart, whose maximum possible overlap is too small, or of one component; entries that meet at the leaves are tested
   on their whole sets.

Trees are built for slices of the shingle space; a shingle with many entries is cut into chunks whose pairs are
separate trees, so no task's size follows a hot shingle. Joins on a class, a hub or a component deal the rows of one
that has many over several tasks (common.lookups).

components() needs one link for each pair of groups, so it leaves out pairs of one component; links() gives every pair
of classes that link, and their number grows with the square of a group of near copies.

Cases: null and empty texts, and texts of white space, have no shingles, link with nothing and are their own
component. Under five words, the whole sequence is the one shingle. Repeated rows are of one class. A row with a null
key takes part, but its key is not a component's smallest (a component of such rows alone has a null id). Rows that
share a key but not a text are told apart. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, blocks_for, by_chars, keyed, lookup, lookups, mix, trimmed, unpack, word_hashes, words
from .components import connected_components
from .exchange import BLOCK_CHARS, DIRECT, SENT, exchange, new_rows, send, sent_table, sums, with_block

WORDS = 5
#: A pair links when NUM * intersection >= DEN * union: 0.8.
NUM, DEN = 5, 4
#: Entries of one shingle in a tree, a leaf's entries, a node's children, and the bitmaps' 64-bit words.
CHUNK, LEAF, FAN, BITMAP, SKETCH = 2_000, 16, 8, 16, 16


def shingle_sets(texts, width: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, hashed and ascending."""
    codes, offs, vocab = words(texts)
    h = word_hashes(vocab)[codes] if len(codes) else np.zeros(0, U64)
    s = np.zeros(max(len(h) - width + 1, 0), U64)
    for i in range(width):
        s = mix(s * U64(0x9E3779B97F4A7C15) + h[i : i + len(s)])
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = np.full(1, b - a, U64)
            for i in range(a, b):
                x = mix(x * U64(0xC2B2AE3D27D4EB4F) + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    """Of the rarest shingles of a set of n, so many meet any partner's."""
    return n - -(-DEN * n // NUM) + 1


# --- signature tree ------------------------------------------------------------------------------


def sketch_of(s: np.ndarray) -> bytes:
    """A set's bitmap: a bit for each shingle, by the highest bits of its hash."""
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[(s >> U64(64 - (64 * SKETCH).bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Tree:
    """Entries in their given order; level 0 are leaves' entries, each higher level groups the one below.

    A level has, for each node: the shingles that its entries stand for (bits in their order), the OR of its entries'
    whole-set bitmaps, the least and the greatest size, the most shingles that others have too, the most shingles that
    share a bit with another of their set, and the component, -1 where there are several."""

    def __init__(self, token: np.ndarray, n: np.ndarray, m: np.ndarray, label: np.ndarray, sketch: np.ndarray):
        distinct, rank = np.unique(token, return_inverse=True)
        bit = rank * (64 * BITMAP) // max(len(distinct), 1)  # neighbours in the order share bits
        bitmap = np.zeros((len(token), BITMAP), U64)
        bitmap[np.arange(len(token)), bit // 64] = U64(1) << (bit % 64).astype(U64)
        folded = n - np.bitwise_count(sketch).sum(1, dtype=np.int64)
        self.levels = [(bitmap, sketch, n, n, m, folded, label)]
        fan = LEAF
        while len(self.levels[-1][2]) > 1:
            b, s, lo, hi, m, c, lab = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            first, last = np.minimum.reduceat(lab, at), np.maximum.reduceat(lab, at)
            one = np.where(first == last, first, -1)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.bitwise_or.reduceat(s, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(m, at), np.maximum.reduceat(c, at), one))
            fan = FAN

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, sketch, lo, hi, m, folded, label = self.levels[level]
        least = DEN * (lo[a] + lo[b])  # intersection >= 4 / 9 of the sizes' sum
        ok = (NUM * hi[a] >= DEN * lo[b]) & (NUM * hi[b] >= DEN * lo[a])
        ok &= np.minimum(m[a], m[b]) * (NUM + DEN) >= least
        ok &= (label[a] != label[b]) | (label[a] < 0)
        at = np.flatnonzero(ok)
        ok[at] = (bits[a[at]] & bits[b[at]]).any(1)
        at = np.flatnonzero(ok)
        # of the shared shingles, those without a bit of their own are at most as many as in either set
        common = np.bitwise_count(sketch[a[at]] & sketch[b[at]]).sum(1, dtype=np.int64) + np.minimum(folded[a[at]], folded[b[at]])
        ok[at] = common * (NUM + DEN) >= least[at]
        return ok

    def pairs(self, limit: int = 1 << 17):
        """Pairs of entries (a < b) that no node pair above them rules out, a bounded number at a time."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            ok = self.may_link(level, a, b)
            a, b = a[ok], b[ok]
            if not level:
                keep = a < b
                if keep.any():
                    yield a[keep], b[keep]
                continue
            fan = LEAF if level == 1 else FAN
            size = len(self.levels[level - 1][1])
            step = max(1, limit // (fan * fan))
            for i in range(0, len(a), step):
                x, y = a[i : i + step, None] * fan + np.arange(fan), b[i : i + step, None] * fan + np.arange(fan)
                x, y = np.repeat(x, fan, axis=1).reshape(-1), np.tile(y, (1, fan)).reshape(-1)
                ok = (x < size) & (y < size) & (x <= y)
                todo.append((level - 1, x[ok], y[ok]))


def candidate_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, m: np.ndarray, label: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of documents that share a token and may link. side: 0 and 1 meet each other, 2 meets its own."""
    order = np.lexsort((doc, n, token))
    token, doc, n, m, label, side, sketch = (x[order] for x in (token, doc, n, m, label, side, sketch))
    _, dense = np.unique(label, return_inverse=True)
    found = [np.zeros((0, 2), np.int64)]
    for a, b in Tree(token, n, m, dense, sketch).pairs():
        ok = (token[a] == token[b]) & (doc[a] != doc[b]) & ((side[a] != side[b]) | (side[a] == 2))
        if ok.any():
            x, y = doc[a[ok]], doc[b[ok]]
            found.append(np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y))), axis=0))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


# --- the join ------------------------------------------------------------------------------------


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) that link, by their whole sets."""
    left = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    rows = lookups(pairs.select("a", "b"), [("b", left), ("a", right)], "inner").select("a", "b", "na", "nb", "sa", "sb")

    def test(batches):
        last: tuple = (None, None)
        for t in batches:
            keep = []
            for na, nb, sa, sb in zip(*(t.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
                if last[0] != sa:
                    last = (sa, np.frombuffer(sa, "<u8"))
                x, y = last[1], np.frombuffer(sb, "<u8")
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(NUM * common >= DEN * (na + nb - common))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(test, "a long, b long")


@dataclass
class Prepared:
    """every: doc_id, th, n, h of each row. classes: h, id, doc_id, th of the row that stands for a class. sets: id, n,
    m (shingles that others have too), shingles (those), sketch, tokens (the prefix) of classes that may link."""

    scratch: Scratch
    blocks: int
    every: DataFrame
    classes: DataFrame
    sets: DataFrame

    def entries(self) -> DataFrame:
        return self.sets.select("id", "n", "m", F.explode("tokens").alias("token"))


def prepare(docs: DataFrame, key: str, text: str, width: int, block_chars: int, direct: int) -> Prepared:
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, key, text)

    def sizes(batches):
        for b in by_chars(batches, "t"):
            sets = shingle_sets(b.column("t"), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.binary())], names=["doc_id", "th", "n", "h"])

    every = scratch.save(rows.mapInArrow(sizes, "doc_id long, th long, n long, h binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")
    classes = every.where("n > 0").groupBy("h").agg(least).select("h", F.monotonically_increasing_id().alias("id"), "r.doc_id", "r.th")
    classes = scratch.save(classes)  # from here on the numbers stand
    blocks = blocks_for(rows, "t", block_chars)
    reps = with_block(classes, blocks, "doc_id", "th").select("block", "th", "id", "h")
    blocked = with_block(rows, blocks, "doc_id", "th").groupBy("block")

    def chosen(t: pa.Table, r: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        """A block's classes and their sets, in a fixed order."""
        ids = dict(zip(r.column("h").to_pylist(), r.column("id").to_pylist()))
        hashes, at = np.unique(t.column("th").to_numpy(), return_index=True)  # copies of a text have one set
        t = t.take(pa.array(np.sort(at[np.isin(hashes, r.column("th").to_numpy())])))
        sets: dict[int, np.ndarray] = {}
        for b in by_chars(t.to_batches(), "t"):
            for s in shingle_sets(b.column("t"), width):
                i = ids.get(set_hash(s))
                if i is not None:
                    sets[i] = s
        order = sorted(sets)
        return order, [sets[i] for i in order]

    def count(t: pa.Table, r: pa.Table, buckets: int) -> pa.Table:
        out = new_rows()
        if t.num_rows and r.num_rows:
            _, sets = chosen(t, r)
            keys, n = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_counts=True)
            send(out, 0, t.column("block")[0].as_py(), keys, [n.astype(np.int64)], buckets)
        return sent_table(out)

    total = lambda inverse, n, values, extra: ([sums(inverse, n, values)[0][inverse]], None)

    def send_all(buckets: int) -> DataFrame:
        f = lambda t, r: count(t, r, buckets)
        return blocked.cogroup(reps.groupBy("block")).applyInArrow(trimmed(f), SENT)

    answers = exchange(send_all, blocks, scratch, sums, total, direct=direct)

    # what a block needs: its classes and the frequencies of its shingles
    given = reps.select("block", "th", "id", "h", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("df"))
    given = given.unionByName(answers.where("block >= 0").select("block", "bucket", F.col("values")[0].alias("df")), allowMissingColumns=True)

    def prefixes(t: pa.Table, g: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("id", "n", "m", "shingles", "sketch", "tokens")}
        is_answer = pc.is_valid(g.column("df"))
        r, got = g.filter(pc.invert(is_answer)), g.filter(is_answer)
        if t.num_rows and r.num_rows:
            ids, sets = chosen(t, r)
            _, at = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_inverse=True)
            packed, order = got.column("df").to_pylist(), np.argsort(got.column("bucket").to_numpy())
            df = np.concatenate([np.zeros(0, np.int64), *(unpack(packed[i], np.int64) for i in order)])
            df, end = df[at], 0
            for i, s in zip(ids, sets):
                f, end = df[end : end + len(s)], end + len(s)
                n, m = len(s), int(np.count_nonzero(f > 1))
                if NUM * m < DEN * n:
                    continue
                first = np.lexsort((s, f))[: prefix_length(n)]
                tokens = s[first][f[first] > 1]
                if len(tokens):
                    for c, v in zip(out, (i, n, m, s[f > 1].tobytes(), sketch_of(s), tokens.view(np.int64).tolist())):
                        out[c].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), types)})

    found = blocked.cogroup(given.groupBy("block")).applyInArrow(trimmed(prefixes), "id long, n long, m long, shingles binary, sketch binary, tokens array<long>")
    sets = scratch.save(found)
    scratch.drop(answers)
    return Prepared(scratch, blocks, every, classes, sets)


def tree_pairs(p: Prepared, labelled: DataFrame, chunk: int) -> DataFrame:
    """Pairs (a < b) of classes of different labels that share a prefix shingle and may link, from the signature trees.
    labelled: a written table of entries with their labels."""
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("token", F.ceil(F.col("c") / chunk).alias("chunks"))
    left = lookup(labelled, mixed, "token", "inner").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    left = left.withColumn("other", other).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    side = F.when(F.col("lo") == F.col("hi"), 2).when(F.col("mine") == F.col("lo"), 0).otherwise(1)
    slice_ = F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(4 * p.blocks))
    left = left.select(slice_.alias("slice"), F.xxhash64("token", "lo", "hi").alias("token"), "id", "n", "m", "label", side.alias("side")).join(p.sets.select("id", "sketch"), "id")

    def tree(t: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(t.num_rows, SKETCH)
        a, b = candidate_pairs(*(t.column(c).to_numpy() for c in ("token", "id", "n", "m", "label", "side")), sketch)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("slice").applyInArrow(trimmed(tree), "a long, b long").distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, block_chars: int = BLOCK_CHARS, chunk: int = CHUNK, direct: int = DIRECT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the smallest key with an equal set), text_hash and is_first for each
    row. is_first: the row, by key and text_hash, that stands for its component, or one without shingles."""
    p = prepare(docs, key, text, width, block_chars, direct)
    scratch, entries, whole = p.scratch, p.entries(), p.sets.select("id", "n", "shingles")

    # hubs: of the classes near in size that share a token, the one with the fewest shingles of its own
    near = entries.select("id", F.xxhash64("token", F.floor(F.log(F.col("n").cast("double")) / 0.11)).alias("slot"), ((F.col("n") - F.col("m")) / F.col("n")).alias("own"))
    hubs = near.groupBy("slot").agg(F.min(F.struct("own", "id"))["id"].alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = lookup(near.drop("own"), hubs, "slot", "inner").where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    pairs = scratch.save(pairs)
    links = scratch.save(verify(pairs, whole))
    label = connected_components(links, scratch)

    # the signature trees: tokens whose entries are not of one component yet
    labelled = scratch.save(entries.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    more = scratch.save(tree_pairs(p, labelled, chunk).join(pairs, ["a", "b"], "left_anti"))
    links = scratch.save(links.union(verify(more, whole)))
    scratch.drop(label, labelled, more, pairs)
    label = connected_components(links, scratch)

    classes = scratch.save(p.classes.join(label, "id", "left").withColumn("c", F.coalesce("label", "id")).drop("label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f")
    of_class = lookup(classes, classes.groupBy("c").agg(first), "c").select("h", F.col("doc_id").alias("class_id"), "f")
    out = lookup(p.every, of_class, "h")
    scratch.drop_but(p.every, classes)
    alone = F.col("n") == 0
    component, of_set = (F.when(alone, F.col("doc_id")).otherwise(F.col(c)) for c in ("f.doc_id", "class_id"))
    is_first = alone | (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), of_set.alias("class_id"), F.col("th").alias("text_hash"), is_first.alias("is_first"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, block_chars: int = BLOCK_CHARS, chunk: int = CHUNK, direct: int = DIRECT) -> DataFrame:
    """a, b: the smallest keys of each two classes that link, a pair once (null where no row of a class has a key)."""
    p = prepare(docs, key, text, width, block_chars, direct)
    labelled = p.scratch.save(p.entries().withColumn("label", F.col("id")))
    pairs = p.scratch.save(tree_pairs(p, labelled, chunk))
    found = p.scratch.save(verify(pairs, p.sets.select("id", "n", "shingles")))
    p.scratch.drop_but(found, p.classes)
    a, b = (p.classes.select(F.col("id").alias(c), F.col("doc_id").alias(f"key_{c}")) for c in "ab")
    both = lookups(found, [("a", a), ("b", b)], "inner")
    return both.select(F.least("key_a", "key_b").alias("a"), F.when(F.col("key_a").isNotNull() & F.col("key_b").isNotNull(), F.greatest("key_a", "key_b")).alias("b"))
