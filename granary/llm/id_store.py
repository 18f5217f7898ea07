"""A content-addressed store of token ids.

encode: texts become id streams with an end id each. A rolling hash over the last WINDOW ids cuts a stream into chunks
(MIN to MAX ids, about 2 ** MASK_BITS), so that equal passages give equal chunks wherever they stand. The store has
three Parquet tables, table=chunks, table=recipes and table=manifest, in one folder:
  chunks    digest (BLAKE2b, 16 bytes), n, ids (little-endian, 2 bytes an id, or 4 where the vocabulary needs it), refs
            (how often recipes name it): each chunk once;
  recipes   part, pos, doc_id, start, n_tokens, digests (one after the other), root: a document's chunks in order, in
            ascending doc_id order; root is the Merkle root of its digests;
  manifest  part, n_docs, n_tokens, root: the Merkle root of the part's documents' roots.
read_documents() rebuilds the ids, read_digests() start, length and CRC; both check every digest and root against the
stored bytes and fail on the first mismatch.

A text's ids are those that the tokenizers library gives. Where the tokenizer lower-cases and drops white space, nothing
joins characters across ASCII white space, and each distinct word is encoded once and then looked up; a worker remembers
a bounded number of words. Whether a tokenizer is such a one is tried out when its file is loaded; with others, texts
are encoded whole.

A chunk that very many recipes name, as that of the empty text, is joined by several tasks (common.lookup).

Cases: null text counts as empty and gives the end id alone; a null key sorts first. Repeated rows are kept: those that
are equal share a recipe, written once for each. Texts of any length are cut like others. An empty table gives an
empty store. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Carried, Scratch, by_chars, lookup, strings, text_column, trim, words

WINDOW, MASK_BITS, MIN, MAX = 16, 8, 64, 1024
DIGEST = 16
#: Words that a worker remembers at most.
MEMORY = 500_000
_workers: dict = {}


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is; no leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        up = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


#: Words that share one string when they are encoded together.
TOGETHER = 200
#: ASCII punctuation but the apostrophe begins a new piece of the pattern after these letters and digits, which no
#: normalisation joins to what follows: it may be looked up by itself.
PUNCTUATED = r"([0-9A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ſ])([!-&(-/:-@\[-`{-~])"


#: Texts that tell whether words can be encoded one by one.
PROBES = ["", " ", "a", "A b", " a  B\tc\n\nd ", "The QUICK brown-fox's tail, (3.5 kg)!", "x\r\ny\x0bz\x0c", "ÄÖ é\u0301 ß ǅ", "don't 'quote' it", "日本 語 👍 ok", "1 234 56", "a\xa0b \x85 c", "... -- !?", "tokenization of uncommonly longish words"]


class Encoder:
    """Ids of texts by a tokenizer file; one for each worker process and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends_word = None
        # words of letters that the normaliser leaves as they are need no more than their bytes and the merges
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if suffix:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()
        self.by_words = all(self._by_words(pa.array([x]), 0)[0].tolist() == [*self.tokenizer.encode(x, add_special_tokens=False).ids, 0] for x in PROBES)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _singly(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of each text, one after the other."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), self.dtype, int(sizes.sum())), sizes

    def _together(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of small letters alone, normalised: each is one piece of the tokenizer's pattern, and one of its ids
        ends a word."""
        if self.ends_word is None:
            return self._singly(found)
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        parts = [found[i : i + TOGETHER] for i in range(0, len(found), TOGETHER)]
        for part, e in zip(parts, self.lean.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:  # not such a tokenizer after all
                for out, x in zip((flat, sizes), self._singly(part)):
                    out.append(x)
        return np.concatenate(flat), np.concatenate(sizes)

    @staticmethod
    def _plain(vocab: pa.Array) -> np.ndarray:
        """Which words have small letters alone, as the normaliser leaves them."""
        out = pc.match_substring_regex(vocab, "^[a-z]+$").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~out)
        rest = rest[pc.utf8_is_alpha(vocab.take(pa.array(rest))).to_numpy(zero_copy_only=False)]
        for i, w in zip(rest.tolist(), strings(vocab.take(pa.array(rest)))):
            out[i] = w.isalpha() and w.lower() == w and unicodedata.is_normalized("NFC", w)
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts, each with its end id."""
        if self.by_words:
            return self._by_words(texts, end_id)
        flat, sizes = self._singly([x or "" for x in texts.to_pylist()])
        stops = np.cumsum(sizes)
        return np.insert(flat, stops, end_id), np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))

    def _by_words(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        # special tokens are told by their exact letters, before the tokenizer lower-cases: A-Z wait for it then
        lower = not pc.any(pc.match_substring(texts, "<|")).as_py()
        if lower:
            texts = pc.replace_substring_regex(texts, PUNCTUATED, r"\1 \2")
        codes, offs, vocab = words(texts, lower=lower)
        found, get = strings(vocab), self.known.get
        at = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
        if len(self.known) + (at < 0).sum() > MEMORY:  # keep the words that these texts met again
            old = np.flatnonzero(at >= 0)[:MEMORY]
            size, first, flat = self.size[at[old]], self.first[at[old]], self.flat
            stop = np.cumsum(size)
            self.flat = flat[np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
            self.first, self.size = stop - size, size
            self.known = {found[i]: k for k, i in enumerate(old.tolist())}
            at[:] = -1
            at[old] = np.arange(len(old))
        new = np.flatnonzero(at < 0)
        plain = self._plain(vocab.take(pa.array(new)))
        new = np.concatenate((new[plain], new[~plain]))
        fresh, n = [found[i] for i in new.tolist()], int(plain.sum())
        got = self._together(fresh[:n]), self._singly(fresh[n:]), (np.array([end_id], self.dtype), np.array([1]))
        sizes = np.concatenate([x for _, x in got])
        flat = np.concatenate((self.flat, *(x for x, _ in got)))
        first = np.concatenate((self.first, len(self.flat) + np.cumsum(sizes) - sizes))
        size = np.concatenate((self.size, sizes))
        at[new] = len(self.first) + np.arange(len(new))
        self.known.update(zip(fresh, at[new].tolist()))
        self.flat, self.first, self.size = flat[:-1], first[:-1], size[:-1]  # without the end
        n = np.diff(offs)
        at = np.append(at, len(first) - 1)
        codes = at[np.insert(codes, offs[1:], len(found)) if len(n) else codes]
        each = size[codes]
        stop = np.cumsum(each)
        ids = flat[np.repeat(first[codes] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(n + 1)))]
        return ids, ends


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def cuts(ids: np.ndarray, ends: np.ndarray, window: int = WINDOW, mask_bits: int = MASK_BITS, least: int = MIN, most: int = MAX) -> list[list[int]]:
    """For each stream ids[ends[i]:ends[i + 1]], where its chunks end."""
    # h[i] = sum over j < window of x[i - j] * 3 ** j, as one id more and one less would roll it; by prefix sums here
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h *= _powers(pow(3, -1, 1 << 64), n)
    np.cumsum(h, out=h)
    h[window:] -= h[:-window].copy() if n > window else h[:0]
    h *= _powers(3, n)
    marked = np.flatnonzero((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - mask_bits) == 0) + 1
    out, i = [], 0
    marks = marked.tolist()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        mine, last = [], a
        while i < len(marks) and marks[i] <= a:
            i += 1
        while i < len(marks) and marks[i] < b:
            m = marks[i]
            i += 1
            while m - last > most:
                last += most
                mine.append(last)
            # a window that began in another text doesn't count
            if m - last >= least and m - a >= window:
                mine.append(m)
                last = m
        while b - last > most:
            last += most
            mine.append(last)
        mine.append(b)
        out.append(mine)
    return out


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One of the tables that are written together; one without rows has no folder."""
    return spark.read.schema(f"{schema}, table string").parquet(folder).where(F.col("table") == name).drop("table")


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    spark, scratch, c = docs.sparkSession, Scratch(docs.sparkSession), Carried(docs)
    rows = c.df.select(F.col(c.at(key)).cast("long").alias("doc_id"), text_column(c.at(text)).alias("t"))

    def encode(batches):
        if tokenizer not in _workers:
            _workers[tokenizer] = Encoder(tokenizer)
        enc = _workers[tokenizer]
        for b in by_chars(batches, "t", 8_000_000):
            ids, ends = enc(b.column("t"), end_id)
            chunks: dict[bytes, tuple[int, bytes]] = {}
            refs: dict[bytes, int] = {}
            docs_, recipes, sizes = [], [], []
            for doc, a, e, stops in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), cuts(ids, ends)):
                parts, at = [], a
                for stop in stops:
                    raw = ids[at:stop].tobytes()
                    d = digest(raw)
                    chunks[d] = (stop - at, raw)
                    refs[d] = refs.get(d, 0) + 1
                    parts.append(d)
                    at = stop
                docs_.append(doc)
                recipes.append(b"".join(parts))
                sizes.append(e - a)
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * n + [True] * len(docs_)),
                    pa.array([None] * n + docs_, pa.int64()),
                    pa.array(list(chunks) + recipes, pa.binary()),
                    pa.array([x for x, _ in chunks.values()] + sizes, pa.int64()),
                    pa.array([x for _, x in chunks.values()] + [None] * len(docs_), pa.binary()),
                    pa.array([refs[d] for d in chunks] + [1] * len(docs_), pa.int64()),
                ],
                names=["is_recipe", "doc_id", "body", "n", "ids", "refs"],
            )
            del ids, chunks, recipes
            trim()

    made = rows.mapInArrow(encode, "is_recipe boolean, doc_id long, body binary, n long, ids binary, refs long")
    # one pass over the texts: a chunk is kept once, equal recipes of one id are counted
    once = made.groupBy("is_recipe", "doc_id", "body", "n").agg(F.first("ids").alias("ids"), F.sum("refs").alias("refs"))
    kind = F.when(F.col("is_recipe"), "unordered").otherwise("chunks")
    once.select("doc_id", F.col("body").alias("digest"), "n", "ids", "refs", kind.alias("table")).write.option("compression", "zstd").partitionBy("table").parquet(folder)
    recipes = _read(spark, folder, "unordered", "doc_id long, digest binary, n long, refs long").withColumnRenamed("digest", "body").select("doc_id", F.col("n").alias("n_tokens"), F.col("body").alias("digests"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("refs"))).alias("copy"))
    # ascending order: ranges of doc_id, each with its tokens counted; a range's start is the sum of those before it
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "digests", "copy").withColumn("part", F.spark_partition_id())
    ordered = scratch.save(ordered)
    totals = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets, "part int, before long")

    def finish(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=lambda i, k=t.column("doc_id").to_pylist(), d=t.column("digests").to_pylist(): (k[i] is not None, k[i] or 0, d[i]))
        t = t.take(pa.array(order, pa.int64()))
        n = t.column("n_tokens").to_numpy()
        start = t.column("before").to_numpy() + np.concatenate(([0], np.cumsum(n)[:-1]))
        roots = [merkle([d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]) for d in t.column("digests").to_pylist()]
        return pa.table({"part": t.column("part"), "pos": pa.array(range(len(order)), pa.int64()), "doc_id": t.column("doc_id"), "start": pa.array(start, pa.int64()), "n_tokens": t.column("n_tokens"), "digests": t.column("digests"), "root": pa.array(roots, pa.binary())})

    final = ordered.join(F.broadcast(offset), "part").groupBy("part").applyInArrow(finish, "part int, pos long, doc_id long, start long, n_tokens long, digests binary, root binary")
    final.write.option("compression", "zstd").parquet(f"{folder}/table=recipes")
    scratch.paths[f"{folder}/table=unordered"] = True
    scratch.drop()

    manifest(spark, folder).write.parquet(f"{folder}/table=manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Of the recipes as they are on disk."""

    def root(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("pos").to_numpy(), kind="stable")
        roots = t.column("root").to_pylist()
        return pa.table({"part": t.column("part")[:1], "n_docs": [t.num_rows], "n_tokens": [int(t.column("n_tokens").to_numpy().sum())], "root": pa.array([merkle([roots[i] for i in order])], pa.binary())})

    return spark.read.parquet(f"{folder}/table=recipes").select("part", "pos", "n_tokens", "root").groupBy("part").applyInArrow(root, "part int, n_docs long, n_tokens long, root binary")


def verify_manifest(spark: SparkSession, folder: str) -> None:
    stored, now = (sorted(map(tuple, x.collect())) for x in (spark.read.parquet(f"{folder}/table=manifest"), manifest(spark, folder)))
    if stored != now:
        raise ValueError(f"the manifest of {folder} doesn't fit its recipes")


# --- CRC-32 of joined pieces from the pieces' own ------------------------------------------------


def gf2_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), reduced by the CRC-32 polynomial; bit 31 is x ** 0."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    for i in range(32):
        out ^= np.where((b >> np.uint64(31 - i)) & np.uint64(1), a, np.uint64(0))
        a = np.where(a & np.uint64(1), (a >> np.uint64(1)) ^ np.uint64(0xEDB88320), a >> np.uint64(1))
    return out


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs as so many zero bytes after them would make them."""
    power = np.array([0x80000000 >> 8], np.uint64)  # x ** 8
    out, left = crc.astype(np.uint64), zeros.astype(np.int64)
    while left.any():
        odd = (left & 1) == 1
        if odd.any():
            out[odd] = gf2_times(out[odd], np.broadcast_to(power, odd.sum()))
        power, left = gf2_times(power, power), left >> 1
    return out


ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}


def _pieces(spark: SparkSession, folder: str, value: str, kind: str, make) -> DataFrame:
    """doc_id, part, pos, start, n_tokens, pieces [(seq, n, value)]: value made from each chunk's stored bytes."""

    def check(batches):
        for b in batches:
            n, raw, d = b.column("n").to_pylist(), b.column("ids").to_pylist(), b.column("digest").to_pylist()
            for x, y in zip(raw, d):
                if digest(x) != y:
                    raise ValueError(f"chunk {y.hex()} of {folder} is damaged")
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array([make(x, k) for x, k in zip(raw, n)], ARROW[kind])], names=["digest", "n", value])

    def intact(batches):
        for b in batches:
            for doc, ds, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digests", "root"))):
                if merkle([ds[i : i + DIGEST] for i in range(0, len(ds), DIGEST)]) != root:
                    raise ValueError(f"the recipe of document {doc} in {folder} is damaged")
            yield b

    stored = _read(spark, folder, "chunks", "digest binary, n long, ids binary, refs long")
    chunks = stored.select("digest", "n", "ids").mapInArrow(check, f"digest binary, n long, {value} {kind}")
    recipes = spark.read.parquet(f"{folder}/table=recipes").select("part", "pos", "doc_id", "start", "n_tokens", "digests", "root")
    each = F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1), lambda i: F.substring("digests", i * DIGEST + 1, F.lit(DIGEST)))
    rows = recipes.mapInArrow(intact, recipes.schema).select("part", "pos", "doc_id", "start", "n_tokens", F.posexplode(each).alias("seq", "digest"))
    # left: a chunk that is missing shows as a null
    joined = lookup(rows, chunks, "digest", counts=stored.select("digest", F.col("refs").alias("count")))
    return joined.groupBy("part", "pos", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("seq", "n", value))).alias("pieces"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""
    verify_manifest(spark, folder)

    def crc(raw: bytes, n: int) -> int:
        return zlib.crc32(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes())

    def combine(batches):
        for b in batches:
            lists = b.column("pieces")
            offs, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            offs = offs - offs[0]
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.add.reduceat(n, offs[:-1]) if len(n) else np.zeros(0, np.int64)
            if (total != b.column("n_tokens").to_numpy()).any() or flat.field("crc").null_count:
                raise ValueError(f"chunks of {folder} are missing")
            run = np.cumsum(n)
            after = np.repeat(run[offs[1:] - 1], np.diff(offs)) - run
            shifted = crc_shift(flat.field("crc").to_numpy(zero_copy_only=False), 4 * after)
            whole = np.bitwise_xor.reduceat(shifted, offs[:-1]) if len(n) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(whole.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = _pieces(spark, folder, "crc", "long", crc).select("doc_id", "start", "n_tokens", "pieces")
    return found.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids, rebuilt from the files."""
    verify_manifest(spark, folder)

    def ids(raw: bytes, n: int) -> list[int]:
        return np.frombuffer(raw, f"<u{len(raw) // n}").tolist()

    found = _pieces(spark, folder, "ids", "array<int>", ids)
    return found.select("doc_id", "start", "n_tokens", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"))
