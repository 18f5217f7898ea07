import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, id_store, language_model, ngram_join, span_dedup
from granary.llm import common as cm

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, block int, score double"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, 0.5) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    make = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", ". "]) for _ in range(k))
    rows = [(i, make(rng.choice([1, 3, 8, 30, 120]))) for i in range(n)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(9)]  # exact copies
    base = make(150).split(" ")
    for i in range(25):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "One"), (3004, "ONE"), (None, rows[0][1]), (None, None)]
    rows += [rows[3], rows[3]]
    return rows


# --- helpers -------------------------------------------------------------------------------------


def test_words_of_slices():
    texts = ["  A b\tC\x0b\x0c\r\n d\x1c e \xa0f ÄB\x85x", None, "", "   ", "one", "é É"] * 50
    for a, n in ((0, 300), (7, 100), (299, 1)):
        part = pa.array(texts, pa.string()).slice(a, n)
        codes, offs, vocab = cm.words(part)
        v = vocab.to_pylist()
        assert [[v[c] for c in codes[offs[i] : offs[i + 1]]] for i in range(n)] == [tokens(x) for x in texts[a : a + n]]


def test_packing():
    for n in (0, 1, 1000):
        keys = np.unique(cm.mix(np.arange(n, dtype=np.uint64)))
        assert (cm.unpack_sorted(cm.pack_sorted(keys)) == keys).all()
        assert cm.bucket_edges(keys, 7)[-1] == n
        wide, fine = cm.bucket_edges(keys, 3), cm.bucket_edges(keys, 12)
        assert (wide == fine[::4]).all()
        assert all((cm.bucket_edges(keys[wide[i] : wide[i + 1]], 12, 4 * i, 4 * i + 4) + wide[i] == fine[4 * i : 4 * i + 5]).all() for i in range(3))


def test_by_chars():
    b = pa.record_batch({"t": pa.array(["x" * 10, None, "y" * 50, "z", ""])})
    parts = list(cm.by_chars([b], "t", 20))
    assert [p.column("t").to_pylist() for p in parts] == [["x" * 10, None], ["y" * 50], ["z", ""]]


def test_bounded_sample(spark):
    df = spark.range(5000)
    got = {r.id for r in cm.bounded_sample(df, F.xxhash64("id"), 100).collect()}
    assert len(got) == 100 == len(got & {r.id for r in cm.bounded_sample(df.repartition(7), F.xxhash64("id"), 100).collect()})
    assert cm.bounded_sample(spark.range(3), F.xxhash64("id"), 100).count() == 3


# --- language model ------------------------------------------------------------------------------


def test_language_model_counts(spark):
    rows = corpus()
    got = language_model.score(frame(spark, rows), block_chars=900).collect()
    assert len(got) == len(rows)
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = collections.Counter(w for i, t in rows if part(i) != 2 for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t in rows:
        w = [*tokens(t), None]
        want[i].append((part(i) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    have = collections.defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert r.score < 0
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}


def brute_model(rows, held=2):
    """Scores by the formula of the module, with plain dictionaries."""
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    texts = [(part(i), [*tokens(t), None]) for i, t in rows]
    uni, bi = collections.Counter(), collections.Counter()
    per = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for p, w in texts:
        if p != held:
            for counts in ((uni, bi), per[p]):
                counts[0].update(w)
                counts[1].update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    bucket = lambda c: int(language_model.frequency_bucket(np.array([c]))[0])
    grid = lambda p, steps: 1 + int(-np.log2(p) * steps) if p > 0 else 0
    cells = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
    for p in sorted(per):
        u, b = per[p]
        left = n - sum(u.values())
        for (x, y), k in b.items():
            cx, cy, cxy = uni[x] - u[x], uni[y] - u[y], bi[x, y] - b[x, y]
            p2, p1 = cxy / cx if cx else 0.0, cy / max(left, 1)
            c = cells[bucket(cx), grid(p2, language_model.P2_STEPS), grid(p1, language_model.P1_STEPS)]
            c[0], c[1], c[2] = c[0] + k, c[1] + k * p2, c[2] + k * p1
    lam = language_model.em(np.array([(b, c, s2 / c, s1 / c) for (b, _, _), (c, s2, s1) in sorted(cells.items())]).reshape(-1, 4), v)
    out = []
    for _, w in texts:
        total = 0.0
        for x, y in zip([None, *w], w):
            a, b, c = lam[bucket(uni[x])]
            total += np.log10(a * bi[x, y] / max(uni[x], 1) + b * uni[y] / max(n, 1) + c / (v + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("direct", [4096, 1])  # keys meet in one step, in two
def test_language_model_scores_by_brute_force(spark, direct):
    rows = corpus(9, 40)
    got, want = collections.defaultdict(list), collections.defaultdict(list)
    for r in language_model.score(frame(spark, rows), block_chars=1200, direct=direct).collect():
        got[r.doc_id].append(round(r.score, 5))
    for (i, _), x in zip(rows, brute_model(rows)):
        want[i].append(round(x, 5))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    p2, p1 = rng.uniform(0.001, 0.9, 4000), rng.uniform(1e-6, 1e-3, 4000)
    lam = np.array([0.6, 0.3, 0.1])
    share = np.column_stack((p2, p1, np.full(4000, 1 / 101))) @ lam
    cells = np.column_stack((np.full(4000, 5), share, p2, p1))
    w = language_model.em(cells, 100)
    best = lambda x: (share * np.log(np.column_stack((p2, p1, np.full(4000, 1 / 101))) @ x)).sum()
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0
    assert best(w[5]) >= best(np.array([1 / 3] * 3)) and (w[7] == w[5]).all()
    assert (language_model.em(np.zeros((0, 4)), 0) == [0, 0, 1]).all()


def test_language_model_without_rows(spark):
    assert language_model.score(frame(spark, [])).count() == 0
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = language_model.score(frame(spark, [(i, "a b") for i in only_held])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0)}


# --- decontamination -----------------------------------------------------------------------------


def nearest(p, t):
    before = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_edit_matching_like_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        word = lambda a, b: decontaminate.normalise("".join(rng.choice("abc ") for _ in range(rng.randint(a, b))))
        p, t = word(1, 40), word(0, 80)
        if not p:
            continue
        k, want = int(0.2 * len(p)), nearest(p, t) if t else len(p)
        got = decontaminate.Matcher([(1, p)], 0.2, 1).hits(t)
        assert [h[:2] for h in got] == ([(1, want)] if want <= k and t else []), (p, t)


def test_decontamination_cases(spark):
    item = "The quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item.upper()), (None, item)], "item_id long, text string")
    docs = frame(spark, [(1, "x " * 50 + item.replace("brown", "browm") + " y" * 50), (2, None), (3, ""), (4, "short"), (5, item[:30]), (6, "The  quick\nbrown fox " + item[20:])])
    got = {r.doc_id: [(h.item_id, h.distance) for h in r.hits] for r in decontaminate.with_hits(docs, items).collect()}
    # an item without an id is reported, a short one is met as whole words
    assert got == {1: [(1, 1), (4, 1), (None, 1)], 2: [], 3: [], 4: [(3, 0)], 5: [], 6: [(1, 0), (4, 0), (None, 0)]}
    order = lambda hits: sorted(hits, key=str)
    again = {r.doc_id: order((h.item_id, h.distance) for h in r.hits) for r in decontaminate.with_hits(docs, items, most=70).collect()}
    assert again == {k: order(v) for k, v in got.items()}
    clash = decontaminate.with_hits(docs.withColumnRenamed("t", "Hits").withColumn("a.b", F.lit(1)), items)
    assert clash.columns == [c for c in docs.columns if c != "t"] + ["a.b", "hits"]
    assert decontaminate.with_hits(docs.limit(0), items).count() == 0
    assert all(not r.hits for r in decontaminate.with_hits(docs, items.limit(0)).collect())


def test_short_items_are_whole_words():
    for t, want in (("a cat sat", True), ("cat", True), ("concat", False), ("cats", False), ("(cat)", True), ("The  CAT", True), ("", False)):
        assert bool(decontaminate.Matcher([(1, "Cat")]).hits(t)) == want, t


# --- spans ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("direct", [4096, 1])
def test_spans_like_brute_force(spark, direct):
    rows = [(i, t) for i, t in corpus(7, 50) if i is not None]
    docs = sorted({(i, t or "") for i, t in rows})
    seen, want = set(), {}
    for i, t in docs:
        ends, h, size = span_dedup.units(t)  # sentences: no stop inside, whatever commas
        assert all(not re.search(r"[.!?\n]+\s*\w", t[a:b].rstrip(".!?\n ")) for a, b in zip([0, *ends], ends))
        n, gone = len(h), [False] * len(h)
        for a in range(n):
            b = a + 3
            while b <= n and size[a:b].sum() < 10:
                b += 1
            if b > n:
                break
            key = tuple(h[a:b].tolist())
            if key in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(key)
        at = [0, *ends]
        want[i, t] = "".join(t[at[j] : at[j + 1]] for j in range(n) if not gone[j]) if any(gone) else t
    got = span_dedup.dedup(frame(spark, rows), min_words=10, block_chars=700, direct=direct).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.doc_id].append(r.text)
    assert all(w in texts[i] for (i, _), w in want.items())
    assert any(r.n_removed for r in got)


def test_repeats_of_fifty_words_in_long_units(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    plain = lambda n: " ".join(fresh(n))
    bare, long_ = plain(50), plain(30) + ". " + plain(40)
    rows = [(1, f"{plain(40)} {bare} {plain(33)}"), (2, f"{plain(7)}, {plain(3)} {bare.upper()} {plain(60)}"), (3, f"{plain(9)} {long_} {plain(9)}"), (4, long_), (5, f"{long_} {plain(5)}")]
    rows += [(6, plain(400)), (7, "again " * 200), (8, "again " * 49)]
    got = {r.doc_id: r for r in span_dedup.dedup(frame(spark, rows), block_chars=900).collect()}
    seen = set()
    for i, text in rows[:7]:
        left, words = got[i].text.lower().split(), text.lower().split()
        assert got[i].removed_words == len(words) - len(left)
        runs = [tuple(left[j : j + 50]) for j in range(len(left) - 49)]
        assert not seen.intersection(runs) and len(runs) == len(set(runs))
        seen.update(runs)
    assert [got[i].text == t for i, t in rows] == [True, False, True, False, False, True, False, True]
    kept = got[2].text.split()
    assert kept[:10] == rows[1][1].split()[:10] and kept[-60:] == rows[1][1].split()[-60:]
    assert got[2].n_units == 1 and got[2].n_removed == 1
    assert len(got[5].text.split()) >= 5 and got[5].text.endswith(rows[4][1][-20:])


def test_spans_without_words(spark):
    assert span_dedup.dedup(frame(spark, [])).count() == 0
    got = span_dedup.dedup(frame(spark, [(1, None), (2, ""), (None, "a. b."), (3, "!!! ...")])).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got) == [(0, "a. b.", 0), (1, "", 0), (2, "", 0), (3, "!!! ...", 0)]


# --- id store ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_crc_of_parts():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randint(0, 99))) for _ in range(2))
        whole = id_store.crc_shift(np.array([zlib.crc32(a)], np.uint64), np.array([len(b)]))[0] ^ np.uint64(zlib.crc32(b))
        assert int(whole) == zlib.crc32(a + b)


def test_cuts_are_local():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40000, 5000), rng.integers(0, 40000, 3000)
    ids, ends = np.concatenate((a, b, a)), np.array([0, 5000, 8000, 13000])
    got = id_store.cuts(ids, ends)
    assert [c[-1] for c in got] == [5000, 8000, 13000] and [x + 8000 for x in got[0]] == got[2]
    assert all(0 < y - x <= id_store.MAX for c, s in zip(got, ends) for x, y in zip([s, *c], c))
    flat = id_store.cuts(np.zeros(5000, int), np.array([0, 5000]))[0]
    assert max(np.diff([0, *flat])) <= id_store.MAX


def test_encoder_like_the_library(path, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "́", "ﬁ", "İ", "Σ", "1", "²", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", ",", ".", "!?", " ", " ", "\n", "\x85", "\xa0", "\x1c", "日", "ª", "👍", "###", "ß", "क़"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", None]
    library, enc = Tokenizer.from_file(path), id_store.Encoder(path)
    monkeypatch.setattr(id_store, "MEMORY", 500)
    for i in range(0, len(texts), 167):
        ids, ends = enc(pa.array(texts[i : i + 167], pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[i : i + 167]]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "[x]": 1, "A b": 2, " a": 3, "b": 4}, unk_token="[x]"))
    t.pre_tokenizer = pre_tokenizers.Split("|", "isolated")  # white space stays in its tokens, and so does letter case
    t.save(str(tmp_path / "t.json"))
    enc = id_store.Encoder(str(tmp_path / "t.json"))
    ids, ends = enc(pa.array(["A b", "a| a|b", None]), 9)
    assert not enc.by_words and ids.tolist() == [2, 9, 0, 1, 3, 1, 4, 9, 9] and ends.tolist() == [0, 2, 8, 9]


def test_store_of_many_equal_texts(spark, path, tmp_path):
    rows = [(None if i % 3 else i, "" if i % 2 else None) for i in range(5000)] + [(i, "one text of many") for i in range(5000)]
    id_store.write_store(frame(spark, rows).repartition(3), str(tmp_path / "s"), path, 1)
    got = id_store.read_digests(spark, str(tmp_path / "s"))
    assert got.count() == len(rows) and got.select("ids_crc32", "n_tokens").distinct().count() == 2
    refs = spark.read.parquet(str(tmp_path / "s/table=chunks"))
    assert sorted(r.refs for r in refs.collect()) == [5000, 5000]


def test_store_round_trip(spark, path, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in corpus(5, 40)] + [(5000, "long " * 9000), (5001, "long " * 9000)]
    id_store.write_store(frame(spark, rows).repartition(3), str(tmp_path / "s"), path, 1)
    library, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, ids))
    docs = id_store.read_documents(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [d.doc_id for d in docs] == [i for i, _ in want]
    by = collections.Counter((i, tuple(ids)) for i, ids in want)
    assert by == collections.Counter((d.doc_id, tuple(d.ids)) for d in docs)
    for d in docs:
        assert d.start == at and d.n_tokens == len(d.ids)
        at += d.n_tokens
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in id_store.read_digests(spark, str(tmp_path / "s")).collect()}
    assert sums == {(d.start, d.n_tokens): zlib.crc32(np.array(d.ids, "<u4").tobytes()) for d in docs}
    chunks = spark.read.parquet(str(tmp_path / "s/table=chunks"))
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damaged_store(spark, path, tmp_path):
    folder = str(tmp_path / "s")
    id_store.write_store(frame(spark, [(1, "a b c"), (2, "d e f")]), folder, path)
    chunks = spark.read.parquet(f"{folder}/table=chunks")
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    chunks.withColumn("ids", F.concat("ids", F.lit(b"\0\0"))).write.mode("overwrite").parquet(f"{folder}/table=chunks")
    with pytest.raises(Exception, match="damaged"):
        id_store.read_digests(spark, folder).collect()


def test_empty_store(spark, path, tmp_path):
    id_store.write_store(frame(spark, []), str(tmp_path / "s"), path)
    assert id_store.read_digests(spark, str(tmp_path / "s")).count() == 0


# --- similarity join -----------------------------------------------------------------------------


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {}
    for g in groups.values():
        keys = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            least[i] = (min(keys) if keys else None) if sets[i] else rows[i][0]
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


@pytest.mark.parametrize(("chunk", "direct"), [(3, 4096), (2000, 1)])
def test_join_like_brute_force(spark, chunk, direct):
    rows = corpus(11, 40)
    rng = random.Random(8)
    base = [f"q{i}" for i in range(90)]
    for i in range(60):  # a chain: neighbours link, the ends don't
        base[rng.randrange(90)] = f"z{i}"
        rows.append((4000 + i, " ".join(base)))
    got = ngram_join.components(frame(spark, rows), block_chars=2500, chunk=chunk, direct=direct).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(linked(rows))


def test_keys_of_any_size_and_texts_that_share_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    edit = lambda t: t.replace("5 ", "five ", 1)
    big = (1 << 62) + 5
    rows = [(7, a), (7, b), (8, edit(a)), (9, edit(b)), (big, c), (big + 1, c), (None, edit(c)), (None, "only one"), (None, "only one")]
    got = ngram_join.components(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(linked(rows))
    assert sum(r.is_first for r in got) == 5  # two of them equal rows


@pytest.mark.parametrize("chunk", [3, 2000])
def test_links_like_brute_force(spark, chunk):
    rows = [(i, t) for i, t in dict(corpus(13, 30)).items() if i is not None]
    of = collections.defaultdict(list)
    for i, t in rows:
        of[shingles(t)].append(i)
    sets = [s for s in of if s]
    want = {tuple(sorted((min(of[x]), min(of[y])))) for j, x in enumerate(sets) for y in sets[:j] if 100 * len(x & y) >= 80 * len(x | y)}
    got = ngram_join.links(frame(spark, rows), block_chars=2500, chunk=chunk).collect()
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_rows_of_one_key(spark):
    """Many rows with no key, and with one: no block or join depends on keys alone."""
    rows = [(None if i % 2 else 5, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}") for i in range(2000)] + [(None, "same words in many rows here")] * 3000 + [(None, None)] * 3000
    df = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(df, block_chars=9000).collect())
    assert got == {(5, 2, 5): 1000, (None, 2, None): 4000, (None, 0, None): 3000}
    assert language_model.score(df, block_chars=20_000).count() == len(rows)
    assert span_dedup.dedup(df, block_chars=20_000).where("text <> ''").count() == 5000


def test_join_without_rows(spark):
    assert ngram_join.components(frame(spark, [])).count() == 0
    got = ngram_join.components(frame(spark, [(2, None), (1, " "), (None, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(20):
        docs = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64) << np.uint64(4))]
        for _ in range(40):
            s = docs[rng.integers(len(docs))].copy()
            s[rng.integers(0, len(s), rng.integers(0, 9))] = rng.integers(0, 1 << 60, 1).astype(np.uint64) << np.uint64(4)
            docs.append(np.unique(s))
        want = {(i, j) for j in range(len(docs)) for i in range(j) if 5 * len(np.intersect1d(docs[i], docs[j])) >= 4 * len(np.union1d(docs[i], docs[j]))}
        every = collections.Counter(t for d in docs for t in d.tolist())
        rows = [(t, i) for i, d in enumerate(docs) for t in d.tolist() if every[t] > 1]
        token, doc = (np.array(x) for x in zip(*rows))
        n, m = np.array([len(d) for d in docs]), np.array([sum(every[t] > 1 for t in d.tolist()) for d in docs])
        sketch = np.array([np.frombuffer(ngram_join.sketch_of(d), "<u8") for d in docs])
        a, b = ngram_join.candidate_pairs(token, doc, n[doc], m[doc], doc, np.full(len(doc), 2), sketch[doc])
        assert want <= set(zip(a.tolist(), b.tolist()))
