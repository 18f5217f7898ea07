"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic (token sums). Raking scales the cells' sampling
probabilities, margin by margin, until the tokens expected of every value are its target share of the budget. A
probability can't be above 1, so each step solves for the factor that meets the target with the cap in force; what is
raked is what is sampled. A document is taken if a hash of its key and text, as a number from 0 to 1, is below its
cell's probability: the choice is the same in every run.

Targets are shares by value, or, by default, the tokens' own shares to a power below 1 (which lifts small values). A
value can't give more tokens than it has: where its share of the budget is more, all of it is taken and the others share
the rest in proportion. mix_with_report() says for each value what was asked for, what could be, and what is expected.

Topics are the nearest of TOPICS centres of hashed bags of words, by spherical k-means: it starts from a bounded sample,
and its centres are means over all documents; a column with topics may be given instead. Texts are tokenised once.

Cells are few beside documents and, up to MAX_CELLS of them, are raked on the driver; more are raked as a DataFrame, by
the same steps and the same rule for stopping.

Cases: a null source, language or topic is a value of its own. Null or empty texts have no tokens, count nothing and
take their cell's probability (a cell without tokens has that of the budget). A value without a target keeps its share;
targets for values without tokens are left out, and the rest are scaled to sum to 1. Where the margins contradict each
other the last iteration stands, and the report shows by how much. Repeated rows are all kept or all left. An empty
table gives an empty result. Extra columns are carried along; columns with the output's names, in any letter case, are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, Scratch, bounded_sample, by_chars, lookup, text_column, trim, word_hashes, words

TOPICS, DIM, SAMPLE, SEED = 8, 256, 4_000, 11
#: Steps of k-means on the sample and over all documents, and the fixed point of a bag's coordinates.
SAMPLE_STEPS, STEPS, ONE = 25, 5, 65_535
MAX_CELLS, ROUNDS, TOLERANCE = 100_000, 400, 1e-9
#: A value whose expected share is that near its target is reported as reached.
REACHED = 1e-3
NONE = "\0"
MARGINS = ("source", "lang", "topic")


def bags(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of texts, and their unit vectors of hashed log counts in fixed point."""
    codes, offs, vocab = words(texts)
    n = np.diff(offs)
    dim = (word_hashes(vocab) % np.uint64(DIM)).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n) * DIM + (dim[codes] if len(codes) else codes)
    x = np.log1p(np.bincount(at, minlength=len(n) * DIM).reshape(len(n), DIM))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return n, np.round(x * ONE).astype("<u2")


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Topics:
    """Centres in the space of bags less their mean."""

    def __init__(self, mean: np.ndarray, sample: np.ndarray, k: int = TOPICS, seed: int = SEED):
        self.mean = mean
        x = sample.astype(float) - mean
        rng = np.random.default_rng(seed)
        self.centres = unit_rows(x[rng.permutation(len(x))[:k]]) if len(x) else np.zeros((1, DIM))
        for _ in range(SAMPLE_STEPS):
            of = self.nearest(sample)
            self.move(np.array([x[of == j].sum(0) for j in range(len(self.centres))]), np.bincount(of, minlength=len(self.centres)))

    def move(self, sums: np.ndarray, n: np.ndarray) -> None:
        self.centres = unit_rows(np.where(n[:, None] > 0, sums, self.centres))

    def nearest(self, bag: np.ndarray) -> np.ndarray:
        return ((bag.astype(float) - self.mean) @ self.centres.T).argmax(1) if len(bag) else np.zeros(0, np.int64)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, DIM)


def sums_by(bagged: DataFrame, topics: Topics | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of all documents' bags, by nearest centre, and the numbers of documents."""

    def add(batches):
        sums, n = np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = unpacked(b.column("bag"))
            of = topics.nearest(x) if topics else np.zeros(len(x), np.int64)
            for j in range(k):
                sums[j] += x[of == j].sum(0, dtype=np.int64)
            n += np.bincount(of, minlength=k)
        if n.any():
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(k * (DIM + 1)), pa.int32()), "v": np.column_stack((n, sums)).reshape(-1).tolist()})

    got = bagged.select("bag").mapInArrow(add, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * (DIM + 1), np.int64)
    for r in got:
        out[r["at"]] = r["v"]
    out = out.reshape(k, DIM + 1)
    return out[:, 1:], out[:, 0]


def fit_topics(bagged: DataFrame, k: int = TOPICS, most: int = SAMPLE, steps: int = STEPS) -> Topics:
    """bagged: a written table with the column bag. Centres that a step doesn't change end the steps."""
    total, n = sums_by(bagged, None, 1)
    mean = total[0] / max(int(n[0]), 1)
    hashed = bagged.select("bag").withColumn("h", F.xxhash64("bag"))
    chosen = bounded_sample(hashed.select("h").distinct(), F.col("h"), most)
    got = hashed.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("bag").alias("bag")).collect()  # most rows
    got.sort(key=lambda r: r.h)
    topics = Topics(mean, np.array([np.frombuffer(r.bag, "<u2") for r in got]).reshape(-1, DIM), k)
    size, before = len(topics.centres), None
    for _ in range(steps):
        sums, n = sums_by(bagged, topics, size)
        topics.move(sums - n[:, None] * mean, n)
        if before is not None and (sums == before).all():
            break
        before = sums
    return topics


def _asked(observed: np.ndarray, names: list, target: dict | None, power: float) -> np.ndarray:
    """Shares that sum to 1; 0 for values without tokens."""
    total = observed.sum() or 1.0
    if target is None:
        want = np.where(observed > 0, (observed / total) ** power, 0.0)
    else:
        want = np.array([float(target.get(v, x / total)) if x > 0 else 0.0 for v, x in zip(names, observed.tolist())])
    return want / (want.sum() or 1.0)


def reachable(observed: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Tokens to expect of each value: min(observed, c * share), with c such that they sum to the budget; values that
    are asked for 0 are taken last."""
    want = min(budget, float(observed.sum()))
    out, left = np.zeros(len(observed)), share > 0
    full = np.zeros(len(observed), bool)
    while left.any():
        rest = want - observed[full].sum()
        c = rest / share[left].sum()
        over = left & (c * share >= observed)
        if not over.any():
            out[left] = c * share[left]
            break
        full |= over
        left &= ~over
    out[full] = observed[full]
    short = want - out.sum()
    none = share <= 0
    if short > 1e-9 * max(want, 1) and observed[none].sum() > 0:
        out[none] = observed[none] * min(1.0, short / observed[none].sum())
    return out


def _factors(code: np.ndarray, w: np.ndarray, tokens: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each value f with sum(tokens * min(1, f * w)) = want, by Newton's steps from below: the sum is concave in f."""
    n = len(want)
    whole = np.bincount(code, w * tokens, n)
    f = np.divide(want, whole, out=np.ones(n), where=whole > 0)
    for _ in range(100):
        capped = f[code] * w >= 1
        full, rest = np.bincount(code, tokens * capped, n), np.bincount(code, w * tokens * ~capped, n)
        new = np.where(rest > 0, np.divide(want - full, rest, out=f.copy(), where=rest > 0), f)
        new = np.maximum(new, f)
        if (new <= f * (1 + 1e-14)).all():
            break
        f = new
    return f


def rake(values: list[list[str]], tokens: np.ndarray, targets: list[dict | None], power: float, budget: float) -> tuple[np.ndarray, list]:
    """Cells' probabilities, and (margin, value, asked, target, expected) for each value; values[j][i] is cell i's."""
    total, coded, report = float(tokens.sum()), [], []
    w = np.full(len(tokens), float(min(max(budget, 0.0), 1.0)))
    if total <= 0:
        return w, report
    for v, target in zip(values, targets):
        names = sorted(set(v))
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[n] for n in v], dtype=np.int64)
        observed = np.bincount(code, tokens, len(names))
        share = _asked(observed, names, target, power)
        coded.append((names, code, share, reachable(observed, share, budget * total)))
    wanted = max(min(budget, 1.0) * total, 1e-300)
    if 0 < budget < 1:
        for _ in range(ROUNDS):
            off = 0.0
            for _names, code, _share, want in coded:
                now = np.bincount(code, np.minimum(1.0, w) * tokens, len(want))
                off = max(off, float(np.abs(now - want).max()) / wanted)
                w = w * _factors(code, w, tokens, want)[code]
            if off < TOLERANCE:
                break
    p = np.where(tokens > 0, np.minimum(1.0, w), min(max(budget, 0.0), 1.0))
    for j, (names, code, share, want) in enumerate(coded):
        expected = np.bincount(code, p * tokens, len(names)) / wanted
        report += list(zip([MARGINS[j]] * len(names), names, share.tolist(), (want / wanted).tolist(), expected.tolist()))
    return p, report


REPORT = "margin string, value string, asked double, target double, expected double"


def rake_frame(cells: DataFrame, margins: list[str], targets: list[dict | None], power: float, budget: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same for more cells than the driver should hold: cells with probability, and the report. A written table of
    cells goes in; each step of each margin is an aggregation and a join."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    start = F.lit(float(min(max(budget, 0.0), 1.0)))
    if total <= 0:
        return cells.withColumn("probability", start), spark.createDataFrame([], REPORT)
    wanted, shares = max(min(budget, 1.0) * total, 1e-300), []
    for c, target in zip(margins, targets):
        s = cells.groupBy(c).agg(F.sum("tokens").alias("observed"))
        own = F.col("observed") / total
        if target is None:
            s = s.withColumn("share", F.when(own > 0, F.pow(own, F.lit(power))).otherwise(0.0))
        else:
            given = spark.createDataFrame(list(target.items()) or [(NONE, 0.0)], f"{c} string, given double")
            s = s.join(F.broadcast(given), c, "left").withColumn("share", F.when(own > 0, F.coalesce("given", own)).otherwise(0.0)).drop("given")
        s = scratch.save(s)
        s = scratch.save(s.withColumn("share", F.col("share") / F.lit(float(s.agg(F.sum("share")).first()[0] or 1.0))).withColumn("full", F.lit(False)))
        want = min(budget * total, float(s.agg(F.sum("observed")).first()[0]))
        while True:  # as reachable()
            full, left = s.agg(F.sum(F.when(F.col("full"), F.col("observed"))), F.sum(F.when(~F.col("full"), F.col("share")))).first()
            by = (want - (full or 0.0)) / left if left else 0.0
            over = ~F.col("full") & (F.col("share") > 0) & (F.lit(by) * F.col("share") >= F.col("observed"))
            if not left or not s.where(over).limit(1).count():
                break
            s = scratch.save(s.withColumn("full", F.col("full") | over))
        s = s.withColumn("want", F.when(F.col("full"), F.col("observed")).otherwise(F.col("share") * F.lit(by)))
        got, none = s.agg(F.sum("want"), F.sum(F.when(F.col("share") <= 0, F.col("observed")))).first()
        if want - got > 1e-9 * max(want, 1) and (none or 0) > 0:
            s = s.withColumn("want", F.when(F.col("share") <= 0, F.col("observed") * F.lit(min(1.0, (want - got) / none))).otherwise(F.col("want")))
        shares.append(scratch.save(s.select(c, "share", "want")))
    state = scratch.save(cells.withColumn("w", start))
    capped = F.least(F.lit(1.0), F.col("w")) * F.col("tokens")
    for _ in range(ROUNDS if 0 < budget < 1 else 0):
        off = 0.0
        for c, s in zip(margins, shares):
            f = scratch.save(state.groupBy(c).agg(F.sum(F.col("w") * F.col("tokens")).alias("whole"), F.sum(capped).alias("now")).join(s, c).withColumn("f", F.when(F.col("whole") > 0, F.col("want") / F.col("whole")).otherwise(1.0)).select(c, "want", "now", "f"))
            off = max(off, float(f.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0]) / wanted)
            for _ in range(100):
                hit = F.col("f") * F.col("w") >= 1
                step = lookup(state, f.select(c, "f"), c, "inner").groupBy(c).agg(F.sum(F.when(hit, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(hit, 0.0).otherwise(F.col("w") * F.col("tokens"))).alias("rest"))
                new = f.join(step, c).withColumn("g", F.when(F.col("rest") > 0, F.greatest("f", (F.col("want") - F.col("full")) / F.col("rest"))).otherwise(F.col("f")))
                new = scratch.save(new.select(c, "want", F.col("g").alias("f"), (F.col("g") > F.col("f") * (1 + 1e-14)).alias("moved")))
                moved = new.where("moved").limit(1).count()
                scratch.drop(f)
                f = new
                if not moved:
                    break
            after = scratch.save(lookup(state, f.select(c, "f"), c, "inner").withColumn("w", F.col("w") * F.col("f")).drop("f"))
            scratch.drop(state, f)
            state = after
        if off < TOLERANCE:
            break
    out = scratch.save(state.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w"))).otherwise(start)).drop("w"))
    report = None
    for name, c, s in zip(MARGINS, margins, shares):
        r = out.groupBy(c).agg(F.sum(F.col("probability") * F.col("tokens")).alias("e")).join(s, c).select(F.lit(name).alias("margin"), F.col(c).alias("value"), F.col("share").alias("asked"), (F.col("want") / wanted).alias("target"), (F.col("e") / wanted).alias("expected"))
        report = r if report is None else report.union(r)
    report = scratch.save(report)
    scratch.drop_but(cells, out, report)
    return out, report


def unit_hash(*of: Column) -> Column:
    """From 0 to 1, evenly."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit(SEED)), 11).cast("double") / F.lit(float(1 << 53))


def mix_with_report(docs: DataFrame, budget: float, power: float = 0.5, targets: dict | None = None, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame]:
    """docs with n_tokens, topic, weight, probability and selected; and for each value of each margin the share of the
    budget that was asked for, the target that can be, the expected share, and whether that is REACHED for what was
    asked. weight is probability over budget: tokens by weight have the expected shares. targets: {"source": {value:
    share}, ...}."""
    spark = docs.sparkSession
    scratch, tables = Scratch(spark), Scratch(spark)
    c = Carried(docs, "weight", "probability", "selected", "n_tokens", *(["topic"] if topic is None else []))
    names = {"source": source, "lang": lang} | ({"topic": topic} if topic else {})
    own = {f"m_{m}": F.coalesce(F.col(c.at(n)).cast("string"), F.lit(NONE)) for m, n in names.items()}
    rows = c.df.select(*c.kept, *[v.alias(m) for m, v in own.items()], text_column(c.at(text)).alias("t"), F.col(c.at(key)).alias("k"))
    rows = rows.withColumn("u", unit_hash(F.col("k"), F.xxhash64("t"))).drop("k")
    kept = [f for f in rows.schema.fields if f.name != "t"]

    def profile(batches):
        for b in by_chars(batches, "t"):
            n, x = bags(b.column("t"))
            bag = pa.array([v.tobytes() for v in x] if topic is None else [None] * len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(n), bag], names=[*(f.name for f in kept), "n_tokens", "bag"])
            del n, x, bag
            trim()

    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("bag", T.BinaryType())])
    rows = tables.save(rows.mapInArrow(profile, schema))
    if topic is None:
        fitted = fit_topics(rows.where("n_tokens > 0").select("bag"))

        def place(batches):
            for b in batches:
                at = b.schema.get_field_index("bag")
                cols = [x for i, x in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(fitted.nearest(unpacked(b.column("bag"))), pa.int64())], names=[*(n for n in b.schema.names if n != "bag"), "topic"])

        rows = rows.mapInArrow(place, T.StructType([*[f for f in rows.schema.fields if f.name != "bag"], T.StructField("topic", T.LongType())]))
        rows = rows.withColumn("m_topic", F.col("topic").cast("string"))
    margins = [f"m_{m}" for m in MARGINS]
    cells = scratch.save(rows.groupBy(*margins).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    wanted = [(targets or {}).get(m) for m in MARGINS]
    if cells.count() <= max_cells:
        got = sorted(map(tuple, cells.collect()))
        p, lines = rake([[g[j] for g in got] for j in range(3)], np.array([g[-1] for g in got], dtype=float), wanted, power, budget)
        probability = spark.createDataFrame([(*g[:-1], float(a)) for g, a in zip(got, p)], ", ".join(f"{m} string" for m in margins) + ", probability double")
        report = spark.createDataFrame(lines, REPORT)
        scratch.drop()
        out = rows.join(F.broadcast(probability), margins)  # max_cells rows at most
    else:
        probability, report = rake_frame(cells, margins, wanted, power, budget, scratch)
        cell = lambda f: f.withColumn("cell", F.xxhash64(*margins))  # noqa: E731  to look for hot cells; the join is on the values
        hot = lookup(cell(rows), cell(probability).groupBy("cell").agg(F.collect_list(F.struct(*margins, "probability")).alias("ps")), "cell", "inner")
        mine = F.filter("ps", lambda x: (x["m_source"] == F.col("m_source")) & (x["m_lang"] == F.col("m_lang")) & (x["m_topic"] == F.col("m_topic")))
        out = hot.withColumn("probability", F.get(mine, F.lit(0))["probability"])
    weight = F.col("probability") / F.lit(float(min(max(budget, 1e-300), 1.0)))
    new = ["n_tokens", *(["topic"] if topic is None else []), weight.alias("weight"), "probability", (F.col("u") < F.col("probability")).alias("selected")]
    reached = (F.abs(F.col("asked") - F.col("expected")) <= REACHED).alias("reached")
    return c.back(out, *new), report.select("*", reached)


def mix(docs: DataFrame, budget: float, power: float = 0.5, targets: dict | None = None, **columns) -> DataFrame:
    """mix_with_report()'s documents."""
    return mix_with_report(docs, budget, power, targets, **columns)[0]
