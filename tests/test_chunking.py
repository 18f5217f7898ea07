import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.operators import chunking as ck


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def text(spark, column, value):
    return one(spark, column, t=value)


def loop(words, most, overlap):
    chunks, current = [], []
    for w in words:
        current.append(w)
        if len(current) >= most:
            chunks.append(" ".join(current))
            current = current[-overlap:] if overlap else []
    return chunks + [" ".join(current)] if current else chunks


def test_windows(spark):
    cases = [(n, m, o) for n in (0, 1, 5, 9, 10, 11, 20, 50) for m, o in ((10, 5), (20, 5), (5, 1), (5, 0))]
    for n, m, o in cases:
        words = [f"w{i}" for i in range(n)]
        assert text(spark, ck.window_chunks(F.col("t"), m, o), " \n".join(words)) == loop(words, m, o), (n, m, o)


def test_windows_odd_texts(spark):
    assert text(spark, ck.window_chunks(F.col("t")), None) == []
    assert text(spark, ck.window_chunks(F.col("t")), " \t \x1c ") == []
    assert text(spark, ck.window_chunks(F.col("t")), "a b\x1dc") == ["a b c"]
    with pytest.raises(ValueError):
        ck.window_chunks(F.col("t"), 5, 5)


def test_blocks(spark):
    b = lambda t: text(spark, ck.blocks(F.col("t")), t)
    assert b("# T\na\nb\n\n- x\nBob: hi\ntail") == ["# T", "a b", "- x", "Bob: hi", "tail"]
    assert b("| A | B |\n| a | b |") == ["| A | B |", "| a | b |"]
    assert b("  - indented\nBob:\n**bold**\n-5\n1. one") == ["- indented Bob:", "**bold**", "-5", "1. one"]
    assert b(None) == [] and b("") == [] and b(" \n\n ") == []
    assert b("ÜBER ALLES\r\nx y") == ["ÜBER ALLES", "x y"]


def test_packing(spark):
    pack = lambda bs, m, o: one(spark, ck.pack_blocks(F.array(*[F.lit(b) for b in bs]), m, o))
    assert pack(["a b c", "d e", "f"], 4, 1) == ["a b c", "c d e f"]
    assert pack(["a b c d e f"], 3, 1) == ["a b c d e f"]
    assert pack(["a b", "c d", "e"], 3, 0) == ["a b", "c d e"]
    sims = F.array(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.9))
    assert one(spark, ck.pack_blocks(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 10, 0, sims)) == ["a", "b c"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 7), max_size=12), st.integers(2, 9), st.integers(0, 1))
def test_packing_like_a_loop(spark, sizes, most, overlap):
    found = [" ".join(f"{i}.{j}" for j in range(n)) for i, n in enumerate(sizes)]
    chunks, current = [], ""
    for b in found:
        if not current:
            current = b
        elif len(current.split()) + len(b.split()) > most:
            chunks.append(current)
            current = " ".join(current.split()[-overlap:] + [b]) if overlap else b
        else:
            current += " " + b
    chunks += [current] if current else []
    df = spark.createDataFrame([(found,)], "b array<string>")
    assert df.select(ck.pack_blocks(F.col("b"), most, overlap)).first()[0] == chunks


def test_tables_and_prose(spark):
    df = spark.createDataFrame([(["A"], [{"A": "1"}], ["Section 3", "3.1 Pricing"], "Pricing")], "c array<string>, r array<map<string,string>>, h array<string>, l string")
    t = lambda *cols: df.select(ck.table_chunks(*[F.col(c) for c in cols])).first()[0]
    assert t("c", "r", "h", "l") == ["Section 3 > 3.1 Pricing — Pricing — columns: A — 1 row", "Section 3 > 3.1 Pricing — Pricing — A: 1"]
    none = spark.createDataFrame([([], None, None, None)], df.schema)
    assert none.select(ck.table_chunks(F.col("c"), F.col("r"), F.col("h"), F.col("l"))).first()[0] == []
    p = lambda content, heads: spark.createDataFrame([(content, heads)], "t string, h array<string>").select(ck.prose_chunks(F.col("t"), F.col("h"))).first()[0]
    assert p("INVOICE", ["INVOICE"]) == ["INVOICE"]
    assert p("", None) == [""] and p(None, []) == [""]
    assert p("some words", ["A", "B"]) == ["[A > B] some words"]
