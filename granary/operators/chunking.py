"""Chunking of prose and tables as expressions over one row: nothing here shuffles, and all of it runs in the JVM.

Windows, blocks (headings, bullets, speakers and paragraphs), packing of blocks into chunks with a carried-over tail,
table chunks that repeat their labels, prose chunks with a breadcrumb, and the dispatch between the last two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx

MAX_TOKENS, OVERLAP = 400, 40
#: How lines that stand alone begin.
HEADING = r"(?U)^#{1,6}\s+"
BULLET = r"(?U)^(?:[-*•]|\d+\.\s+)"
SPEAKER = r"(?U)^[A-Za-z][A-Za-z0-9 _-]{0,32}:\s+"


def window_chunks(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Windows of max_tokens words that share overlap words, and what is left after the last of them, even if that is
    only the overlap. Without overlap the rest may be empty and is then left out. No words: no chunks."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap must be less than a chunk")
    step = max_tokens - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.when(n < max_tokens, 0).otherwise(F.floor((n - max_tokens) / step).cast("int") + 1)
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, max_tokens), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(parts, lambda x: x != ""))

    return tx.bind(tx.words(F.coalesce(text, F.lit(""))), cut)


def blocks(text: Column) -> Column:
    """Headings, upper-case lines, bullets and speaker lines by themselves; other lines joined up to the next break."""
    alone = lambda line: line.rlike(HEADING) | tx.is_upper(line) | line.rlike(BULLET) | line.rlike(SPEAKER)
    kind = lambda line: F.when(tx.is_blank(line), 0).when(alone(line), 1).otherwise(2)
    lines = F.transform(F.transform(tx.lines(F.coalesce(text, F.lit(""))), tx.rstrip), lambda line: F.struct(kind(line).alias("k"), tx.strip(line).alias("t")))

    def cut(found: Column) -> Column:
        n = F.size(found)
        # a block begins at each line that stands alone, and at prose that follows no prose
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(found, i)["k"] == 1) | ((F.get(found, i)["k"] == 2) & (F.coalesce(F.get(found, i - 1)["k"], F.lit(0)) != 2)))
        part = lambda a, b: F.transform(F.filter(F.slice(found, a + 1, b - a), lambda x: x["k"] != 0), lambda x: x["t"])
        return tx.bind(first, lambda at: F.transform(at, lambda i, j: F.array_join(part(i, F.coalesce(F.get(at, j + 1), n)), " ")))

    return tx.bind(lines, cut)


def pack_blocks(found: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, similarity: Column | None = None, threshold: float = 0.75) -> Column:
    """Blocks packed greedily into chunks; a new chunk begins with the last overlap words of the one before. A block
    is never split. similarity: for each block its similarity to the one before; below threshold a new chunk begins.

    Only numbers are folded: which blocks a chunk has and how many words it carries over, which are the last before its
    blocks among all words. The text is cut out once at the end."""
    items = F.transform(found, lambda b, i: F.struct(tx.words(b).alias("w"), (F.lit(1.0) if similarity is None else F.coalesce(F.get(similarity, i), F.lit(1.0))).alias("s")))

    def packed(bound: Column) -> Column:
        sizes = F.transform(bound, lambda x: F.struct(F.size(x["w"]).alias("n"), x["s"].alias("s")))
        chunk = "struct<at:int,word:int,carry:int>"  # first block, first word of it, words carried over
        empty = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("word"))

        def step(acc: Column, x: Column) -> Column:
            carry = F.least(acc["n"], F.lit(overlap))
            new = (F.size(acc["done"]) == 0) | (x["s"] < threshold) | (acc["n"] + x["n"] > max_tokens)
            carried = F.when(F.size(acc["done"]) == 0, F.lit(0)).otherwise(carry)
            done = F.when(new, F.array_append(acc["done"], F.struct(acc["at"].alias("at"), acc["word"].alias("word"), carried.alias("carry")))).otherwise(acc["done"])
            return F.struct(done.alias("done"), F.when(new, carried + x["n"]).otherwise(acc["n"] + x["n"]).alias("n"), (acc["at"] + 1).alias("at"), (acc["word"] + x["n"]).alias("word"))

        cuts = F.aggregate(sizes, empty, step, lambda acc: acc["done"])
        words = F.flatten(F.transform(bound, lambda x: x["w"]))

        def text(at: Column, all_words: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                body = F.slice(found, c["at"] + 1, F.coalesce(F.get(at, j + 1)["at"], F.size(found)) - c["at"])
                tail = F.slice(all_words, c["word"] - c["carry"] + 1, c["carry"])
                return F.array_join(F.concat(tail, body), " ")

            return F.transform(at, one)

        return tx.bind(words, lambda all_words: tx.bind(cuts, lambda at: text(at, all_words)))

    return tx.bind(items, packed)


def structured_chunks(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    return tx.bind(blocks(text), lambda found: pack_blocks(found, max_tokens, overlap))


def prose_chunks(text: Column, headings: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Structured chunks (the text itself if there are none) behind their breadcrumb, unless a chunk is a heading."""
    crumb = F.array_join(headings, " > ")
    known = F.transform(headings, tx.strip)

    def placed(base: Column) -> Column:
        base = F.when(F.size(base) == 0, F.array(F.coalesce(text, F.lit("")))).otherwise(base)
        return F.when(F.coalesce(F.size(headings), F.lit(0)) < 1, base).otherwise(F.transform(base, lambda c: F.when(F.array_contains(known, tx.strip(c)), c).otherwise(F.concat(F.lit("["), crumb, F.lit("] "), c))))

    return tx.bind(structured_chunks(text, max_tokens, overlap), placed)


def table_chunks(columns: Column, rows: Column, headings: Column, label: Column) -> Column:
    """A summary and a chunk for each row (rows: array of maps), each with breadcrumb, label and column names."""
    prefix = F.concat_ws(" — ", F.when(F.size(headings) > 0, F.array_join(headings, " > ")), F.coalesce(F.nullif(label, F.lit("")), F.lit("Table")))
    n = F.size(rows)
    summary = F.concat(prefix, F.lit(" — columns: "), F.array_join(columns, ", "), F.lit(" — "), n.cast("string"), F.when(n == 1, " row").otherwise(" rows"))
    each = F.transform(rows, lambda r: F.concat(prefix, F.lit(" — "), F.array_join(F.transform(columns, lambda c: F.concat(c, F.lit(": "), F.coalesce(F.try_element_at(r, c), F.lit("")))), ", ")))
    return F.when((F.coalesce(F.size(columns), F.lit(0)) < 1) | (F.coalesce(n, F.lit(0)) < 1), F.array().cast("array<string>")).otherwise(F.concat(F.array(summary), each))


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk of documents (content, block_type, headings, table_columns, table_rows, table_label):
    table chunks for tables that come with columns and rows, prose chunks for the rest; chunk_index counts from 0."""
    is_table = (F.col("block_type") == "table") & (F.coalesce(F.size("table_columns"), F.lit(0)) > 0) & (F.coalesce(F.size("table_rows"), F.lit(0)) > 0)
    chunks = F.when(is_table, table_chunks(F.col("table_columns"), F.col("table_rows"), F.col("headings"), F.col("table_label"))).otherwise(prose_chunks(F.col("content"), F.col("headings"), max_tokens, overlap))
    return docs.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))


#: The chunkers by name, for settings that name one: functions of a text column.
STRATEGIES = {"window": window_chunks, "structured": structured_chunks}


def chunk_column(docs: DataFrame, column: str, strategy: str = "structured", key: str = "doc_id", **options) -> DataFrame:
    """docs with a row for each chunk (the text itself where there is none), and a chunk_id of key and position."""
    c = STRATEGIES[strategy](F.col(column), **options)
    c = F.when(F.size(c) == 0, F.array(F.coalesce(F.col(column), F.lit("")))).otherwise(c)
    out = docs.select("*", F.posexplode(c).alias("chunk_index", "chunk"))
    return out.withColumn("chunk_id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))
