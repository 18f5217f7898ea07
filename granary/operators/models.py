"""Calls of models by injected functions: nothing here knows a provider, and no plan depends on an answer's words."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How much of a text a model gets to extract facts from.
PROMPT_CHARS = 2_000

Backends = dict[str, Callable[[], Callable]]


def backend(of: Backends, name: str) -> Callable[[], Callable]:
    """The loader with a name; an unknown one raises ValueError before any task runs."""
    if name not in of:
        raise ValueError(f"no backend {name!r} among {', '.join(sorted(of)) or 'none'}")
    return of[name]


def joined_segments(segments: Column) -> Column:
    """The text of a transcript's segments."""
    return F.array_join(F.filter(F.transform(segments, lambda s: F.trim(s)), lambda s: s != ""), " ")


def answers(df: DataFrame, prompt: Column, load: Callable[[], Callable[[str], str]], out: str = "answer") -> DataFrame:
    """df with a model's answers (null where the call failed) and their errors. load makes the function, once for each
    worker's share of the rows."""
    rows = df.withColumn("__prompt", prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = load()
        for pdf in batches:
            got = []
            for p in pdf["__prompt"].tolist():
                try:
                    got.append((None if p is None else f(p), None))
                except Exception as e:  # noqa: BLE001
                    got.append((None, f"{type(e).__name__}: {e}"))
            a, e = zip(*got) if got else ((), ())
            yield pdf.drop(columns="__prompt").assign(**{out: pd.Series(a, index=pdf.index, dtype=object), f"{out}_error": pd.Series(e, index=pdf.index, dtype=object)})

    return rows.mapInPandas(call, schema)


def extract_facts(docs: DataFrame, text: str, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """docs with facts: the object in a model's JSON answer about the beginning of each text, as a map of strings; empty
    where the call failed or the answer is no such JSON."""

    def facts(answer: str | None) -> dict[str, str]:
        try:
            got = json.loads(answer or "")
        except ValueError:
            return {}
        return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()} if isinstance(got, dict) else {}

    parse = F.udf(facts, "map<string,string>")
    got = answers(docs, F.substring(F.col(text), 1, PROMPT_CHARS), load, "__a")
    return got.withColumn("facts", parse("__a")).drop("__a", "__a_error")
