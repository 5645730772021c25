"""Tokenizers loaded from a file (the `tokenizers` library's JSON), as columns.

The path is a parameter and has to be one that the executors open; a worker loads a file once. A text that can't be tokenised has no tokens and is flagged,
so that one bad document doesn't end a job and can be counted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.tokens import VOCABULARY

_LOADED: dict = {}


def load(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def end_of_text(path: str, names: tuple[str, ...] = ("<|endoftext|>", "</s>")) -> int:
    """Id of the token that ends a document; ValueError where it doesn't fit 16 bits or there is none."""
    found = next((i for i in map(load(path).token_to_id, names) if i is not None), None)
    if found is None or found >= VOCABULARY:
        raise ValueError("no token for the end of a document within 16 bits")
    return found


def encoded(path: str, special: bool = False, coder: Callable[[str], list[int]] | None = None):
    """A function of a text column: (ids, failed). Null is an empty text. special: with the tokens that the tokenizer sets around a text."""

    @F.pandas_udf("struct<ids array<int>, failed boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        encode = coder or (lambda t: load(path).encode(t, add_special_tokens=special).ids)
        ids, failed = [], []
        for t in texts:
            try:
                ids.append(np.asarray(encode(t or ""), dtype=np.int32))
                failed.append(False)
            except Exception:  # noqa: BLE001  whatever a tokenizer raises for a text
                ids.append(np.zeros(0, dtype=np.int32))
                failed.append(True)
        return pd.DataFrame({"ids": ids, "failed": failed})

    return run


def token_table(docs: DataFrame, path: str, *keep: str, eos: int | None = None) -> DataFrame:
    """(doc_id, *keep, tokens, n_tokens, failed) of documents(doc_id, text), each with its end; a document that can't be tokenised has its end alone."""
    end = end_of_text(path) if eos is None else eos
    made = docs.select("doc_id", *keep, encoded(path)(F.col("text").cast("string")).alias("e"))
    tokens = F.concat("e.ids", F.array(F.lit(end)))
    return made.select("doc_id", *keep, tokens.alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"), F.col("e.failed").alias("failed"))


def prompt_and_answer(probes: DataFrame, path: str) -> DataFrame:
    """(id, tokens, n_prompt) of probes(id, prompt, answer): the ids of prompt and answer as one text, and how many the prompt has by itself.

    With the tokens that the tokenizer sets around a text.
    """
    code = encoded(path, special=True)
    both = F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("answer", F.lit("")))
    made = probes.select("id", code(both).alias("b"), code(F.col("prompt")).alias("p"))
    return made.select("id", F.col("b.ids").alias("tokens"), F.size("p.ids").alias("n_prompt"))


def decoded(path: str):
    """A function of a column of ids: the text they stand for."""

    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else load(path).decode(list(t), skip_special_tokens=False) for t in tokens], dtype=object)

    return run


def stand_in_vector(token: Column, size: int) -> Column:
    """An array of `size` numbers between -1 and 1 that depends on nothing but the token id."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.xxhash64(token, i) / F.lit(float(1 << 63)))
