"""Token columns.

The tokenizer used where no model vocabulary is at hand is a stand-in: white-space words, hashed into 3..65535, so that ids fit in 16 bits. Ids 0
to 2 are reserved; 1 begins a chunk for the models, 2 ends a document.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

BOS, EOS = 1, 2
RESERVED = 3
VOCABULARY = 65_536
WORD = "[^ \\t\\n\\r]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def token_of(word: Column) -> Column:
    return (RESERVED + F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % (VOCABULARY - RESERVED)).cast("int")


def tokenize(text: Column, eos: int | None = EOS) -> Column:
    """Token ids of a text, null like empty; with `eos` at the end unless it is None."""
    ids = F.transform(words(text), token_of)
    return ids if eos is None else F.concat(ids, F.array(F.lit(eos)))


class _Words(dict):
    """Ids of words; a word that isn't known is hashed."""

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        self[word] = found = RESERVED + (h[0] << 8 | h[1]) % (VOCABULARY - RESERVED)
        return found


#: Words that a worker keeps, about; then it begins anew.
KEPT = 1 << 18
_KNOWN = _Words()


def word_ids(texts: pa.Array) -> pa.Array:
    find, ids, sizes = re.compile(WORD).findall, [], [0]
    for text in texts.to_pylist():
        ids.append(np.fromiter(map(_KNOWN.__getitem__, find(text or "")), dtype=np.int32))
        ids.append(np.array([EOS], dtype=np.int32))
        sizes.append(sizes[-1] + len(ids[-2]) + 1)
        if len(_KNOWN) > KEPT:
            _KNOWN.clear()
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def tokenize_by_words(text: Column | str) -> Column:
    """tokenize(), in workers that hash a word once as long as they keep it: a word of a text is a look-up, where the expression hashes every one."""
    return F.arrow_udf(word_ids, ArrayType(IntegerType()))(text)


def n_tokens(text: Column) -> Column:
    """Number of tokens, without an end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def in_range(tokens: Column, below: int = VOCABULARY) -> Column:
    """The tokens; raises where one lies outside 0..below-1."""
    return F.when(F.forall(tokens, lambda t: (t >= 0) & (t < below)), tokens).otherwise(F.raise_error(F.lit(f"a token id outside 0..{below - 1}")))


def with_bos(tokens: Column, bos: int | None = BOS) -> Column:
    """`bos` in front unless it is there; None: unchanged. Id 0 is an id like others."""
    return tokens if bos is None else F.when(F.try_element_at(tokens, F.lit(1)) == bos, tokens).otherwise(F.concat(F.array(F.lit(bos)), tokens))


def chunks(tokens: Column, length: int) -> Column:
    """Arrays of up to length + 1 tokens that overlap by one, so that each token but the first is a target once; fewer than 2 tokens: none."""
    n = F.size(tokens)
    starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(length + 1)))


def detokenize(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows(doc_id, tokens) with text, the words that vocabulary(token, word) has for the ids, joined by blanks; others show as <id>. No tokens: an empty text."""
    each = rows.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token")).join(vocabulary, "token", "left")
    word = F.coalesce("word", F.concat(F.lit("<"), F.col("token").cast("string"), F.lit(">")))
    listed = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", word.alias("w")))))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda s: s["w"]), " ").alias("text"))


#: The same in DuckDB's SQL.
SQL_WORD = "[^ \\t\\n\\r]+"
SQL_TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}'), lambda w: {RESERVED} + ('0x' || substr(md5(w), 1, 4))::bigint % {VOCABULARY - RESERVED})"
SQL_TOKEN_TABLE = f"docs as (select doc_id, lang, source, list_append({SQL_TOKENS}, {EOS}) as tokens from documents), counted as (select *, len(tokens) as n_tokens from docs), seen as (select *, cast(sum(n_tokens) over (order by doc_id) as bigint) as total_tokens_seen from counted)"
