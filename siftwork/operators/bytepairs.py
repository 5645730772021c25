"""Byte-pair ids of documents by a table of different pre-tokens, and text back from ids.

Spark cuts texts into pre-tokens; of a batch of documents each different one is merged once, and a task remembers the ids of a bounded number of them. Nothing is
shuffled, so that work and memory grow with the texts alone. Text comes back from the bytes of ids in their order, which are decoded only when
they are together: a character may span ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a task remembers, and characters of one at most.
KNOWN, LONGEST = 200_000, 64
# Fixed value: the pattern that byte-level tokenizers cut texts by, in the syntax of Spark's regular expressions.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones of Latin-1 for themselves, all others by those from 256 on, in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass
class Pairs:
    """Ids of tokens, ranks of pairs that merge, and ids of the strings that are tokens wherever they stand."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    added: dict[str, int]


def load(path: str) -> Pairs:
    """From a file of the `tokenizers` library; ValueError where it isn't plain byte-level byte-pair coding."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or said.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is another kind of tokenizer")
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    return Pairs(model["vocab"], {p: k for k, p in enumerate(pairs)}, {t["content"]: t["id"] for t in said.get("added_tokens", ())})


def fits(path: str) -> bool:
    """Whether the tokenizer file is one that load() takes."""
    try:
        load(path)
    except ValueError:
        return False
    return True


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of a pre-token: of the neighbours that may merge those of the lowest rank do, the first ones first, until none may. In time n log n."""
    part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    open_ = [(ranks[p], i, *p) for i, p in enumerate(zip(word, word[1:])) if p in ranks]
    heapq.heapify(open_)
    while open_:
        _, i, a, b = heapq.heappop(open_)
        j = after[i] if part[i] else len(part)
        # Either has merged with another one meanwhile.
        if j >= len(part) or part[i] != a or part[j] != b:
            continue
        part[i], part[j], after[i] = a + b, "", after[j]
        if after[j] < len(part):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if 0 <= left and right < len(part) and (pair := (part[left], part[right])) in ranks:
                heapq.heappush(open_, (ranks[pair], left, *pair))
    return [p for p in part if p]


def pretokens(text: Column, added: list[str]) -> Column:
    """The pre-tokens of a text, null like empty, in order; strings of `added` stand by themselves."""
    known = F.coalesce(text, F.lit(""))

    def cut(s: Column) -> Column:
        return F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))

    if not added:
        return cut(known)
    either = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    between, marks = F.split(known, either, -1), F.regexp_extract_all(known, F.lit(f"({either})"), F.lit(1))
    # A text that is split n times has n of the strings.
    return F.flatten(F.transform(between, lambda s, i: F.when(i > 0, F.concat(F.array(F.get(marks, i - 1)), cut(s))).otherwise(cut(s))))


def _edges(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among the elements of all, and their end; a null list is empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _id_column(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str, end: int | None = None, known: int = KNOWN) -> DataFrame:
    """(doc_id, tokens, n_tokens) of docs(doc_id, text), whose doc_ids are unique: ids by the tokenizer file at `path`, and `end` behind them if given."""
    pairs = load(path)
    each = docs.select("doc_id", pretokens(F.col("text").cast("string"), list(pairs.added)).alias("words"))
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_byte, p, seen = letters(), sent.value, {}

        def ids(word: str) -> list[int]:
            if (found := seen.get(word)) is None:
                found = [p.added[word]] if word in p.added else [p.ids[t] for t in merged("".join(by_byte[x] for x in word.encode()), p.ranks)]
                if len(seen) >= known:
                    seen.clear()
                if len(word) <= LONGEST:
                    seen[word] = found
            return found

        for b in batches:
            words = b.column(1).flatten().dictionary_encode()
            coded = pa.array([ids(w) for w in words.dictionary.to_pylist()], pa.list_(pa.int32())).take(words.indices)
            at = pa.array(_edges(coded)[_edges(b.column(1))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, coded.flatten())], names=["doc_id", "tokens"])

    made = each.mapInArrow(run, f"{_id_column(docs)}, tokens array<int>")
    tokens = F.col("tokens") if end is None else F.concat("tokens", F.array(F.lit(end)))
    return made.select("doc_id", tokens.alias("tokens")).select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"))


def vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of every id of the tokenizer file at `path`."""
    pairs, byte_of = load(path), {c: b for b, c in enumerate(letters())}
    found = {i: bytes(byte_of[c] for c in t) for t, i in pairs.ids.items() if t not in pairs.added}
    return found | {i: t.encode() for t, i in pairs.added.items()}


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows(doc_id, tokens), whose doc_ids are unique: the text that ids stand for, none for no ids; what isn't UTF-8 shows as U+FFFD, an id that isn't known as <id>."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            ids = b.column(1).flatten().dictionary_encode()
            piece = pa.array([known.get(i, b"<%d>" % i) for i in ids.dictionary.to_pylist()], pa.large_binary())
            each = piece.take(ids.indices)
            size = np.array([len(x) for x in piece.to_pylist()] + [0], dtype=np.int64)[ids.indices.fill_null(len(piece)).to_numpy(zero_copy_only=False)]
            # The pieces lie one behind another: a text is those between its ends.
            at = np.concatenate([[0], np.cumsum(size)])[_edges(b.column(1))]
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int64)), each.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([b.column(0), whole.cast(pa.binary())], names=["doc_id", "whole"])

    coded = rows.select("doc_id", F.col("tokens").cast("array<long>").alias("tokens"))
    return coded.mapInArrow(run, f"{_id_column(rows)}, whole binary").select("doc_id", F.make_valid_utf8(F.col("whole").cast("string")).alias("text"))
