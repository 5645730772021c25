import math
import random
import re
from collections import Counter

import duckdb
import pytest

from siftwork.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
STOPS = ["the", "of", "and", "to", "in", "that", "is", "was"]


def plain_base(text):
    """The contract's counts, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def prose(rng, n):
    made = ["".join(rng.choice("aeioust") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    out = []
    for i in range(n):
        w = rng.choice(STOPS) if rng.random() < 0.4 else rng.choice(made)
        out.append((w.capitalize() if i % 12 == 0 else w) + ("." if i % 12 == 11 else "") + ("\n" if i % 60 == 59 else ""))
    return " ".join(out)


def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([20, 60, 150, 400])), "en") for i in range(60)]
    rows += [(100, " ".join(w + "&&&" for w in prose(rng, 200).split()), "en"), (101, " | ".join("".join(rng.choice("aeioust") for _ in range(7)) for _ in range(300)), "en")]
    rows += [(102, "wher " * 200, "en"), (103, "a b c\n" * 3 + "a b c", "en"), (104, None, "en"), (105, "", "en"), (106, " \n\t", None), (107, prose(rng, 300), None)]
    rows += [(108, "è é x y\x0bz\x1c 🙂 <b>", "fr"), (None, rows[0][1], "en"), (5, rows[5][1], "en"), (109, "q " * 60, "xx"), (110, prose(rng, 40_000), "en"), (111, "… " * 150, "en"), (112, "a a a a", "en")]
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    return quality.judge(spark.createDataFrame(corpus(), "doc_id long, text string, lang string")).collect()


def test_base_counts(judged):
    want = sorted(repr((i, *plain_base(t))) for i, t, _ in corpus())
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in judged) == want


def test_verdicts(judged):
    by = {r.doc_id: r for r in judged}
    assert all(by[i].kept == (by[i].n_words >= 50) for i in range(60))
    assert not by[100].kept and by[100].char_distance > quality.MOST_CHARS
    assert not by[101].kept and by[101].word_distance > quality.MOST_WORDS
    assert by[102].base_failed and not by[102].kept
    # Without a language there is no distance, and short texts have none.
    assert by[107].kept and by[107].char_distance is None and by[107].word_distance is None
    assert by[103].char_distance is None and by[103].word_distance is None
    assert by[109].char_distance is None


def test_like_sql(judged):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, None if t is None else t, k) for i, t, k in corpus()])
    got = sorted(repr(tuple(r)) for r in judged)
    want = con.execute(f"select {', '.join(judged[0].__fields__)} from ({quality.ORACLE})").fetchall()
    assert got == sorted(map(repr, want))


def test_distance():
    import numpy as np

    assert quality.distance(np.array([1, 0]), np.array([0, 5])) == 1
    assert quality.distance(np.array([2, 6]), np.array([1, 3])) == 0
    p, q = (0.5, 0.5), (0.1, 0.9)
    want = sum(a * math.log2(2 * a / (a + b)) + b * math.log2(2 * b / (a + b)) for a, b in zip(p, q)) / 2
    assert abs(quality.distance(np.array([5, 5]), np.array([1, 9])) - math.sqrt(want)) < 1e-12


def test_tasks_that_hold_few_words(spark, judged, monkeypatch):
    monkeypatch.setattr(quality, "HELD", 10)
    got = quality.judge(spark.createDataFrame(corpus(), "doc_id long, text string, lang string")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, judged))


def test_empty_tables_and_other_columns(spark):
    schema = "doc_id long, text string, lang string, n_words int, word string, kind string, n int, total int"
    assert quality.judge(spark.createDataFrame([], schema)).collect() == []
    (r,) = quality.judge(spark.createDataFrame([(1, "x " * 99, "en", 1, "w", "k", 1, 1)], schema)).collect()
    assert (r.doc_id, r.n_words, r.n_repeat_words, r.kept) == (1, 99, 99, False)
    (r,) = quality.judge(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).collect()
    assert (r.n_words, r.char_distance) == (2, None)
