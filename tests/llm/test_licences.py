import pathlib

import duckdb
import pandas as pd
import pytest

from siftwork.llm import licences

APACHE = pathlib.Path("/usr/share/common-licenses/Apache-2.0")
MIT = """MIT License

Copyright (c) 2020 Someone Permission is hereby granted, free of
charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""


def scan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, directory string, text string").selectExpr("doc_id", "directory", "text", "1 as id", "2 as licence", "3 as word")
    return {r.doc_id: (r.licence, r.origin) for r in licences.scan(docs).collect()}


def test_scan(spark):
    prose = "the free software we use has a licence and a copyright but this is a long line of prose about many other things that nobody would call a notice " * 3
    rows = [
        (1, "a", "MIT License"),
        (2, "a/b", "code\nLicensed under the Apache License, Version 2.0\nmore code"),
        (3, "a/c/d", "plain"),
        (4, "a/b", "word " * 400),
        (5, "e", prose),
        (6, "e", "w " * 500 + "\nReleased under the MIT License."),
        (7, "e", None),
        (8, None, "Licensed under CC BY-NC 4.0"),
        (9, None, ""),
        (None, "a", ""),
    ]
    got = scan(spark, rows)
    assert got == {
        1: ("MIT", "own"), 2: ("Apache-2.0", "own"), 3: ("MIT", "inherited"), 4: ("Apache-2.0", "inherited"), 5: (None, None),
        6: ("MIT", "own"), 7: (None, None), 8: ("CC-BY-NC", "own"), 9: (None, None), None: ("MIT", "inherited"),
    }


def test_every_word_has_its_weight(spark):
    rare = " ".join(f"rare{k}" for k in range(20))
    rows = [(1, "a", f"copy associated documentation free charge {rare}"), (2, "b", "Released under the MIT License."), *((k, "c", "word") for k in range(3, 300))]
    assert {k: v for k, v in scan(spark, rows).items() if v[0]} == {2: ("MIT", "own")}


@pytest.mark.skipif(not APACHE.exists(), reason="no full text")
def test_full_texts_are_licence_files(spark):
    long = "the water of the old house ran over many green stones in summer " * 20
    rows = [(1, "a", MIT), (2, "a", "x"), (3, "b", APACHE.read_text()), (4, "b/c", "x"), (5, "d", f"{long}\nReleased under the MIT License."), (6, "d", "x")]
    assert len(MIT.split()) > licences.FILE_WORDS
    assert scan(spark, rows) == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 5: ("MIT", "own"), 6: (None, None)}


def test_empty(spark):
    assert scan(spark, []) == {}
    assert scan(spark, [(1, "x", "MIT License"), (1, "x", "MIT License")]) == {1: ("MIT", "own")}


def test_null_ids_and_long_texts(spark):
    rows = [(None, "a", "Released under the MIT License."), (None, "b", "nothing here"), (None, "b", "nothing here"), (1, "b", "word " * 300_000 + "\nReleased under the MIT License."), (1, "b", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, directory string, text string")
    got = sorted((str(r.doc_id), str(r.directory), str(r.licence), str(r.origin)) for r in licences.scan(docs).collect())
    assert got == [("1", "b", "MIT", "own"), ("1", "b", "MIT", "own"), ("None", "None", "None", "None"), ("None", "a", "MIT", "own"), ("None", "b", "MIT", "inherited"), ("None", "b", "MIT", "inherited")]


@pytest.mark.skipif(not APACHE.exists(), reason="no full text")
def test_full_texts_like_sql(spark):
    """Full texts, with words of their own around them or between, whole in one line, beside prose with words of theirs and notices."""
    apache, prose = APACHE.read_text(), "the software of the old house has a licence and its terms run over many green stones in summer " * 30
    texts = [MIT, MIT.upper() + "\nrare words of one file", MIT.replace("\n", " "), apache, apache + prose, prose + MIT, prose, f"{prose}\nLicensed under the BSD License", "Licensed under the BSD License", "", None, "\u043b\u0438\u0446\u0435\u043d\u0437\u0438\u044f " * 200]
    rows = [(k, t, "en" if k % 3 else "de", f"s{k % 5}/{'x' if k % 2 else 'y'}", len(t or "")) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = licences.scan(docs.select("doc_id", licences.directory_of_documents().alias("directory"), "text"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=docs.columns))
    want = con.execute(licences.oracle())
    columns = [d[0] for d in want.description]
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in want.fetchall())
    own = {r.doc_id: r.licence for r in got.where("origin = 'own'").collect()}
    assert {k: own.get(k) for k in range(12) if k != 5} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 6: None, 7: "BSD", 8: "BSD", 9: None, 10: None, 11: None}


@pytest.mark.skipif(not APACHE.exists(), reason="no full text")
def test_profiles_by_rule():
    found = {name: terms for name, whole, terms in licences.templates() if whole and name in ("MIT", "Apache-2.0")}
    assert found == {"MIT": licences.profile(MIT), "Apache-2.0": licences.profile(APACHE.read_text())}


def test_equal_ids_keep_their_lines_apart(spark):
    rows = [(1, "a", "Released under the MIT License."), (1, "a", "long prose that has nothing to do with any such thing " * 5), (2, "b", "nothing")]
    assert scan(spark, rows) == {1: ("MIT", "own"), 2: (None, None)}
