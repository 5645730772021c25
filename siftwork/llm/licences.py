"""Licence scan: TF-IDF cosine of lines and of whole texts to licence templates, then inheritance from the nearest licensed directory.

Everything is a DataFrame expression. A line or text is a vector over all its words (common ones aside), so that prose which mentions a
licence isn't one. Document frequencies come from grouped counts over all documents. A cosine is first bounded inside the row, by the
templates' own terms and the number of other words, each of which adds 1 to a squared length at least; only lines and texts that may reach
the threshold have their other words looked up.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines at least this similar to a notice carry its licence.
COSINE = 0.6
#: Whole texts at least this similar to the profile of a licence's full text are that licence's text.
FULL_TEXT = 0.7
#: Rows that are sent to every executor rather than joined by shuffles.
FEW = 200_000
#: A document of at most so many words with a notice is a licence file, as is a licence's full text; its licence is that of its directory too.
FILE_WORDS = 150
#: Terms in the profile of a full text.
PROFILE = 20

# The usual short notices of these licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 public domain dedication"),
)
# The most frequent terms of these licences' full texts and their counts, as `profile` gives them (two versions of the GPL).
FULL = (
    ("MIT", "software 9 copyright 3 copies 2 copy 2 including 2 notice 2 permission 2 above 1 action 1 arising 1 associated 1 authors 1 charge 1 claim 1 conditions 1 connection 1 contract 1 damages 1 deal 1 dealings 1"),
    ("Apache-2.0", "license 35 works 19 derivative 18 conditions 13 copyright 13 contributor 10 entity 10 licensor 10 mean 10 including 9 notice 9 terms 9 contribution 8 notices 8 within 8 patent 7 apache 6 modifications 6 object 6 otherwise 6"),
    ("GPL", "license 102 covered 41 terms 32 copyright 30 software 27 convey 26 copy 25 public 25 version 25 corresponding 23 general 23 patent 23 gnu 22 object 21 product 21 free 20 rights 19 means 18 conveying 15 section 15"),
    ("GPL", "license 46 software 35 free 28 distribute 19 copy 18 terms 18 distribution 16 public 16 general 15 copyright 14 conditions 13 version 13 warranty 13 based 12 rights 11 foundation 10 make 9 section 9 copies 8 gnu 8"),
    ("BSD", "conditions 3 contributors 3 copyright 3 including 3 provided 3 regents 3 software 3 above 2 binary 2 disclaimer 2 implied 2 liability 2 limited 2 list 2 notice 2 redistributions 2 university 2 warranties 2 advised 1 arising 1"),
    ("MPL-2.0", "license 69 software 39 covered 36 contributor 35 terms 20 means 18 version 17 rights 14 licenses 13 secondary 12 notice 11 section 11 patent 10 distribute 9 granted 9 liability 9 claims 8 contributions 8 limitation 8 warranty 8"),
    ("CC0", "rights 22 affirmer 17 copyright 11 related 11 including 9 commons 8 law 8 purpose 8 applicable 7 cc0 7 creative 7 waiver 7 license 6 document 5 future 5 legal 5 limitation 5 purposes 5 works 5 action 4"),
)
STOP = frozenset("a all and are as at by can except file files for from has in is it may met modify not of on or org http www person source that the this to use v with you work code forms form program any following extent possible under 0 2 3 4".split())
#: Left out of whole texts.
COMMON = STOP | frozenset(
    """a about all also an and any are as at be been but by c can did do does each for from had has have he her here his i if in into is it its may me more
    most must my no not of on one only or other our out over s shall she should so some such than that the their then there these they this those to two
    under up was we were what when where which who whom will with without would you your""".split()
)
TERM = "[a-z0-9]+"


def _words(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def profile(text: str) -> dict[str, int]:
    """The most frequent terms of a full text, of two characters or more and not numbers, with their counts; ties by name."""
    found = Counter(w for w in _words(text) if w not in COMMON and len(w) > 1 and not w.isdigit())
    return dict(sorted(found.items(), key=lambda wn: (-wn[1], wn[0]))[:PROFILE])


def templates() -> list[tuple[str, bool, dict[str, int]]]:
    """(licence, whether it is for whole texts, count of each term)."""
    notices = [(name, False, dict(Counter(w for w in _words(text) if w not in STOP))) for name, text in TEMPLATES]
    parts = [(name, text.split()) for name, text in FULL]
    return notices + [(name, True, {w: int(n) for w, n in zip(p[::2], p[1::2])}) for name, p in parts]


def vocabulary(whole: bool | None = None) -> list[str]:
    """The terms of the templates: all of them, or those for whole texts, or for lines."""
    return sorted({w for _, kind, terms in templates() for w in terms if whole in (None, kind)})


def _lower(text: Column) -> Column:
    """a-z for A-Z, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text() -> Column:
    return _lower(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _all(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _id() -> Column:
    """What a document is known by: its doc_id, or where that is null its text, which alone decides about its licence."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _few(rows: DataFrame) -> DataFrame:
    """rows, sent to every executor where they are few: then the texts that they are joined with stay where they are."""
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _idf(total: int, df: Column) -> Column:
    return F.log((1.0 + total) / (1.0 + df)) + 1.0


def units(docs: DataFrame) -> DataFrame:
    """(id, whole, words): the lines that have a term of a notice, and every whole text; words without the common ones, in order."""
    rows = docs.select(_id().alias("id"), F.transform(F.split(_text(), "\n"), _all).alias("lines"))
    told = F.filter("lines", lambda words: F.exists(words, lambda w: w.isin(*vocabulary(whole=False))))
    line = F.transform(told, lambda words: F.struct(F.lit(False).alias("whole"), F.filter(words, lambda w: ~w.isin(*sorted(STOP))).alias("words")))
    text = F.struct(F.lit(True).alias("whole"), F.filter(F.flatten("lines"), lambda w: ~w.isin(*sorted(COMMON))).alias("words"))
    return rows.select("id", F.inline(F.concat(F.array(text), line)))


def near(docs: DataFrame, idf: dict[str, float], cosine: float) -> DataFrame:
    """(id, whole, words, known, licence, score, least) of the units and templates whose cosine may be `least` or more.

    known is the squared length of a unit over the templates' terms, score its inner product with the template over the template's length.
    """
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    hits = units(docs).withColumn("hits", F.filter("words", lambda w: w.isin(*idf)))
    valued = hits.withColumn("valued", F.transform(F.array_distinct("hits"), lambda w: F.struct(w.alias("word"), (F.size(F.filter("hits", lambda x: x == w)) * weight[w]).alias("value"))))
    sized = valued.withColumn("known", F.aggregate("valued", F.lit(0.0), lambda acc, v: acc + v["value"] * v["value"]))

    def score(terms: dict[str, int]) -> Column:
        length = sum((n * idf[w]) ** 2 for w, n in terms.items()) ** 0.5
        share = F.create_map(*[F.lit(x) for w, n in terms.items() for x in (w, n * idf[w] / length)])
        return F.aggregate("valued", F.lit(0.0), lambda acc, v: acc + v["value"] * F.coalesce(F.try_element_at(share, v["word"]), F.lit(0.0)))

    def scores(kind: bool) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("licence"), score(terms).alias("score")) for name, whole, terms in templates() if whole == kind])

    least = F.when(F.col("whole"), FULL_TEXT).otherwise(cosine)
    bound = F.sqrt(F.col("known") + F.size("words") - F.size("hits"))
    fits = F.filter(F.when(F.col("whole"), scores(True)).otherwise(scores(False)), lambda s: (s["score"] > 0) & (s["score"] >= (least - 1e-6) * bound))
    return sized.where(F.size("hits") > 0).select("id", "whole", "words", "known", least.alias("least"), F.inline(fits))


def frequencies(words: Column, docs: DataFrame) -> DataFrame:
    """(word, df): how many documents have each of the words, an array for every row of docs."""
    return docs.select(_id().alias("id"), F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count_distinct("id").alias("df"))


def detect(docs: DataFrame, total: int, cosine: float = COSINE) -> DataFrame:
    """(id, licence, cosine, full) of the documents, total in all, with a line or text that is similar enough to a template.

    The best line or text and template count, ties to the first name; full: the whole text is that of a licence.
    """
    known = vocabulary()
    # One row a term of the templates, whose number is that of the lists above.
    seen = dict(frequencies(F.filter(_all(_text()), lambda w: w.isin(*known)), docs).select("word", _idf(total, F.col("df"))).collect())
    unseen = docs.sparkSession.range(1).select(_idf(total, F.lit(0))).first()[0]
    close = near(docs, {w: seen.get(w, unseen) for w in known}, cosine).withColumn("key", F.md5(F.concat_ws(" ", "words"))).checkpoint()
    # Equal lines have equal words: each is looked up once.
    once = close.select("key", "words").dropDuplicates(["key"])
    others = once.select("key", F.explode(F.filter("words", lambda w: ~w.isin(*known))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n")).checkpoint()
    every = docs.select(_id().alias("id"), F.explode(F.array_distinct(_all(_text()))).alias("word"))
    df = every.join(_few(others.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count_distinct("id").alias("df"))
    value = F.col("n") * _idf(total, F.col("df"))
    rest = others.join(df, "word").groupBy("key").agg(F.sum(value * value).alias("rest"))
    scored = close.select("id", "whole", "key", "known", "least", "licence", "score").join(rest, "key", "left")
    exact = scored.withColumn("cosine", F.round(F.col("score") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0))), 6)).where("cosine >= least")
    best = exact.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence", "cosine")).alias("b"), F.bool_or("whole").alias("full"))
    return best.select("id", "b.licence", "b.cosine", "full")


def scan(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, directory, licence, cosine, origin ('own', 'inherited' or null) for every row of files(doc_id, directory, text).

    A file has the licence of its best line or of its whole text, or else that of the nearest directory above it, its own first, that holds
    a licence file: a file with a licence of its own that is short or a licence's full text; of several the one of the smallest doc_id
    counts. A null or empty text has no licence of its own; a null directory has none to inherit and gives none; rows of equal doc_id share
    what is found in any of them, rows without doc_id only with rows of the same text; texts are read whole, however long; repeated rows
    are rows like others; other columns are ignored; an empty table gives no rows. Words are runs of a-z and 0-9; others don't count.
    """
    files = files.select("doc_id", "directory", "text")
    n_words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^ \\t\\n\\r]+"))
    slim = files.select("doc_id", _id().alias("id"), F.col("directory").cast("string").alias("directory"), (n_words <= FILE_WORDS).alias("short")).checkpoint()
    known = slim.join(detect(files, slim.count(), cosine).checkpoint(), "id", "left")
    first = F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "id", "licence")).alias("first")
    given = known.where("licence is not null and (short or full)").groupBy("directory").agg(first).select(F.col("directory").alias("above"), F.col("first.licence").alias("above_licence"))
    parts = F.split("directory", "/")
    ways = slim.where("directory is not null").select("directory").distinct()
    steps = ways.select("directory", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = steps.join(given, "above").groupBy("directory").agg(F.max(F.struct("depth", "above_licence")).alias("n")).select("directory", F.col("n.above_licence").alias("inherited"))
    out = known.join(nearest, "directory", "left")
    return out.select("doc_id", "directory", F.coalesce("licence", "inherited").alias("licence"), "cosine", F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"))


def directory_of_documents() -> Column:
    """source for English documents and source/lang for others: the directories that the table documents stands for."""
    return F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """`scan` over the table documents, in DuckDB's SQL."""
    entries = ", ".join(f"({k}, {_sql(name)}, {str(whole).lower()}, {_sql(w)}, {float(n)}::double)" for k, (name, whole, terms) in enumerate(templates()) for w, n in sorted(terms.items()))
    stop, common = (", ".join(_sql(w) for w in sorted(words)) for words in (STOP, COMMON))
    notices = ", ".join(_sql(w) for w in vocabulary(whole=False))
    return f"""
with d as (select doc_id, coalesce(doc_id, -9223372036854775808) as id, case when lang = 'en' then source else concat_ws('/', source, lang) end as directory,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    t(template, licence, whole, word, tf) as (values {entries}),
    l as (select id, regexp_extract_all(unnest(string_split(text, chr(10))), '{TERM}') as words from d),
    u as materialized (select row_number() over () as unit, * from (
        select id, false as whole, list_filter(words, lambda w: w not in ({stop})) as words from l where len(list_filter(words, lambda w: w in ({notices}))) > 0
        union all select id, true, list_filter(regexp_extract_all(text, '{TERM}'), lambda w: w not in ({common})) from d)),
    n as (select unit, id, whole, word, count(*) as n from (select unit, id, whole, unnest(words) as word from u) group by all),
    e as (select word, count(distinct id) as df from (select id, unnest(list_distinct(regexp_extract_all(text, '{TERM}'))) as word from d) group by word),
    i as (select word, ln((1.0::double + (select count(*) from d)) / (1.0::double + coalesce(df, 0))) + 1.0::double as idf
        from (select word from e union select word from t) left join e using (word)),
    g as (select template, licence, whole, word, tf * idf as weight from t join i using (word)),
    h as (select template, sqrt(sum(weight * weight)) as t_length from g group by template),
    v as (select unit, id, whole, word, n * idf as value from n join i using (word)),
    z as (select unit, sqrt(sum(value * value)) as length from v group by unit),
    p as (select unit, id, whole, template, licence, sum(value * weight) as dot from v join g using (word, whole) group by all),
    c as (select id, whole, licence, round(dot / (length * t_length), 6) as cosine from p join z using (unit) join h using (template)),
    m as (select * from c where cosine >= case when whole then {FULL_TEXT} else {COSINE} end),
    o as (select id, arg_min(licence, (-cosine, licence)) as licence, max(cosine) as cosine, bool_or(whole) as is_full from m group by id),
    k as (select d.doc_id, d.id, d.directory, o.licence, o.cosine, o.is_full or len(regexp_extract_all(d.text, '[^ \\t\\n\\r]+')) <= {FILE_WORDS} as gives from d left join o using (id)),
    a as (select directory as above, arg_min(licence, id) as above_licence from k where licence is not null and gives group by directory),
    y as (select directory, string_split(directory, '/') as parts from (select distinct directory from k where directory is not null)),
    x as (select directory, depth, array_to_string(parts[1:depth], '/') as above from (select directory, parts, unnest(range(1, len(parts) + 1)) as depth from y)),
    q as (select directory, arg_max(above_licence, depth) as inherited from x join a using (above) group by directory)
select doc_id, directory, coalesce(licence, inherited) as licence, cosine,
    case when licence is not null then 'own' when inherited is not null then 'inherited' end as origin from k left join q using (directory)
"""
