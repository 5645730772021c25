import random
import re

import numpy as np
from siftwork.llm import langid

WORDS = {"en": "the and of water house that with from have this".split(), "de": "der und die wasser haus dass mit von haben diese".split(), "fr": "le et les eau maison que avec depuis avoir cette".split()}


def prose(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def setup(spark):
    rng = random.Random(3)
    docs = [(k, prose(rng, lang, 80), lang) for k, lang in enumerate(list(WORDS) * 40)]
    return rng, langid.fit(spark.createDataFrame([*docs, (999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string"))


def page(text, lang=None):
    return f"<html{f' lang={lang}-XX' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def test_evidence(spark):
    rng, model = setup(spark)
    rows = [(k, f"http://h{k % 7}.d.org/{lang}/x", page(prose(rng, lang, 30), lang)) for k, lang in enumerate(list(WORDS) * 20)]
    rows += [(500 + k, "http://only.german.de/x", page(prose(rng, "de", 30), "de")) for k in range(20)]
    rows += [(1000, "http://h1.d.org/fr/a", page(prose(rng, "fr", 40), "en")), (1001, "http://only.german.de/y", page("123")), (1002, None, page("zzz", "fr")), (1003, "http://h1.d.org/fr/b", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as host", "2 as o0")
    got = {r.page_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang == lang for k, lang in enumerate(list(WORDS) * 20))
    assert got[1000].lang == "fr"  # the text outweighs a wrong declaration
    assert got[1001].lang == "de"  # nothing but the host speaks
    assert got[1002].lang == "fr" and got[1003].lang == "fr"
    assert got[None].lang is not None and abs(got[0].probability - 1) < 0.05


def test_what_is_missing_says_nothing(spark):
    """Pages of one language declare it and those of another don't; a page of which nothing is known goes by the priors."""
    rng, model = setup(spark)
    rows = [(k, "http://h.d.org/x", page(prose(rng, "en", 30), "en")) for k in range(60)] + [(100 + k, "http://h.d.org/x", page(prose(rng, "de", 30))) for k in range(20)] + [(1000, None, None)]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert (got[1000].lang, got[1000].declared, got[1000].suffix) == ("en", "-", "-") and got[1000].probability > 0.6
    assert all(got[100 + k].lang == "de" for k in range(20))


def test_rare_language_is_known(spark):
    rng = random.Random(4)
    docs = [(k, prose(rng, "en" if k else "fr", 20), "en" if k else "fr") for k in range(60)]
    langs, logp = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=1)
    assert langs == ["en", "fr"] and logp.shape == (2, langid.DIM)


def test_empty(spark):
    _, model = setup(spark)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(none, model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    one = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert langid.identify(one, nothing).first().lang is None


def test_like_plain_python(spark):
    """The whole fusion again, page by page."""
    rng, (langs, logp) = setup(spark)
    n = len(langs)
    rows = []
    for k in range(60):
        lang = rng.choice(langs)
        url = rng.choice(["http://h{}.x.org/{}/p", "https://www.h{}.{}/p", "http://u@h{}.y.com:80/a?{}", None])
        rows.append((k, url and url.format(rng.randint(1, 3), lang), rng.choice([page(prose(rng, lang, rng.randint(0, 6)), rng.choice([None, lang, "xx", "en"])), None, ""])))
    weights = langid.html.model()
    seen = []
    for _, url, html in rows:
        m = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]*)(/[^?#]*)?", url or "")
        host = m[1].lower() if m else ""
        parts = host.split(".")
        named = re.match(r"/.*?([a-z]{2})(?=[/.]|$)", "") if not m else re.search(r"/([a-z]{2})(?=[-_/.?#]|$)", m[2] or "")
        suffix = named[1] if named and named[1] in langs else parts[-1] if parts[-1] in langs else "?" if len(parts) > 1 else "-"
        declared = re.search(r"<html lang=([a-z]+)", html or "")
        code = declared[1] if declared else "-"
        g = langid.grams(langid.html.main_text(html, weights))
        ll = logp @ g * min(1.0, langid.WEIGHT / g.sum()) if g.sum() else np.zeros(n)
        seen.append({"host": host, "domain": ".".join(parts[-2:]) if len(parts) > 1 else host, "suffix": suffix, "declared": code if code in langs or code == "-" else "?", "ll": ll - ll.max()})

    def normal(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    text = [normal(s["ll"]) for s in seen]

    def said(by, value):
        own = sum(t for s, t in zip(seen, text, strict=True) if s[by] == value)
        return np.log((own + langid.EVEN) / (sum(text) + langid.EVEN * (n + 2)))

    own = [s["ll"] + (0 if s["declared"] == "-" else said("declared", s["declared"])) + (0 if s["suffix"] == "-" else said("suffix", s["suffix"])) for s in seen]
    p = [normal(o) for o in own]
    want = {}
    for k, s in enumerate(seen):
        prior = np.full(n, 1.0 / n)
        for level in (None, "domain", "host"):
            rest = [p[j] for j, t in enumerate(seen) if j != k and (level is None or t[level] == s[level])]
            prior = (sum(rest, np.zeros(n)) + langid.STRENGTH * prior) / (len(rest) + langid.STRENGTH)
        final = normal(own[k] + np.log(prior + 1e-12))
        want[k] = (langs[int(np.argmax(np.round(final, 9)))], float(final.max()))
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), (langs, logp)).collect()
    for r in got:
        assert (r.host, r.declared, r.suffix) == tuple(seen[r.page_id][c] for c in ("host", "declared", "suffix")), rows[r.page_id]
        assert (r.lang, round(r.probability, 6)) == (want[r.page_id][0], round(want[r.page_id][1], 6)), (rows[r.page_id], seen[r.page_id])


def test_fit_like_plain_python(spark):
    rng = random.Random(8)
    docs = [(k, prose(rng, lang, 10), lang) for k, lang in enumerate(["en"] * 200 + ["de"] * 30)] + [(None, "nobody", "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, logp = langid.fit(table, sample=20)
    order = {r.doc_id: r.u for r in table.where("doc_id is not null").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {1 << 31}) as u").collect()}
    for i, lang in enumerate(langs):
        chosen = sorted((order[k], k, t) for k, t, x in docs if x == lang and k is not None)[:20]
        counts = sum(langid.grams(t) for *_, t in chosen) + 0.5
        assert np.allclose(logp[i], np.log(counts / counts.sum()))


def test_long_page(spark):
    _, model = setup(spark)
    text = "der und die wasser haus " * 50_000
    assert langid.identify(spark.createDataFrame([(1, None, page(text))], "page_id long, url string, html string"), model).first().lang == "de"
