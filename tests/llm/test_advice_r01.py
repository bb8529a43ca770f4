
import numpy as np

from edittide.llm import ann, html, quotes


def _unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _check_nearest(spark, x, k, step):
    """Every result equals brute force."""
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter(f"vec_id % {step} = 0"), k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(np.float64)
    short = missed = 0
    for q in range(0, len(x), step):
        score = y @ y[q]
        score[q] = -np.inf
        want = np.sort(score)[::-1][: min(k, len(x) - 1)]
        found = [got.get(q, {}).get(r + 1) for r in range(len(want))]
        short += None in found
        missed += sum(f is None or abs(score[f[0]] - w) > 1e-9 for f, w in zip(found, want))
    return short, missed


def test_nearest_with_more_lists_than_probes(spark):
    rng = np.random.default_rng(5)
    x = _unit(rng.normal(size=(12_000, 32)))
    assert _check_nearest(spark, x, 20, 60) == (0, 0)


def test_nearest_of_small_tight_groups(spark):
    rng = np.random.default_rng(6)
    centres = np.repeat(rng.normal(size=(300, 32)), 15, axis=0)
    x = _unit(centres + 0.02 * rng.normal(size=centres.shape))
    assert _check_nearest(spark, x, 20, 15) == (0, 0)


def test_nearest_of_norms_that_vary(spark):
    """Over 200 lists, more than a search reads, keeps or enters by; norms log-normal."""
    rng = np.random.default_rng(7)
    x = (_unit(rng.normal(size=(20_000, 48))) * rng.lognormal(sigma=0.7, size=(20_000, 1))).astype(np.float32)
    assert len(x) // ann.LIST > 200 > max(ann.PROBES, ann.KEPT, ann.ENTRIES)
    assert _check_nearest(spark, x, 20, 100) == (0, 0)


def test_nearest_ties_by_id(spark):
    rows = [(0, [1.0, 0.0])] + [(100 + j, [1.0, float(j)]) for j in range(1, 201)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        for exact in (True, False):
            got = ann.nearest(df, df.filter("vec_id = 0"), 5, exact).orderBy("rank").collect()
            assert [r["vec_id"] for r in got] == [101, 102, 103, 104, 105] or not exact and len(got) == 5


def test_nearest_of_doubles(spark):
    a = 1.0 + 2.0**-40
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [a, 0.0]), (3, [a, 0.0]), (4, [2.0, 0.0]), (4, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.filter("vec_id = 1"), 9).orderBy("rank").collect()]
    assert got == [(1, 1, 3, a), (1, 2, 2, 1.0), (1, 3, 4, 0.5)]


def _texts(spark, bodies):
    rows = [(i, "http://a.org/", f"<html><body><nav>Home {i}</nav>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_template_inside_named_article(spark):
    bodies = [f"<article><div class=teaser>Read all we have</div><h1>Head {i}</h1><p>Body {i}</p><p>Ends here for all</p></article>" for i in range(4)]
    assert _texts(spark, bodies) == [f"Head {i}\nBody {i}" for i in range(4)]


def test_every_varying_slot(spark):
    split = [f"<div class=lead><p>Lead {i}</p></div><div class=text><p>Long body {i} with many more words</p></div>" for i in range(4)]
    other = [f"<section class=b><p>Other layout {i}</p></section>" for i in range(4)]
    want = [f"Lead {i}\nLong body {i} with many more words" for i in range(4)] + [f"Other layout {i}" for i in range(4)]
    assert _texts(spark, split + other) == want


def test_copies_are_no_template(spark):
    copy = "<div class=copied><h1>Head</h1><p>Only body</p></div>"
    assert _texts(spark, [copy] * 4) == ["Head\nOnly body"] * 4
    assert _texts(spark, [copy] * 4 + [f"<div class=own><p>Mine {i}</p></div>" for i in range(3)])[:4] == ["Head\nOnly body"] * 4


def _ordered(spark, texts):
    talk = [(1, i, "user", t) for i, t in enumerate(texts)]
    rows = quotes.threads(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()
    return [(r["turn"], r["reply_to"], r["thread"], r["position"]) for r in sorted(rows, key=lambda r: (r["thread"], r["position"]))]


def test_interleaved_replies(spark):
    texts = ["zero", "one", "two", "> zero\nthree", "> one\nfour", "> three\nfive"]
    assert _ordered(spark, texts) == [(0, None, 1, 1), (1, 0, 1, 2), (2, 1, 1, 3), (4, 1, 2, 1), (3, 0, 3, 1), (5, 3, 3, 2)]


def test_two_long_interleaved_threads(spark):
    n = 21
    texts = ["root", "a1", "> root\na2"] + [f"> a{i - 2}\na{i}" for i in range(3, n)]
    got = _ordered(spark, texts)
    assert [g[0] for g in got] == [0, *range(1, n, 2), *range(2, n, 2)]
    assert [g[2:] for g in got[:11]] == [(1, i + 1) for i in range(11)] and [g[2:] for g in got[11:]] == [(2, i + 1) for i in range(10)]
