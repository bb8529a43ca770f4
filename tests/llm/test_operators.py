"""Operators against brute force, exact round trips and held-out rows, with nulls, empty texts, ties, repeats and empty tables."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edittide.llm import ann, decontaminate, hosts, html, lengths, mixing, near, queries, quotes, toxicity, warc
from edittide.llm import words as W
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def _words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


def test_blocks_split_like_whole_texts(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A b\x0bC", "é" * 50] + [" ".join("".join(rng.choices("abé,Z0-", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    column = pa.array(texts)

    def run(kind):
        return [tuple(h[at[i] : at[i + 1]].tolist()) for _, rows, h, at in W.words(column, W.table(kind)) for i in range(rows)]

    for kind, pattern in (("space", rb"[^\x20\x09-\x0D]+"), ("alnum", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        monkeypatch.setattr(W, "BLOCK", 1 << 20)
        whole = run(kind)
        names = {}
        for t, got in zip(texts, whole):
            want = _words(t, pattern)
            assert len(want) == len(got)
            for w, h in zip(want, got):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)
        for block in (1, 7, 64):
            monkeypatch.setattr(W, "BLOCK", block)
            assert run(kind) == whole


def _contaminated(text, items, size=10):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = _words(text, pattern), set(), set()
    for i, t in items:
        v = _words(t, pattern)
        m = min(size, len(v))
        grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
        for k in range(len(w) - m + 1 if v else 0):
            if tuple(w[k : k + m]) in grams:
                hit |= set(range(k, k + m))
                found.add(i)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("shard", [500_000, 12])
def test_decontamination(spark, shard):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 4, 6, 9])))) for i in range(8)] + [(100, None), (9, "Q"), (None, "z z z z"), (8, "x y"), (8, "x y"), (7, " ".join(word() for _ in range(40)))]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + rng.choice(["", " q", " X y!", " z z z z z"])) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "a b")]
    i_df = spark.createDataFrame(items, "item_id long, text string")
    d_df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find(d_df, i_df, size=4, shard_words=shard).select("doc_id", "text", "found.n_words", decontaminate.hit_words().alias("n"), F.transform("found.items", lambda x: x.cast("string")).alias("items")).collect()
    assert len(found) == len(docs)
    for r in found:
        n, hit, ids = _contaminated(r["text"], items, 4)
        assert (r["n_words"], r["n"], sorted(r["items"])) == (n, hit, ids), r
    none = decontaminate.report(d_df, i_df.limit(0)).collect()
    assert all(r["n_hit"] == 0 and not r["contaminated"] and r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in none)
    assert decontaminate.report(d_df.limit(0), i_df).count() == 0


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten"
    text = "É before, " + item.upper().replace(" ", ", ") + " after it and quite some more words to keep the share low é"
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, item, "en", "s", 0), (3, "clean", "en", "s", 5), (4, None, None, None, None)], DOCS)
    out = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1]["text"] == "É before, \n after it and quite some more words to keep the share low é"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "clean" and out[4]["text"] is None


ARTICLE = "<article><h1>A &amp; B</h1><p>one<b> two</b>\n three<br>four<p>five</article>"


def test_html(spark):
    page = lambda body: f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class="ad">buy</div>{body}<footer>foot</footer>'
    rows = [(1, "http://a.org/1", page(ARTICLE)), (2, None, None), (3, "x", ""), (4, "http://a.org/2", page('<article><p>x</p><section class="comments"><p>no</p></section><form>f</form><script>var a="</p>";</script></article><aside>s</aside>'))]
    rows += [(10 + i, "http://b.org/", page(f"<div class=crumb>Always here</div><div class=text><p>Body {i} of words</p><p>More {i}</p></div><div class=tail><p>Note</p></div>")) for i in range(5)]
    rows += [(20, "http://c.org/", "<p>only < text"), (21, "http://c.org/", "<nav>menu<article>kept"), (10, "http://b.org/", rows[4][2])]
    got = {(r["page_id"]): r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\none two three four\nfive" and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"], got[4]["text"]) == ("", 0, "", "x")
    assert got[12]["text"] == "Body 2 of words\nMore 2"
    assert got[20]["text"] == "only < text" and got[21]["text"] == "kept"
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_by_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, html.extracted(pages).collect()))
    monkeypatch.setattr(html, "SENT", -1)
    assert sorted(map(tuple, html.extracted(pages).collect())) == want


def test_token_counts(spark):
    texts = [None, "", "a", "Hello, wörld!", "Hello, wörld!", " " * 50, "x" * 5000]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    own = lengths.encoding()
    n = [len(own.encode_ordinary(t or "")) for t in texts]
    assert sorted(r["n_tokens"] for r in sums) == sorted(set(n))
    for r in sums:
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_above"], r["tokens_above"], r["tokens_cut"]) == (n.count(k), sum(x > k for x in n), sum(x for x in n if x > k), sum(min(x, k) for x in n))
    table = spark.createDataFrame([tuple(r) for r in sums], "n_tokens long, n_docs long, docs_above long, tokens_above long, tokens_cut long, share_within double")
    assert lengths.quantile(table, 0.5).first()["n_tokens"] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert lengths.suffix_sums(lengths.histogram(spark.createDataFrame([], "text string"))).count() == 0


def test_long_white_space_counts(spark, monkeypatch):
    own = lengths.encoding()
    assert [lengths.counter(own)(t) for t in (" " * 5_000_000, "a" + " " * 5_000_000 + "b")] == [5_000_000, 5_000_001]
    monkeypatch.setattr(lengths, "RUN", 3)
    count, rng = lengths.counter(own), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices([" ", "\n", "\t", "\u00a0", "\u3000", "a", "é", "1", "!", "\x1c", "\u200b"], k=rng.randint(0, 25)))
        assert count(text) == len(own.encode_ordinary(text)), repr(text)


def test_suffix_rules(spark):
    names = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.github.io": "x.github.io", "10.0.0.1:80": "10.0.0.1", "[::1]": "[::1]", "foo.bar.ck": "foo.bar.ck", "a.www.ck": "www.ck", "u@h.com:80": "h.com", "": "", "a.b.": "a.b", "x." * 5000 + "org": "x.org"}
    df = spark.createDataFrame([(n, 1, 1) for n in names], "host string, n long, good long")
    assert {r["host"]: r["domain"] for r in hosts.placed(df).collect()} == names
    own = spark.createDataFrame([("b.org",), ("org",)], "rule string")
    assert {r["domain"] for r in hosts.placed(df.limit(0).unionByName(spark.createDataFrame([("z.a.b.org", 1, 1)], df.schema)), own).collect()} == {"a.b.org"}


def test_urls(spark):
    urls = ["http://Example.ORG/es/1", "http://a.example.org/en/12?x", "https://x.org", "https://x.org/", "http://y.com/fr/", "http://y.com/de/1", "http://notcom/de/", None, "none", "a://b://c/d#e", "http://u@h.com:80/q?/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    good = spark.createDataFrame([(10, True), (None, True), (9, False), (9, None)], "page_id long, good boolean")
    got = {r["page_id"]: r for r in hosts.judged(pages, good, queries.RULES).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(11)] == [("example.org", "/es/1"), ("a.example.org", "/en/12"), ("x.org", ""), ("x.org", "/"), ("y.com", "/fr/"), ("y.com", "/de/1"), ("notcom", "/de/"), ("", ""), ("", ""), ("b:", "//c/d"), ("u@h.com:80", "/q")]
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "example.org/en/1", None, "org/", "com/fr/", "com/de/", None, None, None, None, None]
    assert [got[i]["verdict"] for i in (0, 1, 3, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert hosts.judged(pages, good.limit(0), queries.RULES).count() == 12 and hosts.judged(pages.limit(0), good, queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    pages = [(i, "good.a.com") for i in range(50)] + [(100 + i, "bad.b.com") for i in range(50)] + [(200, "new.b.com"), (300, "once.a.com")]
    marks = [(i, True) for i in range(50)] + [(100 + i, i < 2) for i in range(50)] + [(300, False)]
    got = {r["host"]: r for r in hosts.reputation(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(marks, "page_id long, good boolean")).collect()}
    assert got["bad.b.com"]["mean"] < got["new.b.com"]["mean"] < got["good.a.com"]["mean"] and got["once.a.com"]["mean"] > got["bad.b.com"]["mean"]
    assert all(r["bound"] <= r["mean"] for r in got.values())


def test_quotes(spark):
    talk = [(1, 0, "user", "First line here.\nSecond, line!"), (1, 1, "assistant", "Answer one."), (1, 2, "user", "> first line HERE\n>> nothing known\nmy reply"), (1, 3, "assistant", ">> Second line\n> my reply\nok"), (1, 4, "user", "plain"), (2, 0, None, None), (None, 1, "user", "> x"), (1, 4, "user", "plain")]
    got = [tuple(r) for r in quotes.threads(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "text", "reply_to", "thread", "n_quoted", "n_linked").collect()]
    by = {(r[0], r[1]): r[2:] for r in got}
    assert len(got) == 8
    assert by[1, 2] == ("my reply", 0, 2, 2, 1) and by[1, 3] == ("ok", 2, 2, 2, 2) and by[1, 1] == ("Answer one.", 0, 1, 0, 0)
    assert by[1, 4] == ("plain", 3, 2, 0, 0) and by[2, 0] == (None, None, 1, 0, 0) and by[None, 1] == ("", None, 0, 1, 0)


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(900):
        bad, low = rng.random() < 0.2, rng.random() < 0.2
        w = rng.choices(vocabulary, k=60) + (rng.choices(["vile", "nasty"], k=3) if bad else []) + (["spam", "buy"] if low else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(not low), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(-1, None), (-2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows[:600]] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, queries.CATEGORIES)
    got = {r["doc_id"]: r["scores"] for r in toxicity.scored(docs, chain).collect()}
    wrong = sum(got[r[0]]["is_toxic"] != bool(r[3]) for r in rows[600:])
    assert wrong <= 3 and len(got) == 902 and not got[-1]["is_toxic"] and not got[-2]["is_toxic"]
    assert len(chain.weights[1]) == len(chain.words) + 2
    blank = toxicity.train(docs, labels.limit(0), queries.CATEGORIES)
    assert not any(r["scores"]["is_toxic"] for r in toxicity.scored(docs, blank).collect())
    many = docs.filter("doc_id = 3").crossJoin(spark.range(500).select()).unionByName(docs)
    again = toxicity.train(many, labels.unionByName(spark.createDataFrame([(10**6 + i, 1, 1) for i in range(5000)], labels.schema)), queries.CATEGORIES, fit_rows=600)
    assert (again.words == chain.words).all() and again.weights[1] == pytest.approx(chain.weights[1])


def _logistic(x, y, penalty):
    """Ridge logistic regression by Newton's method; penalty: of each column."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_chain_against_newton(spark):
    """The whole chain, out-of-fold probabilities included, against dense Newton steps."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        low = rng.random() < 0.4
        bad = rng.random() < (0.6 if low else 0.1)
        rows.append((i, " ".join(rng.sample("a b c d e f g h".split(), 4) + (["low"] if low and rng.random() < 0.9 else []) + (["bad"] if bad and rng.random() < 0.9 else [])), int(not low), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, queries.CATEGORIES)
    got = {r["doc_id"]: (r["scores"]["p_low_quality"], r["scores"]["p_toxic"]) for r in toxicity.scored(docs, chain).collect()}
    names = sorted({w for r in rows for w in r[1].split()})
    x = np.array([[w in r[1].split() for w in names] for r in rows], float)
    x = x[:, x.sum(0) <= 0.7 * len(rows)]
    fold = np.argsort(np.argsort(W.mix(np.arange(len(rows)).astype(np.uint64)), kind="stable"), kind="stable") % toxicity.FOLDS
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def fitted(x, extra, y):
        rate = y.mean()
        keep = np.abs(y @ x - x.sum(0) * rate) / np.sqrt(x.sum(0) * rate * (1 - rate)) >= 5
        dense = np.column_stack([x[:, keep], extra, np.ones(len(x))])
        w = _logistic(dense, y, np.array([0.3] * keep.sum() + [0.01] * extra.shape[1] + [1e-6]))
        return lambda x, extra: sigmoid(np.column_stack([x[:, keep], extra, np.ones(len(x))]) @ w)

    earlier, seen = np.zeros((len(rows), 0)), np.zeros((len(rows), 0))
    for c, y in enumerate((np.array([1 - r[2] for r in rows], float), np.array([r[3] for r in rows], float))):
        p = fitted(x, earlier, y)(x, seen)
        assert np.abs(p - np.array([got[i][c] for i in range(len(rows))])).max() < 0.02
        out = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            out[fold == f] = fitted(x[fold != f], earlier[fold != f], y[fold != f])(x[fold == f], earlier[fold == f])
        earlier, seen = np.column_stack([earlier, out]), np.column_stack([seen, p])


def _targets(sizes, weights, total, most):
    """Shares by weight, cut at the limits and shared again, round by round."""
    out, left = {}, total
    while len(out) < len(sizes):
        w = sum(weights[i] for i in range(len(sizes)) if i not in out)
        unit = left / w
        over = [i for i in range(len(sizes)) if i not in out and unit * weights[i] > most * sizes[i]]
        if not over:
            return [out.get(i, unit * weights[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
    return [out[i] for i in range(len(sizes))]


def test_mixing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), None, rng.choice(["a", "b", "é", None]), 0) for i in range(3000)] + [(None, None, None, "a", None)] + [(5, "x y", None, "a", 0)] * 70
    docs = spark.createDataFrame(rows, DOCS)
    run = lambda df: mixing.mixed(df, queries.SCHEDULES).collect()
    got = run(docs)
    assert len(got) == len(rows)
    names = ["a", "b", "é", None]
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s and r[1]) for s in names}
    want = _targets([size[s] for s in names], [5, 2, 1, 5], 1.5 * sum(size.values()), 2)
    for s, t in zip(names, want):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - t) <= 1 and all(r["target"] == pytest.approx(t) and r["source_size"] == size[s] for r in mine)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    monkeypatch.setattr(mixing, "BLOCK", 50)
    assert sorted(map(str, run(docs.repartition(7)))) == sorted(map(str, got))
    assert mixing.mixed(docs.limit(0), [mixing.constant(1)]).count() == 0


def test_many_sources(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 0, 1, 2, 5, 300, 2000]) for _ in range(500)]
    df = spark.createDataFrame([(f"s{i:03}", s, float([5, 2, 1][i % 3])) for i, s in enumerate(sizes)], "source string, source_size long, weight double").repartition(9)
    for share in (0.3, 1.0, 1.5, 1.9):
        got = [r["target"] for r in mixing.targets(df, share, 2.0).orderBy("source").collect()]
        assert got == pytest.approx(_targets(sizes, [[5, 2, 1][i % 3] for i in range(500)], share * sum(sizes), 2))


def test_curriculum_follows_its_schedule(spark):
    docs = spark.createDataFrame([(i, "w w", "en", "a", 3) for i in range(4000)], DOCS)
    at = sorted(r["position"] for r in mixing.mixed(docs, [mixing.ramp(2.0, 0.0)], share=1.0).collect())
    for share in (0.25, 0.5, 0.75):
        assert at[int(share * len(at))] == pytest.approx(1 - math.sqrt(1 - share), abs=0.01)


def _components(rows, k, percent):
    def of(text):
        w = _words(text)
        return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, of(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz")
    rows = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (None, "one"), (905, " \t"), (902, "one")]
    n = 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 150))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(int(rng.random() ** 2 * 0.12 * len(w))):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = [word()] if rng.random() < 0.7 else []
            if rng.random() < 0.2:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            base = w if rng.random() < 0.3 else base
            rows.append((n, " ".join(w)))
            n += 1
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert len(got) == len(rows)
    want = _components(rows, k, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hub_of_unlike_members(spark, monkeypatch):
    """5,000 texts that share half their words, so that few hubs hold most of them, and some pairs that are near only to each other."""
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, shared + [f"w{x}" for x in rng.integers(0, 1 << 40, 40)]) for i in range(5000)]
    for i in range(100, 5000, 100):
        w = list(rows[i][1])
        w[60 + i // 100 % 40] = "other"
        rows[i + 1] = (i + 1, w)
    rows = [(i, " ".join(w)) for i, w in rows]
    # pairs by the shingles that the shared words do not make: two texts that have none in common share 58 of 138 at most
    sets = {i: near_sets(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near_ids = {(a, b) for h in holders.values() if len(h) < 50 for a in h for b in h if a < b}
    want = {i: i for i in sets}
    for a, b in sorted(near_ids):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            want[b] = min(want[b], want[a])
    assert sum(a != b for a, b in want.items()) == 49
    fetched = []
    real = near._texts_of
    monkeypatch.setattr(near, "_texts_of", lambda ids, docs: fetched.append(ids.distinct().count()) or real(ids, docs))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert fetched[0] > 2500 and fetched[1] < 500  # most texts meet a hub, few are read again for the tiles


def near_sets(text, k=3):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_rows_that_share_an_id(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(20))
    rows = [(1, text("x")), (2, text("y")), (3, text("x")), (3, text("y")), (3, None), (4, text("z")), (4, text("z")), (5, text("z"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = {}
    for r in docs.withColumn("h", F.xxhash64("text")).collect():
        judged[r["doc_id"]] = max(judged.get(r["doc_id"], (-(1 << 63), None)), (r["h"], r["text"]), key=lambda x: x[0])
    want = _components([(i, t) for i, (_, t) in judged.items()], 5, 80)
    for n in (1, 3):
        got = near.near_duplicates(docs.repartition(n)).collect()
        assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(4)
    u = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    s = near.sketches(np.concatenate([u[:260], u[40:]]), np.array([0, 260, 520, 520]), 2000)
    assert abs((s[0] == s[1]).mean() - 220 / 300) < 0.05 and (s[2] == np.iinfo(np.uint64).max).all()


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in near.components(edges).collect()} == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).astype(np.float32) + 2 * rng.normal(size=(10, 16)).astype(np.float32)[rng.integers(0, 10, 3000)]
    x[2000:2600] = x[2000]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16), (5080, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 3000, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        score = y @ y[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(y)), -score))[:20]
        assert sorted(found) == list(range(1, 21)) and q not in {v for v, _ in found.values()}
        assert all(abs(s - score[v]) < 1e-9 for v, s in found.values())
        hits += sum(s >= score[order[-1]] - 1e-9 for _, s in found.values())
    assert hits / (20 * len(got)) >= 0.9
    assert [got[2000][r][0] for r in (1, 2)] == [2001, 2002] or got[2000][1][1] > y[2000] @ y[2000]
    assert ann.nearest(df.limit(0), df.limit(0), 20).count() == 0
    assert ann.nearest(df.filter("vec_id < 3"), df.filter("vec_id < 3"), 20).count() == 6


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\n b", "same"), (1, "http://b/", "same"), (7, None, None), (5, "u", ""), (9, "u", "é" * 100_000), (9, "u", "é" * 100_000), (2, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for page, url, text in rows:
        body = (text or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 5: ("response", None), 7: ("revisit", 5), 9: ("response", None), 2: ("response", None)}
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder, least=5, limit=300)
    some = {r["page_id"]: r for r in warc.read(index.filter("page_id in (1, 3, 9)"), folder).collect()}
    assert some[3]["kind"] == "response" and bytes(some[3]["payload"]) == b"same" and bytes(some[9]["payload"]).decode() == "é" * 100_000
    import gzip
    import os

    records = b"".join(gzip.decompress(open(f"{tmp_path}/w/{f}", "rb").read()) for f in os.listdir(tmp_path / "w") if f.endswith(".gz")).decode()
    by_page = {m[2]: m[1] for m in re.finditer(r"WARC-Record-ID: (\S+)\r\nX-Page: (\S+)", records)}
    assert len(set(by_page.values())) == len(by_page) == 6 and f"WARC-Refers-To: {by_page['1']}" not in records
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges_join_near_records():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 10), ("b", 0, 3)]
    assert list(warc.ranges(rows, gap=20, most=50)) == [("a", 0, 15, 0, 2), ("a", 100, 110, 2, 3), ("b", 0, 3, 3, 4)]
