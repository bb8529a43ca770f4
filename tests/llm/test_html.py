"""HTML extraction: classes by brute force, pages without names, deep nesting, null and odd rows."""

import random
import re
from collections import Counter

from edittide.llm import html

SF = "/root/testdata/sf0.001"
KIND = "page_id long, url string, html string"


def _run(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, KIND)).collect()}


def _stripped(page):
    """Without class names, and without the element that names the article."""
    return re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"</?article[^>]*>", "", page or ""))


def test_names_are_not_needed(spark):
    """On hosts of PAGES different pages or more."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()]
    want = _run(spark, pages)
    of = lambda url: re.sub(r"^.*?://([^/?#]*).*$", r"\1", url or "").lower()
    different = Counter(h for h, _ in {(of(u), want[i]) for i, u, _ in pages})
    large = {i for i, u, _ in pages if different[of(u)] >= html.PAGES}
    assert all(want.values()) and len(large) > 0.9 * len(pages)
    for other in (_stripped, lambda h: _stripped((h or "").replace("<article", "<div").replace("</article", "</div"))):
        got = _run(spark, [(i, u, other(h)) for i, u, h in pages])
        wrong = [i for i in large if got[i] != want[i]]
        assert len(wrong) <= 0.002 * len(large), (len(wrong), len(large), got[wrong[0]], want[wrong[0]])


def _templates(pages):
    """Text tokens of a host's template, by explicit occurrence vectors."""
    parsed = {}
    for p in pages:
        elements, blocks = html.parse(p)
        parsed["\n".join(b.text for b in blocks if b.role != "beside")] = elements, blocks
    vectors, above = {}, {}
    for i, (elements, blocks) in enumerate(parsed.values()):
        for t, n in elements.items():
            vectors.setdefault((0, t), {})[i] = n
        for t, n in Counter(b.token for b in blocks).items():
            vectors.setdefault((1, t), {})[i] = n
        above |= {b.token: b.above for b in blocks}
    return {t for (kind, t), v in vectors.items() if kind and len(v) >= html.PAGES and any(vectors[0, e] == v for e in above[t] if (0, e) in vectors)}


def test_classes_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for host in range(6):
        for i in range(rng.randint(1, 12)):
            parts = []
            for j in range(5):
                text = rng.choice([f"same {j}", f"same {j}", f"own {host} {i} {j}", f"few {j} {i % 3}"])
                parts.append(rng.choice(["<div><p>{}</p></div>", "<div class=s><p>{}</p></div>", "<section>{}</section>", "<ul><li>{}</li><li>x</li></ul>"]).format(text))
            rows.append((len(rows), f"http://h{host}.org/", "<body>" + "".join(parts[: rng.randint(1, 5)]) + f"<p>end {i} of {host}</p></body>"))
    rows += [(len(rows) + i, u, h) for i, (u, h) in enumerate([rows[0][1:], rows[0][1:]])]
    from pyspark.sql import functions as F

    from edittide.llm import hosts

    df = spark.createDataFrame(rows, KIND).select(hosts.host(F.col("url")).alias("host"), "page_id", "html")
    got = {}
    for r in html.templates(df)[0].collect():
        got.setdefault(r["host"], set()).add(r["token"])
    for host in range(6):
        assert got.get(f"h{host}.org", set()) == _templates([r[2] for r in rows if r[1] == f"http://h{host}.org/"])


def test_template_by_turns(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted(map(tuple, html.extracted(pages).collect()))
    monkeypatch.setattr(html, "SENT", -1)
    monkeypatch.setattr(html, "TURN", 5)
    assert sorted(map(tuple, html.extracted(pages).collect())) == want


def test_deep_and_odd_pages(spark):
    n = 100_000
    odd = ["<b>" * n + "deep", "<div>" * n + "deep" + "</div>" * n, "<div>" * 20_000 + "<p>deep" + "</x>" * n, "<p>&am<b>p;</b> &amp; x", None, "", "<", "<p", "plain", "<!--", "<script>x", "<p>a&nbsp;b \n c</p>"]
    got = _run(spark, [(i, f"http://h{i}/", h) for i, h in enumerate(odd)])
    assert [got[i] for i in range(len(odd))] == ["deep", "deep", "deep", "&amp; & x", "", "", "<", "<p", "plain", "", "", "a b c"]
