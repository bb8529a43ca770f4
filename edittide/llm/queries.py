"""Registered queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from edittide.llm import ann, decontaminate, hosts, html, lengths, mixing, near, quotes, toxicity, warc
from edittide.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def op8_near_duplicates(spark, sf_dir):
    """Components of documents linked at 85 % over three-word shingles."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


#: What ends a word of the decontamination query.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW.format("text")}, ''), '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all(coalesce({_LOW.format("text")}, ''), '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
s AS (SELECT DISTINCT m FROM i),
e AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, s WHERE len(w) >= m)),
h AS (SELECT doc_id, e.m AS m, k, item_id FROM e JOIN g ON e.m = g.m AND e.g = g.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
)
def op1_decontamination(spark, sf_dir):
    """Documents that hold ten words of a benchmark item in a row."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Categories as conditions on the labels table, in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


@query()
def op6_toxicity(spark, sf_dir):
    """Every document's category probabilities; toxic: what the chain flags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.scored(docs, chain).select("doc_id", "scores.p_low_quality", "scores.p_toxic", F.col("scores.is_toxic").alias("toxic"))


#: Weights over training time of the sources in turn: falling, level, rising. Their integrals are 5, 2 and 1.
SCHEDULES = (mixing.ramp(6.0, 4.0), mixing.constant(2.0), mixing.ramp(0.5, 1.5))
_KNOTS = " ".join(f"WHEN {i} THEN {{'w': {s[0][1]}, 'm': {s[1][1] - s[0][1]}, 'z': {mixing.area(s)}}}" for i, s in enumerate(SCHEDULES))


@query(
    f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 {_KNOTS} END AS k FROM p),
o AS (SELECT *, 2.0 * source_size AS cap, sum(2.0 * source_size) OVER w AS until, sum(k.z) OVER w AS gone FROM n WINDOW w AS (ORDER BY source_size / k.z, encode(source) NULLS FIRST ROWS UNBOUNDED PRECEDING)),
u AS (SELECT max((1.5 * (SELECT sum(source_size) FROM p) - (until - cap)) / ((SELECT sum(k.z) FROM n) - (gone - k.z))) AS unit FROM o),
t AS (SELECT source, source_size, k, CAST(least(cap, unit * k.z) AS DOUBLE) AS target FROM o, u),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', doc_id, size)), 1, 15) AS BIGINT) AS h FROM d),
e AS (SELECT h.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS e FROM h),
f AS (SELECT doc_id, e.source, size, source_size, target, k, floor((e - size) * (target / nullif(source_size, 0))) AS a, floor(e * (target / nullif(source_size, 0))) AS b FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, a / nullif(target, 0) * k.z AS c FROM f)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(b - a, 0) AS BIGINT) AS taken,
  CASE WHEN b > a THEN round(2 * c / (k.w + sqrt(greatest(k.w * k.w + 2 * k.m * c, 0))), 6) END AS position FROM g"""
)
def op7_mixing(spark, sf_dir):
    """Sources mixed 5 : 2 : 1 in turn to 150 % of all words, none beyond two passes."""
    return mixing.mixed(table(spark, sf_dir, "documents"), SCHEDULES).withColumn("position", F.round("position", 6))


@query()
def op3_token_counts(spark, sf_dir):
    """Documents by encoded length, with suffix sums for every context limit."""
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents")))


#: Rules of the url query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


_SUFFIXES = ", ".join(f"('{r.removeprefix('!').removeprefix('*.')}', {-1 if r[0] == '!' else 1 if r[0] == '*' else 0})" for r in hosts.SUFFIX_RULES)
_FITS = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)


def _moments(level: str) -> str:
    """One row (s): prior strength of a level of (n, good)."""
    return f"""(SELECT CASE WHEN coalesce(t, 0) = 0 OR k < 2 THEN 10.0 WHEN spread > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / spread - 1)) ELSE 1000.0 END AS s FROM (
  SELECT *, (gg - t * m * m - (k - 1) * m * (1 - m)) / greatest(t - nn / t, 1e-9) AS spread FROM (
    SELECT CAST(sum(n) AS DOUBLE) AS t, sum(good) / sum(n) AS m, CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(good * good AS DOUBLE) / n) AS gg, count(*) AS k FROM {level} WHERE n > 0)))"""


@query(
    f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
marks AS (SELECT doc_id AS page_id, bool_and(quality = 1 AND toxic = 0) AS good FROM labels WHERE doc_id IS NOT NULL AND (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, count(good) AS n, count(*) FILTER (good) AS good FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN marks USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS name FROM seen),
cells AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') OR name LIKE '[%' THEN [name] ELSE string_split(name, '.') END AS l FROM bare),
rules(r, more) AS (VALUES {_SUFFIXES}),
met AS (SELECT host, max(CASE WHEN more = -1 THEN 1048576 + k - 1 WHEN more = 1 THEN CASE WHEN len(l) > k THEN k + 1 END ELSE k END) % 1048576 AS s
  FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM cells) JOIN rules ON array_to_string(l[len(l) - k + 1:], '.') = r GROUP BY host),
h AS (SELECT cells.host, n, good, array_to_string(l[greatest(len(l) - greatest(coalesce(s, 1), 1), 0) + 1:], '.') AS suffix, array_to_string(l[greatest(len(l) - greatest(coalesce(s, 1), 1) - 1, 0) + 1:], '.') AS domain FROM cells LEFT JOIN met USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
s1 AS {_moments("h")}, s2 AS {_moments("d")}, s3 AS {_moments("x")},
base AS (SELECT CASE WHEN coalesce(sum(n), 0) > 0 THEN (sum(good) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS b FROM x),
top AS (SELECT suffix, (good + s * b) / (n + s) AS up FROM x, s3, base),
mid AS (SELECT domain, suffix, (good + s * up) / (n + s) AS up FROM d JOIN top USING (suffix), s2),
rated AS (SELECT host, mean, greatest(0.0, mean - 1.2816 * sqrt(mean * (1 - mean) / (n + s + 1))) AS bound FROM (SELECT host, n, s, (good + s * up) / (n + s) AS mean FROM h JOIN mid USING (domain, suffix), s1)),
told AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS v FROM (SELECT DISTINCT page_id, host, path FROM p) q, ({_FITS}) f WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, rule, coalesce(v, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound
FROM p JOIN rated USING (host) LEFT JOIN told ON told.page_id IS NOT DISTINCT FROM p.page_id AND told.host = p.host AND told.path = p.path"""
)
def op4_url_filter(spark, sf_dir):
    """Verdict for every page's url: rules first, else the host's reputation by labelled pages."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    told = hosts.judged(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return told.withColumns({c: F.round(c, 6) for c in ("mean", "bound")})


@query()
def op5_quotation_links(spark, sf_dir):
    """Messages without quotes, in reply order."""
    return quotes.threads(table(spark, sf_dir, "conversations"))


@query(
    """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p),
n AS (SELECT *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(x, CAST(i + 1 AS BIGINT), 1)) - 1) AS v FROM d),
b AS (SELECT *, list_transform(range(0, 32), lambda j: CAST((v[CAST((j * 5) // 4 + 1 AS BIGINT)] * 16 + coalesce(v[CAST((j * 5) // 4 + 2 AS BIGINT)], 0)) // CAST(pow(2, 3 - (j * 5) % 4) AS BIGINT) % 32 AS BIGINT)) AS q FROM n)
SELECT page_id, url, payload_bytes, array_to_string(list_transform(q, lambda z: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', z + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""
)
def op10_warc(spark, sf_dir):
    """Every page written to archives and read back through the index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op2_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


@query()
def op9_nearest(spark, sf_dir):
    """The 20 vectors of largest inner product for every twentieth vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(e, e.filter("vec_id % 20 = 0"), k=20)
