"""Host reputation by empirical Bayes, with rules that come first.

Labelled page outcomes are counted per host and rolled up to the registered domain and the suffix. Each
level's rate shrinks towards its parent's through a beta-binomial prior whose strength comes from the
spread of the level's own rates (method of moments): suffix towards all pages, domain towards suffix,
host towards domain. A page is allowed if the lower bound of its host's posterior is high enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edittide.llm.common import cut

#: The default rules for suffixes, in the notation of public suffix lists. A name is a suffix, `*.` stands for any label before a
#: name, `!` excepts a name from such a rule; where no rule fits, the last label is the suffix. A full list is a parameter (`suffix_rules`).
SUFFIX_RULES = (
    "ac.at ac.id ac.il ac.in ac.jp ac.ke ac.kr ac.nz ac.uk ac.za co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn "
    "com.co com.eg com.hk com.mx com.my com.ng com.np com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.br edu.cn edu.in "
    "edu.mx edu.np edu.pk edu.pl edu.tr edu.tw firm.in gc.ca go.id go.jp go.kr go.th gob.ar gob.mx gov.au gov.br gov.cn gov.in gov.np gov.pl gov.tr gov.tw "
    "gov.ua gov.uk gov.za govt.nz gouv.fr ltd.uk me.uk ne.jp net.ar net.au net.br net.cn net.in net.nz net.pl net.tr net.uk nhs.uk nom.br or.at or.id or.jp or.kr "
    "org.ar org.au org.br org.cn org.hk org.il org.in org.mx org.np org.nz org.pl org.tr org.tw org.ua org.uk org.za plc.uk police.uk sch.id web.id "
    "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev vercel.app web.app *.bd *.ck !www.ck *.er *.fk *.kh *.mm *.np !com.np *.pg *.sch.uk"
).split()
#: Rules at most that are sent to all workers (the public list has some 10,000); labels at most of a rule's name.
SENT_RULES, RULE_LABELS = 100_000, 10


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(name: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":\d*$", ""), r"\.$", "")


def placed(hosts: DataFrame, suffix_rules: Sequence[str] | DataFrame = SUFFIX_RULES) -> DataFrame:
    """`hosts` (host, n, good) with domain (suffix and the label before it) and suffix by the rules, a sequence or a DataFrame (rule).

    The rule of the most labels counts, an exception before others; without one the last label is the suffix. A host that is a suffix is its
    own domain, as are addresses (four numbers, or in brackets), which are their own suffix too. A host meets at most RULE_LABELS rules; the rules are sent to all workers up to SENT_RULES and joined by name beyond.
    """
    spark = hosts.sparkSession
    given = suffix_rules if isinstance(suffix_rules, DataFrame) else spark.createDataFrame([(r,) for r in suffix_rules], "rule string")
    rules = given.select(F.lower(F.regexp_replace("rule", r"^(!|\*\.)", "")).alias("name"), F.when(F.startswith("rule", F.lit("!")), -1).when(F.startswith("rule", F.lit("*.")), 1).otherwise(0).alias("more"))
    rules = rules.filter("name <> ''").groupBy("name").agg(F.max(F.col("more") == 1).alias("any"), F.max(F.col("more") == 0).alias("own"), F.max(F.col("more") == -1).alias("not"))
    if not isinstance(suffix_rules, DataFrame) and len(suffix_rules) <= SENT_RULES:
        rules = F.broadcast(rules)
    name = bare(F.col("host"))
    address = F.rlike(name, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) | F.startswith(name, F.lit("["))
    known = hosts.withColumns({"labels": F.when(address, F.array(name)).otherwise(F.split(name, r"\."))})
    tail = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    asked = known.select("host", F.size("labels").alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(RULE_LABELS))), lambda k: F.struct(k.alias("k"), tail(k).alias("name")))).alias("t"))
    met = asked.select("host", "size", "t.k", "t.name").join(rules, "name")
    # labels of the suffix by this rule; an exception beats all, by a bonus that no number of labels has
    by_rule = F.when(F.col("not"), F.lit(1 << 20) + F.col("k") - 1).when(F.col("any") & (F.col("size") > F.col("k")), F.col("k") + 1).when(F.col("own"), F.col("k"))
    best = met.groupBy("host").agg(F.max(by_rule).alias("s"))
    out = known.join(best, "host", "left").withColumn("s", F.greatest(F.coalesce(F.col("s") % (1 << 20), F.lit(1)), F.lit(1)))
    return out.withColumns({"suffix": tail(F.col("s")), "domain": tail(F.least(F.col("s") + 1, F.size("labels")))}).drop("labels", "s")


def rule_of(name: Column, at: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule (verdict, host, path) that fits with the longest text, as struct<verdict, rule>, or null.

    A rule fits its host and all subdomains if the url's path starts with the rule's.
    """
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((name == h) | F.endswith(name, F.lit("." + h))) & F.startswith(at, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _spread(level: DataFrame) -> DataFrame:
    """One row of a level's sums that its prior needs."""
    n, good = F.col("n"), F.col("good")
    return level.filter("n > 0").agg(F.sum(n).alias("t"), F.sum(good).alias("g"), F.sum(n * n).alias("nn"), F.sum(good * good / n).alias("gg"), F.count("*").alias("k"))


def _prior(r) -> float:
    """Prior strength by the method of moments, held between 1 and 1000."""
    if not r["t"] or r["k"] < 2:
        return 10.0
    t, k = float(r["t"]), r["k"]
    m = r["g"] / t
    between = r["gg"] - t * m * m  # sum of n (rate - m)^2
    spread = (between - (k - 1) * m * (1 - m)) / max(t - r["nn"] / t, 1e-9)
    return min(1000.0, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1000.0


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.2816, suffix_rules: Sequence[str] | DataFrame = SUFFIX_RULES) -> DataFrame:
    """Per host of `pages` (page_id, host): host, n, good, mean, bound of the posterior rate of good pages.

    outcomes: (page_id, good boolean). bound: mean less z posterior standard deviations (z = 1.2816: a tenth lies below). Hosts are
    counted before they are joined, so a host with a third of all pages is one row; the pages are read once. Without outcomes every mean is 0.5.
    """
    marks = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    seen = pages.select("page_id", "host").distinct().join(marks, "page_id", "left")
    hosts = cut(placed(seen.groupBy("host").agg(F.count("good").alias("n"), F.count_if("good").alias("good")), suffix_rules))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows = [_spread(level).first() for level in (hosts, domains, suffixes)]
    s1, s2, s3 = (_prior(r) for r in rows)
    whole, good = rows[0]["t"] or 0, rows[0]["g"] or 0
    base = (good + 0.5) / (whole + 1) if whole else 0.5
    shrunk = lambda s, up: (F.col("good") + F.lit(s) * up) / (F.col("n") + F.lit(s))
    top = suffixes.select("suffix", shrunk(s3, F.lit(base)).alias("up_suffix"))
    mid = domains.join(top, "suffix").select("domain", "suffix", shrunk(s2, F.col("up_suffix")).alias("up_domain"))
    out = hosts.join(mid, ["domain", "suffix"]).withColumn("mean", shrunk(s1, F.col("up_domain")))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(s1 + 1)))
    return out.select("host", "n", "good", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * sd).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], least: float = 0.5, suffix_rules: Sequence[str] | DataFrame = SUFFIX_RULES) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, mean, bound.

    verdict: the longest fitting rule's, else allow if the host's posterior bound is `least` or more. Rows without a host (null or odd
    urls) share the host ''.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rated = reputation(rows, outcomes, suffix_rules=suffix_rules).select("host", "mean", "bound")
    told = rows.join(rated, "host").withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return told.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), method).alias("verdict"), "mean", "bound")
