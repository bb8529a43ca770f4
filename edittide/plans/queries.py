"""Registered queries over the driver's tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edittide import sinks
from edittide.functions import columns as C
from edittide.functions import geometry as G
from edittide.operators import changesets as CS
from edittide.operators import filters, incremental, report, stats, tm, viewer
from edittide.plans import standin as V
from edittide.schema import ACTIONS, COUNTERS, KINDS
from edittide.sources import replication
from edittide.streaming import increments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The split of the incremental queries, and the range of the ranged ones.
START, MIDDLE, END = "1997-01-01 00:00:00", "1998-06-15 00:00:00", "2000-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {V.SQL.strip()}\n{sql.strip()}"
        return f

    return register


_NINE = ", ".join(f"CAST(count(*) FILTER (osm_type = '{k}' AND action = '{a}') AS BIGINT) AS {k}_{a}" for k in KINDS for a in ACTIONS)
_SUM = " + ".join(COUNTERS)
_COLS = ", ".join(COUNTERS)


def _users(where: str = "true", more: str = "") -> str:
    return f"SELECT uid, min(name) AS name, count(DISTINCT changeset) AS changesets, {_NINE}{more}, count(*) AS map_changes FROM elements WHERE {where} GROUP BY uid"


def _days(where: str = "true", more: str = "") -> str:
    return f"SELECT day AS timestamp, count(DISTINCT uid) AS users, count(DISTINCT changeset) AS changesets, {_NINE}{more}, count(*) AS map_changes FROM elements WHERE {where} GROUP BY day"


_RANK = "row_number() OVER (ORDER BY map_changes DESC, uid)"
_SETS = """sets AS (
  SELECT uid, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, string_agg(DISTINCT tag, ',' ORDER BY tag) AS hashtags, string_agg(DISTINCT created_by, ',' ORDER BY created_by) AS editors
  FROM (SELECT DISTINCT uid, changeset FROM elements) e
  JOIN (SELECT id, created_by, unnest([tag1, tag2]) AS tag, country FROM changesets LEFT JOIN boundaries ON lon BETWEEN x0 AND x1) c ON c.id = e.changeset GROUP BY uid)"""


# --- statistics -------------------------------------------------------------------------------


@query(f"SELECT *, {_RANK} AS rank FROM ({_users()})")
def user_stats(spark, d):
    return stats.ranked(stats.user_stats(V.elements(spark, d)))


@query(f"{_days()} ORDER BY timestamp")
def day_summary(spark, d):
    return stats.day_summary(V.elements(spark, d)).orderBy("timestamp")


@query(f"SELECT *, {_RANK} AS rank FROM ({_users(f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")})")
def user_stats_range(spark, d):
    return stats.ranked(stats.user_stats(filters.in_range(V.elements(spark, d), START, END)))


@query("SELECT osm_type, action, day, count(*) AS n FROM elements GROUP BY ALL")
def action_counts(spark, d):
    return stats.prepared(V.elements(spark, d)).groupBy("osm_type", "action", "day").agg(F.count("*").alias("n"))


_POI = "".join(f", count(*) FILTER (osm_type = 'nodes' AND tagged AND action = '{a}') AS poi_{a}" for a in ("create", "modify"))
_TAGS = "".join(f", CASE WHEN bool_or(tagged AND action <> 'delete') THEN count(*) FILTER (tagged AND {c} AND action = '{a}') END AS {t}_{a}" for t, c in (("size", "true"), ("promo", "kind = 'promo'")) for a in ("create", "modify"))
_LEN = "".join(f", CAST(coalesce(sum(round_even(len, 0)) FILTER (osm_type = 'ways' AND action = 'create' AND tagged AND {c}), 0) AS BIGINT) AS {t}_len_m" for t, c in (("size", "true"), ("promo", "kind = 'promo'")))


@query(_users(more=_POI))
def poi_counts(spark, d):
    return stats.user_stats(V.elements(spark, d, tags=True), poi=True)


@query(_users(more=_TAGS))
def requested_tags_user(spark, d):
    return stats.user_stats(V.elements(spark, d, tags=True), tags=("size", "promo"))


@query(_days(more=_POI + _TAGS))
def requested_tags_day(spark, d):
    return stats.day_summary(V.elements(spark, d, tags=True), poi=True, tags=("size", "promo"))


@query(_users(more=_LEN))
def length_by_tag(spark, d):
    return stats.user_stats(V.elements(spark, d, tags=True), lengths=("size", "promo"))


@query(_days(more=_LEN))
def length_by_tag_day(spark, d):
    return stats.day_summary(V.elements(spark, d, tags=True), lengths=("size", "promo"))


def _histogram(by: str, pairs: bool = False) -> str:
    labels = "[kind, 'size', kind || '=' || brand, 'size=' || psize]" if pairs else "[kind, 'size']"
    return f"SELECT {by}, action, tag, count(*) AS n FROM (SELECT {by}, action, unnest({labels}) AS tag FROM elements WHERE tagged AND action <> 'delete') GROUP BY ALL"


@query(_histogram("uid"))
def tag_keys_user(spark, d):
    return stats.tag_histogram(V.elements(spark, d, tags=True), "uid")


@query(_histogram("day"))
def tag_keys_day(spark, d):
    return stats.tag_histogram(V.elements(spark, d, tags=True), "day")


@query(_histogram("uid", pairs=True))
def tag_key_values_user(spark, d):
    return stats.tag_histogram(V.elements(spark, d, tags=True), "uid", key_value=True)


@query(_histogram("day", pairs=True))
def tag_key_values_day(spark, d):
    return stats.tag_histogram(V.elements(spark, d, tags=True), "day", key_value=True)


_MAP_TEXT = """SELECT uid, string_agg(tag || ':' || n, ',' ORDER BY n DESC, tag) FILTER (action = 'create') AS tags_create,
  string_agg(tag || ':' || n, ',' ORDER BY n DESC, tag) FILTER (action = 'modify') AS tags_modify FROM ({}) GROUP BY uid"""


@query(_MAP_TEXT.format(_histogram("uid")))
def tag_maps_sorted(spark, d):
    maps = stats.tag_maps(stats.tag_histogram(V.elements(spark, d, tags=True), "uid"), "uid")
    text = lambda c: F.nullif(F.array_join(F.transform(C.by_count(F.col(c)), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), F.lit("")).alias(c)
    return maps.select("uid", text("tags_create"), text("tags_modify"))


# --- changesets -------------------------------------------------------------------------------


@query("SELECT id, unnest([tag1, tag2]) AS hashtag FROM changesets")
def hashtag_extract(spark, d):
    return V.changesets(spark, d).select("id", F.explode(C.hashtags(F.col("comment"))).alias("hashtag"))


@query(_users("changeset IN (SELECT id FROM changesets WHERE lower(comment) LIKE '%hotosm-project-1%' OR lower(comment) LIKE '%urgent%')"))
def hashtag_substring_filter(spark, d):
    return stats.user_stats(filters.in_changesets(V.elements(spark, d), CS.select_changesets(V.changesets(spark, d), hashtags=("hotosm-project-1", "URGENT"))))


@query(_users("changeset IN (SELECT id FROM changesets WHERE lower(tag1) IN ('#1-urgent', '#hotosm-project-7') OR tag2 = '#hotosm-project-7')"))
def hashtag_exact_filter(spark, d):
    return stats.user_stats(filters.in_changesets(V.elements(spark, d), CS.select_changesets(V.changesets(spark, d), hashtags=("#1-urgent", "#HotOSM-project-7"), exact=True)))


@query("SELECT id, name, editor, created_by, editor IN ('streetcomplete', 'vespucci', 'go map', 'every door android', 'organic maps android', 'osmand', 'every door ios', 'organic maps ios', 'osmand maps') OR created_by IS NULL AS field FROM (SELECT id, name, CASE WHEN id % 3 = 0 THEN 'osmand' WHEN id % 3 = 1 THEN editor END AS editor, CASE WHEN id % 3 = 0 THEN 'OsmAnd 4.' || id % 3 WHEN id % 3 = 1 THEN created_by END AS created_by FROM changesets)")
def field_editor_filter(spark, d):
    made = F.when(F.col("id") % 3 == 0, F.concat(F.lit("OsmAnd 4."), (F.col("id") % 3).cast("string"))).when(F.col("id") % 3 == 1, F.col("created_by"))
    cs = V.changesets(spark, d).withColumn("created_by", made)
    return cs.select("id", F.col("user").alias("name"), C.editor(F.col("created_by")).alias("editor"), "created_by", C.from_field_editor(F.col("created_by")).alias("field"))


@query(_users("name IN ('Customer#000000001', 'Customer#000000007', 'customer#000000008')"))
def user_whitelist(spark, d):
    return stats.user_stats(filters.selected(V.elements(spark, d), None, ("Customer#000000001", "Customer#000000007", "customer#000000008"), False))


@query(_users("changeset IN (SELECT id FROM changesets WHERE lower(comment) LIKE '%urgent%' AND name IN ('Customer#000000001', 'Customer#000000004'))"))
def changeset_user_filter(spark, d):
    cs = CS.select_changesets(V.changesets(spark, d), hashtags=("urgent",), users=("Customer#000000001", "Customer#000000004"))
    return stats.user_stats(filters.selected(V.elements(spark, d), cs, (), True))


_BOX = [[[[-20.5, -40.0], [60.0, -40.0], [60.0, 30.5], [-20.5, 30.5], [-20.5, -40.0]]]]


@query("SELECT id, lon, lat FROM changesets WHERE lon > -20.5 AND lon < 60 AND lat > -40 AND lat < 30.5")
def boundary_filter(spark, d):
    return CS.select_changesets(V.changesets(spark, d), boundary=G.rings_literal(_BOX)).select("id", "lon", "lat")


@query(_users("changeset IN (SELECT id FROM changesets WHERE lon > -20.5 AND lon < 60 AND lat > -40 AND lat < 30.5 AND name IN ('Customer#000000001', 'Customer#000000007', 'Customer#000000011'))"))
def boundary_users_filter(spark, d):
    """Names count with a boundary, too."""
    cs = CS.select_changesets(V.changesets(spark, d), users=("Customer#000000001", "Customer#000000007", "Customer#000000011"), boundary=G.rings_literal(_BOX))
    return stats.user_stats(filters.selected(V.elements(spark, d), cs, (), True))


@query("SELECT id, country FROM changesets JOIN boundaries ON lon BETWEEN x0 AND x1")
def country_join(spark, d):
    return CS.with_countries(V.changesets(spark, d), V.boundaries(spark, d)).select("id", "country")


def _described(spark, d, *names):
    """Changesets with the lists that are asked for; countries, which need the boundaries, only then."""
    names = names or ("countries", "hashtags", "editors")
    return CS.describe(V.changesets(spark, d), V.boundaries(spark, d) if "countries" in names else None).select("id", *names)


def _sets(spark, d, *names):
    return stats.user_sets(V.elements(spark, d), _described(spark, d, *names))


@query(f", {_SETS} SELECT s.*, sets.* EXCLUDE (uid) FROM ({_users()}) s LEFT JOIN sets USING (uid)")
def user_enrichment(spark, d):
    return stats.enriched(V.elements(spark, d), _described(spark, d))


@query("SELECT day, editor, count(*) AS n FROM elements JOIN changesets ON id = changeset GROUP BY ALL")
def day_editor_histogram(spark, d):
    return stats.day_editors(V.elements(spark, d), V.changesets(spark, d))


# --- reports ----------------------------------------------------------------------------------

_BIG = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
_BY_ACTION = ", ".join(f"{' + '.join(f'{k}_{a}' for k in KINDS)} AS {n}" for a, n in (("create", "created"), ("modify", "modified"), ("delete", "deleted")))


@query(f"SELECT count(*) AS users, CAST(sum(changesets) AS BIGINT) AS changesets, CAST(sum(map_changes) AS BIGINT) AS map_changes, CAST(sum(created) AS BIGINT) AS created, CAST(sum(modified) AS BIGINT) AS modified, CAST(sum(deleted) AS BIGINT) AS deleted FROM (SELECT *, {_BY_ACTION} FROM ({_users()}))")
def global_totals(spark, d):
    return report.totals(stats.user_stats(V.elements(spark, d)))


@query(f"SELECT {_BIG} FROM ({_users()})")
def element_type_totals(spark, d):
    return report.kind_totals(stats.user_stats(V.elements(spark, d)))


def _named_sets(spark, d, column):
    names = V.table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return _sets(spark, d, column).join(names, "uid")


@query(f", {_SETS} SELECT item, count(*) AS users FROM (SELECT uid, unnest(string_split(countries, ',')) AS item FROM sets) GROUP BY item ORDER BY users DESC, item LIMIT 20")
def users_per_country(spark, d):
    return report.users_per(_named_sets(spark, d, "countries"), "countries", 20, blanks=True)


@query(f", {_SETS} SELECT item, count(*) AS users FROM (SELECT uid, unnest(string_split(hashtags, ',')) AS item FROM sets) WHERE trim(item) <> '' GROUP BY item ORDER BY users DESC, item LIMIT 20")
def users_per_hashtag(spark, d):
    return report.users_per(_named_sets(spark, d, "hashtags"), "hashtags", 20)


_EDITOR_USERS = "SELECT regexp_extract(item, '^[a-z]+') || ' ' || right(item, 1) AS item, count(DISTINCT uid) AS users FROM (SELECT uid, unnest(string_split(editors, ',')) AS item FROM sets) GROUP BY 1"


@query(f", {_SETS}, per AS ({_EDITOR_USERS}), cut AS (SELECT *, row_number() OVER (ORDER BY users DESC, item) AS n FROM per) SELECT CASE WHEN n <= 8 THEN item ELSE 'Others' END AS item, CAST(sum(users) AS BIGINT) AS users, round(100.0 * CAST(sum(users) AS DOUBLE) / (SELECT sum(users) FROM per), 6) AS percent FROM cut GROUP BY 1")
def editor_share(spark, d):
    label = F.concat_ws(" ", C.editor(F.col("item")), F.right("item", F.lit(1)))
    rows = report.items(_sets(spark, d, "editors"), "editors").withColumn("item", label)
    per = rows.select("uid", "item").distinct().groupBy("item").agg(F.count("*").alias("users"))
    return report.shares(per, 8, "item", "users")


@query(f"SELECT tag || ' (' || action || ')' AS tag, CAST(sum(n) AS BIGINT) AS n FROM ({_histogram('uid')}) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, d):
    h = stats.tag_histogram(V.elements(spark, d, tags=True), "uid")
    return report.top(h.groupBy(F.concat(F.col("tag"), F.lit(" ("), F.col("action"), F.lit(")")).alias("tag")).agg(F.sum("n").alias("n")), 10, "n", "tag")


@query(f"SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM ({_histogram('uid')}) WHERE action = 'create' GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def tag_map_sum_top5(spark, d):
    maps = stats.tag_maps(stats.tag_histogram(V.elements(spark, d, tags=True), "uid"), "uid")
    return report.sum_maps(maps.select(C.count_json(F.col("tags_create")).alias("tags_create")), "tags_create", 5)


def _trend(column: str) -> str:
    return f", {_SETS} SELECT item, count(*) AS n FROM (SELECT unnest(string_split({column}, ',')) AS item FROM sets) WHERE trim(item) <> '' GROUP BY item ORDER BY n DESC, item LIMIT 5"


@query(_trend("hashtags"))
def trending_hashtags(spark, d):
    return report.trending(_sets(spark, d, "hashtags"), "hashtags")


@query(_trend("editors"))
def trending_editors(spark, d):
    return report.trending(_sets(spark, d, "editors"), "editors")


@query(_trend("countries"))
def trending_countries(spark, d):
    return report.trending(_sets(spark, d, "countries"), "countries")


@query(f"SELECT * FROM (SELECT *, {_RANK} AS rank FROM ({_users()})) WHERE rank <= 50")
def top_rows(spark, d):
    return stats.top_ranked(stats.user_stats(V.elements(spark, d)), 50)


@query(f"SELECT name, changesets, map_changes, {_BY_ACTION} FROM ({_users()}) ORDER BY map_changes DESC, uid LIMIT 25")
def top_users_image(spark, d):
    return report.by_action(report.top(stats.user_stats(V.elements(spark, d)), 25, "map_changes", "uid")).select("name", "changesets", "map_changes", "created", "modified", "deleted")


@query(f"SELECT name, map_changes FROM ({_users()}) ORDER BY map_changes DESC, uid LIMIT 5")
def top_five_users(spark, d):
    return report.top(stats.user_stats(V.elements(spark, d)), 5, "map_changes", "uid").select("name", "map_changes")


_KM = ", ".join(f"CAST(round_even(CAST(sum({t}_len_m) AS DOUBLE) / 1000, 0) AS BIGINT) AS {t}_km" for t in ("size", "promo"))
_TAG_SUMS = ", ".join(f"CAST(coalesce(sum({t}_{a}), 0) AS BIGINT) AS {t}_{a}" for t in ("poi", "size", "promo") for a in ("create", "modify"))


@query(f"SELECT {_TAG_SUMS}, {_KM} FROM ({_users(more=_POI + _TAGS + _LEN)})")
def summary_tag_totals(spark, d):
    users = stats.user_stats(V.elements(spark, d, tags=True), poi=True, tags=("size", "promo"), lengths=("size", "promo"))
    sums = [F.coalesce(F.sum(f"{t}_{a}"), F.lit(0)).cast("bigint").alias(f"{t}_{a}") for t in ("poi", "size", "promo") for a in ("create", "modify")]
    return users.agg(*sums, *[F.bround(F.sum(f"{t}_len_m") / 1000).cast("bigint").alias(f"{t}_km") for t in ("size", "promo")])


@query("SELECT id, 'https://www.openstreetmap.org/user/' || replace(replace(label, ' ', '%20'), '#', '%23') AS profile FROM (SELECT id, name || ' a/b~c*' || id AS label FROM changesets)".replace("replace(label, ' ', '%20')", "replace(replace(label, ' ', '%20'), '*', '%2A')"))
def profile_links(spark, d):
    return V.changesets(spark, d).select("id", C.profile_url(F.concat(F.col("user"), F.lit(" a/b~c*"), F.col("id").cast("string"))).alias("profile"))


# --- projects ---------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(id % 50 AS VARCHAR) AS project FROM changesets WHERE id IN (SELECT changeset FROM elements)")
def tm_projects(spark, d):
    return tm.project_ids(_sets(spark, d, "hashtags"))


_ROLL = "SELECT name, tm_projects, min(tm_mapping_level) AS tm_mapping_level, CAST(sum(tasks_mapped) AS BIGINT) AS tasks_mapped, CAST(sum(tasks_validated) AS BIGINT) AS tasks_validated, CAST(sum(tasks_total) AS BIGINT) AS tasks_total FROM contributions GROUP BY name, tm_projects"


@query(_ROLL)
def tm_rollup(spark, d):
    return tm.rollup(V.contributions(spark, d))


@query("SELECT c.* FROM contributions c WHERE name IN (SELECT name FROM elements WHERE ts < TIMESTAMP '1992-06-01 00:00:00')")
def tm_contributors(spark, d):
    """Contributions of the users that have elements in a range."""
    return tm.of_users(V.contributions(spark, d), filters.in_range(V.elements(spark, d), None, "1992-06-01 00:00:00").select(F.col("user").alias("name")))


_TM_USERS = f""", asked AS (SELECT DISTINCT name, CAST(id % 50 AS VARCHAR) AS tm_projects FROM changesets WHERE id IN (SELECT changeset FROM elements)),
mine AS (SELECT name, string_agg(tm_projects, ',' ORDER BY tm_projects) AS tm_projects, min(tm_mapping_level) AS tm_mapping_level,
  CAST(coalesce(sum(tasks_mapped), 0) AS BIGINT) AS tasks_mapped, CAST(coalesce(sum(tasks_validated), 0) AS BIGINT) AS tasks_validated, CAST(coalesce(sum(tasks_total), 0) AS BIGINT) AS tasks_total
  FROM asked LEFT JOIN ({_ROLL}) r USING (name, tm_projects) GROUP BY name)"""


def _with_tm(spark, d):
    return tm.with_contributions(_named_sets(spark, d, "hashtags").select("uid", "name", "hashtags"), V.contributions(spark, d))


@query(f"{_TM_USERS} SELECT uid, mine.* FROM mine JOIN (SELECT DISTINCT uid, name FROM elements) USING (name)")
def tm_user_merge(spark, d):
    return _with_tm(spark, d).drop("hashtags")


@query(f"{_TM_USERS} SELECT name, tasks_mapped FROM mine ORDER BY tasks_mapped DESC, name LIMIT 5")
def tm_top_mappers(spark, d):
    return report.top(_with_tm(spark, d), 5, "tasks_mapped", "name").select("name", "tasks_mapped")


@query(f"{_TM_USERS} SELECT name, tasks_validated FROM mine ORDER BY tasks_validated DESC, name LIMIT 5")
def tm_top_validators(spark, d):
    return report.top(_with_tm(spark, d), 5, "tasks_validated", "name").select("name", "tasks_validated")


# --- merging ----------------------------------------------------------------------------------

_OLD, _NEW = f"ts < TIMESTAMP '{MIDDLE}'", f"ts >= TIMESTAMP '{MIDDLE}'"


def _halves(spark, d, tags=False):
    e = V.elements(spark, d, tags=tags)
    return filters.in_range(e, None, MIDDLE), filters.in_range(e, MIDDLE, None)


def _added(key: str, names: tuple[str, ...]) -> str:
    cells = ", ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN a.{c} + b.{c} ELSE coalesce(a.{c}, b.{c}) END AS {c}" for c in names)
    return f"coalesce(a.{key}, b.{key}) AS {key}, {cells}"


_USER_NUMBERS = ("changesets", *COUNTERS, "size_create", "map_changes")


@query(f"SELECT *, {_RANK} AS rank FROM (SELECT {_added('uid', (*_USER_NUMBERS, 'size_modify', 'promo_create', 'promo_modify'))}, coalesce(a.name, b.name) AS name FROM ({_users(_OLD, _TAGS)}) a FULL JOIN ({_users(_NEW, _TAGS)}) b ON a.uid = b.uid)")
def merge_user_stats(spark, d):
    old, new = (stats.user_stats(h, tags=("size", "promo")) for h in _halves(spark, d, tags=True))
    return stats.ranked(incremental.merge(old, new, "uid"))


@query(f"SELECT {_added('timestamp', ('users', 'changesets', *COUNTERS, 'map_changes'))} FROM ({_days("ts < TIMESTAMP '1998-06-20 00:00:00'")}) a FULL JOIN ({_days(_NEW)}) b ON a.timestamp = b.timestamp")
def merge_day_summary(spark, d):
    e = V.elements(spark, d)
    return incremental.merge(stats.day_summary(filters.in_range(e, None, "1998-06-20 00:00:00")), stats.day_summary(filters.in_range(e, MIDDLE, None)), "timestamp")


@query("SELECT uid, string_agg(DISTINCT created_by, ',' ORDER BY created_by) AS editors FROM changesets WHERE id IN (SELECT changeset FROM elements) GROUP BY uid")
def merge_sets(spark, d):
    described = CS.describe(V.changesets(spark, d))
    old, new = (stats.user_sets(h, described).select("uid", "editors") for h in _halves(spark, d))
    return incremental.merge(old, new, "uid")


@query(f"SELECT uid, tag, CAST(n AS BIGINT) AS n FROM ({_histogram('uid')}) WHERE action = 'modify'")
def merge_tag_maps(spark, d):
    old, new = (stats.tag_maps(stats.tag_histogram(h, "uid"), "uid").select("uid", C.count_json(F.col("tags_modify")).alias("tags_modify")) for h in _halves(spark, d, tags=True))
    return incremental.merge(old, new, "uid").select("uid", F.explode(C.counts_from_json(F.col("tags_modify"))).alias("tag", "n"))


@query("SELECT uid, count(DISTINCT changeset) AS changesets FROM elements GROUP BY uid")
def merge_exact_changesets(spark, d):
    return incremental.snapshot_merge(_halves(spark, d), "uid")


@query(f"SELECT uid, min(name) AS name, count(DISTINCT changeset) AS changesets, {_NINE}, count(*) AS map_changes FROM (SELECT * FROM elements UNION ALL SELECT * FROM elements WHERE ts >= TIMESTAMP '{END}') GROUP BY uid")
def multi_source_union(spark, d):
    e = V.elements(spark, d)
    return stats.user_stats(e.unionByName(filters.in_range(e, END, None)))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, action, count(*) AS n FROM elements GROUP BY ALL")
def daily_windows(spark, d):
    """The streaming windows of one UTC day over a table."""
    return increments.day_counts(V.elements(spark, d))


@query(f"SELECT rank, name, 'https://www.openstreetmap.org/user/' || replace(name, '#', '%23') AS profile, uid, changesets, map_changes, {', '.join(f'{c} AS "{c.replace("_", ".")}"' for c in COUNTERS)}, '{START}' AS start_date, '{END}' AS end_date FROM (SELECT *, {_RANK} AS rank FROM ({_users(f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")}))")
def export_table(spark, d):
    """Ranked users as they are exported: profile, start and end of the range, dotted counters."""
    users = stats.ranked(stats.user_stats(filters.in_range(V.elements(spark, d), START, END)))
    return sinks.export_columns(sinks.with_profile(users, START, END))


# --- sources, geometry, viewer ----------------------------------------------------------------

_PATH = "substr(p, 1, 3) || '{0}' || substr(p, 4, 3) || '{0}' || substr(p, 7)"


@query(f"SELECT o_orderkey AS seq, 'temp/changefiles/minute/' || {_PATH.format('_')} || '.osc.gz' AS path FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS p FROM orders)")
def landing_paths(spark, d):
    seq = F.col("o_orderkey")
    url = C.sequence_path(seq, "https://example.org/replication/minute/", ".osc.gz")
    return V.table(spark, d, "orders").select(seq.alias("seq"), C.cache_path(url, "changefiles").alias("path"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey END AS sequence, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND, '%Y-%m-%d %H:%M:%S') END AS at FROM orders")
def state_parse(spark, d):
    """State files of both kinds, and texts that are none."""
    key = F.col("o_orderkey")
    at = F.timestamp_add("SECOND", (key % 86400).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    clock = lambda pattern: F.date_format(at, pattern)
    feed = F.concat(F.lit("#x\nsequenceNumber="), key.cast("string"), F.lit("\ntimestamp="), F.replace(clock("yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.lit("T")), F.lit("Z\n"))
    feed = F.when(key % 5 == 0, F.replace(feed, F.lit(":"), F.lit("\\:"))).otherwise(feed)
    run = F.concat(F.lit("---\nlast_run: "), clock("yyyy-MM-dd HH:mm:ss"), F.lit(".123 +00:00\nsequence: "), key.cast("string"))
    text = F.when(key % 5 == 4, F.lit("<html>no such file</html>")).when(key % 5 == 3, run).otherwise(feed)
    parsed = C.utc_clock(C.state_timestamp(text))
    return V.table(spark, d, "orders").select(key.alias("id"), C.state_sequence(text).alias("sequence"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate) - 3600 * (CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 2 END) END::BIGINT AS seconds FROM orders")
def date_parse(spark, d):
    """Texts with an offset as instants; others are NULL."""
    key, text = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    text = F.when(key % 3 == 0, text).when(key % 3 == 1, F.concat(text, F.lit("+00:00"))).otherwise(F.concat(text, F.lit("+02:00")))
    return V.table(spark, d, "orders").select(key.alias("id"), F.unix_seconds(C.parse_utc(text)).alias("seconds"))


@query("SELECT id, try_cast(cell AS DOUBLE) AS value FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '-' || o_orderkey || '.25' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE o_orderkey || 'e2' END AS cell FROM orders)")
def number_cells(spark, d):
    key = F.col("o_orderkey")
    text = key.cast("string")
    cell = F.when(key % 5 == 0, F.concat(F.lit("-"), text, F.lit(".25"))).when(key % 5 == 1, "n/a").when(key % 5 == 2, "").when(key % 5 == 4, F.concat(text, F.lit("e2")))
    return V.table(spark, d, "orders").select(key.alias("id"), C.number(cell).alias("value"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'https://raw.githubusercontent.com/a/b/main/' || o_orderkey || '.csv' WHEN 1 THEN 'https://github.com/a/b/' || o_orderkey ELSE 'https://example.org/blob/' || o_orderkey END AS url FROM orders")
def raw_urls(spark, d):
    key = F.col("o_orderkey")
    url = F.when(key % 3 == 0, F.concat(F.lit("https://github.com/a/b/blob/main/"), key.cast("string"), F.lit(".csv")))
    url = url.when(key % 3 == 1, F.concat(F.lit("https://github.com/a/b/"), key.cast("string"))).otherwise(F.concat(F.lit("https://example.org/blob/"), key.cast("string")))
    return V.table(spark, d, "orders").select(key.alias("id"), C.raw_url(url).alias("url"))


@query("SELECT id, CASE WHEN id % 7 <> 0 THEN (lon + lon + 3) / 2 END AS x, (lat - 1 + lat) / 2 AS y FROM changesets")
def box_centroids(spark, d):
    """Middles of boxes; a box without an edge has none."""
    lon, lat = F.col("lon"), F.col("lat")
    return V.changesets(spark, d).select("id", G.centroid(lon, F.when(F.col("id") % 7 != 0, lon + 3)).alias("x"), G.centroid(lat - 1, lat).alias("y"))


#: A feed that writes a file every 50 seconds since EPOCH, and the range that is planned over it.
_EPOCH, _FROM, _TO = (datetime(2024, 1, *t, tzinfo=timezone.utc) for t in ((1,), (3, 5, 30, 20), (3, 9)))
_STEP, _NEWEST = timedelta(seconds=50), 6_000


def _plan_sql(first: str, last: str, folder: str, suffix: str) -> str:
    path = _PATH.format("/")
    return f"SELECT seq, 'https://example.org/{folder}/' || {path} || '{suffix}' AS url FROM (SELECT seq, lpad(CAST(seq AS VARCHAR), 9, '0') AS p FROM (SELECT unnest(generate_series({first}, {last})) AS seq))"


def _at(seq: int) -> datetime:
    return _EPOCH + seq * _STEP


@query(_plan_sql("(2 * 86400 + 5 * 3600 + 30 * 60 + 20) // 50 - 60", "least(6000, (2 * 86400 + 9 * 3600) // 50 + 60)", "minute", ".osc.gz"))
def change_file_plan(spark, d):
    """Minute files of a range: the last one not after its start less an hour's files, and as many after its end."""
    plan = replication.change_sequences(_FROM, _TO, "minute", lambda t: min(_NEWEST, (t - _EPOCH) // _STEP), _at, _NEWEST)
    return replication.planned(spark, plan, "https://example.org/minute/")


#: The start of every preset as of a Sunday noon, from the calendar alone.
_NOW = datetime(2024, 3, 31, 12, 34, 56, tzinfo=timezone.utc)
_PRESETS = {
    "last_hour": ("date_trunc('hour', n) - INTERVAL 1 HOUR", "date_trunc('hour', n)"),
    "last_day": ("date_trunc('day', n) - INTERVAL 1 DAY", "date_trunc('day', n)"),
    "last_week": ("date_trunc('week', n) - INTERVAL 7 DAY", "date_trunc('week', n) - INTERVAL 1 DAY"),
    "last_month": ("date_trunc('month', n) - INTERVAL 1 MONTH", "date_trunc('month', n)"),
    "last_year": ("date_trunc('year', n) - INTERVAL 1 YEAR", "date_trunc('year', n) - INTERVAL 1 DAY"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS preset, strftime({a}, '%Y-%m-%d %H:%M') AS first, strftime({b}, '%Y-%m-%d %H:%M') AS last FROM (SELECT TIMESTAMP '2024-03-31 12:34:56' AS n)" for name, (a, b) in _PRESETS.items()))
def range_presets(spark, d):
    rows = [(name, *(t.strftime("%Y-%m-%d %H:%M") for t in replication.preset(name, _NOW))) for name in _PRESETS]
    return spark.createDataFrame(rows, "preset string, first string, last string")


@query("SELECT unnest(['https://example.org/replication/minute', 'https://a.example.org/x', 'https://example.org/replication/day']) AS url")
def source_aliases(spark, d):
    urls = replication.source_urls(["minute", "https://a.example.org/x", "day", "minute", "https://a.example.org/x"], "https://example.org")
    return spark.createDataFrame([(u,) for u in urls], "url string")


@query("SELECT o_orderkey AS seq, 'https://example.org/' || substr(p, 1, 3) || '/' || substr(p, 4, 3) || '/' || substr(p, 7) || '.osm.gz' AS url, 'https://example.org/' || substr(p, 1, 3) || '/' || substr(p, 4, 3) || '/' || substr(p, 7) || '.state.txt' AS state FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS p FROM orders)")
def sequence_urls(spark, d):
    seq = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(seq.alias("seq"), C.sequence_path(seq, "https://example.org/", ".osm.gz").alias("url"), C.sequence_path(seq, "https://example.org/", ".state.txt").alias("state"))


@query("SELECT lower(n_name) AS id, 'https://example.org/' || lower(n_name) || '-updates' AS update_url FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7')")
def country_url_lookup(spark, d):
    catalogue = V.table(spark, d, "nation").select(F.lower("n_name").alias("id"), F.concat(F.lit("https://example.org/"), F.lower("n_name"), F.lit("-updates")).alias("update_url"))
    return replication.extract_urls(catalogue, ("Nation_3", "nation_7"))


@query("SELECT o_orderkey AS id, day, minutes FROM (SELECT o_orderkey, strftime(o_orderdate + INTERVAL 345 MINUTE, '%Y-%m-%d %H:%M') AS day, CAST(epoch(o_orderdate) / 60 - epoch(TIMESTAMP '1998-01-01 00:00:00') / 60 AS BIGINT) AS minutes FROM orders)")
def zone_and_minutes(spark, d):
    at, since = (C.instant(t.cast("timestamp_ntz")) for t in (F.col("o_orderdate"), F.lit("1998-01-01 00:00:00")))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(C.in_zone(at, "Asia/Kathmandu"), "yyyy-MM-dd HH:mm").alias("day"), C.minutes_between(at, since).alias("minutes"))


@query("SELECT event_id, strftime(make_timestamp((1700000000 + event_id * 7919) * 1000000), '%Y-%m-%d') AS day FROM events")
def utc_days(spark, d):
    """Instants as UTC days, whatever the session's zone."""
    return V.table(spark, d, "events").select("event_id", C.day(F.timestamp_seconds(F.lit(1700000000) + F.col("event_id") * 7919)).alias("day"))


_HAVERSINE = f"{2 * G.EARTH_RADIUS!r} * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(lon - plon) / 2), 2)))"


@query(
    f"""SELECT c_custkey AS id, round(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN 0.0 ELSE coalesce(m, 0.0) END, 2) AS metres FROM customer LEFT JOIN (
  SELECT uid, sum({_HAVERSINE}) AS m FROM (SELECT uid, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM changesets WINDOW w AS (PARTITION BY uid ORDER BY id)) GROUP BY uid) ON uid = c_custkey"""
)
def way_lengths(spark, d):
    """Lengths of ways from the nodes of their own files; ways of later versions or with missing nodes have none."""
    return stats.way_lengths(V.ways_and_nodes(spark, d)).filter("osm_type = 'ways'").select("id", F.round("len", 2).alias("metres"))


@query(f"SELECT id, round({2 * G.EARTH_RADIUS!r} * asin(sqrt(pow(sin(radians(0.01) / 2), 2) + cos(radians(lat)) * cos(radians(lat + 0.01)) * pow(sin(radians(0.02) / 2), 2))), 3) AS metres FROM changesets")
def haversine_length(spark, d):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lon, lat = F.col("lon"), F.col("lat")
    path = F.array(point(lon, lat), point(lon + F.lit(0.02), lat + F.lit(0.01)))
    return V.changesets(spark, d).select("id", F.round(G.path_length(path), 3).alias("metres"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS props_k, json_extract_string(props, '$.missing') AS props_missing FROM events")
def json_extract(spark, d):
    return viewer.with_json_key(viewer.with_json_key(V.table(spark, d, "events"), "props", "k"), "props", "missing").select("event_id", "props_k", "props_missing")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, d):
    return viewer.json_keys(V.table(spark, d, "events"), "props")


@query("SELECT event_id, user_id, value FROM events WHERE value BETWEEN 2 AND 9.5 AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def viewer_range(spark, d):
    e = viewer.between(V.table(spark, d, "events"), "value", 2, 9.5)
    return viewer.between(e, "ts", "2024-01-03 00:00:00", "2024-01-20 00:00:00").select("event_id", "user_id", "value")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7 OR event_type = 'click'")
def viewer_equals(spark, d):
    e = V.table(spark, d, "events")
    return viewer.equals(e, "user_id", "7").unionByName(viewer.equals(e.filter(F.col("user_id") != 7), "event_type", "click")).select("event_id", "event_type", "value")


@query("SELECT min(value) AS low, max(value) AS high FROM events")
def viewer_minmax(spark, d):
    return viewer.extent(V.table(spark, d, "events"), "value")


@query("SELECT user_id, event_id FROM events")
def viewer_project(spark, d):
    return viewer.project(V.table(spark, d, "events"), ("user_id", "event_id"))


@query("SELECT event_id, value FROM events ORDER BY value DESC")
def viewer_sort(spark, d):
    return viewer.sort(V.table(spark, d, "events"), "value", ascending=False).select("event_id", "value")


@query(f", {_SETS} SELECT bool_or(coalesce(countries, '') <> '') AS \"any\" FROM sets")
def column_has_text(spark, d):
    return report.has_any(_sets(spark, d, "countries"), "countries")
