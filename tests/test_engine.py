import gzip
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from edittide import sinks
from edittide.config import ConfigError, StatsConfig
from edittide.functions import columns as C
from edittide.functions import geometry as G
from edittide.operators import changesets, incremental, report, stats, tm
from edittide.sources import files, replication
from edittide.streaming import increments

UTC = timezone.utc

OSC = """<osmChange version="0.6">
<create><node id="1" version="1" timestamp="2024-01-01T10:00:00Z" uid="7" user="ann" changeset="100" lat="0" lon="0"><tag k="amenity" v="cafe"/></node></create>
<create><node id="2" version="1" timestamp="2024-01-01T10:00:01Z" uid="7" user="ann" changeset="100" lat="0" lon="1"/>
<way id="5" version="1" timestamp="2024-01-01T10:00:02Z" uid="7" user="ann" changeset="100"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/><tag k="name" v="x"/></way>
<way id="6" version="1" timestamp="2024-01-02T10:00:02Z" uid="8" user="bob" changeset="101"><nd ref="1"/><nd ref="99"/><tag k="highway" v="path"/></way></create>
<modify><relation id="9" version="3" timestamp="2024-01-02T11:00:00Z" uid="8" user="bob" changeset="101"/></modify>
<delete><node id="3" version="2" timestamp="2024-01-02T12:00:00Z" uid="8" user="bob" changeset="102"/></delete>
</osmChange>"""

OSM = """<osm><changeset id="100" user="ann" created_at="2024-01-01T09:00:00Z" min_lon="0" min_lat="0" max_lon="2" max_lat="2"><tag k="created_by" v="JOSM/1.5 (1 en)"/><tag k="comment" v="fix #Roads and #नेपाल-1"/></changeset>
<changeset id="101" user="bob" created_at="2024-01-01T09:00:00Z"><tag k="comment" v="roadmap only"/></changeset></osm>"""


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    d = tmp_path_factory.mktemp("landed")
    for name, text in (("a.osc.gz", OSC), ("c.osm.gz", OSM)):
        with gzip.open(d / name, "wt", encoding="utf-8") as f:
            f.write(text)
    return d


def test_change_file_to_stats(spark, landed):
    e = stats.way_lengths(files.change_files(spark, str(landed / "a.osc.gz")))
    got = {r["uid"]: r for r in stats.user_stats(e, poi=True, tags=("highway",), lengths=("highway",)).collect()}
    assert (got[7]["name"], got[7]["changesets"], got[7]["map_changes"]) == ("ann", 1, 3)
    assert (got[7]["nodes_create"], got[7]["ways_create"], got[7]["poi_create"], got[7]["highway_create"]) == (2, 1, 1, 1)
    assert got[7]["highway_len_m"] == round(G.EARTH_RADIUS * 3.141592653589793 / 180)
    assert (got[8]["highway_len_m"], got[8]["relations_modify"], got[8]["nodes_delete"], got[8]["changesets"]) == (0, 1, 1, 2)
    days = {r["timestamp"]: r["map_changes"] for r in stats.day_summary(e).collect()}
    assert days == {"2024-01-01": 3, "2024-01-02": 3}
    assert sum(days.values()) == sum(r["map_changes"] for r in got.values())


def test_changeset_file(spark, landed):
    cs = changesets.flat(files.changeset_files(spark, str(landed / "c.osm.gz")))
    got = {r["id"]: r for r in cs.withColumn("h", C.hashtags(F.col("comment"))).withColumn("e", C.editor(F.col("created_by"))).collect()}
    assert (got[100]["lon"], got[100]["lat"], got[100]["e"]) == (1.0, 1.0, "josm")
    assert got[100]["h"][0] == "#Roads" and got[100]["h"][1].startswith("#न")
    assert got[101]["h"] == [] and got[101]["lon"] is None
    substring = changesets.select_changesets(cs, hashtags=("ROAD",))
    assert {r["id"] for r in substring.collect()} == {100, 101}
    assert {r["id"] for r in changesets.select_changesets(cs, hashtags=("#roads",), exact=True).collect()} == {100}
    assert [r["id"] for r in changesets.select_changesets(cs, field_mappers=True).collect()] == [101]


def test_corrupt_file_is_reported(spark, tmp_path):
    (tmp_path / "bad.osc").write_text('<osmChange><create><node id="x" version="1"/></create></osmChange>')
    assert files.unreadable(spark, str(tmp_path / "bad.osc")).count() >= 1


@pytest.mark.parametrize(
    "text,want",
    [("JOSM/1.5 (123 en)", "josm"), ("iD 2.27", "id"), ("Go Map!! 4", "go map"), ("123", "123"), (" 9 ", ""), (None, None)],
)
def test_editor(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.editor(F.col("t"))).first()[0] == want


def test_points_in_square_with_hole(spark):
    rings = G.rings_literal(G.read_feature(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}})))
    points = [(1.0, 1.0, True, True), (5.0, 5.0, False, False), (11.0, 1.0, False, False), (0.0, 5.0, False, True), (10.0, 5.0, False, True), (5.0, 10.0, False, True), (4.0, 5.0, False, True), (10.0, 10.0, False, True), (None, 1.0, None, None)]
    rows = spark.createDataFrame([(p[0], p[1]) for p in points], "x double, y double")
    got = rows.select(G.point_in_rings(F.col("x"), F.col("y"), rings, False).alias("a"), G.point_in_rings(F.col("x"), F.col("y"), rings, True).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(p[2], p[3]) for p in points]


def test_bad_features():
    for text in ("{", '{"type": "FeatureCollection"}', '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}'):
        with pytest.raises(G.GeometryError):
            G.read_feature(text)


def test_lengths_round_half_to_even(spark):
    rows = [("ways", 1, False, datetime(2024, 1, 1), 1, "a", 1, {"highway": "x"}, v) for v in (0.5, 1.5, 2.5)]
    e = spark.createDataFrame(rows, "osm_type string, version int, deleted boolean, ts timestamp, uid long, user string, changeset long, tags map<string,string>, len double")
    assert stats.user_stats(e, lengths=("highway",)).first()["highway_len_m"] == 4


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 5, "x,y", '{"k":2}'), (2, "b", None, None, None)], "uid long, name string, map_changes long, editors string, tags_create string")
    new = spark.createDataFrame([(1, "a", 3, "y,nan,z", '{"k":1,"j":4}'), (3, "c", 1, "q", None)], "uid long, name string, map_changes long, editors string, tags_create string")
    got = {r["uid"]: r for r in incremental.merge(old, new, "uid").collect()}
    assert (got[1]["map_changes"], got[1]["editors"], got[1]["tags_create"]) == (8, "x,y,z", '{"j":4,"k":3}')
    assert got[2]["map_changes"] is None and got[3]["name"] == "c"


def test_rank_without_ties(spark):
    df = spark.createDataFrame([(i, f"u{i}", 5) for i in range(7)], "uid long, name string, map_changes long")
    assert [r["rank"] for r in stats.ranked(df).orderBy("uid").collect()] == list(range(1, 8))
    assert [r["rank"] for r in stats.top_ranked(df, 7).orderBy("uid").collect()] == list(range(1, 8))
    assert report.top(df, 5, "map_changes", "uid").count() == 5


def test_projects_without_match(spark):
    users = spark.createDataFrame([(1, "a", "#hotosm-project-4,#x"), (2, "b", "")], "uid long, name string, hashtags string")
    none = spark.createDataFrame([], "name string, tm_projects string, tm_mapping_level string, tasks_mapped long, tasks_validated long, tasks_total long")
    got = {r["uid"]: r for r in tm.with_contributions(users, none).collect()}
    assert got[1]["tm_projects"] == "4" and got[1]["tasks_total"] == 0 and got[2]["tm_projects"] is None


def test_presets():
    now = datetime(2024, 3, 13, 15, 30, tzinfo=UTC)
    day = lambda *a: datetime(*a, tzinfo=UTC)
    assert replication.preset("last_hour", now) == (day(2024, 3, 13, 14), day(2024, 3, 13, 15))
    assert replication.preset("last_week", now) == (day(2024, 3, 4), day(2024, 3, 10))
    assert replication.preset("last_week", now, whole=True)[1] == day(2024, 3, 11)
    assert replication.preset("last_month", now) == (day(2024, 2, 1), day(2024, 3, 1))
    assert replication.preset("last_year", now) == (day(2023, 1, 1), day(2023, 12, 31))
    assert replication.preset("days", now, days=3) == (day(2024, 3, 10), day(2024, 3, 13))


def test_sequence_plan():
    zero = datetime(2024, 1, 1, tzinfo=UTC)
    seq_at = lambda t: min(5000, int((t - zero) / timedelta(minutes=1)))
    time_of = lambda s: zero + timedelta(minutes=s)
    got = replication.change_sequences(zero + timedelta(minutes=600, seconds=30), zero + timedelta(minutes=700), "minute", seq_at, time_of, 5000)
    assert (got[0], got[-1]) == (540, 760)
    assert replication.change_sequences(zero + timedelta(minutes=600), zero + timedelta(minutes=700), "day", seq_at, time_of, 5000)[-1] == 701
    with pytest.raises(ConfigError):
        replication.change_sequences(zero, zero, "hour", lambda t: 9, time_of, 5)


def test_config():
    assert StatsConfig(key_value=True).resolved().all_tags
    assert StatsConfig(tm_stats=True).resolved().changeset
    now = datetime(2024, 1, 1, tzinfo=UTC)
    for bad in (StatsConfig(tags=("poi",)), StatsConfig(start=now, end=now), StatsConfig(start=now, end=now + timedelta(days=3), hashtags=("#x",)), StatsConfig(update=True, preset="last_day"), StatsConfig(country=("nepal",), start=now, end=now + timedelta(hours=2))):
        with pytest.raises(ConfigError):
            bad.resolved()


def test_paths_and_urls(spark):
    df = spark.createDataFrame([("https://x.org/replication/minute/001/002/003.osc.gz", 1002003)], "u string, s long")
    r = df.select(C.cache_path(F.col("u"), "changefiles").alias("p"), C.sequence_path(F.col("s"), "b/", ".osc.gz").alias("q"), C.profile_url(F.lit("a b/~*é+")).alias("l")).first()
    assert (r["p"], r["q"]) == ("temp/changefiles/minute/001_002_003.osc.gz", "b/001/002/003.osc.gz")
    assert r["l"].endswith("/a%20b/~%2A%C3%A9%2B")
    assert replication.source_urls(["minute", "https://a", "https://a"], "https://p") == ["https://p/replication/minute", "https://a"]


def test_state_files(spark, tmp_path):
    (tmp_path / "a.state.txt").write_text("#x\nsequenceNumber=42\ntimestamp=2024-01-02T03\\:04\\:05Z\n")
    (tmp_path / "b.state.txt").write_text("---\nlast_run: 2024-01-02 03:04:06.123 +00:00\nsequence: 43\n")
    got = {r["sequence"]: r["ts"] for r in files.state_files(spark, str(tmp_path)).collect()}
    assert got == {42: datetime(2024, 1, 2, 3, 4, 5), 43: datetime(2024, 1, 2, 3, 4, 6)}


def test_sinks(spark, landed, tmp_path):
    users = stats.ranked(stats.user_stats(files.change_files(spark, str(landed / "a.osc.gz")), poi=True))
    sinks.csv(sinks.with_profile(users, "s", "e"), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns[:6] == ["rank", "name", "profile", "uid", "changesets", "map_changes"] and "nodes.create" in back.columns and back.count() == 2
    sinks.json_lines(users, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    text = sinks.markdown(users, "s", "e")
    assert "2 users made 3 changesets with 6 map changes" in text and "- ann: 3 map changes" in text
    assert sinks.text_grid(users.select("rank", "name")).count("\n") == 6
    meta = sinks.metadata("run --password hunter2 --last_day", "x", "s", "e")
    assert "hunter2" not in meta and sinks.resume_point(meta) == "e"
    assert sinks.human(2_340_000) == "2.3 million"


def test_geojson_and_contributions(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}))
    b = files.boundaries(spark, str(tmp_path / "b.geojson"))
    cs = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.5, 5.2), (3, None, 1.0), (4, 9.0, 9.0)], "id long, lon double, lat double")
    assert sorted((r["id"], r["country"]) for r in changesets.with_countries(cs, b).collect()) == [(1, "A"), (1, "B"), (2, "B")]
    (tmp_path / "17.json").write_text(json.dumps({"userContributions": [{"username": "a", "mappingLevel": "BEGINNER", "mapped": 1, "validated": 2, "total": 3}]}))
    r = files.contributions(spark, str(tmp_path / "17.json")).first()
    assert (r["name"], r["tm_projects"], r["tasks_total"]) == ("a", "17", 3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("nodes", 1, False, datetime(2024, 1, d, 5), d % 3, f"u{d % 3}", d, {}) for d in range(1, 9)]
    kind = "osm_type string, version int, deleted boolean, ts timestamp, uid long, user string, changeset long, tags map<string,string>"
    e = spark.createDataFrame(rows, kind).repartition(3)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    summarise = lambda b: stats.user_stats(b)
    q = stream.writeStream.foreachBatch(increments.into_snapshot(str(tmp_path / "snap"), summarise, "uid")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    import os

    last = max(int(p.split("=")[1]) for p in os.listdir(tmp_path / "snap") if "=" in p)
    got = {r["uid"]: r["map_changes"] for r in increments.snapshot(spark, str(tmp_path / "snap"), last).collect()}
    assert got == {r["uid"]: r["map_changes"] for r in stats.user_stats(e).collect()}
    q = increments.day_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").count() == 8


def test_changeset_plan():
    zero = datetime(2024, 1, 1, tzinfo=UTC)
    time_of = lambda s: zero + timedelta(minutes=s)
    plan = lambda a, b: replication.changeset_sequences(a, b, 5000, time_of(5000), time_of)
    got = plan(zero + timedelta(minutes=600), zero + timedelta(minutes=700))
    assert (got[0], got[-1]) == (540, 760)
    assert plan(zero + timedelta(minutes=600), None)[-1] == 5000 and plan(zero + timedelta(minutes=600), zero + timedelta(minutes=4990))[-1] == 5000
    with pytest.raises(ConfigError):
        plan(time_of(5000), None)


def test_windows_are_utc_days_in_any_zone(spark):
    kind = "osm_type string, version int, deleted boolean, ts timestamp_ntz, uid long, user string, changeset long, tags map<string,string>"
    e = spark.createDataFrame([("nodes", 1, False, datetime(2024, 1, d, h), 1, "u", d, {}) for d, h in ((1, 0), (1, 23), (2, 2))], kind)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        zoned = e.withColumn("ts", F.make_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.lit(0), F.lit(0), F.lit("UTC")))
        for df in (e, zoned):
            assert sorted((r["day"], r["n"]) for r in increments.day_counts(df).collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_names_within_a_changeset(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("nodes", 1, False, at(5), 1, "late", 7, {}), ("nodes", 2, False, at(1), 1, "early", 7, {}), ("ways", 1, False, at(9), 1, "late", 8, {}), ("nodes", 1, False, at(1), 2, "b", 9, {}), ("nodes", 1, False, at(1), 2, "a", 9, {}), ("nodes", 1, False, at(1), 3, None, 9, {})]
    e = spark.createDataFrame(rows, "osm_type string, version int, deleted boolean, ts timestamp, uid long, user string, changeset long, tags map<string,string>")
    got = {r["uid"]: (r["name"], r["changesets"], r["map_changes"]) for r in stats.user_stats(e).collect()}
    assert got == {1: ("early", 2, 3), 2: ("a", 1, 2), 3: (None, 1, 1)}


def test_enriched_reads_what_the_parts_read(spark):
    e = spark.createDataFrame([("nodes", 1, False, datetime(2024, 1, 1), u, f"u{u}", c, {}) for u, c in ((1, 1), (1, 2), (2, 2), (3, 9))], "osm_type string, version int, deleted boolean, ts timestamp, uid long, user string, changeset long, tags map<string,string>")
    cs = spark.createDataFrame([(1, ["#a"], ["x"]), (2, ["#b", "#a"], [])], "id long, hashtags array<string>, editors array<string>")
    got = sorted(tuple(r) for r in stats.enriched(e, cs).select("uid", "changesets", "hashtags", "editors").collect())
    assert got == [(1, 2, "#a,#b", "x"), (2, 1, "#a,#b", ""), (3, 1, None, None)]
