"""Runs from options to results and files, one for each way in."""

import gzip
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from edittide import run, sinks
from edittide.config import ConfigError, StatsConfig
from edittide.functions import columns as C
from edittide.operators import changesets, filters, stats
from edittide.sources import files, replication
from tests.test_engine import OSC, OSM

UTC = timezone.utc
START, MIDDLE, END = (datetime(2024, 1, d, tzinfo=UTC) for d in (1, 2, 3))
CONTRIBUTIONS = "name string, tm_projects string, tm_mapping_level string, tasks_mapped long, tasks_validated long, tasks_total long"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("landed")
    for name, text in (("a.osc.gz", OSC), ("c.osm.gz", OSM.replace("fix #Roads", "fix #hotosm-project-17 #Roads"))):
        with gzip.open(d / name, "wt", encoding="utf-8") as f:
            f.write(text)
    square = lambda name, x: (name, [[(x, -1.0), (x + 5.0, -1.0), (x + 5.0, 5.0), (x, 5.0), (x, -1.0)]])
    countries = spark.createDataFrame([square("A", 0.0), square("B", 50.0)], "name string, rings array<array<struct<x:double,y:double>>>")
    contributions = spark.createDataFrame([("ann", "17", "ADVANCED", 3, 2, 5), ("bob", "17", "BEGINNER", 9, 9, 18)], CONTRIBUTIONS)
    return run.Inputs([files.change_files(spark, str(d / "a.osc.gz"))], files.changeset_files(spark, str(d / "c.osm.gz")), countries, contributions, now=END)


def test_plain_range(spark, inputs):
    r = run.calculate(spark, StatsConfig(start=START, end=MIDDLE), run.Inputs(inputs.elements))
    assert [(x["rank"], x["name"], x["map_changes"]) for x in r.users.collect()] == [(1, "ann", 3)] and r.days is None
    assert run.calculate(spark, StatsConfig(start=START, end=END, users=("bob",)), run.Inputs(inputs.elements)).users.first()["name"] == "bob"
    one = run.calculate(spark, StatsConfig(preset="last_day", rows=1), run.Inputs(inputs.elements, now=END + timedelta(hours=3)))
    assert (one.start, one.end) == (MIDDLE, END) and [(x["rank"], x["name"]) for x in one.users.collect()] == [(1, "bob")]


def test_everything(spark, inputs, tmp_path):
    c = StatsConfig(start=START, end=MIDDLE, hashtags=("roads",), tags=("highway",), length=("highway",), key_value=True, summary=True, tm_stats=True, meta=True, formats=("csv", "json", "text"), name="s")
    r = run.calculate(spark, c, inputs)
    u = r.users.first()
    assert (u["name"], u["countries"], u["editors"], u["highway_create"], u["tm_projects"], u["tasks_total"]) == ("ann", "A", "JOSM/1.5 (1 en)", 1, "17", 5)
    assert u["highway_len_m"] > 100_000 and '"highway=path":1' in u["tags_create"] and "#Roads" in u["hashtags"]
    day = r.days.first()
    assert (day["timestamp"], day["users"], day["editors"]) == ("2024-01-01", 1, '{"josm":3}')
    texts = run.write(r, str(tmp_path), "run --password x")
    back = spark.read.csv(str(tmp_path / "s.csv"), header=True, escape="\"").first()
    assert back["end_date"] == "2024-01-02 00:00:00+00:00" and back["nodes.create"] == "2"
    assert "- ann: 3 tasks" in texts["s_summary.md"] and "Top tags (create)" in texts["s_summary.md"]
    assert sinks.resume_point(texts["s_metadata.json"]) == "2024-01-02 00:00:00+00:00" and "hours" in texts["elapsed"]
    resumed = run.calculate(spark, StatsConfig(read_from_metadata="s"), run.Inputs(inputs.elements, metadata=texts["s_metadata.json"], now=END))
    assert resumed.start == MIDDLE and [x["name"] for x in resumed.users.collect()] == ["bob"]


def test_update_equals_whole(spark, inputs, tmp_path):
    base = StatsConfig(start=START, end=MIDDLE, changeset=True, tags=("highway",), all_tags=True, summary=True)
    run.write(run.calculate(spark, base, inputs), str(tmp_path))
    later = run.Inputs(**{**vars(inputs), "old_users": str(tmp_path / "stats.csv"), "old_days": str(tmp_path / "stats_summary.csv")})
    update = StatsConfig(update=True, end=END, changeset=True, tags=("highway",), all_tags=True, summary=True)
    got, want = run.calculate(spark, update, later), run.calculate(spark, StatsConfig(**{**vars(update), "update": False, "start": START}), inputs)
    assert got.start == MIDDLE
    # a merged list or map without entries is empty, not NULL
    rows = lambda df, columns: sorted(str([None if v in ("", "{}") else v for v in r]) for r in df.select(sorted(columns)).collect())
    for a, b in ((got.users, want.users), (got.days, want.days)):
        assert rows(a, b.columns) == rows(b, b.columns)
    with pytest.raises(ConfigError):
        run.calculate(spark, update, inputs)


def test_names_count_with_a_boundary(spark, inputs):
    box = '{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-1, -1], [9, -1], [9, 9], [-1, 9], [-1, -1]]]}}'
    for users, want in (((), ["ann"]), (("ann",), ["ann"]), (("bob",), [])):
        r = run.calculate(spark, StatsConfig(start=START, end=END, boundary=box, users=users), inputs)
        assert [x["name"] for x in r.users.collect()] == want
    cs = changesets.flat(inputs.changesets)
    assert {x["id"] for x in changesets.select_changesets(cs, users=("bob",)).collect()} == {101}
    assert {x["id"] for x in changesets.select_changesets(cs, users=("ann",), field_mappers=True).collect()} == {101}


def test_other_session_zones(spark):
    rows = [("nodes", 1, False, datetime(2024, 1, 1, 2, tzinfo=UTC), 1, "a", 1, {}), ("nodes", 1, False, datetime(2024, 1, 2, tzinfo=UTC), 1, "a", 1, {})]
    kind = "osm_type string, version int, deleted boolean, ts timestamp, uid long, user string, changeset long, tags map<string,string>"
    e = spark.createDataFrame(rows, kind)
    for zone in ("America/New_York", "Asia/Kathmandu", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r["timestamp"] for r in stats.day_summary(e).orderBy("timestamp").collect()] == ["2024-01-01", "2024-01-02"]
            assert filters.in_range(e, START, MIDDLE).count() == 1 and filters.in_range(e, "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 1
            at = e.limit(1).select(F.date_format(C.in_zone(F.col("ts"), "Asia/Kathmandu"), "yyyy-MM-dd HH:mm").alias("k"), F.unix_seconds(C.state_timestamp(F.lit("timestamp=2024-01-02T03\\:04\\:05Z"))).alias("s")).first()
            assert (at["k"], at["s"]) == ("2024-01-01 07:45", 1704164645)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_changeset_sequences():
    zero = datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda m: zero + timedelta(minutes=m)
    late = lambda s: at(s - 7)  # files that lag by seven numbers
    got = replication.changeset_sequences(at(600), at(700), 5000, at(5000), late)
    assert (got[0], got[-1]) == (607 - replication.CHANGESET_PAD, 707 + replication.CHANGESET_PAD)
    assert late(got[0]) <= at(600) and late(got[-1]) >= at(700)
    assert replication.changeset_sequences(at(600), None, 5000, at(5000), at)[-1] == 5000
    with pytest.raises(ConfigError):
        replication.changeset_sequences(at(5000), None, 5000, at(5000), at)


def test_earlier_result_by_name(spark, tmp_path):
    (tmp_path / "old.csv").write_text('name,tags_create,nodes.create,uid,extra\nann,"{""a"":2}",5,7,x\n')
    r = files.stats_csv(spark, str(tmp_path / "old.csv"), "uid long, nodes_create long, tags_create string, name string, ways_create long").first()
    assert tuple(r) == (7, 5, '{"a":2}', "ann", None)
    assert files.table_csv(spark, str(tmp_path / "old.csv")).schema["uid"].dataType.simpleString() == "int"


def test_elapsed_and_small_functions(spark):
    assert sinks.elapsed(3725.9) == "1 hours 2 minutes 5 seconds"
    row = spark.range(1).select(C.number(F.lit("x")).alias("a"), C.number(F.lit("1.5")).alias("b"), F.unix_seconds(C.parse_utc(F.lit("2024-01-01 05:45:00+05:45"))).alias("c"), C.raw_url(F.lit("https://github.com/a/b/blob/main/c.csv")).alias("d")).first()
    assert tuple(row) == (None, 1.5, 1704067200, "https://raw.githubusercontent.com/a/b/main/c.csv")
    users = spark.createDataFrame([(1, "a", 2, 10, *[1] * 9)], "uid long, name string, changesets long, map_changes long, " + ", ".join(f"{k}_{a} long" for k in ("nodes", "ways", "relations") for a in ("create", "modify", "delete")))
    assert sinks.post_text(users, "x").startswith("x: 1 users made 2 changesets with 10 map changes.")
