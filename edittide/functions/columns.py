"""Row expressions over elements, changesets and results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from edittide.schema import ACTIONS, COUNTERS, KINDS

#: Fixed value: what starts and forms a hashtag (letters, digits, underscore, hyphen).
HASHTAG = r"#[\p{L}\p{N}_-]+"
#: Fixed value: editors made for work in the field.
FIELD_EDITORS = (
    "streetcomplete",
    "vespucci",
    "go map",
    "every door android",
    "organic maps android",
    "osmand",
    "every door ios",
    "organic maps ios",
    "osmand maps",
)


def action(version: Column, deleted: Column) -> Column:
    """create, modify or delete; NULL for a version below 0."""
    v = F.when(deleted, F.lit(0)).otherwise(version)
    return F.when(v == 0, "delete").when(v == 1, "create").when(v > 1, "modify")


def utc_clock(ts: Column) -> Column:
    """An instant as the time that clocks show in UTC (without a zone), whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def instant(clock: Column) -> Column:
    """What clocks show in UTC (a time without a zone) as an instant, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), clock))


def day(ts: Column, zoned: bool = True) -> Column:
    """UTC day as yyyy-MM-dd. `zoned`: ts is an instant; else it is UTC time without a zone."""
    if zoned:
        return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int")).cast("string")
    return ts.cast("date").cast("string")


def is_poi(osm_type: Column, tags: Column, act: Column) -> Column:
    return (osm_type == "nodes") & (F.size(tags) > 0) & (act != "delete")


def has_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, F.lit(key)), F.lit(False))


def total(names: Iterable[str], prefix: str = "") -> Column:
    """Sum of columns, a NULL counted as 0."""
    out = F.lit(0).cast("bigint")
    for n in names:
        out = out + F.coalesce(F.col(prefix + n), F.lit(0))
    return out


def map_changes() -> Column:
    return total(COUNTERS)


def of_action(act: str) -> Column:
    """Row total of an action over the element kinds."""
    assert act in ACTIONS
    return total(f"{k}_{act}" for k in KINDS)


def hashtags(comment: Column) -> Column:
    """Distinct hashtags of a comment in their first spelling; empty for NULL."""
    found = F.regexp_extract_all(comment, F.lit(HASHTAG), F.lit(0))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def comment_contains(comment: Column, needles: Sequence[str]) -> Column:
    """Any needle, whatever its case, anywhere in the comment; a NULL comment has none."""
    low = F.lower(comment)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n.lower()))
    return F.coalesce(out, F.lit(False))


def hashtag_in(comment: Column, needles: Sequence[str]) -> Column:
    """Any needle (with its `#`) equal to a hashtag, whatever its case."""
    low = F.transform(hashtags(comment), F.lower)
    return F.arrays_overlap(low, F.array(*[F.lit(n.lower()) for n in needles]).cast("array<string>"))


def editor(created_by: Column) -> Column:
    """First run of letters and white space, lower-cased and trimmed; else the trimmed input."""
    run = F.regexp_extract(created_by, r"([a-zA-Z\s]+)", 1)
    return F.when(run == "", F.trim(created_by)).otherwise(F.trim(F.lower(run)))


def from_field_editor(created_by: Column) -> Column:
    """Also true for changesets that name no editor."""
    return created_by.isNull() | editor(created_by).isin(*FIELD_EDITORS)


def project_ids(tags: Column) -> Column:
    return F.regexp_extract_all(tags, F.lit(r"#hotosm-project-(\d+)"), F.lit(1))


def percent_encoded(text: Column) -> Column:
    """Path-style percent encoding: the form encoding of url_encode, mended in four places."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def profile_url(name: Column, prefix: str = "https://www.openstreetmap.org/user/") -> Column:
    return F.concat(F.lit(prefix), percent_encoded(name))


def sequence_path(sequence: Column, base: str, suffix: str) -> Column:
    """Sequence number as base + AAA/BBB/CCC + suffix; numbers of over nine digits keep the rest in the last part."""
    s = sequence.cast("string")
    s = F.when(F.length(s) < 9, F.lpad(s, 9, "0")).otherwise(s)
    return F.concat(F.lit(base), F.substring(s, 1, 3), F.lit("/"), F.substring(s, 4, 3), F.lit("/"), s.substr(F.lit(7), F.length(s)), F.lit(suffix))


def cache_path(url: Column, mode: str) -> Column:
    """Landing path of a replication file: temp/<mode>/<directory before the numbers>/AAA_BBB_CCC.ext."""
    parts = F.split(url, "/")
    return F.concat_ws("/", F.lit("temp"), F.lit(mode), F.element_at(parts, -4), F.concat_ws("_", F.element_at(parts, -3), F.element_at(parts, -2), F.element_at(parts, -1)))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, cut towards zero."""
    return ((F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 60).cast("bigint")


def state_timestamp(text: Column) -> Column:
    """`timestamp=` or `last_run:` of a replication state file."""
    plain = F.regexp_replace(text, r"\\:", ":")
    iso = F.regexp_extract(plain, r"timestamp=(\S+?)Z", 1)
    run = F.regexp_extract(plain, r"last_run: (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    utc = lambda text: F.concat(text, F.lit("+00:00"))
    return F.coalesce(F.try_to_timestamp(utc(iso), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(utc(run), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def state_sequence(text: Column) -> Column:
    n = F.regexp_extract(text, r"(?:sequence: |sequenceNumber=)(\d+)", 1)
    return F.when(n != "", n.cast("bigint"))


def parse_utc(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def in_zone(ts: Column, zone: str) -> Column:
    """An instant as the time that clocks show in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_clock(ts))


def add_known(a: Column, b: Column) -> Column:
    """a + b; the one that is known if the other is NULL; NULL if both are."""
    return F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b))


def number(text: Column) -> Column:
    """Text as a number, NULL where it is none."""
    return text.try_cast("double")


def joined_union(a: Column, b: Column) -> Column:
    """Two comma lists as one, sorted, without repeats and without 'nan'; NULL counts as empty."""
    parts = [F.when(x.isNull() | (x == ""), F.array().cast("array<string>")).otherwise(F.split(x, ",")) for x in (a, b)]
    return F.array_join(F.array_sort(F.array_remove(F.array_union(*parts), "nan")), ",")


def map_sum(a: Column, b: Column) -> Column:
    """Union of the keys, values added; a NULL map counts as empty."""
    empty = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def by_count(counts: Column) -> Column:
    """Entries of a map as an array, largest count first, ties by key."""
    return F.array_sort(
        F.map_entries(counts),
        lambda x, y: F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0),
    )


def count_json(counts: Column) -> Column:
    """A map of counts as JSON text, largest first."""
    return F.to_json(F.map_from_entries(by_count(counts)))


def counts_from_json(text: Column) -> Column:
    """JSON text as a map of counts; NULL where it is no such object."""
    return F.from_json(text, "map<string,bigint>")


def json_value(text: Column, key: str) -> Column:
    """Value of a key of a JSON object as text; NULL for bad JSON or a missing key."""
    return F.get_json_object(text, "$['" + key.replace("'", "\\'") + "']")


def raw_url(url: Column) -> Column:
    """A code host's page of a file as the address of its raw content."""
    raw = F.replace(F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/blob/"), F.lit("/"))
    return F.when(F.contains(url, F.lit("github.com")) & F.contains(url, F.lit("/blob/")), raw).otherwise(url)
