"""Writers of results. The frames here have one row per user or day."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edittide.functions import columns as C
from edittide.operators import report
from edittide.schema import ACTIONS, KINDS

_ORDER = ("rank", "name", "profile", "uid", "timestamp", "users", "changesets", "map_changes")


def export_columns(df: DataFrame) -> DataFrame:
    """Fixed order, and dots for underscores in counters (nodes.create)."""
    rest = [c for c in df.columns if c not in _ORDER]
    base = [f"{k}_{a}" for k in (*KINDS, "poi") for a in ACTIONS if f"{k}_{a}" in rest]
    late = [c for c in ("tags_create", "tags_modify", "hashtags") if c in rest]
    tm = [c for c in rest if c.startswith(("tm_", "tasks_"))]
    dates = [c for c in ("start_date", "end_date") if c in rest]
    sets = [c for c in ("countries", "editors") if c in rest]
    own = [c for c in rest if c not in {*base, *late, *tm, *dates, *sets}]
    dotted = lambda c: re.sub(r"_(create|modify|delete)$", r".\1", c) if c not in ("tags_create", "tags_modify") else c
    return df.select(*[F.col(c).alias(dotted(c)) for c in (*[c for c in _ORDER if c in df.columns], *base, *sets, *own, *late, *tm, *dates)])


def with_profile(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumns({"profile": C.profile_url(F.col("name")), "start_date": F.lit(start), "end_date": F.lit(end)})


def csv(df: DataFrame, path: str) -> None:
    """One part file with a header; quotes in JSON cells are doubled."""
    export_columns(df).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def json_lines(df: DataFrame, path: str) -> None:
    export_columns(df).coalesce(1).write.mode("overwrite").json(path)


def text_grid(df: DataFrame, rows: int = 1000) -> str:
    """A table with lines around its cells, of the first `rows` rows (a report for reading)."""
    found = df.limit(rows).collect()
    cells = [list(df.columns), *[["" if v is None else str(v) for v in r] for r in found]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = lambda mark: "+" + "+".join(mark * (w + 2) for w in width) + "+"
    body = lambda r: "|" + "|".join(f" {v.ljust(w)} " for v, w in zip(r, width)) + "|"
    out = [line("-"), body(cells[0]), line("=")]
    for r in cells[1:]:
        out += [body(r), line("-")]
    return "\n".join(out)


def human(n: float) -> str:
    """1234567 as 1.2 million; below a million with its digits."""
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million")):
        if abs(n) >= size:
            return f"{n / size:.1f} {name}"
    return str(int(n))


def markdown(users: DataFrame, start: str, end: str, lists: Sequence[str] = (), tags: Sequence[str] = (), lengths: Sequence[str] = ()) -> str:
    """Summary for reading: totals, five top users, tag and length totals, and the five most frequent entries of comma lists."""
    t = report.totals(users).first()
    out = [f"### Stats from {start} to {end} (UTC)", "", f"#### {human(t['users'])} users made {human(t['changesets'])} changesets with {human(t['map_changes'])} map changes.", f"#### {human(t['created'])} elements were created, {human(t['modified'])} modified and {human(t['deleted'])} deleted.", "", "Top 5 users:"]
    out += [f"- {r['name']}: {human(r['map_changes'])} map changes" for r in report.top(users, 5, "map_changes", "uid").collect()]
    known = [x for x in ("poi", *tags) if f"{x}_create" in users.columns]
    if known:
        sums = users.agg(*[F.coalesce(F.sum(f"{x}_{a}"), F.lit(0)).alias(f"{x}_{a}") for x in known for a in ("create", "modify")]).first()
        out += ["", "Tags:", *[f"- {x}: created {human(sums[f'{x}_create'])}, modified {human(sums[f'{x}_modify'])}" for x in known]]
    if lengths:
        sums = users.agg(*[F.bround(F.coalesce(F.sum(f"{x}_len_m"), F.lit(0)) / 1000).alias(x) for x in lengths]).first()
        out += [f"- {x} length created: {human(sums[x])} km" for x in lengths]
    if "tags_create" in users.columns:
        for a in ("create", "modify"):
            out += ["", f"Top tags ({a}):", *[f"- {r['tag']}: {human(r['n'])}" for r in report.sum_maps(users, f"tags_{a}", 5).collect()]]
    if "tasks_mapped" in users.columns:
        for c, what in (("tasks_mapped", "mappers"), ("tasks_validated", "validators")):
            found = report.top(users.filter(F.col(c) > 0), 5, c, "uid").collect()
            out += ["", f"Top project {what}:", *[f"- {r['name']}: {human(r[c])} tasks" for r in found]] if found else []
    for c in lists:
        if c in users.columns and report.has_any(users, c).first()["any"]:
            out += ["", f"Trending {c}:", *[f"- {r['item']}: {r['n']} users" for r in report.trending(users, c).collect()]]
    return "\n".join(out) + "\n"


def elapsed(seconds: float) -> str:
    """Seconds as hours, minutes and seconds."""
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes // 60} hours {minutes % 60} minutes {rest} seconds"


def metadata(command: str, source: str, start: str, end: str, start_seq: str = "", end_seq: str = "") -> str:
    """Run metadata as JSON; the value after a password option is blotted out."""
    safe = re.sub(r"(--password[= ])(\"[^\"]*\"|'[^']*'|\S+)", r"\1***", command)
    return json.dumps({"command": safe, "source": source, "start_date": start, "start_seq": start_seq, "end_date": end, "end_seq": end_seq}, indent=2)


def resume_point(text: str) -> str:
    """Where the run after this metadata starts."""
    return json.loads(text)["end_date"]


def post_text(users: DataFrame, name: str) -> str:
    """Short text of the totals for a post."""
    t = report.totals(users).first()
    return f"{name}: {human(t['users'])} users made {human(t['changesets'])} changesets with {human(t['map_changes'])} map changes. {human(t['created'])} created, {human(t['modified'])} modified, {human(t['deleted'])} deleted."
