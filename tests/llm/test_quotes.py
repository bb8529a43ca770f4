"""Quotation links and reply order against plain Python."""

import random
import re

from edittide.llm import quotes

KIND = "conv_id long, turn long, role string, text string"


def _normal(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def _passages(text):
    """(level, lines) of runs of lines of one level, up to a blank one."""
    out, last = [], None
    for line in re.split(r"\r?\n", text or ""):
        marks = re.match(r"[ \t]*>[> \t]*", line)
        marks = marks[0] if marks else ""
        body = line[len(marks) :]
        if not body.strip(" \t\r\n"):
            last = None
            continue
        level = marks.count(">")
        if level == last:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
        last = level
    return out


def _units(lines):
    found = {_normal(" ".join(lines)), *map(_normal, lines), *map(_normal, re.split(r"(?<=[.!?…])\s", " ".join(lines)))}
    return found - {""}


def _expected(texts):
    """Per turn: reply_to, n_quoted, n_linked; and the turns in reply order."""
    rows, said, kids = {}, {}, {}
    for turn, text in sorted(texts.items()):
        votes, quoted = {}, 0
        parts = _passages(text)
        for level, lines in parts:
            if not level:
                continue
            quoted += 1
            hits = [(len(u), max(said[u])) for u in _units(lines) if u in said]
            if hits:
                votes.setdefault(level, []).append(max(hits)[1])
        before = max((t for t in texts if t < turn), default=None)
        parent = before
        if votes:
            level = votes[min(votes)]
            parent = max(set(level), key=lambda s: (level.count(s), s))
        rows[turn] = (parent, quoted, sum(map(len, votes.values())))
        kids.setdefault(parent, []).append(turn)
        for level, lines in parts:
            if not level:
                for u in _units(lines):
                    said.setdefault(u, set()).add(turn)
    order, stack = [], list(kids.get(None, []))
    while stack:
        t = stack.pop()
        order.append(t)
        stack += reversed(kids.get(t, []))
    return rows, order


def _check(spark, talks):
    got = {}
    rows = [(c, t, "user", x) for c, talk in talks.items() for t, x in talk.items()]
    random.Random(0).shuffle(rows)
    for r in quotes.threads(spark.createDataFrame(rows, KIND)).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for c, talk in talks.items():
        want, order = _expected(talk)
        assert {r["turn"]: (r["reply_to"], r["n_quoted"], r["n_linked"]) for r in got[c]} == want, c
        assert [r["turn"] for r in sorted(got[c], key=lambda r: (r["thread"], r["position"]))] == order, c


def test_links_and_order(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng = random.Random(4)
    words = "alpha beta gamma delta eps".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(2, 4))) + rng.choice([".", "!", "", "?"])

    def wrapped(text, marks):
        out, line = [], []
        for w in text.split():
            line.append(w)
            if rng.random() < 0.3:
                out.append(line)
                line = []
        return "\n".join(marks + " ".join(x) for x in [*out, line] if x)

    talks = {}
    for c in range(25):
        talk, own = {}, []
        for turn in sorted(rng.sample(range(60), rng.randint(1, 22))):
            parts = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if own and rng.random() < 0.8:
                    said = rng.choice(own[-6:] if rng.random() < 0.5 else own)
                    parts.append(wrapped(said, rng.choice(["> ", ">", ">> ", "  > > "])))
                else:
                    parts.append("> " + sentence())
                parts.append(rng.choice(["", " ", ">"]))
            body = " ".join(sentence() for _ in range(rng.randint(1, 3))) + f" {c} {turn}."
            own.append(body)
            talk[turn] = "\n".join([*parts, wrapped(body, "")]) if rng.random() < 0.95 else rng.choice(["", None])
        talks[c] = talk
    _check(spark, talks)


def test_depth_first(spark):
    of = lambda replies: {t: "".join(f"> m{p}\n" for p in [p] if p is not None) + f"m{t}" for t, p in enumerate(replies)}
    talks = {1: of([None, None, 0, 1, 2]), 2: of([None, 0, 0, 1, 1, 2]), 3: of([None, 0, 0, 0, 1, 2, 3, 1, 7, 2])}
    _check(spark, talks)
    rows = quotes.threads(spark.createDataFrame([(1, t, "user", x) for t, x in talks[1].items()], KIND)).collect()
    assert [r["turn"] for r in rows] == [0, 1, 3, 2, 4]


def test_rewrapped_quote_links(spark):
    _check(spark, {1: {0: "alpha one two three four five six", 1: "other", 2: "> alpha one two\n> three four five six\nyes"}, 2: {0: "a b\nc d. e f", 1: "x", 2: "> e F", 3: "> c d\n\n> a b"}})


def test_odd_texts(spark):
    rows = [(1, 0, "user", ">" * 1_000_000 + " x"), (1, 1, "user", " \n" * 300_000), (1, 2, "user", "> x\n" * 200_000 + "end"), (1, 3, "user", "said\r\n"), (1, 4, "user", "> said\r\nsaid"), (1, 4, "user", "again"), (None, 1, None, "> x"), (2, None, None, None), (3, 0, None, "")]
    got = {(r["conv_id"], r["turn"], r["text"]): r for r in quotes.threads(spark.createDataFrame(rows, KIND)).collect()}
    assert len(got) == len(rows)
    assert got[1, 0, ""]["n_quoted"] == 1 and got[1, 2, "end"]["n_quoted"] == 1
    assert got[1, 4, "said"]["reply_to"] == 3 and got[1, 4, "again"]["reply_to"] == 3
    assert (got[None, 1, ""]["thread"], got[2, None, None]["position"], got[3, 0, ""]["reply_to"]) == (0, 0, None)
    assert quotes.threads(spark.createDataFrame([], KIND)).count() == 0
