"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its elements, named by their path, and its text blocks, named by path and text. Tokens of a
host that occur the same number of times on the same pages (equal occurrence vectors) form an equivalence class. A vector is
held as counts and a combined hash of (page, count), so classes come from one aggregation by (host, token). Pages of a host with the
same content are one page. A class is valid if it spans enough pages, and holds text in one of its own elements. Valid classes are the
host's template. Text outside it fills the template's slots, one for each path of a block element.

The slot that holds most of a host's varying text is the article's main one. If the markup names an element around it as the article, the article is
what that element holds; else it is the main slot, what lies in elements for text (paragraphs, headings, lists, tables), and other
slots that hold a fair share. Names decide on pages without the host's main slot, and on hosts of too few pages. What the markup names as beside
the article is in no slot.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Set
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edittide.llm import hosts
from edittide.llm.common import cut

#: Pages that a class must span; template rows that are sent to all workers at most; pages of a host that a task extracts beyond that.
PAGES, SENT, TURN = 3, 500_000, 4096
#: Elements above a text that its nesting is looked for in; share of the varying text below which a bare text in no element for text is no article's.
ABOVE, BARE = 32, 0.1

#: Fixed values of HTML: elements that end a block, that hold no content of their own, that are empty, and that an opening tag closes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav footer aside form button select option menu dialog iframe object svg canvas template noscript".split())
RAW = "script|style|noscript|template|iframe|textarea|svg"
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}, "tfoot": {"tbody", "tr"}}
#: What names an element as the article or as something beside it, in class, id or role.
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|post-content|entry-content|main-content|main)(?:$|[\s_-])")
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|footer|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|widget|masthead|login|signup|search|pagination|pager|complementary|contentinfo|copyright|skip-link)(?:$|[\s_-])"
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>", re.S | re.I)
_NAMED = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)


def _role(tag: str, attributes: str) -> tuple[str, str]:
    """Name of an element in paths, and what it is: 'main', 'beside' or ''."""
    names, hidden = [], False
    if attributes:
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif value:
                names.append(value)
    label = " ".join(names)
    name = f"{tag}.{label}" if label else tag
    if hidden or tag in DROPPED or label and BESIDE.search(label):
        return name, "beside"
    if tag in ("article", "main") or label and ARTICLE.search(label):
        return name, "main"
    return name, ""


class Block(NamedTuple):
    """A text block: its role (its nearest ancestor's that has one), its text, the hashes of its path and slot, whether an element for text holds it,
    and the nearest elements above it."""

    role: str
    text: str
    path: int
    slot: int
    flow: bool
    above: list[int]

    @property
    def token(self) -> int:
        return _hash(f"{self.path}\0{self.text}")


def parse(text: str) -> tuple[Counter, list[Block]]:
    """Counts of the elements' paths, and the blocks in page order. A path is a hash of the path above and the element's name, so depth costs nothing."""
    elements: Counter = Counter()
    blocks: list[Block] = []
    stack: list[tuple] = [("", 0, "", False, 0, False)]  # tag, path, role, inside the article, slot, element for text
    open_: Counter = Counter()
    known: dict[tuple[int, str], int] = {}
    run: list[str] = []
    state: list[tuple] = []

    def end() -> None:
        if run:
            words = " ".join("".join(run).split())
            if words:
                (_, path, role, _, slot, flow), above = state
                blocks.append(Block(role, words, path, slot, flow, above))
            run.clear()

    def put(piece: str) -> None:
        if not run:
            state[:] = stack[-1], [s[1] for s in stack[-ABOVE:]]
        run.append(piece)

    def pop(n: int) -> None:
        for s in stack[n:]:
            open_[s[0]] -= 1
        del stack[n:]

    def last(tag: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)

    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            put(entities.unescape(text[at : m.start()]))
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if open_[tag]:
                if tag in BLOCKS:
                    end()
                pop(last(tag))
            elif tag in BLOCKS:
                end()
            continue
        if tag == "br":
            put(" ")
            continue
        name, role = _role(tag, m[4] or "")
        if tag in BLOCKS or role:
            end()
        if tag in VOID:
            continue
        if tag in BLOCKS and open_["p"]:
            p = last("p")
            if not (open_["button"] or open_["object"]) or not {"button", "object"} & {s[0] for s in stack[p:]}:
                pop(p)
        if tag in CLOSES:
            while stack[-1][0] in CLOSES[tag]:
                pop(len(stack) - 1)
        if tag in ("article", "main") and open_["head"]:
            pop(next(i for i, s in enumerate(stack) if s[0] == "head"))
        _, above, inherited, inside, slot, flow = stack[-1]
        if tag == "header" and role != "main" and not BESIDE.search(name):
            role = "" if inside else "beside"
        if tag == "body":
            kept = [s for s in stack if s[0] in ("", "html")]
            pop(1)
            stack += kept[1:]
            open_.update(s[0] for s in kept[1:])
            _, above, inherited, inside, slot, flow = stack[-1]
        path = known.get((above, name))
        if path is None:
            path = known[above, name] = _hash(f"{above}/{name}")
        elements[path] += 1
        if m[4] and m[4].endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            slot, flow = path, flow or tag in FLOW
        stack.append((tag, path, role or inherited, inside or role == "main", slot, flow))
        open_[tag] += 1
    if at < len(text):
        put(entities.unescape(text[at:]))
    end()
    return elements, blocks


def _hash(text: str) -> int:
    """Same 64-bit number of a text in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_ROW = pa.struct([("kind", pa.int32()), ("token", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("slot", pa.int64()), ("above", pa.list_(pa.int64()))])
_TOKENS = "host string, content long, tokens array<struct<kind int, token long, n long, chars long, slot long, above array<long>>>"
_TOKENS_ARROW = pa.schema([("host", pa.string()), ("content", pa.int64()), ("tokens", pa.list_(_ROW))])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and distinct content of a batch the tokens with their counts. kind 0: element, 1: text block, with the elements above it, 2: slot,
    with the characters in it that are not beside the article; slot 0 stands for the page.

    content: hash of the text outside parts that are named as beside; pages that differ in nothing else are copies and count once.
    """
    for b in batches:
        seen: set[tuple[str, int]] = set()
        rows = []
        for host, html in zip(*(c.to_pylist() for c in b.columns)):
            elements, blocks = parse(html or "")
            content = _hash("\n".join(x.text for x in blocks if x.role != "beside"))
            if (host, content) in seen:
                continue
            seen.add((host, content))
            texts = {x.token: x for x in blocks}
            counts, slots = Counter(x.token for x in blocks), Counter({0: 0})
            for x in blocks:
                if x.role != "beside":
                    slots[x.slot] += len(x.text)
                    slots[0] += len(x.text)
            tokens = [(0, t, n, None, None, None) for t, n in elements.items()]
            tokens += [(1, t, counts[t], 0 if x.role == "beside" else len(x.text), x.slot, x.above) for t, x in texts.items()]
            rows.append((host, content, tokens + [(2, t, n, None, None, None) for t, n in slots.items()]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), _TOKENS_ARROW)] if rows else [pa.array([], t.type) for t in _TOKENS_ARROW], schema=_TOKENS_ARROW)


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `pages` (host, page_id, html): (host, token) of the text blocks of templates; (host, slot, main) of hosts of PAGES different pages.

    The second has the slot with the most varying text (main) and others that hold a share of BARE at least.
    """
    distinct = pages.select("host", "html").mapInArrow(_tokens, _TOKENS).dropDuplicates(["host", "content"])
    found = distinct.select("host", "content", F.inline("tokens"))
    vector = ("pages", "n", "sig")
    counted = F.count("*").alias("pages"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("content", "n")).alias("sig"), F.first("chars").alias("chars"), F.first("slot").alias("slot"), F.first("above").alias("above")
    wide = cut(found.groupBy("host", "kind", "token").agg(*counted).filter((F.col("pages") >= PAGES) | (F.col("kind") == 2)))
    # Nesting: a text of the template lies in an element of its own class, which has at least these two tokens then.
    elements = wide.filter("kind = 0").select("host", F.col("token").alias("element"), *vector)
    texts = wide.filter("kind = 1").select("host", "token", "chars", "slot", *vector, F.explode("above").alias("element"))
    kept = cut(texts.join(elements, ["host", "element", *vector], "left_semi").select("host", "token", "slot", (F.col("chars") * F.col("n")).alias("chars")).distinct())
    fixed = kept.groupBy("host", "slot").agg(F.sum("chars").alias("fixed"))
    whole = kept.groupBy("host").agg(F.sum("chars").alias("fixed")).withColumn("slot", F.lit(0).cast("long"))
    slots = wide.filter("kind = 2").select("host", F.col("token").alias("slot"), "n", "pages")
    slots = slots.join(fixed.unionByName(whole), ["host", "slot"], "left").withColumn("chars", F.col("n") - F.coalesce("fixed", F.lit(0)))
    page = slots.filter("slot = 0").select("host", "pages", F.col("chars").alias("all")).filter((F.col("pages") >= PAGES) & (F.col("all") > 0))
    most = slots.filter("slot <> 0").groupBy("host").agg(F.max_by("slot", F.struct("chars", "slot")).alias("top"))
    fair = slots.filter("slot <> 0").select("host", "slot", "chars").join(page, "host").join(most, "host").withColumn("main", F.col("slot") == F.col("top"))
    return kept.select("host", "token"), fair.filter(F.col("main") | (F.col("chars") >= F.col("all") * BARE)).select("host", "slot", "main")


def article(html: str, constant: Set[int], main: int | None, fair: Set[int] = frozenset()) -> str:
    """The article's blocks outside the template, one a line. main, fair: the host's main slot and others with a fair share, if known."""
    _, blocks = parse(html)
    blocks = [x for x in blocks if x.role != "beside" and x.token not in constant]
    chars: Counter = Counter()
    for x in blocks:
        chars[x.slot] += len(x.text)
    if main in chars:
        named = any(x.role == "main" for x in blocks if x.slot == main)
    else:
        named = any(x.role == "main" for x in blocks)
        main = max(chars, key=chars.__getitem__, default=None)
        fair = {s for s, n in chars.items() if n >= BARE * sum(chars.values())}
    return "\n".join(x.text for x in blocks if (x.role == "main" if named else x.flow or x.slot == main or x.slot in fair))


def _answer(pages: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _extracted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants, mains, fairs = sent.value
        for b in batches:
            hosts_, pages, urls, htmls = (c.to_pylist() for c in b.columns)
            yield _answer(pages, urls, [article(t or "", constants.get(h, frozenset()), mains.get(h), fairs.get(h, frozenset())) for h, t in zip(hosts_, htmls)])

    return run


def _extracted_by_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, turn, kind, token, page_id, url, html) sorted by (host, turn, kind): the host's template (kind 0: tokens, 1: main slot, 2: other
    slots with a fair share), then pages."""
    at, constant, main, fair = None, set(), None, set()
    for b in batches:
        pages, urls, texts = [], [], []
        for host, turn, kind, token, page, url, html in zip(*(c.to_pylist() for c in b.columns)):
            if (host, turn) != at:
                at, constant, main, fair = (host, turn), set(), None, set()
            if kind == 0:
                constant.add(token)
            elif kind == 1:
                main = token
            elif kind == 2:
                fair.add(token)
            else:
                pages.append(page)
                urls.append(url)
                texts.append(article(html or "", constant, main, fair))
        yield _answer(pages, urls, texts)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    text: the article's blocks in page order, one a line, character references decoded and white space in a block as one space; empty for a
    null or empty html or if there is none. Pages without a host share the host ''. Templates of at most SENT tokens in all are sent to the
    workers; with more, a host's pages are dealt in turns of about TURN, and its template goes once to each turn.
    """
    out = "page_id long, url string, text string, n_chars long"
    rows = pages.select(hosts.host(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tokens, slots = (cut(df) for df in templates(rows))
    if tokens.count() + slots.count() <= SENT:
        constants: dict[str, set[int]] = {}
        for r in tokens.toLocalIterator():
            constants.setdefault(r["host"], set()).add(r["token"])
        mains: dict[str, int] = {}
        fairs: dict[str, set[int]] = {}
        for r in slots.toLocalIterator():
            if r["main"]:
                mains[r["host"]] = r["slot"]
            else:
                fairs.setdefault(r["host"], set()).add(r["slot"])
        sent = pages.sparkSession.sparkContext.broadcast((constants, mains, fairs))
        return rows.mapInArrow(_extracted(sent), out)
    turns = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns")))
    none, zero = F.lit(None), F.lit(0)
    each = tokens.select("host", F.lit(0).alias("kind"), "token").unionByName(slots.select("host", F.when(F.col("main"), 1).otherwise(2).alias("kind"), F.col("slot").alias("token")))
    each = each.join(turns, "host").withColumn("turn", F.explode(F.sequence(zero, F.col("turns") - 1)))
    each = each.select("host", "turn", "kind", "token", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"))
    dealt = rows.join(turns, "host").withColumn("turn", F.pmod(F.xxhash64("page_id", "url"), F.col("turns")).cast("int"))
    dealt = dealt.select("host", "turn", F.lit(3).alias("kind"), none.cast("long").alias("token"), "page_id", "url", "html")
    return each.unionByName(dealt).repartition("host", "turn").sortWithinPartitions("host", "turn", "kind").mapInArrow(_extracted_by_turn, out)
