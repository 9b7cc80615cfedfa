"""Main text of web pages, by their elements and by a suffix array of each host.

Elements that never hold the article (menus, footers, forms, scripts and the like, by name, class or id) go with all
they hold. The remaining blocks of every page are one token stream, and the streams of a host are put in one suffix
array. A whole block is boilerplate if it lies in strings that distinct streams share and at least half of the host's
distinct streams have it outside of an ``article`` or ``main`` element. Of a page without such an element all else is the
text. Of one that has it the text is what the element holds: what articles share is theirs, and only boilerplate that
several of them have swallowed, as an element does that is not closed, is cut out. Pages with one stream count once, so
copies of a page do not make its text boilerplate.

What no block of boilerplate is in cannot lose anything, whatever the array finds. So the array is given the streams
that hold such blocks, with an empty block in place of what one stream alone has.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .repeated_strings import merged, repeated_spans
from .url_reputation import url_host

#: Bytes of a string that distinct pages of a host must share, and of the pieces that anchors are chosen from.
LENGTH, PIECE = 48, 16
#: Share of a host's distinct streams, and their least number, that have a block of boilerplate.
SHARE, LEAST = 0.5, 2

_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "aside button canvas datalist dialog fieldset footer form head label map menu nav noscript object select svg template audio video".split()
) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ROOT = frozenset(("article", "main"))
_KEPT = _ROOT | frozenset(("html", "body"))
#: Parts of a class or an id that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer menu "
    "modal nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar social sponsor sponsored "
    "subscribe widget".split()
)
#: An element that is closed by the start of another one, and how far up it is looked for.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table div section article main aside nav footer header form blockquote td th body".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_MARKED = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in _RAW}


def _dropped(name: str, attributes: str) -> bool:
    if name in _DROPPED:
        return True
    if name in _KEPT or "=" not in attributes:
        return False
    return any(p in _MARKS for m in _MARKED.finditer(attributes) for p in _PARTS.split("".join(x or "" for x in m.groups()).lower()))


def page_blocks(page: str | None) -> list[tuple[str, bool]]:
    """The blocks of a page in order, each with whether it lies in an article; in time linear in the page."""
    text = page or ""
    blocks: list[tuple[str, bool]] = []
    current: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether they are dropped
    opened: Counter[str] = Counter()
    dropped = articles = 0
    at, last, quotes = 0, text.rfind(">"), True

    def end_block() -> None:
        words = " ".join("".join(current).split())
        if words:
            blocks.append((words, articles > 0))
        current.clear()

    def pop() -> str:
        nonlocal dropped, articles
        name, gone = stack[-1]
        if name in _BLOCK:
            end_block()
        stack.pop()
        opened[name] -= 1
        dropped -= gone
        articles -= name in _ROOT
        return name

    def pop_to(names: tuple[str, ...], barrier: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1) if any(opened[n] for n in names) else ():
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in barrier:
                return

    while True:
        start = text.find("<", at)
        if start < 0 or start > last:
            if not dropped:
                current.append(html.unescape(text[at:]))
            break
        if start > at and not dropped:
            current.append(html.unescape(text[at:start]))
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = len(text) if end < 0 else end + 3
            continue
        found = _NAME.match(text, start)
        if not found:
            if text[start + 1 : start + 2] in ("!", "?", "/"):
                at = text.find(">", start) + 1
            else:
                if not dropped:
                    current.append("<")
                at = start + 1
            continue
        rest = _REST.match(text, found.end()) if quotes else None
        if rest is None:  # a quote that is not closed: from here on a tag ends at the next bracket
            quotes = False
        end = rest.end() if rest else text.find(">", found.end()) + 1
        if end <= 0:
            break
        closing, name, attributes = found[1], found[2].lower(), text[found.end() : end - 1]
        at = end
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            elif name in ("p", "br"):
                end_block()
            continue
        if name in _RAW:
            ended = _ENDS[name].search(text, at)
            at = ended.end() if ended else len(text)
            continue
        if name == "br":
            current.append(" ")
        if name in _VOID:
            if name == "hr":
                end_block()
            continue
        if name in _CLOSES:
            pop_to(_CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
        if name in _BLOCK:
            pop_to(("p",), _BARRIER)
            end_block()
        gone = (name == "header" and not articles) or _dropped(name, attributes)
        stack.append((name, gone))
        opened[name] += 1
        dropped += gone
        articles += name in _ROOT
    end_block()
    return blocks


def _shared_stream(blocks: list[str], digests: set[bytes]) -> tuple[list[int], list[str]]:
    """The blocks with one of the digests, each with its number; a run of others is one empty block."""
    at, out = [], []
    for i, block in enumerate(blocks):
        if hashlib.md5(block.encode()).digest() in digests:
            at.append(i)
            out.append(block)
        elif not at or at[-1] >= 0:
            at.append(-1)
            out.append("")
    return at, out


def _own_text(blocks: list[str], inside: list[bool], spans: list[dict] | None, shared: list[dict] | None) -> str:
    """The article's blocks, of a page without one all, but for boilerplate that lies whole in a repeated string."""
    article, digests = any(inside), {s["block"]: s for s in shared or ()}
    gone, cut, k, place = merged(spans), set(), 0, 0
    for i, block in zip(*_shared_stream(blocks, set(digests)), strict=True) if gone else ():
        raw = block.encode()
        while k < len(gone) and gone[k][1] < place + len(raw):
            k += 1
        if i >= 0 and k < len(gone) and gone[k][0] <= place:
            found = digests[hashlib.md5(raw).digest()]
            if found["swallowed" if article else "common"]:
                cut.add(i)
        place += len(raw) + 1
    return "\n".join(b for i, b in enumerate(blocks) if (inside[i] or not article) and i not in cut)


def _shared_blocks(streams: DataFrame) -> DataFrame:
    """(node, shared): digests of a stream's blocks that another distinct stream of its scope has too, if one is common.

    A common one is outside of an article in enough of the scope's distinct streams, a swallowed one inside of some as well.
    """
    digests = F.transform(F.arrays_zip("blocks", "inside"), lambda x: F.struct(F.unhex(F.md5(x["blocks"])).alias("block"), x["inside"].alias("inside")))
    each = streams.select("scope", "node", F.explode(F.array_distinct(digests)).alias("b")).select("scope", "node", "b.block", "b.inside")
    blocks = stored(each.groupBy("scope", "node", "block").agg(F.max("inside").alias("within"), F.max(~F.col("inside")).alias("outside")))
    pages = blocks.groupBy("scope").agg(F.count_distinct("node").alias("pages"))
    counts = blocks.groupBy("scope", "block").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("within", "outside")])
    common = (F.col("outside") >= LEAST) & (F.col("outside") >= SHARE * F.col("pages"))
    often = counts.where("n > 1").join(pages, "scope").select("scope", "block", common.alias("common"), (common & (F.col("within") >= LEAST)).alias("swallowed"))
    often = stored(often)
    scopes = stored(often.where("common").select("scope").distinct())
    met = blocks.select("scope", "node", "block").join(scopes, "scope", "left_semi").join(often, ["scope", "block"])
    found = met.groupBy("node").agg(F.collect_list(F.struct("block", "common", "swallowed")).alias("shared"))
    return stored(found.where(F.exists("shared", lambda b: b["common"])))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars.

    A null page is an empty one, and has an empty text. Pages of a host that have one stream count as one for it, and each
    gets its row; pages without a host in their url are compared with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(page) for page in batch.column(2).to_pylist()]
            blocks = pa.array([[b for b, _ in f] for f in found], pa.list_(pa.string()))
            inside = pa.array([[a for _, a in f] for f in found], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blocks, inside], ["page_id", "url", "blocks", "inside"])

    kind = dict(pages.dtypes)["page_id"]
    scope = F.xxhash64(url_host(F.col("url")))
    parsed = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, blocks array<string>, inside array<boolean>")
    node = F.unhex(F.md5(F.concat_ws(":", F.col("scope").cast("string"), F.array_join("blocks", "\n"))))
    streams = stored(parsed.withColumn("scope", scope).withColumn("node", node), "zstd")
    shared = _shared_blocks(streams)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (3, 4)), strict=True)
            texts = ["\n".join(_shared_stream(blocks, {s["block"] for s in some})[1]) for blocks, some in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["id", "node", "scope", "text"])

    texts = streams.join(shared, "node").select(F.col("page_id").alias("id"), "node", "scope", "blocks", "shared")
    spans = repeated_spans(texts.mapInArrow(reduce, f"id {kind}, node binary, scope long, text string"), LENGTH, PIECE, across=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_own_text(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = streams.join(spans, "node", "left").join(shared, "node", "left").select("page_id", "url", "blocks", "inside", "spans", "shared")
    text = joined.mapInArrow(cut, f"page_id {kind}, url string, text string")
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
