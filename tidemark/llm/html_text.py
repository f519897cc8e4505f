"""Main text of web pages: markup structure, then differencing against the page nearest by URL.

A page is cut into blocks. Blocks in menus, headers, footers, side bars, forms, scripts, notices, adverts and comments
(by element, role, class or id) are dropped. If the page marks its article (`article`, `main` or role=main), the
blocks in it are the text and all others are dropped: shared lines there are the author's (licences, quotations).
On other pages the rest is undecided: pages are sorted by path within each host, each is aligned line by line with
the page before and the page after it (longest common subsequence of lines, each numbered by its occurrence, so that
it is a longest increasing subsequence in n log n), and undecided lines shared with either are deleted, unless they are
more than half of the page's undecided text: then the neighbour is a copy, and what they share is the text.

Pages are dealt by ranges of (host, path), so a host with a third of all pages is cut like any other. The first and
the last page of each range meet their neighbours of the next range that has pages in groups of two; an only page is both.

Defined results: null or empty html gives an empty text; a null url has an empty host and path; pages that repeat a
url are neighbours in order of their id (null first; rows that repeat both, in any order, have equal texts if decided);
pages of any length are read whole; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts_for, written

#: Pages for a range, more once there would be MOST_RANGES of them.
RANGE_BYTES, MOST_RANGES = 8 << 20, 100_000
#: HTML elements whose text is not shown or not the author's, and those that end a block of text.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "title")
DROPPED = frozenset("nav header footer aside form button select menu dialog head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget ad ads advert advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus respond share sharing social related newsletter subscribe login search contentinfo complementary".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*+))>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ENDS = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in RAW}


def marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role say that an element is not the article, and that it is."""
    if not attributes:
        return False, False
    off = main = False
    for kind, *values in NAMED.findall(attributes):
        words = re.split(r"[^a-z0-9]+", "".join(values).lower())
        off |= not MARKS.isdisjoint(words)
        main |= kind.lower() == "role" and "main" in words
    return off or re.search(r"(?:^|\s)hidden(?:[\s=]|$)", attributes) is not None, main


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """The lines that may be the text, all lines of the page, and whether its markup decides (then the first are the text)."""
    inside: list[str] = []
    open_: list[str] = []
    every: list[str] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element; dropped; in the article
    state, found = (False, False), False

    def flush() -> None:
        nonlocal found
        line = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if not line:
            return
        every.append(line)
        if state[0]:
            return
        if state[1]:
            found = True
            inside.append(line)
        else:
            open_.append(line)

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name == "br":
            buffer.append(" ")
            continue
        if not closing and name in ENDS:
            if not attributes.endswith("/"):
                end = ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            off = not closing and name not in VOID and attributes and marked(attributes)[0]
            if off or any(x[0] == name for x in stack):
                pass  # an inline element that is dropped is followed like a block
            else:
                continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                stack.pop()
            before = stack[-1] if stack else ("", False, False)
            off, main = marked(attributes)
            region = before[2] or name in ("article", "main") or main
            stack.append((name, before[1] or name in DROPPED or off and name not in ("html", "body", "article", "main"), region))
        state = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    buffer.append(page[at:])
    flush()
    return (inside, every, True) if found else (open_, every, False)


def line_keys(lines: list[str]) -> list[int]:
    """A signed 64-bit key for each line and its occurrence on the page."""
    seen: dict[str, int] = {}
    out = []
    for x in lines:
        seen[x] = n = seen.get(x, 0) + 1
        out.append(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), n) - (1 << 63))
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """The keys on a longest common subsequence of two lists of distinct keys."""
    where = {k: i for i, k in enumerate(b)}
    tails: list[int] = []
    ends: list[int] = []
    back: dict[int, int] = {}
    for k in a:
        if (j := where.get(k)) is not None:
            at = bisect_left(tails, j)
            tails[at:at + 1] = [j]
            ends[at:at + 1] = [k]
            if at:
                back[k] = ends[at - 1]
    out = set()
    k = ends[-1] if ends else None
    while k is not None:
        out.add(k)
        k = back.get(k)
    return out


ROW = "page_id long, url string, host string, path string, lines array<string>, line_keys array<bigint>, all_keys array<bigint>, decided boolean"
OUT = "page_id long, url string, text string"


def parsed(df: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    rows = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(f"`{page}`").cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                lines, keys, every, decided = [], [], [], []
                for x in b.column(4).to_pylist():
                    own, all_, sure = blocks(x or "")
                    lines.append(own)
                    keys.append([] if sure else own_keys(own, all_))
                    every.append(line_keys(all_))
                    decided.append(sure)
                wide = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(lines, pa.list_(pa.string())), pa.array(keys, wide), pa.array(every, wide), pa.array(decided)], names=[c.split()[0] for c in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)


def own_keys(own: list[str], every: list[str]) -> list[int]:
    """The keys, as in the whole page, of the lines that may be text: an in-order walk over all lines."""
    keys, out, k = line_keys(every), [], 0
    for x in own:
        while every[k] != x:
            k += 1
        out.append(keys[k])
        k += 1
    return out


def _finished(row: dict, shared: set[int]) -> tuple[int, str | None, str]:
    lines = row["lines"]
    if not row["decided"]:
        kept = [x for x, k in zip(lines, row["line_keys"], strict=True) if k not in shared]
        lines = kept or lines
    return row["page_id"], row["url"], "\n".join(lines)


def _met(a: dict | None, b: dict | None) -> tuple[set[int], set[int]]:
    """The lines of each page that its alignment with the other tells to be the site's.

    A page that shares more than half of its undecided characters with its neighbour is a copy, or nearly: what they share
    is the text then, and tells nothing.
    """
    if a is None or b is None or a["host"] != b["host"] or a["decided"] and b["decided"]:
        return set(), set()
    common = common_lines(a["all_keys"], b["all_keys"])

    def told(row: dict) -> set[int]:
        sizes = [len(x) for x in row["lines"]]
        shared = sum(n for n, k in zip(sizes, row["line_keys"], strict=True) if k in common) if not row["decided"] else 0
        return common if shared * 2 <= sum(sizes) else set()

    return told(a), told(b)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "url", "text"])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, url and text for each row."""
    total = df.select(F.sum(F.octet_length(F.col(f"`{page}`").cast("string")))).first()[0] or 0
    dealt = parsed(df, page_id, url, page).repartitionByRange(parts_for(total, max(range_bytes, total // MOST_RANGES)), "host", "path", "url", "page_id").sortWithinPartitions("host", "path", "url", "page_id")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                yield from b.slice(lo, 500).to_pylist()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, set[int], bool, bool]]:
        """Each page, what it shares with its neighbours here, whether it is the first and the last of the range."""
        now, first, left = None, True, set()
        for after in rows_of(batches):
            if now is not None:
                right, next_left = _met(now, after)
                yield now, left | right, first, False
                first, left = False, next_left
            now = after
        if now is not None:
            yield now, left, first, True

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, shared, first, last in walked(batches):
            if not (first or last):
                out.append(_finished(row, shared))
                if len(out) == 500:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    edge = f"part int, slot int, ends boolean, shared array<bigint>, {ROW}"
    names = [c.split()[0] for c in edge.split(", ")]
    wide, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    kinds = (pa.int32(), pa.int32(), pa.bool_(), wide, pa.int64(), pa.string(), pa.string(), pa.string(), texts, wide, wide, pa.bool_())

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first page of the range (slot 0) and the last one (slot 1, or the first page itself)."""
        part, rows = TaskContext.get().partitionId(), []
        for row, shared, first, last in walked(batches):
            if first or last:
                rows.append({"part": part, "slot": int(not first), "ends": last, "shared": sorted(shared)} | row)
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["side"])
        found = _met(*rows) if len(rows) == 2 else (set(), set())
        columns = [[r["part"] for r in rows], [r["slot"] for r in rows], [sorted(x) for x, _ in zip(found, rows, strict=False)]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), wide), strict=True)], names=["part", "slot", "more"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield _batch([_finished(r, {*r["shared"], *(k for x in r["more"] or [] for k in x)}) for r in rows.to_pylist()])

    # two pages for each range; a range meets the next one that has pages
    edges = written(dealt.mapInArrow(outer, edge), "html-edges")
    after = written(edges.select("part").distinct().select("part", F.lead("part").over(Window.orderBy("part")).alias("next")), "html-ranges")
    lasts = edges.where("ends").join(after, "part").where("next is not null").select(F.col("part").alias("border"), F.lit(0).alias("side"), *names)
    firsts = edges.where("slot = 0").join(after.select(F.col("part").alias("border"), F.col("next").alias("part")), "part").select("border", F.lit(1).alias("side"), *names)
    met = lasts.union(firsts).groupBy("border").applyInArrow(meet, "part int, slot int, more array<bigint>")
    both = edges.join(met.groupBy("part", "slot").agg(F.collect_list("more").alias("more")), ["part", "slot"], "left")  # a page has two neighbours
    return dealt.mapInArrow(inner, OUT).union(both.select("shared", "more", *[c.split()[0] for c in ROW.split(", ")]).mapInArrow(finish, OUT))
