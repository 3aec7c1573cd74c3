"""Main text of web pages by nearest-URL page differencing.

Pages stand in the order of host and URL path, and each is aligned with the page before and the page behind it.  Two alignments by a longest
common subsequence find what is the site's and not the page's:

* text lines, between pages of one host: a line outside the article that both pages have is the template's;
* slots, the containers that lines stand in (an element of sections, or a div or section with a class or id, by tag and names): a container that
  both pages have in the same order is a part of the template even if it is filled with other text on each page, as menus, adverts and footers are.

The container with the article itself is in all pages, too, and stays: it is the article or main element if there is one, else the container
with the most text that the other page does not have.  Inside it no shared line goes, as neighbours may quote the same passage; only named
containers that follow its last line do (reader comments, share boxes).  Names are compared, never read.  What HTML itself defines as not being
main content (nav, aside, footer, form, ...) goes even if no neighbour has it; n_shared and n_markup count the lines that went either way.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.tables import written

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that HTML defines as something else than main content.
AWAY = frozenset("aside button datalist dialog footer form head input label menu nav select".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_DIGITS = re.compile(r"\d+")
_DIGEST = struct.Struct(">i")
#: What a line is by its markup: plain, in an article or main element, in a named container, or in an element of AWAY.
PLAIN, ARTICLE, NAMED, FURNITURE = range(4)
#: Bytes of lines in a part of the URL order, and parts at most (a row's part is found among so many split points).
PART_BYTES, PARTS, SAMPLED = 8 << 20, 4096, 16


def _entered(tag: str, attrs: str, above: tuple[str, bool, int, str]) -> tuple[str, bool, int, str]:
    """What lies in an element: its tag, whether it is hidden, its kind and its slot (the path of its containers)."""
    _, hidden, kind, slot = above
    names = []
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += [key[0] + x for x in _DIGITS.sub("0", value).split()]
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    if tag in AWAY or (tag == "header" and kind != ARTICLE):
        kind = FURNITURE
    elif tag in ("article", "main") and kind != FURNITURE:
        # An article in an article is a reader comment by the standard.
        kind = FURNITURE if tag == "article" and "/article" in slot else ARTICLE
    elif not (names and tag in ("div", "section")):
        return tag, hidden, kind, slot
    elif kind == PLAIN:
        kind = NAMED
    return tag, hidden, kind, f"{slot}/{tag}{'.'.join(sorted(names))}"


def lines_of(page: str) -> tuple[list[str], list[int], list[str]]:
    """The text blocks of a page in order, the kind of each by its markup, and its slot."""
    lines: list[str] = []
    kinds: list[int] = []
    slots: list[str] = []
    text: list[str] = []
    root = ("", False, PLAIN, "")
    stack: list[tuple[str, bool, int, str]] = []
    at, end = 0, len(page)

    def close() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                _, _, kind, slot = stack[-1] if stack else root
                kinds.append(kind)
                slots.append(slot)

    while at < end:
        m = _TAG.search(page, at)
        start = m.start() if m else end
        if start > at and not (stack and stack[-1][1]):
            text.append(page[at:start])
        if not m:
            break
        at = max(m.end(), start + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or stack[k][1] or stack[k][2:] != (stack[k - 1] if k else root)[2:]:
                        close()
                        del stack[k:]
                    else:
                        del stack[k]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if not m[0].endswith("/>") else None
            at = shut.end() if shut else (at if m[0].endswith("/>") else end)
            continue
        if tag in BLOCK:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before it
                name = stack[k][0]
                if name == "p" or (name == tag and tag in ("li", "dt", "dd", "tr", "option")):
                    close()
                    del stack[k:]
                    break
                if name in BLOCK:
                    break
        elif tag in ("td", "th"):
            text.append(" ")
        if tag in VOID or m[0].endswith("/>"):
            continue
        above = stack[-1] if stack else root
        entered = _entered(tag, m[3] or "", above)
        if entered[1:] != above[1:]:
            close()
        stack.append(entered)
    close()
    return lines, kinds, slots


# --- Alignment ------------------------------------------------------------------------------------


def _rows(a: list, b: list) -> Iterator[int]:
    """For each prefix of a: bits of b's positions, 0 where the longest common subsequence with b's prefix grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


#: Bits of rows kept for the way back; longer pairs are halved until they fit.
ROW_BITS = 1 << 26


def shared_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence, whatever repeats; memory is bounded for long lists."""
    lo, x, y = 0, len(a), len(b)
    while lo < x and lo < y and a[lo] == b[lo]:
        lo += 1
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    left, right = list(range(lo)), list(range(lo))
    in_b, in_a = set(b[lo:y]), set(a[lo:x])
    i_of = [i for i in range(lo, x) if a[i] in in_b]
    j_of = [j for j in range(lo, y) if b[j] in in_a]
    for i, j in _aligned([a[i] for i in i_of], [b[j] for j in j_of]):
        left.append(i_of[i])
        right.append(j_of[j])
    return left + list(range(x, len(a))), right + list(range(y, len(b)))


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ROW_BITS:
        h = len(a) // 2
        *_, down = _rows(a[:h], b)
        *_, up = _rows(a[:h - 1:-1], b[::-1])
        first, last, total, best = 0, len(b) - up.bit_count(), 0, (-1, 0)
        for j in range(len(b) + 1):
            total = first + last
            best = max(best, (total, -j))
            if j < len(b):
                first += not down >> j & 1
                last -= not up >> (len(b) - 1 - j) & 1
        j = -best[1]
        return _aligned(a[:h], b[:j]) + [(h + i, j + k) for i, k in _aligned(a[h:], b[j:])]
    rows, i, j, out = list(_rows(a, b)), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


class _Page:
    """A page in the stream: its lines, their kinds and slots, and the lines known to go."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.lines = pa.decompress(row["packed"], row["bytes"], "zstd", asbytes=True).decode("utf-8").split("\n") if row["bytes"] else []
        self.kinds = [k for k, n in zip(row["kinds"], row["counts"], strict=True) for _ in range(n)]
        self.slots = [s for s, n in zip(row["slots"], row["counts"], strict=True) for _ in range(n)]
        self.gone: set[int] = set()

    def compare(self, other: "_Page", copies: float) -> None:
        """Align two neighbours and note what goes in both."""
        left, right = [], []
        if self.row["k"]["host"] == other.row["k"]["host"]:
            left, right = shared_lines(self.lines, other.lines)
            mine, others = (sum(k != FURNITURE for k in x.kinds) for x in (self, other))
            if 2 * sum(self.kinds[i] != FURNITURE for i in left) > copies * (mine + others):  # copies of each other say nothing about lines
                left, right = [], []
        a, b = self.row["slots"], other.row["slots"]
        both = {a[i] for i in shared_lines(a, b)[0]}
        self._judge(left, both)
        other._judge(right, both)

    def _judge(self, shared: list[int], aligned: set[int]) -> None:
        lines = self.lines
        if not lines:
            return
        lost = set(shared)
        own: Counter = Counter()
        for i, (kind, slot) in enumerate(zip(self.kinds, self.slots, strict=True)):
            if i not in lost or kind == ARTICLE:
                own[kind, slot] += len(lines[i])
        article = [(n, s) for (k, s), n in own.items() if k == ARTICLE]
        named = max(((n, s) for (k, s), n in own.items() if k == NAMED), default=(0, None))
        # Without an article, or with one that is no more than a teaser, the fullest container holds the main text.
        stays = named[1] if named[0] > max(4 * sum(n for n, _ in article), own[PLAIN, self.slots[0]] if not article else 0) else None
        body = max(article, default=(0, None))[1]
        after = max((i for i, (k, s) in enumerate(zip(self.kinds, self.slots, strict=True)) if k == ARTICLE and s == body), default=-1)
        for i, (kind, slot) in enumerate(zip(self.kinds, self.slots, strict=True)):
            if kind == ARTICLE:
                if i > after and slot != body and slot in aligned:
                    self.gone.add(i)
            elif i in lost or (kind != PLAIN and slot in aligned and slot != stays):
                self.gone.add(i)

    def result(self) -> tuple:
        left = [x for i, x in enumerate(self.lines) if i not in self.gone and self.kinds[i] != FURNITURE]
        text = "\n".join(left)
        n = len(self.lines)
        return self.row["k"]["page_id"], self.row["url"], text, len(text), len(self.gone), n - len(left) - len(self.gone)


# --- Spark ----------------------------------------------------------------------------------------


_STORED = "page_id long, url string, host string, path string, packed binary, bytes long, kinds array<byte>, slots array<int>, counts array<int>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = [x.split()[0] for x in _STORED.split(", ")]
    codec = pa.Codec("zstd", compression_level=6)
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            try:
                parts = urlsplit(url or "")
                host, path = (parts.netloc or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
            except ValueError:
                host, path = "", url
            lines, of, where = lines_of(page.as_py() or "")
            runs = [(*x, len(list(g))) for x, g in groupby(zip(of, where, strict=True))]
            raw = "\n".join(lines).encode("utf-8")
            rows.append((host, path, codec.compress(raw, asbytes=True), len(raw), [x for x, _, _ in runs], [_DIGEST.unpack(zlib.crc32(x.encode()).to_bytes(4, "big"))[0] for _, x, _ in runs], [n for _, _, n in runs]))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def _differenced(copies: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Page | None = None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())
        names = ["page_id", "url", "text", "n_chars", "n_shared", "n_markup"]

        def packed(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done, size = [], 0
            for i in range(batch.num_rows):
                page = _Page({n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
                if before is not None:
                    if before.row["part"] == page.row["part"]:
                        before.compare(page, copies)
                    if not before.row["ghost"]:
                        done.append(before.result())
                        size += done[-1][3]
                before = page
                if size > 1 << 22:
                    yield packed(done)
                    done, size = [], 0
            if done:
                yield packed(done)
        if before is not None and not before.row["ghost"]:
            yield packed([before.result()])

    return run


def main_text(pages: DataFrame, *, copies: float = 0.7) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row, from its whole html; n_shared and n_markup: lines that went.

    Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by line ends in page
    order.  Two neighbours in one host that share more than `copies` of their lines are copies, and no line goes for being in both; neighbours of
    different hosts are aligned by containers only.  A null or empty html gives an empty text; a null url sorts into a host of its own;
    repeated rows are rows; a page without any neighbour loses only what HTML defines as not being main content.  Other columns are ignored.

    The URL order is dealt into parts at split points from a sample of `SAMPLED` keys a part; a part also gets the last page of the part
    before it and the first of the part behind it, to be compared with, so no pair is lost where parts meet and results don't depend on the parts.
    """
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parsed, _STORED)
    k = F.struct("host", "path", "page_id", F.xxhash64("packed", "slots").alias("h")).alias("k")
    t = written(parsed.select(k, "url", "packed", "bytes", "kinds", "slots", "counts", F.monotonically_increasing_id().alias("row")))
    n, total = t.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = min(PARTS, max(1 + (total or 0) // PART_BYTES, min(n // 128, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    share = min(1.0, SAMPLED * parts / max(1, n))
    drawn = t.select("k").where(F.pmod(F.xxhash64(F.lit("split"), "k"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("k").limit(4 * SAMPLED * PARTS).collect() if parts > 1 else []
    splits = list(dict.fromkeys(r.k for r in drawn[len(drawn) // parts :: max(1, len(drawn) // parts)]))
    at = pages.sparkSession.createDataFrame([(splits,)], f"splits array<{t.schema['k'].dataType.simpleString()}>")

    def halved(s, _):
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        return F.when(s.lo >= s.hi, s).when(F.get("splits", middle) <= F.col("k"), F.struct((middle + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), middle.alias("hi")))

    part = F.aggregate(F.sequence(F.lit(0), F.lit(PARTS.bit_length())), F.struct(F.lit(0).alias("lo"), F.size("splits").alias("hi")), halved).lo.alias("part")
    columns = ["k", "url", "packed", "bytes", "kinds", "slots", "counts"]
    placed = t.crossJoin(F.broadcast(at)).select(part, *columns, "row", F.lit(False).alias("ghost"))  # one row, PARTS split points at most
    ends = placed.groupBy("part").agg(F.min_by("row", "k").alias("first"), F.max_by("row", "k").alias("last"))
    w = Window.orderBy("part")  # a row per part
    beside = ends.select("part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("behind"))
    ghosts = beside.select("part", F.explode(F.array("before", "behind")).alias("row")).where("row is not null")
    ghosts = t.join(F.broadcast(ghosts), "row").select("part", *columns, F.lit(True).alias("ghost"))  # two rows a part
    dealt = placed.drop("row").unionByName(ghosts).repartition(parts, "part").sortWithinPartitions("part", "k")
    return dealt.mapInArrow(_differenced(copies), "page_id long, url string, text string, n_chars long, n_shared int, n_markup int")
