"""HTML extraction by differencing each page with the pages of nearest URL on its host.

Pages are parsed into text blocks, the lines of the page, each with a prior from its surroundings: ``out`` (menus, headers,
footers, sidebars, forms, by element), ``soft`` (notices, adverts, comments and so on, by a word of class, id or role alone),
``main`` (inside an article or main element) or ``open`` (nothing tells). All pages are ordered by host and URL path; each is
aligned by the longest common subsequence of blocks with up to ``siblings`` pages next to it in this order on the
same host. A page that shares most of its text (``out`` and ``soft`` blocks apart) with a neighbour is a copy, not a sibling from
one template: the next one that differs is taken instead, past any number of equal pages in between.

Shared lines are deleted. Prior and differencing decide together:

- ``open``: deleted where the nearest sibling shares the line, or two others do.
- ``main``: deleted where at least four siblings, and three quarters of those tried, share the line at the same place, counted from the
  beginning or from the end of the article: a line of the template inside it. Passages that articles quote stay, however many do; so does
  a line that begins with the page's title, or with which the title begins (``named``).
- ``soft``: deleted; but on a page without an article element and without any other text that is kept, the longest
  run of such blocks in one element that no sibling shares is the article.
- ``out``: deleted.

``n_decided`` counts the blocks that differencing decided: all ``open`` ones of pages with siblings, deleted ``main`` and kept ``soft`` ones.

Scale. URLs alone are sorted first, which gives the edges of ranges of some thousand pages, so a host with a third of all
pages is spread over many ranges. Then pages are parsed once and their packed blocks shuffled once, to their range and, near
an edge, to the next; a task walks its range with a window of few different pages, equal neighbours held as one. Only where more
than ``reach`` equal pages lie across an edge, siblings beyond that edge are not seen.

Defined results. Null html: empty text. Null url: no host, no neighbours. Repeated rows and equal URLs: a row each, in order of
page_id. Very long pages: aligned in parts, in memory in proportion to their blocks. Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never part of the article.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
OUT = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
#: Elements inside a block of text; all others begin and end blocks.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id or role that mark what is not the article.
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal "
    "overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright sidebar aside widget related recommended "
    "comment comments commentlist respond disqus discussion share sharing social newsletter subscribe subscription signup login search form pagination pager toolbar complementary contentinfo".split()
)
MAIN_WORDS = {"article", "main"}
#: Elements that an opening element ends, for those without an end tag.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
COPY_SHARE = 0.7
TEXT_ZONES = ("main", "named", "open")
COLUMNS = ["page_id", "url", "text", "n_chars", "n_blocks", "n_shared", "n_decided"]


class Blocks(HTMLParser):
    """Collects (zone, text) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []  # element, the zone it opens
        self.blocks: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.silent = 0
        self.has_main = False
        self.title = ""

    def zone(self) -> str:
        zone, soft, heading = "open", "", False
        for tag, opened in self.stack:
            heading |= tag in HEADINGS
            if opened == "out":
                return "out"
            if opened and opened.startswith("soft"):
                soft = soft or opened
            elif opened == "header":
                if zone != "main":
                    return "out"
                zone = "header"
            elif opened == "main" and zone == "open":
                zone = "main"
        if zone == "header" and not heading:  # of an article header only the headings
            return "out"
        return soft or ("main" if zone == "header" else zone)

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append((self.zone(), text))

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            if tag not in VOID:
                self.stack.append((tag, "silent"))
            return
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        for old in ENDS.get(tag, ()):
            if self.stack and self.stack[-1][0] == old:
                self.stack.pop()
        words = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
                words.update(re.findall(r"[a-z]+", re.sub(r"\b(?:has|with|without|no)[-_]\w+", " ", value)))
        opened = None
        if tag in OUT:
            opened = "out"
        elif tag == "header":
            opened = "header"
        elif tag in MAIN:
            opened = "main"
        elif tag not in ("html", "body") and words & OUT_WORDS:
            opened = "header" if words & OUT_WORDS <= {"header", "masthead"} else f"soft{len(self.blocks)}"
        elif words & MAIN_WORDS and tag in ("div", "section", "td"):
            opened = "main"
        self.has_main |= opened == "main"
        if opened and tag in INLINE:
            self.flush()
        self.stack.append((tag, opened))

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.held.append(" ")
            return
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is None:
            if tag not in INLINE:
                self.flush()
            return
        if tag in INLINE and any(t not in INLINE for t, _ in self.stack[at + 1 :]):
            return  # a stray end of an inline element does not end blocks
        if tag not in INLINE or self.stack[at][1]:
            self.flush()
        for _, opened in self.stack[at:]:
            self.silent -= opened == "silent"
        del self.stack[at:]

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)
        elif self.stack and self.stack[-1][0] == "title":
            self.title += data


def blocks_of(html: str) -> tuple[list[tuple[str, str]], bool]:
    """(zone, text) of each block, and whether the page marks its article."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    title = " ".join(parser.title.split())
    named = lambda text: title and (text.startswith(title) or title.startswith(text))
    return [("named" if z == "main" and named(t) else z, t) for z, t in parser.blocks], parser.has_main


#: Bits that one alignment may hold; longer pages are aligned in halves.
ALIGN_BITS = 1 << 26


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    v, full = _steps(a, b)[-1], len(b)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(full // 8 + 1, "little"), np.uint8), bitorder="little")[:full]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _steps(a: list, b: list, keep: bool = False) -> list[int]:
    """Bit-parallel dynamic programming: after each element of ``a`` the zero bits are where the length grows along ``b``."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v, out = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
        else:
            out[0] = v
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    ia = [i for i in range(start, len(a) - end) if a[i] in both]
    ib = [j for j in range(start, len(b) - end) if b[j] in both]
    middle, todo = [], [(ia, ib)]
    while todo:
        ia, ib = todo.pop()
        if not ia or not ib:
            continue
        x, y = [a[i] for i in ia], [b[j] for j in ib]
        if len(x) > 1 and len(x) * len(y) > ALIGN_BITS:  # the best place in b for the middle of a, then each half
            half = len(x) // 2
            cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(ia[:half], ib[:cut]), (ia[half:], ib[cut:])]
            continue
        rows, row, col = _steps(x, y, keep=True), len(x), len(y)
        while row and col:
            if rows[row] >> (col - 1) & 1:
                col -= 1
            else:
                row -= 1
                if rows[row] >> (col - 1) & 1:
                    middle.append((ia[row], ib[col - 1]))
                    col -= 1
    return [(i, i) for i in range(start)] + sorted(middle) + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def _closeness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def shared_lines(entries: list[dict], k: int, look: int, siblings: int) -> tuple[list[bool], list[int], int]:
    """Which blocks of entry k its nearest sibling shares, how many siblings share each (inside articles: at its place), and how many there are."""
    page = entries[k]
    nearest, times, tried = [False] * len(page["texts"]), [0] * len(page["texts"]), 0
    if not page["host"]:
        return nearest, times, 0
    near = [j for j in range(max(0, k - look), min(len(entries), k + look + 1)) if j != k and entries[j]["host"] == page["host"]]
    near.sort(key=lambda j: (-_closeness(entries[j]["path"], page["path"]), abs(j - k), j))
    for j in near:
        other = entries[j]
        pairs = common(page["texts"], other["texts"])
        size = sum(len(page["texts"][i]) for i, _ in pairs if page["zones"][i] in TEXT_ZONES)
        if size > COPY_SHARE * max(1, min(page["inside"], other["inside"])):
            continue
        tried += 1
        for i, j in pairs:
            a, b = page["places"][i], other["places"][j]
            times[i] += page["zones"][i] != "main" or a[0] == b[0] or a[1] == b[1]
            nearest[i] |= tried == 1
        if tried == siblings:
            break
    return nearest, times, tried


def places(zones: list[str]) -> list[tuple[int, int]]:
    """The place of each block among those of the article, from its beginning and from its end; -1 for others."""
    at = [i for i, z in enumerate(zones) if z in ("main", "named")]
    of = {i: (k, len(at) - k) for k, i in enumerate(at)}
    return [of.get(i, (-1, -1)) for i in range(len(zones))]


def text_of(zones: list[str], texts: list[str], nearest: list[bool], times: list[int], tried: int, has_main: bool) -> tuple[str, int]:
    """The text of a page, and how many of its blocks differencing decided."""
    keep, decided = [], 0
    for zone, near, n in zip(zones, nearest, times):
        template = n >= 4 and 4 * n >= 3 * tried
        keep.append(zone == "named" or zone == "main" and not template or zone == "open" and not (near or n > 1))
        decided += zone == "open" and tried > 0 or zone == "main" and template
    if not has_main and not any(keep):
        best, run, size = [], [], 0
        for i, (zone, n) in enumerate(zip([*zones, "out"], [*times, 1])):
            if run and (n or zone != zones[run[0]]):
                if (own := sum(len(texts[j]) for j in run)) > size:
                    best, size = run, own
                run = []
            if zone.startswith("soft") and not n:
                run.append(i)
        for i in best:
            keep[i] = True
        decided += len(best)
    return "\n".join(t for t, k in zip(texts, keep) if k), decided


def _address(url) -> tuple:
    """Host and path of a URL; both empty where it has none."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"[#?].*$", "")
    return F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)", 1)), F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1)


def ranges(keyed: DataFrame, reach: int, per_range: int, most: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The sorted keys in ranges of about ``per_range`` rows: the first key of each, and the keys of ``reach`` rows before and after it.

    Only ``2 * reach`` keys of each of ``most`` ranges at most come to the driver.
    """
    n = max(1, min(most, -(-keyed.count() // per_range)))

    def edges(batches):
        head, tail, at = [], [], None
        for batch in batches:
            keys = batch.column(0)
            if len(keys):
                at = batch.column(1)[0].as_py()
                head += keys.slice(0, max(0, reach - len(head))).to_pylist()
                tail = (tail + keys.slice(max(0, len(keys) - reach)).to_pylist())[-reach:]
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([head], pa.list_(pa.binary())), pa.array([tail], pa.list_(pa.binary()))], ["at", "head", "tail"])

    placed = keyed.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("at", F.spark_partition_id())
    found = sorted(placed.mapInArrow(edges, "at int, head array<binary>, tail array<binary>").collect())
    heads, tails = [[bytes(k) for k in r[1]] for r in found], [[bytes(k) for k in r[2]] for r in found]
    low, high = [], []
    for i in range(len(found)):
        before, after = [], []
        for j in range(i - 1, max(-1, i - 1 - reach), -1):
            before = tails[j] + before
        for j in range(i + 1, min(len(found), i + 1 + reach)):
            after += heads[j]
        low.append((before[-reach:] + heads[i])[0])
        high.append((tails[i] + after[:reach])[-1])
    return [h[0] for h in heads], low, high


def extract(pages: DataFrame, reach: int = 8, siblings: int = 6, per_range: int = 5_000, most_ranges: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_shared (with the nearest sibling), n_decided for every row."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    number = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    keyed = own.withColumn("key", F.concat_ws("\0", *_address(F.col("url")), number, F.coalesce("url", F.lit(""))).cast("binary"))
    first, low, high = ranges(keyed, reach, per_range, most_ranges)

    def parse(batches):
        """Blocks of each page, packed, once for its own range and once for each range that it lies near."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page, url, html, key in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    packed = zlib.compress(json.dumps(blocks_of(html or ""), ensure_ascii=False).encode("utf-8", "surrogatepass"))
                    home = max(0, bisect.bisect_right(first, key) - 1)
                    a = b = home
                    while a and key <= high[a - 1]:
                        a -= 1
                    while b + 1 < len(first) and key >= low[b + 1]:
                        b += 1
                    rows += [(page, url, key, to, to == home, packed) for to in range(a, b + 1)]
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "key", "to", "own", "packed"])

    def difference(batches):
        """Rows of a range in order; a window of few different pages is held, each with the rows that equal it."""
        held, done, here = [], 0, None

        def settle(last: bool):
            nonlocal done
            end = len(held) if last else max(done, len(held) - reach)
            rows = []
            for k in range(done, end):
                entry = held[k]
                if not entry["rows"]:
                    continue
                nearest, times, tried = shared_lines(held, k, reach, siblings)
                text, decided = text_of(entry["zones"], entry["texts"], nearest, times, tried, entry["has_main"])
                rows += [(page, url, text, len(text), len(nearest), sum(nearest), decided) for page, url in entry["rows"]]
            kept = max(0, end - reach)
            del held[:kept]
            done = end - kept
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], COLUMNS)

        for batch in batches:
            for row in batch.to_pylist():
                if row["to"] != here:
                    if held:
                        yield settle(True)
                    held.clear()
                    done, here = 0, row["to"]
                host, path = (x.decode() for x in row["key"].split(b"\0", 2)[:2])
                same = held and held[-1]["host"] == host and held[-1]["packed"] == row["packed"]
                if not same:
                    blocks, has_main = json.loads(zlib.decompress(row["packed"]))
                    zones, texts = [z for z, _ in blocks], [t for _, t in blocks]
                    inside = sum(len(t) for z, t in blocks if z in TEXT_ZONES)
                    held.append({"host": host, "path": path, "packed": row["packed"], "zones": zones, "texts": texts, "places": places(zones), "inside": inside, "has_main": has_main, "rows": []})
                if row["own"]:
                    held[-1]["rows"].append((row["page_id"], row["url"]))
                if len(held) >= 256:
                    yield settle(False)
        if held:
            yield settle(True)

    parsed = keyed.mapInArrow(parse, "page_id long, url string, key binary, to int, own boolean, packed binary")
    placed = parsed.repartitionById(max(1, len(first)), F.col("to")).sortWithinPartitions("to", "key", "packed")
    return placed.mapInArrow(difference, "page_id long, url string, text string, n_chars long, n_blocks long, n_shared long, n_decided long")
