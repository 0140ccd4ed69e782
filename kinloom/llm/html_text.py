"""Main text of web pages by nearest-URL page differencing, and structure for what it leaves.

A page is cut into lines, one a block element, with character references decoded and white
space folded; menus, notices and all else that shows text give lines too. The page is paired with the
nearest urls of its host (by path), all lines are aligned by longest common subsequence, and shared
lines are deleted. Only shared prose of a marked article (paragraphs, headings, lists, quotes and tables in article or main)
stays: articles quote the same passages, and deleting them would lose text. Of what differencing leaves, structure then drops
lines that no other page shares and that still aren't main text: by element, role and class (menus, headers, footers, sidebars,
forms, notices, adverts, comments), and, where the page marks an article, lines outside it.

Pages are dealt into ranges of (host, path, id), bounds taken from a sample, so that a host of any size takes many tasks.
A first pass tells each range what lies before and after it; so the nearest url is the same wherever
the bounds are, and results don't depend on partitions.

Copies don't count as neighbours: a run of pages in order, each alike to the one before (what either holds alone
is at most ALIKE of its characters), is compared with the nearest pages outside the run. A page that has only
copies beside it keeps its text.

Defined results: null or empty html gives an empty text; null urls share one host; pages that
tie on the path are ordered by id, then lines; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinloom.llm._store import materialize
from kinloom.runtime import ship

RANGE, RANGES = 100, 4096  # pages a range where there are few, ranges at most
ALIKE = 0.1

#: Elements by their part in a page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form dialog menu button select".split())
UNSEEN = frozenset("template noscript svg canvas object audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status toolbar".split())
CHROME_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|consent|cookies?|disqus|footer|footnotes?-nav|gdpr|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|notification|outbrain|pager|pagination|popup|promos?|promoted|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|skip-link|"
    r"social|sponsor\w*|subscribe|subscription|taboola|toolbar|widget)(?:$|[\s_-])"
)
HEADER_WORD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_chrome(tag: str, rest: str, inside: bool) -> bool:
    if tag in CHROME or (tag == "header" and not inside):
        return True
    if not rest or tag in ("html", "body", "article", "main") or not _TELLING.search(rest):
        return False
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(rest)}
    if found.get("role") in CHROME_ROLES or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest, re.I):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return bool(CHROME_WORD.search(names)) or (not inside and bool(HEADER_WORD.search(names)))


def page_lines(html: str) -> tuple[list[str], bool]:
    """Lines of a page that structure takes for main text, and whether they come from a marked article."""
    lines, marked = told_lines(html)
    return [x for x, own, _ in lines if own], marked


def told_lines(html: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """All lines of a page, each with whether structure takes it for main text and whether it is prose of a marked article, and whether there is one."""
    lines: list[tuple[str, bool, bool, bool]] = []
    pieces: tuple[list[str], list[str]] = ([], [])  # main text, chrome
    stack: list[tuple[str, int, bool]] = []  # open elements: tag, chrome (2: unseen) here or above, article here or above
    marked = False
    place, end, low = 0, len(html), None

    def flush() -> None:
        for chrome, held in enumerate(pieces):
            if held:
                line = " ".join(unescape("".join(held)).split())
                if line:
                    inside = bool(stack and stack[-1][2])
                    lines.append((line, not chrome, inside, not chrome and inside and any(x[0] in PROSE for x in stack)))
                held.clear()

    def drop(stop: str) -> None:
        """Close elements down to the innermost one of that name, if it is open."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == stop:
                del stack[i:]
                return

    while place < end:
        m = _TOKEN.search(html, place)
        cut = m.start() if m else end
        kind = stack[-1][1] if stack else 0
        if cut > place and kind < 2:
            pieces[kind].append(html[place:cut])
        if not m:
            break
        place = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and kind < 2:
                pieces[kind].append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        rest = m["rest"] if m["tag"] else m["rest2"]
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces[kind % 2].append(" ")
        if (m["end"] or m["end2"]) == "/":
            drop(tag)
            continue
        if tag in VOID or rest.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            low = low or html.lower()
            stop = low.find(f"</{tag}", place) if len(low) == end else html.find(f"</{tag}", place)
            place = end if stop < 0 else stop
            stack.append((tag, 2, bool(stack and stack[-1][2])))
            continue
        names = [x[0] for x in stack[-8:]]
        if tag in BLOCK and "p" in names:
            drop("p")
        elif tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag == "body":
            drop("head")
        chrome, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        chrome = 2 if tag in UNSEEN else chrome or int(_is_chrome(tag, rest, inside))
        if tag in ("article", "main") and not chrome:
            inside = marked = True
        stack.append((tag, chrome, inside))
    flush()
    if marked:
        return [(x, own and inside, prose) for x, own, inside, prose in lines], True
    return [(x, own, False) for x, own, _, _ in lines], False


def common_lines(a: list, b: list) -> set[int]:
    """Positions of a on a longest common subsequence with b (Hunt and Szymanski, 1977)."""
    at: dict = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    tails: list[int] = []
    chain: list = []
    for i, x in enumerate(a):
        for j in reversed(at.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k] = j
                chain[k] = link
    out, link = set(), chain[-1] if chain else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def unshared(keys: list, path: str, before: tuple[str, list] | None, after: tuple[str, list] | None, prose: list[bool]) -> list[int]:
    """Positions of lines that are prose of an article or not shared with the nearer neighbour (the one before, on equal common prefixes)."""
    near = before
    if after is not None and (before is None or _shared_prefix(path, after[0]) > _shared_prefix(path, before[0])):
        near = after
    gone = common_lines(keys, near[1]) if near else set()
    return [i for i in range(len(keys)) if prose[i] or i not in gone]


_LINES = T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("own", T.ArrayType(T.BooleanType())), T.StructField("prose", T.ArrayType(T.BooleanType()))])


def lines_column(html: Column) -> Column:
    """struct(lines, own, prose) of a page."""

    def cut(pages: pa.Array) -> pa.Array:
        found = [told_lines(x.as_py() or "")[0] for x in pages]
        kinds = (pa.string(), pa.bool_(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([[x[i] for x in p] for p in found], pa.list_(kind)) for i, kind in enumerate(kinds)], _LINES.names)

    return F.arrow_udf(cut, _LINES)(html)


Page = tuple[str, str, list, list]  # host, path, keys of lines, their lengths (0 where structure says chrome)


def alike(a: Page, b: Page) -> bool:
    """Whether two pages are copies of each other, but for small parts."""
    if a[2] == b[2]:
        return True

    def alone(x: Page, y: Page) -> bool:
        held = set(y[2])
        return sum(n for k, n in zip(x[2], x[3], strict=True) if k not in held) <= ALIKE * sum(x[3])

    return alone(a, b) and alone(b, a)


def _place(host: str, path: str, page_id) -> tuple:
    return host, path, page_id is not None, 0 if page_id is None else page_id


_OPEN = "open"  # stands for a neighbour that lies in another range


def neighbours_before(pages: list[Page], first) -> list:
    """For pages in order, the one that each is compared with on that side, or None; ``first`` is the first page's."""
    out = [first] if pages else []
    for last, page in zip(pages, pages[1:], strict=False):
        out.append(_next_before(last, out[-1], page))
    return out


def _next_before(last: Page, before_last, page: Page):
    if last[0] != page[0]:
        return None
    return before_last if alike(last, page) else last


def range_ends(pages: list[Page]) -> tuple:
    """First page, last page, what the last has before it and the first after it."""
    return pages[0], pages[-1], neighbours_before(pages, _OPEN)[-1], neighbours_before(pages[::-1], _OPEN)[-1]


def outside(ends: list[tuple]) -> list[tuple]:
    """For ranges in order: what the first page of each has before it, and the last page after it."""
    before, after = [None], [None]
    for (_, last, inner, _), (first, _, _, _) in zip(ends, ends[1:], strict=False):
        before.append(_next_before(last, before[-1] if inner == _OPEN else inner, first))
    for (first, _, _, inner), (_, last, _, _) in zip(ends[::-1], ends[::-1][1:], strict=False):
        after.append(_next_before(first, after[-1] if inner == _OPEN else inner, last))
    return list(zip(before, after[::-1], strict=True))


def _in_order(table: pa.Table) -> tuple[list[dict], list[Page]]:
    rows = sorted(table.to_pylist(), key=lambda r: (_place(r["host"], r["path"], r["page_id"]), r["keys"]))
    return rows, [(r["host"], r["path"], r["keys"], r["sizes"]) for r in rows]


_ENDS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ends", T.BinaryType())])


def _ends(table: pa.Table) -> pa.Table:
    _, pages = _in_order(table)
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "ends": pa.array([pickle.dumps(range_ends(pages))], pa.binary())})


def _difference(shared, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        rows, pages = _in_order(table)
        first, last = shared.value.get(rows[0]["bucket"], (None, None))
        before, after = neighbours_before(pages, first), neighbours_before(pages[::-1], last)[::-1]
        texts, asked = [], [i for i, r in enumerate(rows) if r["lines"] is not None]
        for i in asked:
            (_, path, keys, _), b, a, r = pages[i], before[i], after[i], rows[i]
            left = unshared(keys, path, b and b[1:3], a and a[1:3], r["prose"])
            texts.append("\n".join(line for k in left if (line := r["lines"][k]) is not None))
        rows = [rows[i] for i in asked]
        return pa.table({"page_id": pa.array([r["page_id"] for r in rows], kind), "url": pa.array([r["url"] for r in rows], pa.string()), "text": pa.array(texts, pa.string())})

    return run


def _bounds(places: DataFrame, ranges: int, total: int) -> list[tuple]:
    """Places that cut the pages into about so many ranges."""
    if ranges < 2:
        return []
    found = sorted(_place(r["host"], r["path"], r["page_id"]) for r in places.sample(min(1.0, 20 * ranges / total), seed=7).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _bucket(bounds: list[tuple]):
    def find(*columns: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, _place(*x)) for x in zip(*(c.to_pylist() for c in columns), strict=True)], pa.int32())

    return F.arrow_udf(find, T.IntegerType())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    spark = pages.sparkSession
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    link = F.col(url)
    base = pages.select(
        F.col(page_id).alias("page_id"), link.alias("url"), F.coalesce(F.lower(F.regexp_extract(link, parts, 1)), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(link, parts, 2), F.lit("")).alias("path"), F.col(html).alias("html")
    )
    total = base.count()
    bounds = _bounds(base.select("host", "path", "page_id"), max(1, min(RANGES, total // RANGE)), total)
    bucket = _bucket(bounds)("host", "path", "page_id") if bounds else F.lit(0)
    cut = base.select("page_id", "url", "host", "path", bucket.alias("bucket"), lines_column(F.col("html")).alias("_l")).select("page_id", "url", "host", "path", "bucket", "_l.lines", "_l.own", "_l.prose")
    # Chrome lines travel as hashes only: whatever differencing leaves of them, structure drops.
    shown = cut.withColumn("keys", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("lines", F.zip_with("lines", "own", lambda x, own: F.when(own, x)))
    sizes = F.transform("lines", lambda x: F.coalesce(F.length(x), F.lit(0)))
    # Where all that structure takes for main text is prose of an article, nothing of it can go: such a page's strings stay where they are, its hashes meet its neighbours.
    whole = F.forall(F.arrays_zip("own", "prose"), lambda x: ~x["own"] | x["prose"])
    placed = materialize(shown.withColumn("sizes", sizes).withColumn("whole", whole).drop("own"), "lines")
    certain = placed.where("whole").select("page_id", "url", F.array_join("lines", "\n").alias("text"))
    edges = {}
    if bounds:
        ends = {r["bucket"]: pickle.loads(r["ends"]) for r in placed.select("bucket", "host", "path", "page_id", "keys", "sizes").groupBy("bucket").applyInArrow(_ends, _ENDS).collect()}
        edges = dict(zip(sorted(ends), outside([ends[k] for k in sorted(ends)]), strict=True))
    shared = spark.sparkContext.broadcast(edges)
    result = T.StructType([T.StructField("page_id", base.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    open_ = lambda c: F.when(~F.col("whole"), F.col(c)).alias(c)
    asked = placed.select("page_id", open_("url"), "host", "path", "bucket", "keys", "sizes", open_("lines"), open_("prose"))
    told = asked.groupBy("bucket").applyInArrow(_difference(shared, to_arrow_type(result["page_id"].dataType)), result)
    return certain.unionByName(told).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"))
