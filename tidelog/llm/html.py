"""Main-text extraction: block structure of a page, and differencing against the page with the nearest URL.

A page is cut into text lines, one per block element, with character references decoded and white space folded. Lines of
menus, headers, footers, sidebars, notices, adverts, forms and comments (by element, role, class or id), scripts and styles
are no article. If the page marks its article (`article`, `main`), only the lines in there are left. The lines left are
aligned, by longest common subsequence, with those of a page of the same host, and lines that both share are deleted as the
site's template. Pages of a host with equal lines are one here, at their first path, and what is deleted of one is of all.
Pages next to each other in order of path that share most of their text may be copies, or small articles in a large template:
each is compared with the nearest page before their whole run (or, if there is none, after), which holds the template but no
copy. If the run is all of the host, that page is the next before (or, for a host's first page, after). A page whose lines
are all shared is contained in the other and keeps them. Inside a marked article two pages may well share a headline or a
quotation; there a shared line is template only if it is on most of the host's distinct pages, and on three at least.

Pages find their neighbours by a range sort on host and path over small rows (id, URL, line hashes); rows of one range meet
those of others through a table with a row per range. Page texts are not shuffled for it: a second pass over the pages joins
only the line numbers to delete.

Nulls: null html has no text; a null URL has an empty host and path, and such pages are neighbours of each other. Repeated
pages stay, each with its own row. Extra columns are ignored. An empty table gives an empty result. Pages count whole, of any length; broken markup is read as
browsers do: unclosed elements end with their parent. Of a page that marks both, `main` is taken if it encloses every `article`
with text, else `article`. Captions, formulas, and the text in graphics and media elements are text like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved
from tidelog.llm.urls import host_and_path

# Elements by their part in a page.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select fieldset head".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose text stands apart from the line around them, as that of formulas does that are displayed so.
MEDIA = frozenset("svg object audio video canvas".split())
# Marks of lines: inside `main` only, in an `article` outside of `main`, in an `article` inside `main`.
MAIN_ONLY, ARTICLE, BOTH = 1, 2, 3
MAIN = frozenset(("main", "article"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
# Words of class and id values that mark what is no article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|"
    r"aside|widget|footer|header|masthead|cookie|cookies|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommended|comment|comments|disqus|replies|reply|pagination|pager|toolbar|skip)(?:$|[\s_-])"
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|replies|reply)(?:$|[\s_-])")
# Words of class and id values that name the arrangement of a page: together with a word above they hide no article.
LAYOUT = re.compile(r"(?:^|[_-])(?:wrap|wrapper|container|layout|content|page|main|site|body|grid|row|col|column|left|right|with|has|no|without)(?:$|[_-])")
# Ways to hide, the weaker first. An `article` shows in spite of the first, a `main` of the first two, a heading of the
# article's own header in spite of the third.
FORM_OR_LAYOUT, MARKED, OWN_HEADER, ALWAYS = 1, 2, 3, 4
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
# A line of a marked article that this many distinct pages of a host, and more than half of them, hold is no quotation.
COMMON = 3
# Pages that share this much of the text of either may be copies.
COPY = 0.5

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
DISPLAYED = re.compile(r"\bdisplay\s*=\s*[\"']?block", re.IGNORECASE)
WHITE = re.compile(r"\s+")
# Blocks that close an open paragraph, and siblings that close their like.
CLOSES_P = BLOCKS - {"html", "body"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}


def kind_of_hiding(name: str, attributes: str) -> int:
    """How an element hides what it holds: not at all, or FORM_OR_LAYOUT, MARKED or ALWAYS."""
    if name in DROPPED:
        return FORM_OR_LAYOUT if name == "form" else ALWAYS
    if name in ("html", "body") or ("=" not in attributes and "hidden" not in attributes):
        return 0
    kind = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
        if key in ("class", "id"):
            for token in value.split():
                if (REMARKS if name in MAIN else MARKS).search(token):
                    kind = max(kind, FORM_OR_LAYOUT if LAYOUT.search(token) else MARKED)
        elif key == "role":
            if value in ROLES:
                return ALWAYS
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return ALWAYS
    return kind


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """(text lines that no element hides, for each MAIN_ONLY, ARTICLE or BOTH by what it is inside, else 0)."""
    lines, marks = [], []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, the strongest way in which it is hidden, mark
    hidden, inside = 0, 0
    apart = False  # whether the last formula is

    def flush() -> None:
        if text:
            line = WHITE.sub(" ", "".join(text)).strip()
            text.clear()
            if line:
                lines.append(line)
                marks.append(inside)

    def close(depth: int) -> None:
        nonlocal hidden, inside
        flush()
        del stack[depth:]
        _, hidden, inside = stack[-1] if stack else ("", 0, 0)

    at = 0
    while at < len(html):
        match = TAG.search(html, at)
        if not hidden:
            piece = html[at : match.start() if match else len(html)]
            text.append(unescape(piece) if "&" in piece else piece)
        if not match:
            break
        at = match.end()
        name = match.group(2)
        if not name:
            continue
        name = name.lower()
        if match.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in MEDIA or (name == "math" and apart):
                flush()
            if depth is not None and (name in BLOCKS or name in DROPPED or not any(s[0] in BLOCKS for s in stack[depth + 1 :])):
                if name in BLOCKS or name in DROPPED:
                    close(depth)
                else:
                    del stack[depth:]
                    _, hidden, inside = stack[-1] if stack else ("", 0, 0)
            continue
        if name in VOID:
            if not hidden:
                text.append(" ")
            if name == "hr":
                flush()
            continue
        if name == "math":
            apart = bool(DISPLAYED.search(match.group(3)))
        if name in MEDIA or (name == "math" and apart):
            flush()
        if name in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if depth is not None and not any(s[0] in BLOCKS - {"p"} for s in stack[depth + 1 :]):
                close(depth)
            if name in SIBLINGS:
                like, limits = SIBLINGS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limits:
                        break
                    if stack[i][0] in (name, like):
                        close(i)
                        break
            flush()
        if name in RAW and not match.group(3).endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if match.group(3).endswith("/") and name not in BLOCKS:
            continue
        own = kind_of_hiding(name, match.group(3))
        if (name in MAIN and hidden <= (MARKED if name == "main" else FORM_OR_LAYOUT)) or (name in HEADINGS and hidden == OWN_HEADER):
            hidden = 0
        if name == "header" and own == ALWAYS and not hidden and stack and stack[-1][0] in MAIN and not kind_of_hiding("div", match.group(3)):
            own = OWN_HEADER
        gone = max(hidden, own)
        if not gone and name in MAIN:
            inside = max(inside, MAIN_ONLY) if name == "main" else BOTH if inside in (MAIN_ONLY, BOTH) else ARTICLE
        hidden = gone
        stack.append((name, hidden, inside))
    flush()
    return lines, marks


def open_lines(html: str | None) -> tuple[list[str], bool]:
    """(the lines that differencing judges, whether they are a marked article): those in there, or all of a page without."""
    lines, marks = lines_of(html or "")
    # `main` is the article if it encloses all others.
    least = ARTICLE if ARTICLE in marks else MAIN_ONLY if any(marks) else 0
    return [line for line, mark in zip(lines, marks, strict=True) if mark >= least], least > 0


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Positions of `own` in a longest common subsequence with `other`, in memory linear in the two (divide and conquer)."""
    head = 0
    least = min(len(own), len(other))
    while head < least and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < least - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    mid_own, mid_other = own[head : len(own) - tail], other[head : len(other) - tail]
    ends = np.concatenate((np.arange(head), np.arange(len(own) - tail, len(own))))
    here = np.isin(mid_own, mid_other)
    if not here.any():
        return ends
    # Lines of one side only are never in the subsequence.
    place = np.flatnonzero(here)
    mid_own, mid_other = mid_own[place], mid_other[np.isin(mid_other, mid_own)]
    if len(mid_own) == 1:
        found = np.zeros(1, np.int64)
    else:
        half = len(mid_own) // 2
        front = _lengths(mid_own[:half], mid_other)
        back = _lengths(mid_own[half:][::-1], mid_other[::-1])[::-1]
        cut = int(np.argmax(front + back))
        found = np.concatenate((shared_lines(mid_own[:half], mid_other[:cut]), half + shared_lines(mid_own[half:], mid_other[cut:])))
    return np.sort(np.concatenate((ends, head + place[found])))


def _lengths(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of `own` with every beginning of `other`."""
    row = np.zeros(len(other) + 1, np.int64)
    for line in own:
        met = np.concatenate(([0], np.where(other == line, row[:-1] + 1, 0)))
        row = np.maximum.accumulate(np.maximum(row, met))
    return row


def template_lines(own: np.ndarray, other: np.ndarray, common: np.ndarray | None = None) -> list[int]:
    """Line numbers to delete: the shared ones (of those in `common`, if given), unless they are all."""
    own = np.asarray(own, np.int64)
    shared = shared_lines(own, np.asarray(other, np.int64)).astype(np.int64)
    if common is not None:
        shared = shared[np.isin(own[shared], np.asarray(common, np.int64))]
    return shared.tolist() if len(shared) < len(own) else []


def alike(own: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray) -> bool:
    """Whether the shared lines are most of the text of one of two pages."""
    own, sizes = np.asarray(own, np.int64), np.asarray(sizes, np.int64)
    shared = sizes[shared_lines(own, np.asarray(other, np.int64)).astype(np.int64)].sum()
    return bool(shared > COPY * min(sizes.sum(), int(np.sum(other_sizes))))


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def judged_lines(pages: DataFrame) -> DataFrame:
    """page_key, host, path, lines (hashes), sizes, marked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [open_lines(html) for html in frame["html"]]
            hashes = [[line_hash(line) for line in lines] for lines, _ in found]
            sizes = [list(map(len, lines)) for lines, _ in found]
            yield frame[["page_key", "host", "path"]].assign(lines=hashes, sizes=sizes, marked=[marked for _, marked in found])

    return keyed(pages).mapInPandas(run, "page_key long, host string, path string, lines array<long>, sizes array<int>, marked boolean")


def keyed(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select(F.xxhash64("page_id", "url", "html").alias("page_key"), "page_id", "url", host.alias("host"), path.alias("path"), "html")


ORDER = ["host", "path", "page_key"]
DISTINCT = "host string, path string, page_key long, seq long, range int, marked boolean, lines array<long>, sizes array<int>"


def distinct_pages(judged: DataFrame) -> DataFrame:
    """ORDER, seq, marked, lines, sizes: one row per host and sequence of lines, at its first path."""
    first = judged.groupBy("host", "seq").agg(F.min(F.struct("path", "page_key", "marked", "lines", "sizes")).alias("first"))
    return first.select("host", "first.path", "first.page_key", "seq", "first.marked", "first.lines", "first.sizes")


def common_lines(pages: DataFrame) -> DataFrame:
    """common_host, common: the lines on more than half of a host's distinct pages, so at most twice as many as a page has."""
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= COMMON)
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    lines = lines.where(F.col("n") >= COMMON).join(totals, "host").where(2 * F.col("n") > F.col("n_pages"))
    return lines.groupBy(F.col("host").alias("common_host")).agg(F.collect_list("line").alias("common"))


def runs(pages: DataFrame) -> DataFrame:
    """The distinct pages with the range they are in, the lines of the pages next `before` and `after` (null outside the host),
    and whether a run of pages that are alike `begins` here."""
    ranged = pages.repartitionByRange(*[F.col(c) for c in ORDER]).withColumn("range", F.spark_partition_id())
    ranged = saved(ranged.sortWithinPartitions(*ORDER), "page-order")
    inside = Window.partitionBy("range").orderBy(*ORDER)
    # One row per range: the first and last page of it, to be the neighbour of pages at the borders.
    row = F.struct(*ORDER, "lines", "sizes")
    ends = ranged.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    over = Window.orderBy("range")
    ends = ends.select("range", F.lag("last").over(over).alias("before_range"), F.lead("first").over(over).alias("after_range"))
    near = ranged.withColumn("before", F.lag(row).over(inside)).withColumn("after", F.lead(row).over(inside)).join(ends, "range")
    before, after = F.coalesce("before", "before_range"), F.coalesce("after", "after_range")
    near = near.withColumn("before", before).withColumn("after", after)
    same = F.col("before.host") == F.col("host")
    near = near.select(
        *ORDER,
        *("seq", "range", "marked", "lines", "sizes"),
        F.when(same, F.col("before.lines")).alias("before"),
        F.when(same, F.col("before.sizes")).alias("before_sizes"),
        F.when(F.col("after.host") == F.col("host"), F.col("after.lines")).alias("after"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["lines"], frame["sizes"], frame["before"], frame["before_sizes"], strict=True)
            begins = [row[2] is None or not alike(*row) for row in rows]
            yield frame.drop(columns="before_sizes").assign(begins=begins)

    return near.mapInPandas(run, f"{DISTINCT}, before array<long>, after array<long>, begins boolean")


def neighbours(judged: DataFrame) -> DataFrame:
    """host, seq, lines, other: the lines of the page that each distinct page is compared with; common: `common_lines` for marked pages."""
    found = saved(runs(distinct_pages(judged)), "page-runs")
    # Wrapped, so that a first page of a host, with nothing before it, is met too.
    opening = F.when(F.col("begins"), F.struct(*ORDER, "before"))
    next_run = F.when(F.col("begins"), F.struct(*ORDER, "lines"))
    ends = found.groupBy("range").agg(F.max(opening).alias("last"), F.min(next_run).alias("first"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("range", F.last("last", True).over(earlier).alias("opening_range"), F.last("first", True).over(later).alias("next_range"))
    inside = Window.partitionBy("range")
    so_far = inside.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = inside.orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumn("opening", F.last(opening, True).over(so_far)).withColumn("next_run", F.last(next_run, True).over(to_come)).join(ends, "range")
    near = near.withColumn("opening", F.coalesce("opening", "opening_range")).withColumn("next_run", F.coalesce("next_run", "next_range"))
    outside = F.coalesce("opening.before", F.when(F.col("next_run.host") == F.col("host"), F.col("next_run.lines")))
    other = F.coalesce(outside, "before", "after")
    near = near.select("host", "seq", "marked", "lines", other.alias("other")).where("other is not null")
    common = F.when(F.col("marked"), F.coalesce("common", F.array().cast("array<bigint>")))
    near = near.join(common_lines(found), F.col("host") == F.col("common_host"), "left")
    return near.select("host", "seq", "lines", "other", common.alias("common"))


def deletions(pages: DataFrame) -> DataFrame:
    """page_key, gone: the numbers of the lines that are the site's template."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gone = [template_lines(*row) for row in zip(frame["lines"], frame["other"], frame["common"], strict=True)]
            yield frame[["host", "seq"]].assign(gone=gone)

    judged = judged_lines(pages).where(F.size("lines") > 0).withColumn("seq", F.xxhash64("marked", "lines"))
    judged = saved(judged.dropDuplicates(["page_key"]), "page-lines")
    gone = neighbours(judged).mapInPandas(run, "host string, seq long, gone array<int>").where(F.size("gone") > 0)
    return judged.select("page_key", "host", "seq").join(gone, ["host", "seq"]).select("page_key", "gone")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    gone = saved(deletions(pages), "page-template").withColumnRenamed("page_key", "gone_key")
    met = keyed(pages).join(gone, F.col("page_key") == F.col("gone_key"), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for html, numbers in zip(frame["html"], frame["gone"], strict=True):
                lines, _ = open_lines(html)
                if numbers is not None:
                    deleted = set(numbers)
                    lines = [line for i, line in enumerate(lines) if i not in deleted]
                texts.append(" ".join(lines))
            yield frame[["page_id", "url"]].assign(text=texts)

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    met = met.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "gone")
    found = met.mapInPandas(run, "page_id string, url string, text string")
    return found.withColumn("page_id", F.col("page_id").cast("long"))


def op8(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
