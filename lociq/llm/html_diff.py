"""Main text of pages by differencing each with its nearest page of the host.

Pages are sorted by host and URL path over all partitions (a host may span many),
and each is aligned with the neighbour whose path is most alike: text lines by longest
common subsequence. Lines that both have are the site's, not the page's, and go.
Neighbours that share nearly all lines are one run of copies; its pages are aligned with
the pages before and after the run. Only where a host is one run, pages that differ are
aligned inside it. Runs go on over partitions: each is told the ends of those around it.

Every page is aligned, with or without an article element. Two things differencing alone gets wrong
are settled by the markup after it: copies of an article on one host share all their lines, so lines inside an
article element stay; and menus, notices or adverts that differ from page to page are
dropped by their element. What markup says nothing about is left to differencing, beside an article too; only
where a page has an article and no other page to be aligned with, it is the article alone.
"""

from __future__ import annotations

import hashlib
import html
import os.path
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lociq.llm.text import slices
from lociq.session import cut_lineage

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")

#: Elements whose text is no text of the page, and those that hold what is around an article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
AROUND = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "menuitem", "label", "fieldset", "datalist"}
ARTICLE = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark what is around an article.
MARKED = set(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead header topbar toolbar comment comments respond disqus reply replies discussion share sharing social related recommended widget login signup search".split()
)
#: Whole names of class, id or role that mark what is no text inside an article; headings never are.
MARKED_INSIDE = set(
    "ad ads advert adverts advertisement advertisements sponsored comment comments comment-form comment-list respond disqus_thread share share-bar share-buttons sharing social-share "
    "newsletter newsletter-signup subscribe subscribe-form subscription-form paywall navigation breadcrumb breadcrumbs pagination cookie-notice".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: From this share of the longer one's lines in common, neighbours are copies and the next page after them is looked for.
COPY = 0.9
_PLACED = "part int, seq int, joined boolean, host string, path string, key long, lines binary"


@dataclass
class Line:
    """One block's text, and whether it is inside an article (True), around one (False) or unknown (None)."""

    text: str
    inside: bool | None


def _marked(rest: str, inside: bool) -> bool:
    for name, *values in _ATTRIBUTE.findall(rest):
        if name.lower() in ("class", "id", "role"):
            value = "".join(values).lower()
            if not (MARKED_INSIDE.isdisjoint(value.split()) if inside else MARKED.isdisjoint(re.split(r"[^a-z0-9]+", value))):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The text lines of a page in order: white space is one space, character references are decoded, empty lines are left out.

    A form with all of a page's text in it is the page, not something around it.
    """
    out = _lines(page, True)
    if out and all(x.inside is False for x in out) and "<form" in page.lower():
        out = _lines(page, False)
    return out


def _lines(page: str, forms: bool) -> list[Line]:
    """``lines_of`` with forms around an article (``forms``) or like any block."""
    out: list[Line] = []
    # Open elements: name, what its text is (article: True, around one: False, or unknown: None), the
    # outermost element around an article, and whether one other than a form is among those that are open.
    stack: list[tuple[str, bool | None, str | None, bool]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    state: bool | None = None

    def close() -> None:
        line = _SPACE.sub(" ", "".join(text)).strip()
        if line:
            out.append(Line(line, state))
        text.clear()

    at, skip_to = 0, 0
    # Behind the last > there are no tags, only their beginnings, and perhaps that of a comment, which goes on to the end.
    last = page.rfind(">") + 1
    unclosed = page.find("<!--", last)
    page = page if unclosed < 0 else page[:unclosed]
    for token in _TOKEN.finditer(page, 0, last):
        if token.start() < skip_to:
            continue
        if token.start() > at:
            piece = page[at : token.start()]
            text.append(html.unescape(piece) if "&" in piece else piece)
        at = token.end()
        if at == last and page.startswith("<!--", token.start()) and not page.endswith("-->", token.start() + 4, at):
            at = len(page)
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if opened[name]:
                close() if name not in INLINE else None
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
                before = state
                state = stack[-1][1] if stack else None
                if before is not state and text:  # an inline element that was dropped
                    state, now = before, state
                    close()
                    state = now
            elif name not in INLINE:
                close()
            continue
        if name in RAW and not token["rest"].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = skip_to = end.end() if end else len(page)
            if name not in INLINE:
                close()
            continue
        plain = name in ("html", "body", *ARTICLE) or (state is True and name in HEADINGS)
        around = (name in AROUND and (forms or name != "form")) or (name == "header" and state is not True) or ("=" in token["rest"] and not plain and _marked(token["rest"], state is True))
        # An article starts anew inside a form that nothing else around an article holds.
        _, _, cause, held = stack[-1] if stack else ("", None, None, False)
        around = around or (state is False and not (name in ARTICLE and cause == "form" and not held))
        if name not in INLINE:
            close()
            if stack and stack[-1][0] == "p" and name not in VOID:
                opened[stack.pop()[0]] -= 1
                state = stack[-1][1] if stack else None
        if name in VOID or token["rest"].endswith("/"):
            continue
        now = False if around else True if name in ARTICLE else state
        if now is not state and text:
            close()
        state = now
        _, _, cause, held = stack[-1] if stack else ("", None, None, False)
        stack.append((name, state, cause if cause is not None or state is not False else name, held or name in AROUND - {"form"}))
        opened[name] += 1
    if at < len(page):
        piece = page[at:]
        text.append(html.unescape(piece) if "&" in piece else piece)
    close()
    return out


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: bit rows of the table, one a line of ``b``, read backwards."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    n, middle = len(a) - first - last, b[first : len(b) - last]
    masks: dict[str, int] = {}
    for k in range(n):
        masks[a[first + k]] = masks.get(a[first + k], 0) | 1 << k
    full = (1 << n) - 1
    row, rows = full, []
    for line in middle:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, i, j = [], n, len(middle)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(first + i)
    return [*range(first), *found[::-1], *range(len(a) - last, len(a))]


def copies(a: dict, b: dict) -> bool:
    """Neighbours of one host with nearly all lines in common; ``joined`` of the later one, where it is known, decides."""
    if not a["host"] or a["host"] != b["host"]:
        return False
    if b["joined"] is not None:
        return b["joined"]
    x, y = a["lines"], b["lines"]
    return x == y or (min(len(x), len(y)) >= COPY * max(len(x), len(y)) and len(shared_lines(x, y)) >= COPY * max(len(x), len(y)))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their lines as a list of fingerprints."""
    for batch in batches:
        for row in batch.to_pylist():
            row["lines"] = [row["lines"][k : k + 8] for k in range(0, len(row["lines"]), 8)]
            yield row


def runs(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Runs of copies within a part."""
    run: list[dict] = []
    for row in rows:
        if run and (row["part"] != run[-1]["part"] or not copies(run[-1], row)):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def site_lines(own: dict, around: list[dict], beside: list[dict]) -> list[int] | None:
    """Places of the lines a page shares with the nearest page ``around`` its run, or, without one, with a differing page ``beside`` it; None without either."""
    alike = lambda o: -len(os.path.commonprefix([o["path"], own["path"]]))
    same = lambda pages: sorted((o for o in pages if own["host"] and o["host"] == own["host"] and o["lines"] != own["lines"]), key=alike)
    found = [shared_lines(own["lines"], o["lines"]) for o in same(around) or same(beside)]
    return next((x for x in found if len(x) < COPY * len(own["lines"])), min(found, key=len, default=None))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: its first page, the first after its first run, the last before its last run, and its last."""
    first = second = prior = last = None
    for run in runs(placed(batches)):
        if first is None:
            first = run[0]
        elif second is None:
            second = run[0]
        prior, last = last, run[-1]
    ends = [(role, x) for role, x in (("first", first), ("second", second), ("prior", prior), ("last", last)) if x is not None]
    yield pa.RecordBatch.from_pylist([{"role": role, **x, "lines": b"".join(x["lines"])} for role, x in ends], pa.schema([("role", pa.string()), *_FIELDS]))


_FIELDS = [("part", pa.int32()), ("seq", pa.int32()), ("joined", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("lines", pa.binary())]


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gone): places of the site's lines in each page of a part that has one to be aligned with; rows with a ``seq`` are only looked at."""

    def after(one: list[dict] | None, run: list[dict], two: list[dict] | None) -> Iterator[dict]:
        before = one[-1:] if one and one[-1]["part"] == run[0]["part"] else []
        behind = two[:1] if two and two[0]["part"] == run[0]["part"] else []
        for k, own in enumerate(run):
            if own["seq"] == 0:
                gone = site_lines(own, before + behind, run[max(k - 1, 0) : k] + run[k + 1 : k + 2])
                if gone is not None:
                    yield {"key": own["key"], "gone": gone}

    schema, out = pa.schema([("key", pa.int64()), ("gone", pa.list_(pa.int32()))]), []
    one = run = None
    for two in runs(placed(batches)):
        if run is not None:
            out += after(one, run, two)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        one, run = run, two
    if run is not None:
        out += after(one, run, None)
    yield pa.RecordBatch.from_pylist(out, schema)


def _neighbours(ends: DataFrame) -> DataFrame:
    """What each part sees of those around it, as rows of ``_PLACED``: back and on to the next run's end on its host."""
    parts: dict[int, dict[str, str]] = {}
    for r in ends.select("part", "role", "host").collect():
        parts.setdefault(r.part, {})[r.role] = r.host
    order, seen = sorted(parts), []
    for n, part in enumerate(order):
        for step, near, far, beyond in ((-1, "last", "first", "prior"), (1, "first", "last", "second")):
            at, seq, host = n + step, step, parts[part]["first" if step < 0 else "last"]
            while 0 <= at < len(order) and host and parts[order[at]][near] == host:
                other = beyond if beyond in parts[order[at]] else far
                # Whether the later of two rows from one part goes on with the run of the earlier is known.
                joined = other == far
                pair = [(near, seq, joined if step < 0 else None), (other, seq + step, joined if step > 0 else None)]
                seen += [(part, s, j, order[at], role) for role, s, j in pair]
                if other == beyond:
                    break
                at, seq = at + step, seq + 2 * step
    told = ends.sparkSession.createDataFrame(seen, "part int, seq int, joined boolean, source int, role string")
    return told.join(ends.select(F.col("part").alias("source"), "role", "host", "path", "key", "lines"), ["source", "role"]).drop("source", "role")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", markup: bool = True) -> DataFrame:
    """(id, url, text, lines, dropped) per row: the main text, its lines, and how many lines went.

    A null or empty page has an empty text. A page without url or without another
    page of its host is judged by its markup only: its article, or without one what is not around one. Repeated rows
    are copies of each other, which never delete each other's lines.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    parts = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"), F.col(html_column).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("id", "url", "html"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                out = []
                for row in part.to_pylist():
                    lines = lines_of(row.pop("html") or "")
                    out.append({**row, "lines": b"".join(hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=8).digest() for x in lines)})
                yield pa.RecordBatch.from_pylist(out, pa.schema(_FIELDS[3:]))

    # A page's own fingerprint ends the sort key, so even rows without url are spread and the order is one whatever the partitions.
    small = rows.select("host", "path", "key", "html").mapInArrow(digest, "host string, path string, key long, lines binary")
    small = small.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    small = cut_lineage(small.select(F.spark_partition_id().alias("part"), F.lit(0).alias("seq"), F.lit(None).cast("boolean").alias("joined"), "host", "path", "key", "lines"))
    ends = cut_lineage(small.mapInArrow(_ends, f"role string, {_PLACED}"))
    seen = small.unionByName(_neighbours(ends)).repartition("part").sortWithinPartitions("part", "seq", "host", "path", "key")
    # Of repeated rows, those that are aligned with no line in common say nothing against the others.
    common = F.coalesce(F.min(F.when(F.size("gone") > 0, F.col("gone"))), F.min("gone"))
    gone = cut_lineage(seen.mapInArrow(_gone, "key long, gone array<int>").groupBy("key").agg(common.alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                out = []
                for row in part.to_pylist():
                    lines, site = lines_of(row["html"] or ""), set(row["gone"] or ())
                    # Without a page to be aligned with, an article is all that is known of a page.
                    alone = row["gone"] is None and any(x.inside for x in lines)
                    kept = [x.text for k, x in enumerate(lines) if (k not in site if not markup else x.inside or (x.inside is None and not alone and k not in site))]
                    out.append({"id": row["id"], "url": row["url"], "text": " ".join(kept), "lines": kept, "dropped": len(lines) - len(kept)})
                yield pa.RecordBatch.from_pylist(out, schema)

    fields = f"id {kinds[0]}, url {kinds[1]}, text string, lines array<string>, dropped long"
    schema = pa.schema([("id", to_arrow_type(pages.schema[id_column].dataType)), ("url", to_arrow_type(pages.schema[url_column].dataType)), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("dropped", pa.int64())])
    found = rows.select("id", "url", "html", "key").join(gone, "key", "left").select("id", "url", "html", "gone")
    return found.mapInArrow(run, fields).withColumnsRenamed({"id": id_column, "url": url_column})
