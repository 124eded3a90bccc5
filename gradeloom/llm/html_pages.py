"""Main text of web pages by removal of site templates.

The subtrees of containers (CONTAINERS) are hashed by tag and texts and counted per host in Spark: a subtree that stands with LEAST_PAGES
different main parts of its host is template, however large the host, and is deleted wherever it stands, within an article too. A main part is the page's articles, else its
main element, else what the page says beside the container; equal ones count once, so that copies of a page make no template. Sentences and headings are no
containers: pages may copy these from each other, and they stay. What is left is the text: of the articles, else of the main element, else of the
page. Tags, roles and a few unambiguous class words say what else is no text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) where a host has too few pages to count.

A page is read in time linear in its length, and no step recurses.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Main parts of a host that a template stands with at least.
LEAST_PAGES = 3

#: A tag whose quoted values hold neither < nor >; it looks no further than the next of these.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("head script style noscript template iframe nav footer aside form button select textarea input object embed svg canvas dialog title noembed noframes menu".split())
#: What no reader sees, whether or not it recurs.
UNSEEN = frozenset("head script style noscript template title iframe object embed noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: What may be a template; paragraphs, headings and the like never are by themselves.
CONTAINERS = frozenset("address article aside center details dialog div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
#: Class words that no article text has, in any element.
ADVERTS = frozenset("ad ads adsbygoogle adsense advert advertisement advertising adverts".split())
#: Class words that tell a container's purpose, by themselves or with each other and with PLACES ("cookie-notice", "share-buttons").
PURPOSES = ADVERTS | frozenset("breadcrumb breadcrumbs comment comments disqus gdpr modal nav navbar navigation newsletter popup sidebar signup sponsored subscribe toolbar".split())
#: These do so outside of the article alone, or with another word of a purpose or place.
OUTSIDE = frozenset("banner consent cookie cookies footer header menu notice notices overlay promo promotion respond share sharing social sponsor widget widgets".split())
PLACES = frozenset("area bar block bottom box button buttons container fixed form global icons inline inner item items left link links list main message page panel primary right row secondary section site slot sticky text thread top unit up wrap wrapper".split())
#: A start tag ends an open element of the first set, if none of the second was opened since.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


class Page:
    """A page's elements and texts in page order. Item i is an element (``tag``, ``attrs``) or a text (tag "", the text in
    ``attrs``); its subtree is items i .. ``ends[i]`` - 1. Item 0 is the root."""

    __slots__ = ("attrs", "ends", "parents", "tags")

    def __init__(self, page: str):
        """Never fails; what is not a tag is text."""
        tags, attrs, parents, ends = [""], [""], [-1], [0]
        self.tags, self.attrs, self.parents, self.ends = tags, attrs, parents, ends
        tags[0] = "#root"
        stack, where = [0], {}  # open elements, and for each tag the places in the stack of its open ones
        at, n, last = 0, len(page), page.rfind(">")

        def text(t: str) -> None:
            if t:
                tags.append("")
                attrs.append(t)
                parents.append(stack[-1])
                ends.append(len(tags))

        def close_to(depth: int) -> None:
            """Closes the open elements from this place of the stack on."""
            while len(stack) > depth:
                i = stack.pop()
                where[tags[i]].pop()
                ends[i] = len(tags)

        while at < n:
            i = page.find("<", at)
            if i < 0 or i > last:  # no tag ends any more
                j = page.find("<!--", at) if i >= 0 else -1
                text(page[at:j] if j >= 0 else page[at:])
                break
            text(page[at:i])
            m = _PLAIN_TAG.match(page, i)
            if m:
                slash, tag, attr = m.groups()
                at = m.end()
            elif page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = j + 3 if j >= 0 else n
                continue
            elif page.startswith("<![CDATA[", i):
                j = page.find("]]>", i)
                text(html.escape(page[i + 9 : j if j >= 0 else n], quote=False))
                at = j + 3 if j >= 0 else n
                continue
            elif page.startswith(("<!", "<?"), i):
                at = page.find(">", i) + 1
                continue
            elif m := _TAG_NAME.match(page, i):
                slash, tag = m.groups()
                at = _tag_end(page, m.end(), last)
                attr = page[m.end() : at - 1]
            else:
                text("<")
                at = i + 1
                continue
            tag = tag.lower()
            if slash:
                if where.get(tag):
                    close_to(where[tag][-1])
                continue
            if tag in BLOCK and where.get("p"):
                close_to(where["p"][-1])
            if tag in ENDS:
                close, until = ENDS[tag]
                d = max((where[x][-1] for x in close if where.get(x)), default=-1)
                if d > max((where[x][-1] for x in until if where.get(x)), default=-1):
                    close_to(d)
            tags.append(tag)
            attrs.append(attr)
            parents.append(stack[-1])
            ends.append(len(tags))
            if tag in VOID or attr.endswith("/"):
                continue
            stack.append(len(tags) - 1)
            where.setdefault(tag, []).append(len(stack) - 1)
            if tag in RAW:
                m = _RAW_END[tag].search(page, at)
                text(page[at : m.start() if m else n])
                at = m.end() if m else n
                close_to(len(stack) - 1)
        close_to(1)
        ends[0] = len(tags)


def _tag_end(page: str, at: int, last: int) -> int:
    """Where a tag ends whose name ends at ``at``: after the first > that is not in a quoted value, or the first at all if quotes don't close."""
    first = page.find(">", at) + 1
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not 0 < at <= last:
            break
    return first


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs.strip(" /") else {}


def _says(name: str, inside: bool) -> bool:
    """Whether a class or id tells the purpose of a container that is no text."""
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    if not parts or not all(p in PURPOSES or p in OUTSIDE or p in PLACES for p in parts):
        return False
    told = sum(p in PURPOSES for p in parts)
    return told > 0 or (any(p in OUTSIDE for p in parts) and (not inside or len(parts) > 1))


def unwanted(tag: str, attrs: str, inside: bool) -> bool:
    """Whether tag, role, class or id say that an element is no part of the text; ``inside``: of an article or main element."""
    if tag in GONE or (tag == "header" and not inside):
        return True
    a = _attributes(attrs)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if any(x in ADVERTS for x in names):
        return True
    if tag == "article":
        return any(x.startswith("comment") for x in names)
    return tag in CONTAINERS and any(_says(x, inside) for x in names)


def digests(page: Page) -> list[int]:
    """For each item a hash of its tag and, in order, its texts and child elements; 0 for one without text, for texts, scripts and styles."""
    tags, attrs, parents = page.tags, page.attrs, page.parents
    out, held = [0] * len(tags), [None] * len(tags)
    for i in range(len(tags) - 1, 0, -1):
        if not tags[i]:
            said = " ".join(attrs[i].split())
        elif held[i] and tags[i] not in ("script", "style"):
            out[i] = xxhash.xxh3_64_intdigest(f"{tags[i]}\0" + "\0".join(reversed(held[i]))) or 1
            said = f"\0{out[i]:x}"
        else:
            said = ""
        held[i] = None
        if said:
            p = parents[i]
            if held[p] is None:
                held[p] = [said]
            else:
                held[p].append(said)
    return out


def _top(page: Page, tag: str) -> list[int]:
    """The outermost wanted elements of a kind."""
    out, i, tags = [], 1, page.tags
    while i < len(tags):
        if not tags[i]:
            i += 1
        elif unwanted(tags[i], page.attrs[i], False):
            i = page.ends[i]
        elif tags[i] == tag or (tag == "main" and "role" in page.attrs[i] and _attributes(page.attrs[i]).get("role") == "main"):
            out.append(i)
            i = page.ends[i]
        else:
            i += 1
    return out


def articles(page: Page) -> list[int]:
    """The wanted article elements of a page, else its main element, else nothing."""
    return (_top(page, "article") if "article" in page.tags else []) or _top(page, "main")


def _beside(page: Page) -> list[int]:
    """Running sums, by item, of the hashes of the texts outside of unwanted elements; a difference of two is a range of items."""
    out, i, tags, ends = [0] * (len(page.tags) + 1), 1, page.tags, page.ends
    while i < len(tags):
        to = ends[i] if tags[i] and unwanted(tags[i], page.attrs[i], False) else i + 1
        said = " ".join(page.attrs[i].split()) if not tags[i] else ""
        now = out[i] + (xxhash.xxh3_64_intdigest(said) if said else 0)
        out[i + 1 : to + 1] = [now] * (to - i)
        i = to
    return out


def template_candidates(text: str | None) -> set[tuple[int, int]]:
    """Hashes of the containers with text, but for the articles themselves, each with a hash of what it stands with: the page's articles or main
    element, else the wanted texts of the page outside of the container."""
    if not text:
        return set()
    page = Page(text)
    ds, own = digests(page), articles(page)
    if own:
        part, main = xxhash.xxh3_64_intdigest("\0".join(f"{ds[i]:x}" for i in own)), set(own)
        return {(d, part) for i, (d, t) in enumerate(zip(ds, page.tags, strict=True)) if d and t in CONTAINERS and i not in main}
    upto = _beside(page)
    return {(d, (upto[-1] - upto[page.ends[i]] + upto[i]) & 0xFFFFFFFFFFFFFFFF) for i, (d, t) in enumerate(zip(ds, page.tags, strict=True)) if d and t in CONTAINERS}


def _blocks(page: Page, ds: list[int], cut: frozenset | set, own: set[int]) -> tuple[list[str], int, int]:
    """Blocks of what is left, how many subtrees went as templates, and how many parts with text the rules took from what templates had left."""
    tags, attrs, ends = page.tags, page.attrs, page.ends
    blocks: list[str] = []
    line: list[str] = []
    closing: list[int] = []  # where the open blocks end
    i, n, inside_to, gone, ruled = 1, len(tags), 0, 0, 0

    def end() -> None:
        if t := " ".join("".join(line).split()):
            blocks.append(t)
        line.clear()

    while True:
        while closing and closing[-1] <= i:
            closing.pop()
            end()
        if i >= n:
            end()
            return blocks, gone, ruled
        tag, inside = tags[i], i < inside_to
        if not tag:
            if inside or not own:
                line.append(html.unescape(attrs[i]))
            elif not attrs[i].isspace():
                ruled += 1
        elif tag == "br":
            line.append(" ")
        elif i in own:
            end()
            inside_to = ends[i]
            closing.append(ends[i])
        elif cut and tag in CONTAINERS and ds[i] in cut:
            gone += 1
            i = ends[i]
            continue
        elif unwanted(tag, attrs[i], inside):
            ruled += bool(ds and ds[i] and tag not in UNSEEN)
            i = ends[i]
            continue
        elif tag in BLOCK:
            end()
            closing.append(ends[i])
        i += 1


def extracted(text: str | None, templates: set[int] | frozenset = frozenset()) -> tuple[str, int, str]:
    """The text of a page (blocks in page order, joined by blank lines; white space in a block is one space), the number of subtrees that went as templates, and what
    decided: ``templates`` where these were all that had to go, so that the text is what they leave of the page, with no use of the article mark, tags or classes; ``both`` where
    rules took more; ``rules`` where no template went. A page of which templates leave nothing keeps what it says."""
    if not text:
        return "", 0, "rules"
    page = Page(text)
    ds, own = digests(page) if templates else [], set(articles(page))
    blocks, gone, ruled = _blocks(page, ds, templates, own)
    if gone and not blocks:
        blocks, gone, ruled = _blocks(page, ds, frozenset(), own)
    return "\n\n".join(blocks), gone, "rules" if not gone else "both" if ruled else "templates"


def main_text(text: str | None, templates: set[int] | frozenset = frozenset()) -> str:
    return extracted(text, templates)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted as templates) and decided (see :func:`extracted`) of each row. A null or empty page has an empty text; a null url is
    a host of its own; rows that repeat count once for templates; an empty table gives no rows; other columns are ignored.

    Subtrees are counted per host with partial sums. Templates meet the subtrees by host and hash, and what a page has of them
    meets the page by a hash of host and page, so that a host may have any number of templates. Either is broadcast up to a checked size, else joined by a shuffle.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), _HOST, 1), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).alias("u"), host.alias("host"), F.col(html_col).alias("t")).withColumn("p", F.xxhash64("host", "t"))

    def keyed(host: str, d: int) -> int:
        """A subtree's hash made one of its host; the same again undoes it."""
        return d ^ xxhash.xxh3_64_intdigest(host)

    signed = lambda d: d - (1 << 64 if d >> 63 else 0)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ps, hosts, texts in C.rows_of(batches, "p", "host", "t"):
            rows: list[tuple] = []
            for p, x, t in zip(ps, hosts, texts, strict=True):
                rows += [(p, signed(keyed(x, d)), signed(m)) for d, m in template_candidates(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield C.batch(**{c: pa.array(v, pa.int64()) for c, v in zip("pdm", cols, strict=True)})

    found = C.saved(base.mapInArrow(candidates, "p long, d long, m long"))
    templates = found.select("d", "m").distinct().groupBy("d").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_pages).select("d")
    hits = found.select("p", "d").join(C.small(C.saved(templates)), "d").groupBy("p").agg(F.collect_set("d").alias("ds"))  # a page's own subtrees alone
    joined = base.join(C.small(C.saved(hits)), "p", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, urls, hosts, raw, ds in C.rows_of(batches, "k", "u", "host", "t", "ds"):
            out = [extracted(t, frozenset(keyed(x, v & 0xFFFFFFFFFFFFFFFF) for v in d or ())) for x, t, d in zip(hosts, raw, ds, strict=True)]
            yield C.batch(page_id=pa.array(keys, pa.int64()), url=pa.array(urls, pa.string()), text=pa.array([x[0] for x in out], pa.string()), n_chars=pa.array([len(x[0]) for x in out], pa.int64()), n_templates=pa.array([x[1] for x in out], pa.int64()), decided=pa.array([x[2] for x in out], pa.string()))

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long, n_templates long, decided string")


def op8_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
