"""Main text of web pages by a site style tree.

Every page is read as a tree of block elements. Pages of one host are merged by path
(tag and class names from the root). The presentation importance of a node is the entropy,
to the base of its pages, of its child styles (the sequences of its children), its content
importance that of the text which stands in it. The composite importance of a branch with
l styles is (1 - g^l) of the presentation and g^l of the mean of its children and text, of
a branch without children its content importance. What few pages have is important. Pages
whose text is equal count once. A branch is removed if it and all in it are of low
composite importance, inside `article` and `main` too; the blocks left are the text.

In addition, nodes that present themselves as menus, headers, footers, side columns,
notices, adverts, forms or comments have no importance, and a page with an article or main
element gives only what stands in it.

The tree of a host is a small aggregate of counts, one row for each path of enough pages;
pages of a host are never gathered.

Results for special rows: a null or empty html, or one without text, gives an empty
text; unclosed comments and tags run to the end of the page; a null url has the empty
host; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import host_of
from .workspace import Workspace

#: Pages from which a host's nodes are judged, and the importance they need.
LEAST_PAGES = 5
LEAST_IMPORTANCE = 0.3
#: Weight of what stands in a branch against its presentation; less with each more style.
ATTENUATION = 0.9
#: A child's share of a node is counted in parts of this, so that sums don't depend on order.
SHARES = 1 << 20
TEXT = "#"
#: Nodes to remove that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 20_000

# Elements (fixed values of the markup language).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul head title button select".split()
)
SILENT = frozenset("script style noscript template iframe object svg canvas audio video textarea math noframes noembed xmp title".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
NOISE = frozenset("nav footer aside form dialog menu button select head option search".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
SCOPES = frozenset("article main section div table ul ol dl td th blockquote body nav footer aside form header".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar "
    "aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager".split()
)
HEADER_NAMES = frozenset(("header", "topbar", "siteheader"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)  # a quote opens a value only behind "="
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")
# White space of Unicode (fixed values).
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _is_noise(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in NOISE or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    names = set(NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    return bool(names & NOISE_NAMES) or not in_main and bool(names & HEADER_NAMES)


def blocks(html: str, styles: dict[str, list[str]] | None = None) -> tuple[list[tuple[str, str, bool]], bool]:
    """Blocks of a page outside noise: (path, text, in main); whether it has a main element.

    styles: gets the children of each path outside noise in order, a text as TEXT.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, in main
    pieces: list[str] = []
    has_main = False
    at, end = 0, len(html)

    def flush() -> None:
        if pieces:
            noise, in_main, path = (stack[-1][2], stack[-1][3], stack[-1][1]) if stack else (False, False, "")
            if not noise and (text := WHITE.sub(" ", "".join(pieces)).strip(" ")):
                out.append((path, text, in_main))
                if styles is not None:
                    styles.setdefault(path, []).append(TEXT)
            pieces.clear()

    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            # what is left is text, but for a tag that never ends
            pieces.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            pieces.append(entities.unescape(html[at : m.start()]))
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in SILENT and not m[1]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in EMPTY:
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and not (tag in ("tr", "tbody") and stack[i][0] in ("td", "th")):
                    break
        attributes = _attributes(m[3])
        _, path, noise, in_main = stack[-1] if stack else ("", "", False, False)
        noise = noise or _is_noise(tag, attributes, in_main)
        if tag in MAIN and not noise:
            has_main = in_main = True
        name = ".".join([tag, *sorted(attributes.get("class", "").split())]).replace("/", "|") if attributes else tag
        if styles is not None and not noise:
            styles.setdefault(path, []).append(name)
        stack.append((tag, f"{path}/{name}", noise, in_main))
    flush()
    return out, has_main


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def page_nodes(html: str) -> list[tuple[str, str, bool, int, int, int]]:
    """A page's part of its site's tree: (path, parent, is text, style or content, children, share of the parent)."""
    styles: dict[str, list[str]] = {}
    found, has_main = blocks(html, styles)
    contents: dict[str, list[str]] = {}
    for path, text, in_main in found:
        if in_main or not has_main:
            contents.setdefault(path, []).append(text)
    held = set()
    for path in contents:
        while path not in held:
            held.add(path)
            path = path.rpartition("/")[0]
    rows, shares = [], {"": SHARES}
    for path in sorted(held):  # parents first
        children = [c for c in styles[path] if (path in contents if c == TEXT else f"{path}/{c}" in held)]
        kinds = set(children)
        for c in kinds - {TEXT}:
            shares[f"{path}/{c}"] = SHARES * children.count(c) // len(children)
        rows.append((path, path.rpartition("/")[0], False, _digest("/".join(children)), len(kinds), shares[path]))
        if TEXT in kinds:
            rows.append((path, path, True, _digest("\n".join(contents[path])), 0, SHARES * children.count(TEXT) // len(children)))
    return rows


NODE_SCHEMA = "host string, path string, parent string, is_text boolean, value long, kinds long, share long, page long"


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (host, html) to the nodes of the site's tree."""
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host"), batch.column("html")):
            nodes = page_nodes(html.as_py() or "")
            page = _digest(repr(nodes))
            rows += [(host.as_py(), *node, page) for node in nodes]
        columns = list(zip(*rows)) if rows else [[] for _ in types]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def tree_rows(least_importance: float):
    """applyInArrow function: the nodes of one site's tree that enough pages have, to (host, path) of noise."""

    def run(nodes: pa.Table) -> pa.Table:
        rows = {(r["path"], r["is_text"]): r for r in nodes.to_pylist()}
        below: dict[str, list[dict]] = {}
        for (path, is_text), r in rows.items():
            if path or is_text:
                below.setdefault(r["parent"], []).append(r)
        composite: dict[tuple[str, bool], float] = {}
        noise: set[tuple[str, bool]] = set()
        # children before their parents, a node's text before the node
        for key in sorted(rows, key=lambda k: (k[0].count("/"), k[1]), reverse=True):
            r, parts = rows[key], below.get(key[0], ()) if not key[1] else ()
            if key[1]:
                value, whole = r["importance"], True
            else:
                judged = sum(c["share"] for c in parts) / (SHARES * r["m"])
                inside = sum(c["share"] * composite[c["path"], c["is_text"]] for c in parts) / (SHARES * r["m"]) + max(0.0, 1 - judged)
                # without the other children, if any, that few pages have
                whole = r["kinds"] == sum(c["m"] for c in parts) and all((c["path"], c["is_text"]) in noise for c in parts)
                if all(c["is_text"] for c in parts) and r["kinds"] == sum(c["m"] for c in parts):
                    value = inside  # no child but its text
                else:
                    weight = ATTENUATION ** r["styles"]
                    value = (1 - weight) * r["importance"] + weight * inside
            composite[key] = value
            if whole and value < least_importance:
                noise.add(key)
        low = [path for path, is_text in noise if not is_text and (path, True) in rows]
        host = nodes.column("host")[0].as_py() if len(nodes) else None
        return pa.table({"host": pa.array([host] * len(low), pa.string()), "path": pa.array(low, pa.string())})

    return run


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (page_id, url, html, low) to the page's text."""
    for batch in batches:
        texts = []
        for html, low in zip(batch.column("html"), batch.column("low")):
            found, has_main = blocks(html.as_py() or "")
            drop = set(low.as_py() or ())
            texts.append("\n".join(text for path, text, in_main in found if path not in drop and (in_main or not has_main)))
        yield pa.record_batch(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def low_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """pages (host, html) to (host, path) of the site trees' nodes of low importance."""
    seen = pages.select("host", "html").mapInArrow(node_rows, NODE_SCHEMA).distinct()
    styles = seen.groupBy("host", "path", "is_text", "value").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.sum("kinds").alias("kinds"), F.sum("share").alias("share"))
    # entropy from sums alone: log m - sum(n log n) / m, to the base m
    nodes = styles.groupBy("host", "path", "is_text").agg(
        F.first("parent").alias("parent"), F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum("kinds").alias("kinds"), F.sum("share").alias("share"), F.sum(F.col("n") * F.log("n")).alias("nlogn")
    )
    nodes = nodes.filter((F.col("m") >= least_pages) & (F.col("m") > 1)).withColumn("importance", 1 - F.col("nlogn") / (F.col("m") * F.log("m"))).drop("nlogn")
    return nodes.groupBy("host").applyInArrow(tree_rows(least_importance), "host string, path string")


def extract_text(pages: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    workspace = workspace or Workspace(pages.sparkSession, "html")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    low = workspace.save(low_nodes(rows), "low")
    by_host = low.groupBy("host").agg(F.collect_list("path").alias("low"))  # one site's tree
    if low.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        by_host = F.broadcast(by_host)
    return rows.join(by_host, "host", "left").select("page_id", "url", "html", "low").mapInArrow(text_rows, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
