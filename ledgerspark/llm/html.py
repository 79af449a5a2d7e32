"""Main text of web pages with a site style tree: same-host pages merged, branches weighed by entropy."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, sized


@dataclass(frozen=True)
class Settings:
    """share: weight of presentation in a node's importance; the rest is its content's.

    A node's importance is first shrunk towards 1 as if `prior` more pages had other content there, then weighed by its
    markup: by `aside` outside the article of a page that has one (or else its main element), by `noise` in elements
    that say they aren't main text. Branches under `threshold` go. A node's content is `minima` minima over its blocks' runs
    of `words` words, so a number that changes from page to page doesn't make it another content.
    """

    share: float = 0.1
    threshold: float = 0.25
    prior: float = 4.0
    aside: float = 0.2
    noise: float = 0.1
    minima: int = 8
    words: int = 2


#: Elements that never hold main text, those that are main text's containers, and blocks.
RAW = "script|style|noscript|template|iframe|svg|title|textarea|select"
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
NOISE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|"
                        r"cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|"
                        r"comments?|replies|disqus|login|search|pagination|pager|widget|skip)(?:$|[\s_-])")
#: In an article only containers go by name, and only by a whole class name: a noise word alone or with a word for a part of a page behind it.
CONTAINERS = {"div", "section", "ul", "ol", "table"}
INSIDE_NAME = re.compile(r"(?:ads?|advert\w*|sponsored|promo\w*|nav|menu|breadcrumbs?|sidebar|cookies?|consent|popup|modal|newsletter|subscribe|signup|"
                         r"share|sharing|social|related|recommended|comments?|replies|disqus|pagination|pager)(?:[_-]?(?:area|banner|block|box|buttons?|container|form|links?|list|posts?|"
                         r"section|slot|thread|unit|widget|wrapper))?")
#: Articles that are a reader's comment, and ids that hold comments.
COMMENT_NAME = re.compile(r"(?:comments?|reply|replies|disqus)(?:[_-](?:\d+|area|body|box|item|list|section|thread))?")
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button"}
VOID = {"hr"}
#: Opening one of these closes an open one of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def _describe(tag: str, attrs: str, inside: bool, main: bool) -> tuple[str, bool]:
    """A node's name in the tree, and whether its markup alone says that it isn't main text."""
    if not attrs.strip():
        return tag, tag in NOISE_TAGS or (tag == "header" and not main)
    got = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    name = f"{got.get('class', '')} {got.get('id', '')}".lower().strip()
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")))
    noise = tag in NOISE_TAGS or (tag == "header" and not main) or hidden or got.get("role", "").lower() in NOISE_ROLES
    classes, ids = got.get("class", "").lower().split(), got.get("id", "").lower().split()
    if tag == "article" or inside and tag in CONTAINERS:
        noise = noise or any(COMMENT_NAME.fullmatch(x) for x in classes + ids)
    if inside:
        noise = noise or tag in CONTAINERS and any(INSIDE_NAME.fullmatch(x) for x in classes)
    elif tag not in ("html", "body", "article", "main"):
        noise = noise or bool(NOISE_NAME.search(name))
    return f"{tag}.{'.'.join(sorted(got.get('class', '').lower().split()))}", noise


def blocks(page: str | None, settings: Settings | None = None) -> list[tuple[str, str, float]]:
    """(path, text, weight of its markup) of a page's blocks, in order."""
    s = settings or Settings()
    page = page or ""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, path, noise, 2 in an article, 1 in a main element
    buffer: list[str] = []

    def flush():
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip(" ")
            if text:
                out.append((stack[-1][1], text, stack[-1][3], stack[-1][2]) if stack else ("", text, 0, False))
            buffer.clear()

    def pop_to(tags: set[str], limit: set[str]):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in limit:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag not in BLOCKS:
            if tag == "br":
                buffer.append(" ")
            continue
        flush()
        if m[2]:
            pop_to({tag}, set() if tag in ("article", "main", "body", "html") else {"article"})
            continue
        if tag in VOID:
            continue
        if tag in SELF_CLOSING:
            pop_to(SELF_CLOSING[tag], {"ul", "ol", "table", "div", "article", "section", "blockquote", "dl", "td", "main"} - SELF_CLOSING[tag])
        elif tag != "p":
            pop_to({"p"}, {"div", "article", "section", "li", "td", "blockquote", "main", "aside", "nav", "footer"})
        up = stack[-1] if stack else ("", "", False, 0)
        name, noise = _describe(tag, m[4] or "", up[3] == 2, bool(up[3]))
        stack.append((tag, f"{up[1]}/{name}", noise or up[2], max(up[3], 2 if tag == "article" else 1 if tag == "main" else 0)))
    if at < len(page):
        rest = page[at:]
        buffer.append(rest[:rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)  # a tag that the page's end cuts off
    flush()
    best = max((where for _, _, where, noise in out if not noise), default=0)
    return [(p, t, (s.noise if noise else 1.0) * (1.0 if where == best else s.aside)) for p, t, where, noise in out]


def nodes(found: list[tuple[str, str, float]]) -> dict[str, list[str]]:
    """The texts under each node (a block's path or a path above it) of a page."""
    by: dict[str, list[str]] = {}
    for path, text, _ in found:
        while True:
            by.setdefault(path, []).append(text)
            if not path:
                break
            path = path[:path.rfind("/")]
    return by


_IN_ARTICLE = re.compile(r"/article(?=[./]|$)")


def contents(found: list[tuple[str, str, float]], s: Settings) -> dict[str, list[int]]:
    """The content of each node of a page, as numbers that pages are compared by.

    A block's features are its runs of s.words words (a shorter text is one run), in an article its whole text. A node has the minima under XOR
    of its own blocks' features, one without text of its own those of all blocks under it; nodes in an article, where
    copies of texts belong, have one number for all their text.
    """
    own: dict[str, np.ndarray] = {}
    under: dict[str, np.ndarray] = {}
    salts = _salts(s.minima)
    for path, text, _ in found:
        inside = bool(_IN_ARTICLE.search(path))
        words = [] if inside else text.split(" ")
        runs = [" ".join(words[i:i + s.words]) for i in range(max(1, len(words) - s.words + 1))] if words else [text]
        h = np.array([xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs], np.uint64).view(np.int64)
        least = (h[:, None] ^ salts).min(axis=0)
        own[path] = np.minimum(own[path], least) if path in own else least
        while path:
            path = path[:path.rfind("/")]
            under[path] = np.minimum(under[path], least) if path in under else least
    return {path: [_hash("\n".join(ts))] if _IN_ARTICLE.search(path) else (own if path in own else under)[path].tolist() for path, ts in nodes(found).items()}


def _salts(n: int) -> np.ndarray:
    """Evenly spread 64-bit numbers: each is near other hashes."""
    return np.array([k * 0x9E3779B97F4A7C15 % 2**64 for k in range(1, n + 1)], np.uint64).view(np.int64)


def host_of(url: Column) -> Column:
    """Lower-cased host of an address; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def tree(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, path, pages, importance) of all nodes of the merged trees of all hosts; pages has (host, html).

    Pages of one host with the same main text by markup alone count once, so copied articles aren't taken for templates. For a node on m pages, c pages with one content add
    c/m * log(c)/log(m) to what is common to the pages; importance is 1 less that. The node's presentations (how many blocks of
    text are under it) count by s.share, its contents (the mean over the numbers of `contents`) by the rest. Importance is shrunk towards 1 by s.prior pages,
    so what few pages show weighs little. Tasks send a row for each node of a page, and sums meet before the shuffle, so
    no task holds a host.
    """
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows, part = [], b.slice(at, 64)
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = blocks(page, s)
                    whole = _hash("\n".join(t for _, t, w in got if w == 1.0))
                    of = nodes(got)
                    rows += [(host, path, c, len(of[path]), whole) for path, c in contents(got, s).items()]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()))],
                                                 ["host", "path", "content", "style", "page"])

    found = checkpoint(pages.mapInArrow(run, "host string, path string, content array<long>, style long, page long").distinct())
    c, m = F.col("c").cast("double"), F.col("pages").cast("double")

    def entropy(rows: DataFrame, by: str) -> DataFrame:
        sums = (rows.groupBy("host", "path", "slot", by).agg(F.count("*").alias("c")).groupBy("host", "path", "slot")
                .agg(F.sum("c").alias("pages"), F.sum(c * F.log(c)).alias("s")))
        return (sums.select("host", "path", "pages", F.when(m > 1, 1 - F.col("s") / (m * F.log(m))).otherwise(1.0).alias(by))
                .groupBy("host", "path").agg(F.max("pages").alias("pages"), F.avg(by).alias(by)))

    both = (entropy(found.select("host", "path", F.posexplode("content").alias("slot", "content")), "content")
            .join(entropy(found.withColumn("slot", F.lit(0)), "style").drop("pages"), ["host", "path"]))
    plain = s.share * F.col("style") + (1 - s.share) * F.col("content")
    return both.select("host", "path", "pages", ((m * plain + s.prior) / (m + s.prior)).alias("importance"))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Hosts whose lists of unimportant branches are broadcast at most; longer lists are joined by a shuffle.
BROADCAST_HOSTS = 50_000


def main_text(page: str | None, low: Iterable[str], s: Settings) -> str:
    """The text of a page's blocks, without those of the host's list of nodes and those that their markup alone makes unimportant.

    A branch goes when all nodes with text in it do, so a template around a text doesn't take the text along.
    """
    gone, kept = set(low), []
    for path, text, weight in blocks(page, s):
        if weight >= s.threshold and path not in gone:
            kept.append(text)
    return "\n".join(kept)


def branches(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, path, pages, importance) of the branches that go: nodes under the threshold."""
    return tree(pages, s).where((F.col("importance") < s.threshold) & (F.col("path") != ""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty pages, and those without main text, have an empty text. Pages without an address are
    merged as one host. Very long pages are read whole. Repeated rows are returned each. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    s = settings or Settings()
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    low = checkpoint(branches(rows.select("host", "html"), s).groupBy(F.col("host").alias("h")).agg(F.collect_list("path").alias("low")))
    joined = rows.join(sized(low, BROADCAST_HOSTS), F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "low")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [main_text(page, out or (), s) for page, out in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
