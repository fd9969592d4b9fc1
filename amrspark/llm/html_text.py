"""The main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")

# Element names, as the HTML standard groups them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
_FENCE = frozenset("table td th ul ol dl button body html".split())
_NOISE_TAG = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title".split()
)
_NOISE_ROLE = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "status toolbar".split()
)
# Words of class and id names that mark what surrounds an article.
_NOISE_WORD = frozenset(
    "ad ads adv adbox advert adverts advertisement advertising alert alerts aside banner breadcrumb "
    "breadcrumbs comment commentlist comments consent cookie cookies copyright discussion disqus "
    "feedback footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification notifications outbrain overlay pager pagination paywall popup promo promos "
    "promotion recommended related replies reply respond responses rss search share sharing sidebar "
    "sidenav signup skip social sponsor sponsored subscribe subscription taboola tagcloud teaser "
    "teasers toolbar topbar widget".split()
)
_COMMENT_WORD = frozenset("ad ads advert comment comments reply replies teaser".split())
_PIECES = frozenset("article content entry main post story text".split())


class _Page:
    """A page's elements as parallel lists; a child always stands after its parent."""

    def __init__(self):
        self.tag, self.parent, self.noise = ["#root"], [-1], [False]
        self.text: list[tuple[int, int, str]] = []  # element, block, characters
        self.inside = [False]  # an article or main element
        self.open: dict[str, int] = {}
        self.block = 0


def _parse(source: str) -> _Page:
    page = _Page()
    stack = [0]
    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            _add_text(page, stack[-1], source[at:])
            break
        if lt > at:
            _add_text(page, stack[-1], source[at:lt])
        if source.startswith("<!--", lt):
            close = source.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            close = source.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        found = _TAG.match(source, lt) or _LOOSE_TAG.match(source, lt)
        if not found:
            if source[lt + 1 : lt + 2].isalpha() or source.startswith("</", lt):
                close = source.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                _add_text(page, stack[-1], "<")
                at = lt + 1
            continue
        at = found.end()
        name = found[2].lower()
        if found[1]:
            _end(page, stack, name)
        else:
            node = _start(page, stack, name, found[3])
            if name in _RAW and node is not None:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                stop = close.start() if close else end
                if name == "textarea":
                    _add_text(page, node, source[at:stop])
                at = stop
    return page


def _add_text(page: _Page, node: int, text: str) -> None:
    page.text.append((node, page.block, html.unescape(text)))


def _start(page: _Page, stack: list[int], name: str, attributes: str) -> int | None:
    if name in ("html", "body") and name in (page.tag[i] for i in stack):
        return None
    if name == "body" or (page.tag[stack[-1]] == "head" and name in _BLOCK and name != "title"):
        _close_to(page, stack, ("head",), fence=frozenset())
    if name in _BLOCK:
        page.block += 1
        _close_to(page, stack, ("p",), fence=_FENCE)
        if name in _CLOSES:
            _close_to(page, stack, _CLOSES[name], fence=_FENCE - {"td", "th"})
    node = len(page.tag)
    page.tag.append(name)
    page.parent.append(stack[-1])
    inside = page.inside[stack[-1]]
    page.inside.append(inside or name in ("article", "main"))
    page.noise.append(_is_noise(name, attributes, inside))
    if name == "br":
        page.text.append((stack[-1], page.block, " "))
    if name not in _VOID and (name in _RAW or not attributes.rstrip().endswith("/")):
        stack.append(node)
        page.open[name] = page.open.get(name, 0) + 1
    return node


def _end(page: _Page, stack: list[int], name: str) -> None:
    if name in _BLOCK:
        page.block += 1
    _close_to(page, stack, (name,), fence=frozenset() if name in _BLOCK else _FENCE)


def _close_to(page: _Page, stack: list[int], names: tuple[str, ...], fence: frozenset) -> None:
    """Close the outermost open element of `names` above the nearest fence, and all within it."""
    cut = None
    if not any(page.open.get(name) for name in names):
        return
    for depth in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[depth]]
        if tag in names:
            cut = depth
            if len(names) == 1:
                break
        elif tag in fence:
            break
    if cut is not None:
        for node in stack[cut:]:
            page.open[page.tag[node]] -= 1
        del stack[cut:]


def _is_noise(name: str, attributes: str, inside: bool) -> bool:
    if name in _NOISE_TAG or (name == "header" and not inside):
        return True
    if name in ("html", "body") or not attributes.strip():
        return False
    known = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in known or known.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", known.get("style", "")):
        return True
    if known.get("role") in _NOISE_ROLE:
        return True
    words = set(_TOKEN.findall(f"{known.get('class', '')} {known.get('id', '')}"))
    if name in ("article", "main"):
        return bool(words & _COMMENT_WORD) and not words & _PIECES
    if "header" in words and not inside and not words & _PIECES:
        return True
    return bool(words & _NOISE_WORD)


def _noise(page: _Page) -> list[bool]:
    """Which elements stand in a part that is no article. A form, or an element judged by its class
    alone, that holds the article itself (main, article, or a form's h1) is only a wrapper."""
    n = len(page.tag)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        tag = page.tag[i]
        holds[i] = holds[i] or (tag in ("article", "main") and not page.noise[i])
        up = page.parent[i]
        holds[up] = holds[up] or holds[i] or (tag == "h1" and page.tag[up] == "form")
    noise = [False] * n
    for i in range(1, n):
        wraps = holds[i] and page.tag[i] not in _NOISE_TAG - {"form"} and page.tag[i] not in ("article", "main")
        noise[i] = noise[page.parent[i]] or (page.noise[i] and not wraps)
    return noise


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, one per line.

    Elements that are no part of an article by their name, role or class are left out. For every
    other element, characters per tag, adjusted by the share of linked characters and tags, give
    the composite density; the element with the largest sum of its children's densities holds the
    article. Its threshold is the least density on the path from the body to it: blocks below it
    that stand beside that path are left out, but for headings, and so are those inside the
    article whose characters are mostly links. If `article` or `main` elements stand on the path,
    the outermost of them is the article as a whole.
    """
    if not source:
        return ""
    page = _parse(source)
    n = len(page.tag)
    noise = _noise(page)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    all_chars = all_linked = 0
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for node, _, text in page.text:
        size = len("".join(text.split()))
        if page.tag[node] not in ("script", "style", "title"):
            all_chars += size
            all_linked += size * in_link[node]
        if not noise[node]:
            chars[node] += size
            linked[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if not noise[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (page.tag[i] == "a")
    share = all_linked / max(1, all_chars)
    density = [_density(chars[i], linked[i], tags[i], links[i], share) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        if not noise[i]:
            total[page.parent[i]] += density[i]
    kept = [i for i in range(n) if not noise[i] and chars[i]]
    if not kept:
        return ""
    best = max(kept, key=lambda i: (total[i], density[i], -i))
    path = [best]
    while page.parent[path[-1]] >= 0 and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    named = [k for k, i in enumerate(path) if page.tag[i] in ("article", "main")]
    root, path = path[named[-1] if named else -1], set(path)
    keep, beside = [False] * n, [False] * n
    keep[root], beside[root] = True, not named and root != best
    for i in range(root + 1, n):
        up = page.parent[i]
        beside[i] = beside[up] and i != best
        linky = 2 * linked[i] > chars[i] and page.tag[i] != "a"
        apart = beside[i] and page.tag[i] not in _HEADING
        if keep[up] and not noise[i]:
            low = page.tag[i] in _BLOCK and density[i] < threshold
            keep[i] = i in path or not ((linky or apart) and low)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.text:
        if keep[node]:
            blocks.setdefault(block, []).append(text)
        elif noise[node] and block in blocks:
            blocks[block].append(" ")
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _density(c: int, lc: int, t: int, lt: int, share: float) -> float:
    """Characters per tag, scaled down the more of characters and tags belong to links."""
    if not c:
        return 0.0
    plain = c / max(1, t)
    base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
    if base <= 1 + 1e-9:
        return plain
    return plain * max(0.0, math.log(max(1.0, (c / max(1, lc)) * (max(1, t) / max(1, lt))))) / math.log(base)


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of each web page, as the text of a knowledge chunk.

    The project keeps no page markup of its own; `pages` has the fields that a chunk cut from a
    page needs: chunk_id, source (its url) and html. Returns chunk_id, source and text, one row
    per row, repeated rows included.

    Null, empty and text-free pages have the empty text; whole pages are read, also truncated or
    badly nested ones. Ids and sources may be null. Further columns are ignored.
    """
    kind = pages.schema["chunk_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("source"), pa.array(texts, pa.string())],
                ["chunk_id", "source", "text"],
            )

    rows = pages.select("chunk_id", F.col("source").cast("string").alias("source"), "html")
    return rows.mapInArrow(read, f"chunk_id {kind}, source string, text string")
