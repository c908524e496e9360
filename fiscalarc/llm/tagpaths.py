"""Main text of web pages by tag-path ratios.

Every text node has the path of tags from the root to it. Per path, text length and punctuation are
summed and divided by the number of nodes; both ratios are smoothed over the paths in page order,
fused, and held against a threshold: articles stand on few paths with long, punctuated nodes. The
article is the lowest element that holds all nodes on the paths above it, or the <article> or <main>
around them, and all its blocks are the result. Elements that by their tag, role or name are not the
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) do not take
part, unless the only <article> or <main> is in them, or (for names, roles, forms, hidden elements)
they hold most of the page's text and nothing outside them reads like an article: no path whose fused
ratio comes up to that of a sentence. Elements nested deeper than ``DEPTH`` count as their ancestor there.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: elements without content
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
#: fixed values: elements whose content is not markup
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp"}
#: fixed values: elements inside a block of text
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: fixed values: elements that are never part of an article
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu",
           "dialog", "template", "svg", "math", "canvas", "object", "audio", "video", "map"} | RAW
NEVER = OUTSIDE - {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "menu",
                 "alert", "alertdialog", "form", "menubar", "toolbar"}
OUTSIDE_NAMES = re.compile(
    r"ads?|adverts?|advertis\w*|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|"
    r"consent|gdpr|notices?|popup|modal|overlay|alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"footer|header|masthead|reviews|comments?|commentlist|respond|repl(?:y|ies)|disqus|social|share|"
    r"sharing|related|recommend(?:ed|ations?)?|newsletter|subscribe|subscription|widget|pagination|"
    r"pager|toolbar|login|signup|search")
#: fixed values: words that may stand beside those in a name of the part itself
BESIDE = {"user", "users", "reader", "readers", "visitor", "visitors", "customer", "text", "site", "page", "main", "top", "bottom", "left", "right", "side", "bar", "primary", "secondary",
          "global", "list", "box", "area", "section", "block", "container", "wrapper", "wrap", "inner",
          "links", "items", "form", "posts", "articles", "buttons", "icons", "skip", "link", "bars"}
#: fixed values: a start tag that ends an open element: the open elements, and what shields them
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
          "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "option": ({"option"}, {"select"})}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<broken>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
#: paths count from this share of the largest fused ratio on
THRESHOLD = 0.1
#: a text node of a sentence or more: its fused ratio of length and punctuation
SENTENCE = 120.0
#: paths have at most so many tags; browsers end the nesting of elements likewise
DEPTH = 128
#: the elements that say where the article is
MARKED = ("article", "main")


def _names_outside(name: str) -> bool:
    """Whether a class or id names a part that is not the article, by all of its words."""
    words = [w for w in re.split(r"[-_]+", name) if w]
    hits = [bool(OUTSIDE_NAMES.fullmatch(w)) for w in words]
    return (any(hits) or words == ["side", "bar"] or words == ["skip", "link"]) and all(
        h or w in BESIDE or w.isdigit() for h, w in zip(hits, words))


def _outside(tag: str, attrs: str) -> int:
    """Not part of the article: 3 whatever it holds, 2 by its tag, 1 by its attributes; else 0."""
    if tag in NEVER:
        return 3
    if tag in OUTSIDE and tag != "form":
        return 2
    if tag == "form":
        return 1
    if not attrs or tag in ("html", "body", *MARKED):
        return 0
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "role" and value in OUTSIDE_ROLES) or (
                key in ("class", "id") and any(map(_names_outside, value.split()))):
            return 1
    return 0


def nodes(page: str):
    """(block, path, element path, text) of every text node that may be of the article, in order.

    ``path`` has the tags; the element path the numbers of the elements; nodes of one block share
    its number.
    """
    stack: list[tuple[str, int, bool, tuple]] = []  # the last: elements around that may be outside
    found, doubts, block, element, at, n = [], [], 0, 0, 0, len(page)

    path: tuple[tuple[str, ...], tuple[int, ...]] | None = None
    open_tags: Counter[str] = Counter()

    def add(text: str) -> None:
        nonlocal path
        if path is None:
            path = tuple(s[0] for s in stack[:DEPTH]), tuple(s[1] for s in stack[:DEPTH])
        found.append((block, *path, text))
        doubts.append(stack[-1][3] if stack else ())

    look = 0
    while at < n:
        look = page.find("<", look)
        token = TOKEN.match(page, look) if look >= 0 else None
        if token is None and look >= 0:
            look += 1  # a bare "<" is text
            continue
        hidden = bool(stack) and stack[-1][2]
        stop = look if token else n
        if stop > at and not hidden:
            add(html.unescape(page[at:stop]))
        if token is None:
            break
        at = look = token.end()
        tag = token["close"]
        if tag:
            tag = tag.lower()
            if open_tags[tag]:
                last = len(stack)
                while stack[last - 1][0] != tag:
                    last -= 1
                _cut(stack, last - 1, open_tags)
                path = path if len(stack) >= DEPTH else None
                if tag not in INLINE:
                    block += 1
            continue
        tag = token["open"] or token["broken"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            if not hidden:
                add(" ")
            continue
        if tag not in INLINE:
            block += 1
            if not hidden:
                _end_open(stack, tag, open_tags)
                path = path if len(stack) >= DEPTH else None
        attrs = token["attrs"] or token["rest"] or ""
        if tag in VOID:
            continue
        element += 1
        hidden = bool(stack) and stack[-1][2]
        doubt, why = stack[-1][3] if stack else (), _outside(tag, attrs)
        if why in (1, 2) and len(doubt) < DEPTH:
            doubt = (*doubt, (len(stack), element, why))
        path = path if len(stack) >= DEPTH else None
        stack.append((tag, element, hidden or why == 3, doubt))
        open_tags[tag] += 1
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = look = end.start() if end else n
    return _of_article(found, doubts) if any(doubts) else found


def _of_article(found: list, doubts: list) -> list:
    """The nodes less those in elements that may be outside, where that leaves the article."""
    total, held, around, plain = 0, {}, set(), False
    marks: dict[tuple, int | None] = {}
    beside: dict[tuple, list[int]] = {}
    for (_, path, _, text), doubt in zip(found, doubts):
        size = len(text.strip())
        total += size
        for d in doubt if size else ():
            held[d] = held.get(d, 0) + size
        if path not in marks:
            marks[path] = next((i for i, t in enumerate(path) if t in MARKED), None)
        first = marks[path]
        if size and first is not None:
            plain = plain or not doubt
            around.update(d for d in doubt if d[0] < first)
        if size and not doubt and "a" not in path:
            entry = beside.setdefault(path, [0, 0, 0])
            entry[0] += size
            entry[1] += len(PUNCTUATION.findall(text))
            entry[2] += 1
    if plain:  # an article stands outside all of them
        return [x for x, doubt in zip(found, doubts) if not doubt]
    # the same fused ratio that chooses paths, before smoothing
    article = any(size / n * (1 + marks / n) >= SENTENCE for size, marks, n in beside.values())
    spared = around | {d for d, size in held.items() if d[2] == 1 and 2 * size > total and not article}
    return [x for x, doubt in zip(found, doubts) if spared.issuperset(doubt)]


def _cut(stack: list, size: int, open_tags: Counter) -> None:
    """Close the innermost elements until ``size`` are open."""
    for tag, *_ in stack[size:]:
        open_tags[tag] -= 1
    del stack[size:]


def _end_open(stack: list, tag: str, open_tags: Counter) -> None:
    """End the open elements that the start of the block ``tag`` implies are over."""
    if tag in CLOSES:
        ends, shields = CLOSES[tag]
        if any(open_tags[t] for t in ends):
            for i in reversed(range(len(stack))):
                if stack[i][0] in shields:
                    break
                if stack[i][0] in ends:
                    _cut(stack, i, open_tags)
    if open_tags["p"]:
        for i in reversed(range(len(stack))):
            if stack[i][0] == "p":
                _cut(stack, i, open_tags)
                break


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by two line ends; empty if there is none."""
    if not page:
        return ""
    found = nodes(page)
    stats: dict[tuple[str, ...], list[int]] = {}
    plain: dict[tuple[str, ...], tuple[str, ...]] = {}
    for _, path, _, text in found:
        if path not in plain:
            plain[path] = tuple(t for t in path if t not in INLINE or t == "a")
        size = len(text.strip())
        if size:
            path = plain[path]
            entry = stats.setdefault(path, [0, 0, 0])
            entry[0] += size
            entry[1] += len(PUNCTUATION.findall(text))
            entry[2] += 1
    if not stats:
        return ""
    lengths = [s[0] / s[2] for s in stats.values()]
    marks = [s[1] / s[2] for s in stats.values()]
    fused = [a * (1 + b) for a, b in zip(_smooth(lengths), _smooth(marks))]
    least = THRESHOLD * max(fused)
    chosen = {path for path, score in zip(stats, fused) if score >= least and path[-1:] != ("a",)}
    picked = [(path, elements) for _, path, elements, text in found
              if plain[path] in chosen and text.strip()]
    sizes = [len(text.strip()) for _, path, _, text in found if plain[path] in chosen and text.strip()]
    marked = [any(t in MARKED for t in path) for path, _ in picked]
    if 2 * sum(n for n, m in zip(sizes, marked) if m) >= sum(sizes):  # the page marks its article
        picked = [x for x, m in zip(picked, marked) if m]
        home = _home(picked, MARKED)
        homes = {home} if home else {e[:1 + min(map(path.index, {*MARKED} & {*path}))]
                                     for path, e in picked}
        whole = True
    else:
        homes = {_home(picked)}
        depth = len(next(iter(homes)))
        whole = depth and picked[0][0][depth - 1] not in ("html", "body")
    depths = {len(h) for h in homes}
    inside = [x for x in found if any(x[2][:d] in homes for d in depths)]
    ends = [x[0] for x in inside if plain[x[1]] in chosen and x[3].strip()]
    own: dict[int, list] = {}
    for block, path, _, text in inside:
        own.setdefault(block, []).append((path, text))
    out = []
    for block, parts in own.items():
        line = " ".join("".join(text for _, text in parts).split())
        if not line:
            continue
        linked = sum(len(text.strip()) for path, text in parts if "a" in path)
        if not whole and 2 * linked > len(line) and not ends[0] <= block <= ends[-1]:
            continue  # the article is not apart from the page: links before and behind it
        out.append(line)
    return "\n\n".join(out)


def _home(picked: list, tags: tuple[str, ...] = ()) -> tuple[int, ...]:
    """Lowest block element (of these tags) around all nodes; empty if there is none."""
    path, home = picked[0]
    for _, elements in picked:
        depth = next((i for i, (a, b) in enumerate(zip(home, elements)) if a != b),
                     min(len(home), len(elements)))
        home = home[:depth]
    while home and (path[len(home) - 1] not in tags if tags else path[len(home) - 1] in INLINE | {"p"}):
        home = home[:-1]
    return home


def _smooth(values: list[float]) -> list[float]:
    """Weighted mean with the neighbours in page order."""
    out = []
    for i, v in enumerate(values):
        around = values[max(0, i - 1):i] + values[i + 1:i + 2]
        out.append((2 * v + sum(around)) / (2 + len(around)))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    A null, empty or textless page gives an empty text. Pages are read whole, one by one; rows that
    share a ``page_id`` are extracted each on its own; an empty table gives no rows; other columns
    are not read.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
