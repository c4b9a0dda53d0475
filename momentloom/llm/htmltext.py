"""Main text of web pages by tag-path ratios.

A page is a run of text nodes, each under a path of tags from the root (with classes and ids). Nodes of
one path are alike, so the page is judged by path: characters per node, and punctuation per node with
the spread of both. Both ratios are smoothed over the paths that stand next to each other in page
order, multiplied, and paths above a share of the page's mean are content. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are out by their tags and
class names, whatever their ratios, unless the element so named wraps an article or half of the page. The innermost element that holds all headings, paragraphs and
sentences of the content then gives back its headings and short paragraphs. An article or main
element with content in it is kept whole.

Cases: a null or empty page gives an empty text. Markup that is cut off or not closed is read as
far as it goes. A page without markup is one block. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.shared import ship

THRESHOLD = 0.3
# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LOOSE_TAGS = HEADINGS | frozenset("p pre blockquote figcaption dd dt".split())
TEXT_TAGS = LOOSE_TAGS | frozenset("li td th".split())
OUT_TAGS = frozenset("nav aside footer form head menu dialog search".split()) | RAW
P_ENDS = BLOCKS - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
                "th": {"tr", "table"}, "option": {"select"}}
#: Class and id words of what is not the article.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menus header masthead footer sidebar sidebars aside breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist disqus "
    "reply replies respond discussion share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager skip copyright legal tags tagcloud".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Parts that make a compound name tell the state of an element, not its kind.
STATE_FIRST = frozenset("no not non has with without is".split())
STATE_LAST = frozenset("free fixed sticky enabled disabled visible open closed less".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_END = re.compile(r"[.!?…。！？]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[,.;:!?…、。，！？]")
_SPACE = re.compile(r"\s+")


def _steps(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)`` with kind ``text``, ``open`` or ``close``. What stands in raw
    elements is skipped."""
    at, n = 0, len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            yield "text", page[at:], ""
            return
        if cut > at:
            yield "text", page[at:cut], ""
        m = _TOKEN.match(page, cut)
        if not m:  # a lone "<", or a cut-off "</" at the very end
            if cut + 1 < n and page[cut + 1] in "/" or cut + 1 == n:
                at = page.find(">", cut) + 1 or n
            else:
                yield "text", "<", ""
                at = cut + 1
            continue
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", name, m[3] or ""
            if name in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
                end = re.compile(f"</{name}[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
                yield "close", name, ""
                at = end.end() if end else n


def _named_out(attribute: str, value: str, article: bool) -> str:
    """The word of a class or id that is not the article's, or nothing.

    A class counts by any of its parts, unless it tells a state (``no-sidebar``, ``ad-free``); an id, which
    may be an anchor made of a heading, by its whole or its last part. A header inside an article is its own.
    """
    for name in value.split():
        parts = [part.lower() for part in _NAME.findall(name)]
        if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            continue
        for part in parts if attribute == "class" else parts[-1:]:
            if part in OUT_WORDS and not (part == "header" and article):
                return part
    return ""


def _step(name: str, attributes: str, article: bool) -> tuple[str, bool, str]:
    """The path step of an element, whether its tag, role or state puts it outside the article for good,
    and the word of its classes and id that speaks for that."""
    label, out, word = name, name in OUT_TAGS and name != "form", "form" if name == "form" else ""
    if attributes:
        words = []
        for key, value in _ATTR.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                words += value.split()
                word = word or _named_out(key, value, article)
            out = (out or key == "hidden" or key == "role" and value.lower() in OUT_ROLES
                   or key == "aria-hidden" and value.lower() == "true")
        if words:
            label = f"{name}.{'.'.join(words)}"
    return label, out, "" if name in ("body", "html", "article", "main") else word


def blocks(page: str) -> list[tuple[tuple[str, ...], tuple[int, ...], str, bool]]:
    """``(path, elements, text, out)`` of every block with text, in page order. ``elements`` numbers the
    elements of the path, so that two of the same name differ.

    An element is out by a class or id only if it holds no article or main and, comments aside, less than half of
    the page's prose (text of blocks with a sentence end): else the word names the layout of a wrapper.
    """
    found, wrappers = _read(page, frozenset())
    return _read(page, wrappers)[0] if wrappers else found


def _read(page: str, wrappers: frozenset[int]) -> tuple[list[tuple[tuple[str, ...], tuple[int, ...], str, bool]], frozenset[int]]:
    """The blocks where ``wrappers`` are in despite their names, and the elements that ought to be."""
    # name, label, out, inside an article, number, out for good, nearest element with an outside name
    stack: list[tuple[str, str, bool, bool, int, bool, int]] = []
    found: list[tuple[tuple[str, ...], tuple[int, ...], str, bool]] = []
    parts: list[str] = []
    place: list[tuple[tuple[str, ...], tuple[int, ...], bool, bool, int]] = []  # where the open block is, out, out for good, name
    named: dict[int, tuple[int, str]] = {}  # the next such element above, and the word
    prose: dict[int, int] = defaultdict(int)
    holding: set[int] = set()

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text and place:
            found.append((*place[0][:2], text, place[0][2]))
            if not place[0][3] and _END.search(text):
                prose[place[0][4]] += len(text)
        parts.clear()
        place.clear()

    def close(upto: int) -> None:
        for name, *_ in stack[upto:]:
            if name in BLOCKS:
                flush()
                break
        del stack[upto:]

    number = 0
    for kind, name, attributes in _steps(page):
        if kind == "text":
            out = bool(stack) and stack[-1][2]
            if place and place[0][2] and not out and name.strip():
                flush()
            if not place and name.strip():
                held = [x for x in stack if x[0] in BLOCKS or x[0] in OUT_TAGS]
                place.append((tuple(x[1] for x in held), tuple(x[4] for x in held), out,
                              bool(stack) and stack[-1][5], stack[-1][6] if stack else 0))
            # An advert inside a paragraph is no part of it.
            parts.append(" " if place and out and not place[0][2] else name)
        elif kind == "open":
            if name in BLOCKS:
                flush()
            if name in P_ENDS:
                # A new block ends an open paragraph.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name in SELF_NESTING:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in SELF_NESTING[name]:
                        break
            if name not in VOID:
                number += 1
                above = stack[-1] if stack else ("", "", False, False, 0, False, 0)
                label, gone, word = _step(name, attributes, above[3])
                article = above[3] or name in ("article", "main")
                gone = above[5] or gone or name == "header" and not article
                if name in ("article", "main"):
                    holding.add(above[6])
                if word:
                    named[number] = (above[6], word)
                out = above[2] or gone or bool(word) and number not in wrappers
                stack.append((name, label, out, article, number, gone, number if word else above[6]))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            else:
                if name in BLOCKS:
                    flush()
    flush()
    total = sum(prose.values())
    inside = set()
    for number, (above, word) in reversed(named.items()):  # what an element holds, those above it hold too
        if number in holding:
            holding.add(above)
        if number in holding or word not in COMMENT_WORDS and total and 2 * prose[number] >= total:
            inside.add(number)
        prose[above] += prose[number]
    return found, frozenset(inside)


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)):
            if 0 <= i + d < len(values):
                total, weight = total + w * values[i + d], weight + w
        out.append(total / weight)
    return out


def _spread(values: list[int]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def content_paths(nodes: list[tuple[tuple[str, ...], str]]) -> set[tuple[str, ...]]:
    """Paths whose smoothed and fused ratios reach the threshold."""
    sizes: dict[tuple[str, ...], list[int]] = defaultdict(list)
    marks: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for path, text in nodes:
        sizes[path].append(len(text))
        marks[path].append(len(_PUNCT.findall(text)))
    paths = list(sizes)
    text_ratio = _smooth([sum(sizes[p]) / len(sizes[p]) + _spread(sizes[p]) for p in paths])
    mark_ratio = _smooth([(1 + sum(marks[p])) / len(marks[p]) + _spread(marks[p]) for p in paths])
    fused = [math.log1p(t * m) for t, m in zip(text_ratio, mark_ratio, strict=True)]
    weight = [sum(sizes[p]) for p in paths]
    mean = sum(f * w for f, w in zip(fused, weight, strict=True)) / sum(weight)
    return {p for p, f in zip(paths, fused, strict=True) if f >= THRESHOLD * mean}


def _tag(path: tuple[str, ...]) -> str:
    return path[-1].split(".")[0] if path else ""


def _article(path: tuple[str, ...]) -> int:
    """The place of the outermost article or main in ``path``; its length if there is none."""
    return next((k for k, step in enumerate(path) if step.split(".")[0] in ("article", "main")), len(path))


def main_text(page: str | None) -> str:
    """The blocks of the article, one per line."""
    nodes = [node[:3] for node in blocks(page or "") if not node[3]]
    if not nodes:
        return ""
    inside = [node for node in nodes if _article(node[0]) < len(node[0])]
    nodes = inside or nodes
    chosen = content_paths([(path, text) for path, _, text in nodes])
    if inside:
        kept = {elements[_article(path)] for path, elements, _ in nodes if path in chosen}
        return "\n".join(text for path, elements, text in nodes if elements[_article(path)] in kept)
    # The container: the innermost element that holds all headings, paragraphs and sentences of the content.
    # A bare label ("Imprint") of a path that is content by its neighbours only does not widen it.
    core = [node for node in nodes if node[0] in chosen]
    core = [node for node in core if _tag(node[0]) in LOOSE_TAGS or _PUNCT.search(node[2])] or core
    container = tuple(commonprefix([elements[: len(path) - (_tag(path) in TEXT_TAGS)] for path, elements, _ in core]))
    return "\n".join(
        text for path, elements, text in nodes
        if elements[: len(container)] == container and (path in chosen or _tag(path) in LOOSE_TAGS))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``."""
    rows = ship(pages).select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
