"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of elements from the root to its innermost block element; an element counts with
its class, id and role. For each path the characters outside links and, four times, the punctuation of all its blocks are added up; a
path's ratio is that a block. The ratios are smoothed along the path (every enclosing element below the body has the ratio of all that it
holds; half is the own ratio and half the best of the enclosing ones) and fused with what the page says of its parts, by factors: paths
outside a marked article or main part, or else outside the element whose own blocks hold most, weigh OUTSIDE, those inside weigh MARKED,
and names of menus, footers, sidebars, notices, adverts, forms or readers' comments weigh as FACTORS has it, unless such an element is only
a wrapper of the text (see `_settled`). A name that is only one word of a class (`related-work`) weighs little, so that the ratio decides;
only what a page hides is left out whatever its ratio. The logarithms of the fused ratios are smoothed over the neighbouring paths in page
order. A path is content if that is at least LEAST of the page's largest, and its own fused ratio at least FLOOR. The text is that of all
blocks on such paths, in page order.

White space inside a block, and a line break, becomes one space, character references are decoded in each piece of text, blocks are joined
by a line feed. Null, empty and textless pages give an empty text. Rows that repeat, or that have no page_id, are extracted each. A table
without rows gives none. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the logarithm of the largest fused ratio.
LEAST = 0.55
MARKED, OUTSIDE = 4.0, 1 / 16
FLOOR = 2.0
#: Shares of a path's logarithm, and of each neighbour's, after smoothing in page order.
OWN, BESIDE = 0.7, 0.15

# Element names of HTML and words by which pages name their parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are skipped to their end tag; without one, those of text hold the rest of the page and the others nothing.
_RAW_TEXT = frozenset("script style noscript textarea iframe noframes xmp".split())
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in (*_RAW_TEXT, "template", "svg", "math", "object", "canvas", "audio", "video", "select", "title")}
_IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SCOPES = frozenset("article section div main body html td th table ul ol dl li blockquote aside nav header footer form figure button".split())
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_LISTS = frozenset("ul ol dl table menu dir".split())
_NO_CONTENT = frozenset("nav footer aside form button menu dialog search fieldset legend label title".split())
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar"
    " cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " comment comments commentlist discussion responses respond reply replies disqus widget widgets toolbar pagination pager copyright disclaimer skip skiplink hidden paywall".split()
)
_COMMENTS = frozenset("comment comments commentlist discussion responses respond reply replies disqus".split())
#: Parts that may hold most of a short page's text and still are not its main text.
_FIRM = frozenset("cookie cookies consent gdpr footer copyright disclaimer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


# Verdicts of an element on the text inside it, and their factors. All but HIDDEN can be void.
LIVE, WEAK, NAMED, COMMENTS, PART, HIDDEN = range(6)
FACTORS = (1.0, 1 / 8, 1 / 256, 1 / 256, 1 / 4096, 0.0)
#: Words that add nothing to a part's name in a class.
_GENERIC = frozenset("area article articles bar block blocks body box button buttons container content elem element footer form group header inner item items left line link links list main module outer page panel post posts right row section site story text title top unit wrap wrapper".split())
#: Names of parts of articles as well.
_OF_TEXTS_TOO = frozenset("discussion responses notification notifications alert promotion".split())
_ABOUT = frozenset("has no with without is not".split())


class _Element:
    __slots__ = ("name", "key", "verdict", "marked", "main", "mass")

    def __init__(self, name: str, key: str, verdict: int, marked: bool, main: bool):
        self.name, self.key, self.verdict, self.marked, self.main, self.mass = name, key, verdict, marked, main, 0


def _words(name: str) -> set[str]:
    return set(_WORD.findall(_SPLIT_CASE.sub(" ", name).lower()))


def _said(name: str) -> int:
    """The verdict of one class or id."""
    words = _words(name)
    parts = words & _PARTS
    if not parts or words & _ABOUT:
        return LIVE
    if parts <= _OF_TEXTS_TOO or any(not w.isdigit() and len(w) > 1 for w in words - parts - _GENERIC):
        return WEAK
    return COMMENTS if parts & _COMMENTS else PART if parts & _FIRM else NAMED


def _element(name: str, rest: str, inside_article: bool) -> _Element:
    key, marked, main = name, name in ("article", "main"), name == "main"
    verdict = HIDDEN if name == "head" else NAMED if name == "form" else PART if name in _NO_CONTENT or (name == "header" and not inside_article) else LIVE
    if rest.strip(" \t\r\n/"):
        said = {}
        for k, v in _ATTRIBUTE.findall(rest):
            said.setdefault(k.lower(), entities.unescape(v.strip("\"'")))
        names = " ".join(said.get(k, "") for k in ("class", "id"))
        if names.strip():
            key = f"{name}.{'.'.join(sorted(names.split()))}"
            if name not in ("body", "html", "article", "main"):
                verdict = max([verdict, *map(_said, names.split())])
            elif marked and any("comment" in _words(n) for n in names.split()):
                verdict = HIDDEN
        role = said.get("role", "").lower()
        main = main or role == "main" or said.get("itemprop", "") == "articleBody"
        marked = marked or main or role == "article"
        if role in _ROLES:
            verdict = max(verdict, NAMED if role == "form" else PART)
        if "hidden" in said or said.get("aria-hidden", "") == "true" or "display:none" in said.get("style", "").replace(" ", "").lower():
            verdict = HIDDEN
    return _Element(name, key, verdict, marked, main)


def _settled(found: list[tuple[tuple[_Element, ...], str, int]]) -> list[float]:
    """The factor of each block (elements, text, characters in links), once the verdicts of mere wrappers are void.

    Void are all verdicts around a main part, those by class words (and of forms) of an element that holds most of the page's text, and
    those around the article that holds more than all that is left otherwise. Words of readers' comments count less only where nothing
    is left; an element that is hidden stays so.
    """
    if not any(e.verdict for own, _, _ in found for e in own):
        return [1.0] * len(found)
    masses = [_mass(text, linked) for _, text, linked in found]
    total = 0
    for (own, _, _), mass in zip(found, masses, strict=True):
        if any(e.verdict == HIDDEN for e in own):
            continue
        total += mass
        for e in own:
            e.mass += mass
        inner = max((i for i, e in enumerate(own) if e.main), default=0)
        for e in own[:inner]:
            e.verdict = LIVE

    def void(verdict: int) -> None:
        for own, _, _ in found:
            for e in own:
                if e.verdict == verdict and 2 * e.mass > total:
                    e.verdict = LIVE

    void(WEAK)
    void(NAMED)
    left = sum(mass for (own, _, _), mass in zip(found, masses, strict=True) if not any(e.verdict > WEAK for e in own))
    articles: dict[int, list] = {}
    for (own, _, _), mass in zip(found, masses, strict=True):
        i = next((i for i, e in enumerate(own) if e.marked), None)
        if i is not None and not any(e.verdict > WEAK for e in own[i:]) and {e.verdict for e in own[:i]} - {LIVE, WEAK} == {NAMED}:
            articles.setdefault(id(own[i]), [0, own[:i]])[0] += mass
    mass, around = max(articles.values(), key=lambda a: a[0], default=(0, ()))
    if mass > left:
        for e in around:
            e.verdict = LIVE
        left += mass
    if not left:
        void(COMMENTS)
    return [math.prod(FACTORS[e.verdict] for e in own) for own, _, _ in found]


def _mass(text: str, linked: int) -> int:
    """Plain characters and, four times, punctuation."""
    return len(text) - linked + 4 * len(_PUNCTUATION.findall(text))


def blocks(page: str | None) -> list[tuple[tuple[str, ...], float, bool, str, int]]:
    """(path, factor of its elements' verdicts, through an article or main part, text, characters in links) of each block."""
    out: list[tuple[tuple[_Element, ...], str, int]] = []
    stack: list[_Element] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((tuple(stack), text, min(linked, len(text))))
        linked = 0

    def close(until: int) -> None:
        nonlocal links
        for e in stack[until:]:
            links -= e.name == "a"
        del stack[until:]

    def left_head() -> None:
        for i, e in enumerate(stack):
            if e.name in ("head", "title"):
                flush()
                close(i)
                break

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1].name == "head" and text.strip():
            left_head()
        text = entities.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    page = page or ""
    unended: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if not m["end"] and name not in _IN_HEAD:
            left_head()
        if not m["end"] and name in _RAW:
            if name in ("select", "textarea", "object", "title"):
                flush()
            if name in ("svg", "math") and m["rest"].endswith("/"):
                continue
            end = None if name in unended else _RAW[name].search(page, at)
            if end:
                at = end.end()
                continue
            unended.add(name)
            if name in _RAW_TEXT:
                at = len(page)
            if name != "title":
                continue
        if m["end"]:
            if name in _INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        links -= name == "a"
                        del stack[i]
                        break
                    if stack[i].name not in _INLINE:
                        break
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name in _VOID:
            if name == "br":
                parts.append(" ")
            elif name not in _INLINE:
                flush()
            continue
        if name not in _INLINE:
            flush()
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        close(i)
                        break
                    if stack[i].name in _SCOPES:
                        break
            like = _LIKE.get(name)
            if like:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in _LISTS:
                        break
                    if stack[i].name in like:
                        close(i)
        if not m["rest"].endswith("/") or name in _INLINE or name in _SCOPES:
            stack.append(_element(name, m["rest"], any(e.marked for e in stack)))
            links += name == "a"
    if at < len(page):
        add(page[at:])
    flush()
    paths = [tuple(e.key for e in own if e.name not in _INLINE) for own, _, _ in out]
    return [(path, factor, any(e.marked for e in own), text, n) for path, factor, (own, text, n) in zip(paths, _settled(out), out, strict=True)]


def main_text(page: str | None) -> str:
    """The text of the blocks on content paths, joined by line feeds."""
    found = [x for x in blocks(page) if x[1]]
    if not found:
        return ""
    sums: dict[tuple[str, ...], list[float]] = {}
    weight: dict[tuple[str, ...], float] = {}
    factors: dict[tuple[str, ...], float] = {}
    around: dict[tuple[str, ...], list[float]] = {}
    own: dict[tuple[str, ...], float] = {}
    any_marked = any(marked and factor >= FACTORS[WEAK] for _, factor, marked, _, _ in found)
    for path, factor, marked, text, linked in found:
        mass = _mass(text, linked)
        s = sums.setdefault(path, [0.0, 0])
        s[0] += mass
        s[1] += 1
        factors[path] = max(factor, factors.get(path, 0.0))
        weight[path] = MARKED if marked else OUTSIDE if any_marked else 1.0
        # What is said to be no content counts by its factor in what encloses it.
        parent = path[:-1]
        own[parent] = own.get(parent, 0.0) + mass * factor
        for i in range(1, len(path)):
            if path[i - 1] not in ("html", "body"):
                a = around.setdefault(path[:i], [0.0, 0])
                a[0] += mass * factor
                a[1] += factor
    if not any_marked:
        root = max(own, key=lambda p: (own[p], -len(p)))
        for path in weight:
            weight[path] = MARKED if path[: len(root)] == root else OUTSIDE
    fused = {}
    for path, (mass, n) in sums.items():
        pooled = max((a[0] / a[1] for i in range(1, len(path)) if (a := around.get(path[:i]))), default=mass / n)
        fused[path] = factors[path] * weight[path] * (mass / n + pooled) / 2
    # Neighbours in page order: the paths of the runs of blocks before and after.
    runs = [path for path, _ in itertools.groupby(found, key=lambda x: x[0])]
    beside: dict[tuple[str, ...], list[float]] = {}
    for i, path in enumerate(runs):
        logs = [math.log1p(fused[p]) for p in runs[max(0, i - 1) : i + 2]]
        edges = (1 if i else 0) + (1 if i + 1 < len(runs) else 0)
        beside.setdefault(path, []).append(BESIDE * (sum(logs) - math.log1p(fused[path]) + (2 - edges) * math.log1p(fused[path])))
    smoothed = {path: OWN * math.log1p(x) + sum(beside[path]) / len(beside[path]) for path, x in fused.items()}
    least = LEAST * max(smoothed.values())
    return "\n".join(text for path, _, _, text, _ in found if fused[path] >= FLOOR and smoothed[path] >= least)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text: the main text of every page. A pass over the rows without any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
