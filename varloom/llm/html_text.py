"""HTML extraction: the maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags.  A word scores by the elements it is in
(tag names and the words of class, id and role), a tag costs a little.  The
weights are log-odds learned from labelled pages (:func:`labelled_pages`, built
by rule), the cost of a tag is the one that does best on them.  One linear scan
finds the best run; inside it, words whose own elements speak against them (an
advert within the article) are left out.

Text: character references are decoded, scripts, styles, comments and the head
are skipped, white space inside a block becomes one space, blocks are joined by
two line feeds in page order; nothing is capped.

Defined results: null or empty html gives an empty text; repeated rows give
repeated results; an unfinished tag at the end is markup; a script, style or textarea
without an end runs to the end of the page, of other skipped elements without one the
tag alone is skipped; a long page is read whole, in one pass; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm.common import load

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Fixed values of HTML: elements without an end, elements whose content is not text, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title head select canvas".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())


#: Elements whose content runs to the end of the page if they have no end.
TO_THE_END = frozenset("script style textarea".split())


def tokens(page: str, step, start):
    """Yields (kind, value, state, block number): kind 'w' for text pieces, 't' for tags.

    The state folds the features of the open elements: step(state of those outside,
    features of the element), beginning with start.  Each element is looked at when it
    opens and when it closes only, however many are open.
    """
    stack: list[tuple[str, object]] = []
    blocks: list[int] = []  # places of block elements in the stack
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # elements without an end further on
    block = at = 0

    def close(depth: int) -> None:
        opened.subtract(name for name, _ in stack[depth:])
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            yield "w", text, stack[-1][1] if stack else start, block
            continue
        name = m["tag"] or m["tag2"]
        if not name:
            continue
        name = name.lower()
        closing = bool(m["end"] or m["end2"])
        if name in BLOCK:
            block += 1
        if name in RAW and not closing:
            if (m["attrs"] or m["attrs2"] or "").endswith("/"):
                continue
            end = None
            if name not in endless:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|</{re.escape(name)}\Z", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in TO_THE_END:
                at = len(page)
            else:
                endless.add(name)
            continue
        if closing:
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name not in VOID:
            if name in BLOCK and blocks:
                # A block ends an open paragraph and what is open inside it; list items end their like.
                inner = stack[blocks[-1]][0]
                if inner == "p" or name == inner == "li":
                    close(blocks[-1])
            state = stack[-1][1] if stack else start
            if name not in ("html", "body"):
                words = _PART.findall(" ".join(_CAMEL.sub(" ", a or b or c) for a, b, c in _ATTR.findall(m["attrs"] or m["attrs2"] or "")).lower())
                state = step(state, (name, *words))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, state))
            opened[name] += 1
        state = stack[-1][1] if stack else start
        yield "t", name, state, block
        if name == "br":
            yield "w", " ", state, block


def labelled_pages():
    """(html, content) pairs by rule: content marks each piece of text as wanted (upper-case W) or not (X)."""
    wanted = ["article", "main", "section class='post body content entry story text'", "div class='article content main body post entry story text'", "div id='content main article'", "article class='post'"]
    inner = ["p", "h1", "h2", "h3", "blockquote", "li", "pre", "td", "b", "i", "em", "strong", "a", "span", "figcaption", "code", "div", "section", "ul", "ol", "table"]
    unwanted = [
        "nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "label", "fieldset",
        *(
            f"div class='{c}'"
            for c in """ad|ads|advert|advertisement|sponsored|sponsor|promo|promotion|banner|cookie|consent|notice|alert|warning|gdpr|popup|modal|overlay|menu|nav|navbar|navigation|
            breadcrumb|breadcrumbs|sidebar|side|widget|related|recommended|more|comments|comment|reply|respond|disqus|discussion|share|social|follow|newsletter|subscribe|signup|login|
            footer|foot|header|masthead|copyright|legal|disclaimer|pagination|pager|tags|toolbar|search|form|rating|trending|teaser|outbrain|taboola""".replace("\n", "").replace(" ", "").split("|")
        ),
    ]
    for i, (w, u, order) in enumerate(product(wanted, [*unwanted, *(u.replace("div", "section") for u in unwanted if "=" in u)], (0, 1))):
        t = inner[i // 2 % len(inner)]
        # Both sides hold the same inner elements, so that only what encloses them tells.
        main = f"<{w}><{t}>{'W ' * 8}</{t}><p>{'W ' * 8}<a href='x'>W </a></p><ul><li>{'W ' * 8}</ul></{w.split(' ')[0]}>"
        rest = f"<{u}><{t}>{'X ' * 8}</{t}><p>{'X ' * 8}<a href='x'>X </a></p><ul><li>{'X ' * 8}</ul></{u.split(' ')[0]}>"
        yield f"<html><body><div class='page wrapper container'>{rest if order else ''}{main}{'' if order else rest}</div></body></html>"


def learn(smooth: float = 2.0) -> dict[str, float]:
    """Feature -> log-odds that a word below it is wanted, relative to all words; '' -> a tag's cost."""
    good, bad = Counter(), Counter()
    pages = list(labelled_pages())
    for page in pages:
        for kind, value, features, _ in tokens(page, lambda outside, features: outside | set(features), frozenset([""])):
            if kind == "w" and value.strip():
                (good if "W" in value else bad).update(features)
    ratio = (good[""] + smooth) / (bad[""] + smooth)
    weights = {f: math.log((good[f] + smooth) / (bad[f] + smooth) / ratio) for f in good | bad if f}
    # What is as common on both sides (p, a, li, wrappers) says nothing.
    weights = {f: v for f, v in weights.items() if abs(v) >= 1.0}
    best = (-1.0, 0.0)
    for cost in (0.05, 0.1, 0.2, 0.4):
        got = [extract(p, weights | {"": cost}) for p in pages[::7]]
        score = sum("X" not in g and g.count("W") == 25 for g in got)
        best = max(best, (score, -cost))
    return weights | {"": -best[1]}


def _fold(weights: dict[str, float]):
    """The step by which open elements make the state of a word: (what it is worth if settled, whether it is wanted).

    An element is for or against by its class words, each worth one at most, or
    else by its name.  A word below an element against it costs, but costs nothing inside a wanted
    element: it is left out there without splitting what is around it.
    """

    def step(state: tuple[float | None, bool], features: tuple[str, ...]) -> tuple[float | None, bool]:
        settled, wanted = state
        if settled is not None:
            return state
        worth = sum(max(-1.0, min(1.0, weights.get(f, 0.0))) for f in features[1:]) or weights.get(features[0], 0.0)
        if worth < 0 and not (wanted and features[0] == "header"):
            return (0.0 if wanted else -1.0), wanted
        return None, wanted or worth > 0

    return step


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    if not page:
        return ""
    cost = weights[""]
    pieces = []  # (score, text, block)
    for kind, value, (settled, wanted), block in tokens(page, _fold(weights), (None, False)):
        if kind == "t":
            pieces.append((-cost, "", block, False))
            continue
        n = len(value.split())
        worth = settled if settled is not None else (1.0 if wanted else 0.3)
        pieces.append((worth * n, value, block, worth > 0))
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, (score, *_) in enumerate(pieces):
        if run <= 0:
            run, begin = 0.0, i
        run += score
        if run > best:
            best, span = run, (begin, i + 1)
    blocks: dict[int, list[str]] = {}
    for _, text, block, keep in pieces[slice(*span)]:
        if keep:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(b for b in joined if b)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars for every page; a kept column named like one of the last two gives way to it."""
    weights = learn()
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                texts = [extract(h, weights) for h in piece.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op7_html_text(spark, sf_dir):
    return main_text(load(spark, sf_dir, "pages"))
