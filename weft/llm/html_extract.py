"""Main-text extraction by the maximum-scoring contiguous region of a page.

A page is a sequence of words and tags. Words score positive, tags negative; one linear scan (the maximum subsequence
sum) finds the best contiguous region. Two sets of weights decide, both learned from pages that label themselves:

* of elements: a linear score in an element's name, the words of its class, id and role, and what it holds. Words inside
  an element that scores zero or less weigh nothing and leave the text, so that an aside inside an article goes and a
  wrapper marked ``has-sidebar`` that holds the article stays. Weights start at a prior, for marks that no labelled page
  shows, and a perceptron moves them;
* of tags: a structured perceptron moves them until the scan finds every labelled page's content.

Blocks are split at block elements, and character references are decoded.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that start a block, whose content is no markup, and that have no end tag.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split())
RAW = frozenset("script style textarea title noscript noembed noframes template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: The prior of the element weights: of names, of marks (words of class, id and role), and of what an element holds.
BIAS = 1.0
PRIOR = {"name:" + x: -3.0 for x in "nav footer aside form menu dialog button svg canvas object".split()}
PRIOR |= {"name:header": -1.5} | {"name:" + x: 6.0 for x in "html body main article".split()}
PRIOR |= {"mark:" + x: -3.0 for x in (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "menu nav navbar navigation newsletter notice popup promo promoted recommended related reply replies sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget").split()}
PRIOR |= {"mark:share": -1.5, "mark:header": -1.5}
#: holds: the page's largest article (or main element, or the first tag of either that is never closed), for which alone
#: the weight of article and main counts, or around it; heading: a first-level heading; prose: the share of its words that stand outside
#: links in runs of PROSE_WORDS or more; whole: nine tenths of the page's words, with no article or heading elsewhere,
#: in an element whose name says nothing; form:most: a form with over half of the page's words.
PRIOR |= {"holds": 4.0, "heading": 2.5, "prose": 1.5, "whole": 4.0, "form:most": 4.0}
PROSE_WORDS = 8

#: End tags that may be left out, and what implies them: by opening tag, the elements it ends and the elements beyond
#: which it ends none.
OMITTED = frozenset("p li dt dd tr td th thead tbody tfoot".split())
CLOSES_P = BLOCK - frozenset("body caption head html legend tbody td tfoot th thead title tr".split())
P_SCOPE = frozenset("table td th caption".split())
_CELLS, _TABLE = frozenset("td th".split()), frozenset(["table"])
IMPLIED = {"li": (frozenset(["li"]), frozenset("ul ol menu".split())), "tr": (_CELLS | {"tr"}, _TABLE)}
IMPLIED |= {k: (frozenset("dt dd".split()), frozenset(["dl"])) for k in ("dt", "dd")}
IMPLIED |= {k: (_CELLS, _TABLE | {"tr"}) for k in _CELLS} | {k: (_CELLS | frozenset("tr thead tbody tfoot".split()), _TABLE) for k in ("thead", "tbody", "tfoot")}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag: a ``>`` inside a quoted attribute value does not end it. A value that is never closed is no quotation.
_REST = re.compile(r"""(?:[^>=]++|=\s*+"[^"]{0,100000}+"|=\s*+'[^']{0,100000}+'|=)*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z]+")
_CLOSERS = {name: re.compile(f"</{name}(?![A-Za-z0-9-])", re.IGNORECASE | re.ASCII) for name in RAW} | {c: re.compile(re.escape(c)) for c in ("-->", ">")}


@dataclass
class Tag:
    name: str
    closing: bool
    marks: frozenset[str] = frozenset()  # words of class, id and role
    lone: bool = False

    @property
    def key(self) -> str:
        return ("/" if self.closing else "") + self.name


def tokens(page: str) -> Iterator[Tag | str]:
    """Tags and texts (still with references) of a page in order; comments, doctypes and raw elements are passed over.

    A ``<`` that opens no tag is text; an unclosed comment or raw element reaches to the end.
    """
    at, n = 0, len(page)
    text: list[str] = []
    missing: set[str] = set()  # closers that do not occur any more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = _CLOSERS[what].search(page, start)
        if found is None:
            missing.add(what)
            return -1
        return found.start()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        after = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        if find(">", m.end()) < 0:
            break  # a tag cut off at the end of the page
        rest = _REST.match(page, m.end())
        end = rest.end() - 1 if rest else find(">", m.end())
        body = page[m.end():end]
        name = m.group().lower()
        marks: frozenset[str] = frozenset()
        if not closing and "=" in body:
            marks = frozenset(w.lower() for a in _ATTRIBUTE.finditer(body) for w in _TOKEN.findall(a.group(2) or a.group(3) or a.group(4) or ""))
        if text:
            yield "".join(text)
            text = []
        at = end + 1
        if name in RAW and not closing and not body.endswith("/"):
            close = find(name, at)
            if close < 0:
                at = n
            else:
                gt = find(">", close)
                at = n if gt < 0 else gt + 1
            continue
        yield Tag(name, closing, marks, name in VOID or body.endswith("/"))
    if text:
        yield "".join(text)


@dataclass
class RegionModel:
    """Weights of a word (positive), of tags by name (negative; unknown tags weigh ``other``) and of element features."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.3
    elements: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def weight(self, tag: Tag) -> float:
        return self.tags.get(tag.key, self.other)

    def element_score(self, features: dict[str, float]) -> float:
        return BIAS + sum(self.elements.get(k, 0.0) * v for k, v in features.items())


def best_region(weights: Iterable[float]) -> tuple[int, int]:
    """First and last-plus-one index of the maximum-scoring contiguous run; (0, 0) if nothing is positive.

    Ties take the earliest run, and of those the shortest.
    """
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, w in enumerate(weights):
        if here <= 0:
            here, start = 0.0, i
        here += w
        if here > best + 1e-12:
            best, found = here, (start, i + 1)
    return found


def elements(items: list[Tag | str]) -> list[tuple[int, int]]:
    """(first, last plus one) of the elements that a name or mark can weigh, their tags included, inner ones first.

    Omitted end tags of paragraphs, list items and table parts are implied as in HTML. Other elements without an end tag
    of their own are none: where they end is anyone's guess.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    count: Counter = Counter()

    def pop(end: int, own: bool) -> None:
        name, start = stack.pop()
        count[name] -= 1
        if own or name in OMITTED:
            out.append((start, end))

    def close(names: frozenset[str], scope: frozenset[str], at: int) -> None:
        if any(count[x] for x in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in names:
                    while len(stack) > i:
                        pop(at, False)

    for i, x in enumerate(items):
        if not isinstance(x, Tag) or x.lone:
            continue
        if x.closing:
            while count[x.name]:
                own = stack[-1][0] == x.name
                pop(i + 1 if own else i, own)
                if own:
                    break
            continue
        if x.name in CLOSES_P:
            close(frozenset(["p"]), P_SCOPE, i)
        if x.name in IMPLIED:
            close(*IMPLIED[x.name], i)
        if x.marks or x.name in BLOCK or "name:" + x.name in PRIOR:
            stack.append((x.name, i))
            count[x.name] += 1
    while stack:
        pop(len(items), False)
    return [(a, b) for a, b in out if items[a].marks or "name:" + items[a].name in PRIOR]


def element_features(items: list[Tag | str], spans: list[tuple[int, int]]) -> list[dict[str, float]]:
    """Features of each element: its name and marks, and what it holds."""
    words, prose, heads, links = [0], [0], [0], 0
    for x in items:
        tag = isinstance(x, Tag)
        if tag and x.name == "a" and not x.lone:
            links = max(0, links + (-1 if x.closing else 1))
        n = 0 if tag else len(x.split())
        words.append(words[-1] + n)
        prose.append(prose[-1] + (n if n >= PROSE_WORDS and not links else 0))
        heads.append(heads[-1] + (tag and not x.closing and x.name == "h1"))
    # The article that the page is about: not a comment or a card that is marked up as one too.
    told = [(items[a].name == "article", min([PRIOR.get("mark:" + w, 0.0) for w in items[a].marks] or [0.0]) >= 0, words[b] - words[a], -a) for a, b in spans if items[a].name in ("article", "main")]
    opened = [i for i, x in enumerate(items) if isinstance(x, Tag) and not x.closing and x.name in ("article", "main")]
    about = -max(told)[3] if told else opened[0] if opened else None
    out = []
    for a, b in spans:
        n, inside = words[b] - words[a], about is not None and a <= about < b
        f = {"name:" + items[a].name: float(inside or items[a].name not in ("article", "main"))} | {"mark:" + w: 1.0 for w in items[a].marks}
        f["prose"] = (prose[b] - prose[a]) / n if n else 0.0
        f["holds"] = float(inside and a != about)
        f["heading"] = float(heads[b] > heads[a])
        elsewhere = about is not None and not inside or heads[-1] > heads[b] - heads[a]
        f["whole"] = float(10 * n >= 9 * words[-1] > 0 and not elsewhere and "name:" + items[a].name not in PRIOR)
        f["form:most"] = float(items[a].name == "form" and 2 * n > words[-1])
        out.append(f)
    return out


def _hidden(items: list[Tag | str], model: RegionModel) -> list[bool]:
    """Whether each item lies inside (or opens or closes) an element that scores zero or less."""
    spans = elements(items)
    edges = [0] * (len(items) + 1)
    for (a, b), f in zip(spans, element_features(items, spans)):
        if model.element_score(f) <= 0:
            edges[a] += 1
            edges[b] -= 1
    out, depth = [], 0
    for e in edges[:-1]:
        depth += e
        out.append(depth > 0)
    return out


def _scores(items: list[Tag | str], hidden: list[bool], model: RegionModel) -> list[float]:
    """Words of elements that score zero or less weigh nothing, so that a long footer cannot outweigh a short article;
    their tags cost next to nothing, so that an aside inside an article does not cut it in two."""
    return [(-0.02 if h else model.weight(x)) if isinstance(x, Tag) else 0.0 if h else model.word * len(x.split()) for x, h in zip(items, hidden)]


def region_text(items: list[Tag | str], hidden: list[bool], first: int, last: int) -> str:
    """The blocks of items[first:last], less hidden elements."""
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        words = html_lib.unescape("".join(current)).split()
        current.clear()
        if words:
            blocks.append(" ".join(words))

    for x, h in zip(items[first:last], hidden[first:last]):
        if isinstance(x, Tag):
            if x.name in BLOCK:
                close()
            elif x.name == "br" and not h:
                current.append(" ")
        elif not h:
            current.append(x)
    close()
    return "\n\n".join(blocks)


def extract(page: str | None, model: RegionModel) -> str:
    """The main text of a page; empty for null, for a page without words and where no region scores positive.

    White space inside a block is one space, blocks are trimmed, empty blocks left out, and the rest joined by two
    line feeds. Very long pages are scanned once, in linear time.
    """
    if not page:
        return ""
    items = list(tokens(page))
    hidden = _hidden(items, model)
    first, last = best_region(_scores(items, hidden, model))
    return region_text(items, hidden, first, last)


def train(pages: list[tuple[list[Tag | str], int, int]], rounds: int = 30) -> RegionModel:
    """Weights from labelled pages (items, first and last-plus-one index of the content).

    Elements: a perceptron asks a score above 0 of elements around the content, and inside it of those that no name or
    mark speaks against in the prior, and of 0 or less of elements outside; it moves the weights of names and marks of
    those that it gets wrong. Tags: a tag starts at -0.1 less 4
    times the share of its occurrences, not counting elements that score 0 or less, that lie outside the content; a
    structured perceptron then moves the weights (never above -0.1) until the scan finds every page's content. A word
    weighs 1.
    """
    model = RegionModel()
    judged = []
    for items, first, last in pages:
        spans = elements(items)
        for (a, b), f in zip(spans, element_features(items, spans)):
            outside, around = b <= first or a >= last, a < first and b >= last
            if outside or around or min(PRIOR.get(k, 0.0) for k in f) >= 0:
                judged.append((f, not outside))
    for _ in range(rounds):
        wrong = [(f, good) for f, good in judged if (model.element_score(f) > 0) != good]
        for f, good in wrong:
            if (model.element_score(f) > 0) != good:
                for k in f:
                    if k.startswith(("name:", "mark:")):
                        model.elements[k] = model.elements.get(k, 0.0) + (0.5 if good else -0.5)
        if not wrong:
            break
    inside, outside = Counter(), Counter()
    hides = [_hidden(items, model) for items, _, _ in pages]
    for (items, first, last), hidden in zip(pages, hides):
        for i, x in enumerate(items):
            if isinstance(x, Tag) and not hidden[i]:
                (inside if first <= i < last else outside)[x.key] += 1
    for key in inside | outside:
        model.tags[key] = -0.1 - 4.0 * outside[key] / (inside[key] + outside[key])
    for _ in range(rounds):
        wrong = 0
        for (items, first, last), hidden in zip(pages, hides):
            got = best_region(_scores(items, hidden, model))
            if got == (first, last):
                continue
            wrong += 1
            for sign, (a, b), (c, d) in ((1, (first, last), got), (-1, got, (first, last))):
                for i in [*range(a, min(b, c)), *range(max(a, d), b)] if c < d else range(a, b):
                    x = items[i]
                    if isinstance(x, Tag) and not hidden[i]:
                        step = 4.0 if sign < 0 else 8.0
                        model.tags[x.key] = min(-0.1, model.weight(x) + sign * step)
        if not wrong:
            break
    return model


def label_by_markup(page: str | None) -> tuple[list[Tag | str], int, int] | None:
    """A labelled page from its own markup: the words between its only ``article`` or ``main`` element's tags."""
    items = list(tokens(page or ""))
    for name in ("article", "main"):
        opens = [i for i, x in enumerate(items) if isinstance(x, Tag) and x.name == name and not x.closing]
        closes = [i for i, x in enumerate(items) if isinstance(x, Tag) and x.name == name and x.closing]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            inside = [i for i in range(opens[0], closes[0]) if isinstance(items[i], str) and items[i].split()]
            if inside:
                return items, inside[0], inside[-1] + 1
    return None


#: The bounded training sample of ``fit``: so many pages with the smallest hashes, none longer than so many characters.
LABELLED_PAGES, LABELLED_CHARS = 200, 60_000


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> RegionModel:
    """Weights from a bounded sample of pages that label themselves by markup; priors where no page does."""
    # A hash threshold leaves a few times the sample before anything is sorted or sent.
    marked = pages.where((F.length(html_col) <= LABELLED_CHARS) & F.col(html_col).rlike("(?i)<(article|main)[\\s>]"))
    share = min(1.0, 8 * LABELLED_PAGES / max(1, marked.count()))
    h = F.xxhash64(id_col)
    sample = (marked.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
              .select(h.alias("h"), F.col(html_col).alias("p")).orderBy("h", "p").limit(LABELLED_PAGES))
    return train([x for r in sample.collect() if (x := label_by_markup(r["p"]))])


def extract_pages(pages: DataFrame, model: RegionModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col``, ``url_col``, text (see ``extract``), n_chars (its code points).

    Null html gives an empty text; repeated rows are extracted each; extra columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    schema = src.select(id_col, url_col).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [extract(p.as_py(), m) for p in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=schema.names)

    return src.mapInArrow(run, schema)
