"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: stretches of text between the edges of block
elements. A block's features are the tags and the class and id words of its
ancestors, its length, link share and punctuation. The chain scores each block
and each pair of neighbours as article or not, and Viterbi decoding picks the
best labelling of the whole page.

The field is trained on a bounded sample of the table (``SAMPLE_PAGES``), as the
pages stand and with their blocks set in other layouts (plain boxes, tables,
sidebars, notices, forms, adverts, comments), so that no single tag decides.
A page's labels come from the first of these that it has: an article or main
element; containers whose class or id has a word of ``_ARTICLE``; the box with
the most running text (the last two if they hold at least ``LEAST_TEXT``
characters). The last is a guess, and a page with none of them trains nothing.
If no page of the sample has labels, the field is trained on ``_FIXED`` in
``FIXED_LAYOUTS`` layouts.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BYTES = 150, 60_000
LAYOUTS, FIXED_LAYOUTS = 8, 200
RICH_TEXT, LEAST_TEXT = 60, 140
EPOCHS = 12

#: Elements that start and end a block, those whose content is no text, and those that end an open one of a kind.
BLOCK_TAGS = frozenset(
    "html body div section article main nav header footer aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr button select option menu dialog label center".split()
)
RAW_TAGS = frozenset("script style noscript template textarea title svg iframe object math canvas audio video".split())
#: Of these, those whose content holds no markup: only their own end tag ends them.
_LITERAL_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for tag in "script style noscript textarea title iframe".split()}
#: Start tags that can stand in a head; any other, and text, ends an open one.
_HEAD_TAGS = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset(("ul", "ol", "dl", "table", "select"))
_ENDS_P = BLOCK_TAGS - {"p", "button", "label", "option", "select"}

#: Open elements that are kept apart; deeper ones count as their neighbours, as browsers have it.
DEPTH = 512
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
#: A tag with no tag inside its quotes, as nearly all are; it looks no further than the next "<".
_USUAL = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>""")
_PLAIN = re.compile(r"""[^"'<>]*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|data-y|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class _Next:
    """Where a string occurs next; no part of the page is searched twice."""

    def __init__(self, page: str, wanted: str):
        self.page, self.wanted, self.at = page, wanted, -1

    def after(self, start: int) -> int:
        """The first place at or after ``start``, or the page's length. ``start`` should not go back."""
        if self.at < start:
            found = self.page.find(self.wanted, start)
            self.at = len(self.page) if found < 0 else found
        return self.at


class _Tags:
    """The tags of a page in one pass over it.

    A quote whose partner does not come before the next tag is a plain character,
    and a tag that is not closed ends where the next one begins. One without
    attributes is then taken for text, as in ``a <b``.
    """

    def __init__(self, page: str):
        self.page = page
        self.open, self.close = _Next(page, "<"), _Next(page, ">")
        self.inner = _Next(page, "<")
        self.quotes = {q: _Next(page, q) for q in "\"'"}

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """Start, end, name (None for comments and declarations), whether it closes, and attributes of the next tag."""
        page = self.page
        while (start := self.open.after(at)) < len(page):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, None, False, ""
            if page[start + 1 : start + 2] in ("!", "?"):
                if (end := self.close.after(start)) < len(page):
                    return start, end + 1, None, False, ""
                at = start + 1
                continue
            if (usual := _USUAL.match(page, start)) is not None:
                return start, usual.end(), usual.group(2), usual.group(1) == "/", usual.group(3)
            name = _NAME.match(page, start)
            if name is None:
                at = start + 1
                continue
            end, whole = self._end(name.end())
            attributes = page[name.end() : end]
            if whole or "=" in attributes:
                return start, end + whole, name.group(1), page[start + 1] == "/", attributes
            at = end
        return None

    def _end(self, at: int) -> tuple[int, bool]:
        """Where a tag's attributes end, and whether a bracket is there."""
        page = self.page
        while True:
            at = _PLAIN.match(page, at).end()
            mark = page[at : at + 1]
            if mark in (">", "<", ""):
                return at, mark == ">"
            end = self.quotes[mark].after(at + 1)
            if end == len(page) or self.inner.after(at) < end and (page[end + 1 : end + 2] not in (" ", "\n", "\t", "\r", "/", ">") or page[end - 1] == "="):
                at += 1
            else:
                at = end + 1


def leaf_blocks(page: str) -> Iterator[tuple[str, list[tuple[str, tuple[str, ...], str | None]], int]]:
    """(text, ancestors, characters in links) of each block with text; an ancestor is (tag, its class and id words, its label)."""
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    text: list[str] = []
    links, in_link, at, skip, head = 0, 0, 0, None, False

    def flush():
        nonlocal links
        found = " ".join("".join(text).split())
        held, links_now = list(stack), links
        text.clear()
        links = 0
        return (found, held, links_now) if found else None

    tags, depth = _Tags(page), Counter()

    def shut(i: int) -> None:
        for gone, _, _ in stack[i:]:
            depth[gone] -= 1
        del stack[i:]

    while (found := tags.next(at)) is not None:
        start, end, tag, closing, attributes = found
        if skip is None and start > at:
            piece = references.unescape(page[at:start])
            head = head and not piece.strip()
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        opens = not closing and not attributes.rstrip().endswith("/")
        if tag in _LITERAL_ENDS:
            if opens:
                ended = _LITERAL_ENDS[tag].search(page, at)
                at = ended.end() if ended else len(page)
            continue
        if skip is not None:
            if closing and tag == skip:
                skip = None
            continue
        if tag in RAW_TAGS:
            if opens:
                skip = tag
            continue
        if tag == "head":
            head = not closing
            continue
        if head:
            if tag in _HEAD_TAGS or closing and tag not in ("body", "html"):
                continue
            head = False
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag not in BLOCK_TAGS:
            if tag in ("br", "img", "input", "wbr"):
                text.append(" ")
            continue
        if (block := flush()) is not None:
            yield block
        in_link = 0
        if closing:
            if depth[tag]:
                shut(max(i for i, held in enumerate(stack) if held[0] == tag))
            continue
        ends = _CLOSES.get(tag, ()) if tag != "p" else ("p",)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends or (stack[i][0] == "p" and tag in _ENDS_P):
                shut(i)
                break
            if stack[i][0] in _SCOPES or stack[i][0] not in ("p", *ends):
                break
        if tag == "hr":
            continue
        words, label = [], None
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                value = (a.group(2) or a.group(3) or a.group(4) or "").lower()
                if a.group(1).lower() == "data-y":
                    label = value
                else:
                    words += _WORD.findall(value)
        if len(stack) == DEPTH:
            shut(DEPTH - 1)
        stack.append((tag, tuple(words), label))
        depth[tag] += 1
    if skip is None and at < len(page):
        text.append(references.unescape(page[at:]))
    if (block := flush()) is not None:
        yield block


def features(text: str, ancestors: list, links: int, place: int, total: int) -> list[str]:
    words = text.count(" ") + 1
    share = links / len(text)
    out = ["bias", f"len{0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3}", f"link{0 if share == 0 else 1 if share < 0.5 else 2}"]
    out.append("stop" if text[-1] in ".!?。…\"'»" else "open")
    if "©" in text or "all rights reserved" in text.lower():
        out.append("rights")
    if place == 0:
        out.append("first")
    if place == total - 1:
        out.append("last")
    seen = set()
    for tag, names, _ in ancestors:
        seen.add(f"t:{tag}")
        seen.update([f"c:{name}" for name in names])
    if ancestors:
        out.append(f"own:{ancestors[-1][0]}")
    out.extend(seen)
    return out


class Field:
    """Weights of features for the label article, and of label pairs."""

    def __init__(self, weights: dict[str, float] | None = None, pairs: list[float] | None = None):
        self.weights, self.pairs = weights or {}, pairs or [0.0] * 4

    def emissions(self, chain: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in chain]

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi; ties go to not article."""
        t00, t01, t10, t11 = self.pairs
        back, a, b = [], 0.0, 0.0
        for i, e in enumerate(self.emissions(chain)):
            if i:
                x0, x1 = a + t00 >= b + t10, a + t01 >= b + t11
                back.append((0 if x0 else 1, 0 if x1 else 1))
                a, b = (a + t00 if x0 else b + t10), (a + t01 if x1 else b + t11)
            b += e
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1] if chain else []

    def marginals(self, chain: list[list[str]]) -> tuple[list[float], list[float]]:
        """P(article) of each block, and expected counts of label pairs."""
        e, t = self.emissions(chain), [math.exp(min(max(x, -20), 20)) for x in self.pairs]
        x = [math.exp(min(max(v, -30), 30)) for v in e]
        ahead = []
        a, b = 1.0, x[0]
        for i in range(len(x)):
            if i:
                a, b = a * t[0] + b * t[2], (a * t[1] + b * t[3]) * x[i]
            z = a + b
            a, b = a / z, b / z
            ahead.append((a, b))
        p, expected = [0.0] * len(x), [0.0] * 4
        c, d = 1.0, 1.0
        for i in range(len(x) - 1, -1, -1):
            a, b = ahead[i]
            p[i] = b * d / (a * c + b * d)
            if i:
                u, v = ahead[i - 1]
                joint = [u * t[0] * c, u * t[1] * x[i] * d, v * t[2] * c, v * t[3] * x[i] * d]
                z = sum(joint)
                for k in range(4):
                    expected[k] += joint[k] / z
                c, d = t[0] * c + t[1] * x[i] * d, t[2] * c + t[3] * x[i] * d
                z = c + d
                c, d = c / z, d / z
        return p, expected

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Field:
        """Gradient steps on the conditional likelihood, with step sizes by past gradients."""
        draw, squares, pair_squares = random.Random(seed), defaultdict(float), [0.0] * 4
        weights = defaultdict(float, self.weights)
        self.weights = weights
        for _ in range(epochs):
            draw.shuffle(pages)
            for chain, labels in pages:
                if not chain:
                    continue
                p, expected = self.marginals(chain)
                slope: dict[str, float] = defaultdict(float)
                for fs, y, q in zip(chain, labels, p):
                    if abs(y - q) > 1e-4:
                        for f in fs:
                            slope[f] += y - q
                for f, g in slope.items():
                    g -= decay * weights[f]
                    squares[f] += g * g
                    weights[f] += rate * g / math.sqrt(squares[f] + 1e-8)
                for a, b in zip(labels, labels[1:]):
                    expected[2 * a + b] -= 1
                for k in range(4):
                    pair_squares[k] += expected[k] ** 2
                    self.pairs[k] -= rate * expected[k] / math.sqrt(pair_squares[k] + 1e-8)
        self.weights = dict(weights)
        return self


#: Words of class and id names that mark parts of a page other than its article.
_NOT_ARTICLE = frozenset("ad ads advert advertisement banner sponsor promo sidebar side menu nav navigation navbar breadcrumb footer header masthead comment comments reply replies discussion cookie notice consent alert newsletter subscribe signup login search form share social related recommended widget popup modal".split())
_ARTICLE = frozenset("article content post entry story main body text".split())


#: Text for a table whose pages say nothing of where their articles are: a title, its paragraphs, and other parts of a page.
_FIXED = (
    "A short history of the lighthouse",
    ["The first light on this coast was a fire of wood, kept on the hill above the harbour by the families who fished there.", "In 1790 a tower of stone took its place, and with it came a keeper, who was paid by the town and wrote down every ship that passed.", "Nobody knows who built it.", "The lamp burned oil until the end of the next century; after that it was lit by electricity, and the last keeper left in 1964.", "Today the tower is a small museum. Its books are still read by people who look for lost ships, and by those who study the weather of those years."],
    ["Home", "About us", "Contact", "All news of this week", "Read our terms of use.", "Subscribe to the newsletter", "We use cookies to improve this site. By going on you agree to their use.", "Great post, thanks for sharing it with us!", "Buy two and get the third one free until Sunday.", "More from this site"],
)
_APART = frozenset("nav header footer aside form button select menu".split())


def marked(ancestors: list, named: bool = False, box: tuple | None = None) -> int:
    """The label that a page's own markup gives: inside an article, and in no part of it that is something else.

    With ``named`` containers named like an article count as well; ``box`` is an ancestor that counts as one.
    """
    inside = 0
    for held in ancestors:
        tag, names, label = held
        if label in ("0", "1"):
            inside = int(label)
        elif tag in ("article", "main") or held is box:
            inside = 1
        elif tag in _APART or _NOT_ARTICLE.intersection(names):
            inside = 0
        elif named and tag not in ("html", "body") and _ARTICLE.intersection(names):
            inside = 1
    return inside


def _text_box(blocks: list) -> tuple | None:
    """The ancestor with the most running text: whole sentences that are mostly no link and in no part marked as something else."""
    boxes: dict[int, list] = {}
    for text, ancestors, links in blocks:
        if len(text) < RICH_TEXT or 3 * links > len(text) or text[-1] not in ".!?。…\"'»" or any(tag in _APART or _NOT_ARTICLE.intersection(names) for tag, names, _ in ancestors):
            continue
        # a paragraph's text is its box's; boxes side by side outweigh a single one in the box around them
        own = [a for a in ancestors if a[0] not in ("p", "li", "blockquote", "pre", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl")][::-1]
        for held, share in zip(own, (1.0, 0.6)):
            boxes.setdefault(id(held), [0.0, held])[0] += share * len(text)
    score, box = max(boxes.values(), key=lambda b: b[0], default=(0, None))
    return box if score >= LEAST_TEXT else None


def page_labels(blocks: list) -> list[int]:
    """Labels of a page's blocks by its article elements, else its containers' names, else the box with the most text."""
    labels = [marked(a) for _, a, _ in blocks]
    if any(labels):
        return labels
    named = [marked(a, named=True) for _, a, _ in blocks]
    # a name like post-title holds no article
    if sum(len(t) for (t, _, _), y in zip(blocks, named) if y) >= LEAST_TEXT:
        return named
    box = _text_box(blocks)
    return [marked(a, box=box) for _, a, _ in blocks] if box else labels


def _relaid(draw: random.Random, title: str, paragraphs: list[str], other: list[str]) -> str:
    """The blocks of a page in another layout, with data-y marks."""
    pick = lambda n=1: [references.escape(draw.choice(other)) for _ in range(n)]
    link = lambda s: f'<a href="/x">{s}</a>'
    names = sorted(_NOT_ARTICLE)

    def some(tag_names, class_names, content):
        tag, name = draw.choice(tag_names), draw.choice(class_names)
        kind = draw.choice(("class", "id"))
        return f'<{tag} {kind}="{name}" data-y="0">{content}</{tag}>' if name else f'<{tag} data-y="0">{content}</{tag}>'

    menu = some(("nav", "div", "ul"), ("menu", "nav", "navbar", "main-menu", "navigation", ""), "".join(f"<li>{link(s[:20])}</li>" for s in pick(draw.randint(3, 7))))
    head = some(("header", "div"), ("header", "masthead", "banner", ""), f"<h2>{pick()[0][:40]}</h2><p>{pick()[0]}</p>")
    foot = some(("footer", "div"), ("footer", "site-footer", ""), f"&copy; {pick()[0]}" if draw.random() < 0.7 else f"<p>{pick()[0]}</p>")
    extras = [
        some(("aside", "div"), ("sidebar", "side", "related", "widget"), f"<h3>{pick()[0][:30]}</h3>" + "".join(f"<p>{s}</p>" for s in pick(2))),
        some(("div", "section", "p"), ("notice", "cookie-notice", "consent", "alert", "newsletter"), pick()[0] if draw.random() < 0.5 else f"{pick()[0]} <button>OK</button>"),
        some(("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsor", "promo"), pick()[0]),
        some(("form",), ("search", "login", "subscribe", ""), f"<label>{pick()[0][:25]}</label><input><button>Go</button>"),
        some(("section", "div", "ol"), ("comments", "comment-list", "discussion", "replies"), "".join(f'<div class="comment"><p>{s}</p></div>' for s in pick(draw.randint(1, 4)))),
        some(("div", "ul"), ("share", "social", "breadcrumb", draw.choice(names)), "".join(f"<li>{link(s[:15])}</li>" for s in pick(3))),
    ]
    draw.shuffle(extras)
    wrap = draw.choice(('article', 'main', 'div class="content"', 'div id="content"', 'div class="post"', 'section class="entry"', 'div class="article-body"', 'div', 'div', 'div class="wrap"', 'div class="container"', 'div class="page"', 'div id="inner"', 'td class="main"', 'div class="story text"', 'section'))
    body = [f"<h{draw.choice((1, 1, 2))}>{references.escape(title)}</h1>"] if title and draw.random() < 0.85 else []
    body += [draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<h2>{}</h2>" if len(p) < 80 else "<p>{}</p>")).format(references.escape(p)) for p in paragraphs]
    inner = extras[: draw.randint(0, 2)]
    for part in inner:
        body.insert(draw.randint(0, len(body)), part)
    page = [head, menu, *extras[2 : 2 + draw.randint(0, 2)], f'<{wrap} data-y="1">{"".join(body)}</{wrap.split()[0]}>', *extras[4 : 4 + draw.randint(0, 2)], foot]
    return "<html><body>" + "".join(page if draw.random() < 0.8 else page[1:]) + "</body></html>"


def training_chains(pages: list[str], layouts: int = LAYOUTS, seed: int = 0) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the sampled pages as they are and in other layouts."""
    draw, out, cut = random.Random(seed), [], []
    for page in pages:
        blocks = list(leaf_blocks(page))
        labels = page_labels(blocks)
        if any(labels):
            out.append((blocks, labels))
        own = [t for (t, a, _), y in zip(blocks, labels) if y]
        cut.append((own, [t for (t, _, _), y in zip(blocks, labels) if not y]))
    loose = [t for _, other in cut for t in other if len(t) > 20] or ["More from this site.", "Read our terms of use."]
    texts = [t for own, _ in cut for t in own]
    if not texts:
        title, paragraphs, other = _FIXED
        cut, texts, layouts = [([title, *paragraphs], other)], paragraphs, max(layouts, FIXED_LAYOUTS)
    for own, other in cut:
        if not own:
            continue
        for _ in range(layouts):
            # comments and notices are prose too: some boilerplate is drawn from other pages' texts
            noise = other + draw.sample(loose, min(6, len(loose))) + [t[:300] for t in draw.sample(texts, min(4, len(texts)))]
            blocks = list(leaf_blocks(_relaid(draw, own[0], own[1:] or own, noise)))
            labels = []
            for _, ancestors, _ in blocks:
                label = [y for _, _, y in ancestors if y is not None]
                labels.append(int(label[-1]) if label else 0)
            out.append((blocks, labels))
    return [([features(t, a, n, i, len(blocks)) for i, (t, a, n) in enumerate(blocks)], labels) for blocks, labels in out]


def main_text(page: str | None, field: Field) -> str:
    texts, chain, held = [], [], None
    for block in leaf_blocks(page or ""):  # ancestors are not kept: a deep page has many
        if held is not None:
            chain.append(features(*held, len(chain), len(chain) + 2))
        texts.append(block[0])
        held = block
    if held is not None:
        chain.append(features(*held, len(chain), len(chain) + 1))
    return "\n\n".join(t for t, y in zip(texts, field.decode(chain)) if y)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Field:
    """A field trained on the sample: different pages of up to ``SAMPLE_BYTES``, first by a hash of the id.

    The keys of the sample are chosen first, so that only its own pages travel to the driver.
    """
    html = F.col(f"`{html_col}`")
    keyed = pages.where(F.octet_length(html) <= SAMPLE_BYTES).select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.xxhash64(html).alias("g"), html.alias("html"))
    keys = keyed.select("h", "g").distinct().orderBy("h", "g").limit(SAMPLE_PAGES)
    chosen = keyed.sparkSession.createDataFrame(keys.collect(), "h long, g long")
    rows = keyed.join(F.broadcast(chosen), ["h", "g"]).groupBy("h", "g").agg(F.first("html").alias("html")).collect()
    return Field().train(training_chains([r["html"] for r in sorted(rows, key=lambda r: (r["h"], r["g"]))]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without an article, have an empty text.
    Repeated rows are read each; extra columns are ignored.
    """
    field = pages.sparkSession.sparkContext.broadcast(fit(pages, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, 200):
                part = rows.slice(start, 200)
                texts = [main_text(page, field.value) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
