"""Main text of web pages: the contiguous stretch of a page with the highest score.

A page becomes a row of tokens: tags, and runs of words between them. Words score above zero,
less inside links, and tags below it, so menus and lists of links lose and prose wins; one
linear scan finds the stretch of the highest sum. The weights are log ratios of how often words
and tags stand inside and outside the main content of labelled pages: those that mark it
themselves, with `main` or `article`; a page without these may mark it by class, id or role. Elements that hold no main text by their name or by the names
in their class, id or role are one negative token each, whatever they hold, so that they may
stand inside a stretch but add no text to it. On a page that marks its main content, words
outside it score below zero, and tags inside it as little below as any tag.

The stretch grows to whole blocks. Its text is what they hold: character references decoded, white space
(as Unicode has it, line breaks included) turned into single spaces, blocks joined by newlines.

Bounds of the training sample (the only rows that are sampled): LABELLED pages, KINDS token
kinds. Every page is scanned whole, in time linear in its length.

Defined results
* Null or empty html, and pages without a word in a positive stretch: empty text, 0 characters.
* Of several best stretches the first one, and of these the shortest, is taken.
* Tags cut off at the end of a page are dropped; elements left open end with their parent or
  the page; comments, scripts and the like left open reach to the end.
* No labelled page, or a tag that labelled pages rarely have: weights WORD, LINKED and UNSEEN. Repeated rows are scanned alike. Null ids and
  urls stay null. Empty table: no row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, KINDS = 2000, 1000
#: Weights without labelled pages, and the ranges in which learnt ones are kept.
WORD, LINKED = 1.0, 0.1
WORD_RANGE, LINKED_RANGE, TAG_RANGE = (0.5, 2.0), (0.05, 0.2), (-1.5, -0.1)
PROSE = "p h1 h2 h3 h4 h5 h6 blockquote pre code b i em strong br sub sup q cite figure figcaption dl dt dd".split()
UNSEEN = dict.fromkeys(PROSE, -0.1) | {"a": -1.0, "ul": -0.6, "li": -0.6}
TAG, SEEN = -0.4, 50
NOISE, OUTSIDE = -1.0, -0.5

#: Fixed values of HTML: elements without an end, with raw contents, and that start blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
MARKS = ("main", "article")
#: Elements that a start tag of the same group closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "head", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "dd", "dt", "li"}
#: Elements without main text, and words in class, id or role that say the same.
NOISE_NAMES = frozenset("nav footer aside form button select datalist dialog menu fieldset label object canvas audio video map".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login search nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "related recommended recommendations share sharing social comment comments commentlist respond reply replies disqus "
    "footer header masthead toolbar pagination pager skip contentinfo complementary topbar".split()
)
MAIN_WORDS = frozenset("content main article post entry story body page text".split())
MAIN_LABELS = frozenset(
    "content main article post entry story main-content page-content article-body article-content post-body "
    "post-content entry-content story-body".split()
)
STATES = frozenset("has with no is js without".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
LABELS = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

START, END, TEXT = 0, 1, 2


def events(html: str) -> Iterator[tuple[int, str, str]]:
    """(START, name, attributes), (END, name, "") and (TEXT, raw text, "") in page order."""
    at, text_from, quotes = 0, 0, {'"': True, "'": True}

    def tag_end(start: int) -> int:
        """The '>' that ends a tag, not one inside quotes; -1 if there is none."""
        here = start
        while True:
            end = html.find(">", here)
            if end < 0:
                return -1
            opened = [(p, q) for q in "\"'" if quotes[q] and (p := html.find(q, here, end)) >= 0]
            if not opened:
                return end
            place, quote = min(opened)
            close = html.find(quote, place + 1)
            if close < 0:
                quotes[quote] = False
                continue
            here = close + 1

    while (lt := html.find("<", at)) >= 0:
        head = html[lt + 1 : lt + 2]
        closing = head == "/"
        name = NAME.match(html, lt + 1 + closing)
        if not name and head not in "!?/" or not head:
            at = lt + 1
            continue
        if lt > text_from:
            yield TEXT, html[text_from:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end = end + 2 if end >= 0 else -1
        elif not name or closing:
            end = html.find(">", lt)
        else:
            end = tag_end(name.end())
        if end < 0:
            return
        at = text_from = end + 1
        if not name:
            continue
        word = name.group().lower()
        if closing:
            yield END, word, ""
            continue
        yield START, word, html[name.end() : end]
        if word in RAW_END and html[end - 1] != "/":
            stop = RAW_END[word].search(html, at)
            if not stop:
                return
            at = text_from = stop.start()
    if text_from < len(html):
        yield TEXT, html[text_from:], ""


def noise_label(attributes: str) -> bool:
    """Whether class, id, role or visibility say that an element holds no main text."""
    found = False
    for m in LABELS.finditer(attributes):
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "hidden":
            return True
        if kind == "aria-hidden":
            if value.lower() == "true":
                return True
            continue
        if kind == "style":
            if HIDDEN.search(value):
                return True
            continue
        for label in value.split():
            parts = [p.lower() for p in PARTS.findall(label) if not p.isdigit()]
            if not parts or parts[0] in STATES:
                continue
            if label.lower() in MAIN_WORDS:
                return False
            found = found or parts[-1] in NOISE_WORDS or parts[0] in NOISE_WORDS
    return found


def main_label(attributes: str) -> bool:
    """Whether class, id or role name the main content."""
    for m in LABELS.finditer(attributes):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if m.group(1).lower() in ("class", "id", "role") and not MAIN_LABELS.isdisjoint(value.lower().split()):
            return True
    return False


@dataclass
class Token:
    """A tag (name), or a run of words (text); what it stands in."""

    name: str = ""
    text: str = ""
    words: int = 0
    linked: bool = False
    inside: bool = False
    noise: bool = False
    root: bool = False
    breaks: bool = False


@dataclass
class Page:
    """The tokens of a page, and whether it marks its main content."""

    tokens: list[Token] = field(default_factory=list)
    marked: bool = False


def page_of(html: str, open_noise: bool = False, forms: bool = False) -> Page:
    """The page's tokens. `open_noise` keeps what noise elements hold, `forms` reads forms as text."""
    page, tokens = Page(), []
    stack: list[str] = []
    marks: list[bool] = []
    counts: Counter = Counter()
    noise_from, marked_depth = -1, 0
    seen = list(events(html))
    starts = [(name, a) for kind, name, a in seen if kind == START]
    main = next((m for m in MARKS if any(name == m and not noise_label(a) for name, a in starts)), "")
    page.marked = bool(main) or any(name not in ("html", "body") and main_label(a) for name, a in starts)

    def is_mark(name: str, attributes: str) -> bool:
        return name == main if main else page.marked and name not in ("html", "body") and main_label(attributes)

    def pop_to(depth: int) -> None:
        nonlocal noise_from, marked_depth
        while len(stack) > depth:
            counts[stack.pop()] -= 1
            marked_depth -= marks.pop()
        if noise_from >= len(stack):
            noise_from = -1

    def quiet() -> bool:
        return noise_from >= 0

    for kind, name, more in seen:
        if kind == TEXT:
            if quiet() and not open_noise:
                continue
            text = unescape(name)
            tokens.append(
                Token(text=text, words=len(text.split()), linked=counts["a"] > 0, inside=marked_depth > 0, noise=quiet())
            )
            continue
        if kind == END:
            was = quiet()
            if counts[name] > 0:
                depth = len(stack) - 1
                while stack[depth] != name:
                    depth -= 1
                pop_to(depth)
            elif name not in ("p", "br"):
                continue
            if not was or open_noise:
                tokens.append(Token(name=name, breaks=name in BLOCK, inside=marked_depth > 0, noise=was, root=was and not quiet()))
            continue
        group = CLOSED_BY.get(name)
        if group or name in CLOSES_P:
            # Inline elements left open end with the block they stand in.
            depth = len(stack) - 1
            wanted = group or {"p"}
            while depth >= 0 and stack[depth] not in wanted and (stack[depth] not in BLOCK or group and stack[depth] == "p"):
                depth -= 1
            if depth >= 0 and stack[depth] in wanted:
                if group and name == "tr":
                    while depth > 0 and stack[depth - 1] in wanted:
                        depth -= 1
                pop_to(depth)
        # A void element without text is noise for nothing.
        silent = name not in VOID and name not in ("html", "body", main)
        named = name in NOISE_NAMES and not (forms and name in ("form", "fieldset", "label"))
        if name == "header":
            named = not marked_depth
        is_noise = silent and (named or noise_label(more))
        was = quiet()
        if name not in VOID and not more.endswith("/"):
            stack.append(name)
            marks.append(is_mark(name, more))
            marked_depth += marks[-1]
            counts[name] += 1
            if is_noise and not was:
                noise_from = len(stack) - 1
        if was and not open_noise:
            continue
        tokens.append(Token(name=name, breaks=name in BLOCK, inside=marked_depth > 0, noise=was or is_noise, root=is_noise))
    page.tokens = tokens
    return page


@dataclass(frozen=True)
class Weights:
    word: float = WORD
    linked: float = LINKED
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token, marked: bool) -> float:
        if not token.name:
            if marked and not token.inside:
                return OUTSIDE * token.words
            return (self.linked if token.linked else self.word) * token.words
        if token.inside:
            return TAG_RANGE[1]
        if token.noise:
            return NOISE
        return self.tags.get(token.name, UNSEEN.get(token.name, TAG))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous stretch with the highest positive sum; (0, 0) if none."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, found = total, (first, i + 1)
    return found


def whole_blocks(tokens: list[Token], first: int, end: int) -> list[Token]:
    """The stretch with the rest of the blocks in which it begins and ends."""
    parts = lambda t: t.breaks or t.noise
    while first > 0 and not parts(tokens[first]) and not parts(tokens[first - 1]):
        first -= 1
    while end < len(tokens) and not parts(tokens[end - 1]) and not parts(tokens[end]):
        end += 1
    return tokens[first:end]


def text_of(tokens: list[Token]) -> str:
    blocks: list[list[str]] = [[]]
    for token in tokens:
        if token.name:
            if token.breaks or token.noise:
                blocks.append([])
            elif token.name == "br":
                blocks[-1].append(" ")
        else:
            blocks[-1].append(token.text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def main_text(html: str | None, weights: Weights) -> str:
    """The main text of one page."""
    for forms in (False, True):
        page = page_of(html or "", forms=forms)
        first, end = best_stretch([weights.of(t, page.marked) for t in page.tokens])
        if end:
            return text_of(whole_blocks(page.tokens, first, end))
        # A form may hold a whole page; only pages without other main text are read so.
        if "<form" not in (html or "").lower() or page.marked:
            break
    return ""


def token_counts(html: str) -> Counter:
    """How many words and tags of each kind stand inside and outside the marked content."""
    out: Counter = Counter()
    page = page_of(html, open_noise=True)
    for token in page.tokens:
        inside = token.inside and not token.noise
        if token.name:
            # What makes an element noise is its own token's weight, not that of its name.
            out[inside, f"<{token.name[:40]}>"] += not token.root
        elif token.words:
            out[inside, "linked" if token.linked else "word"] += token.words
    return out


def learn(pages: DataFrame, labelled: int = LABELLED) -> Weights:
    """Weights from at most `labelled` pages, chosen by a hash, that mark their main content."""
    marked = pages.filter(F.col("html").rlike("(?i)<(main|article)[\\s>]"))
    marked = marked.select(F.xxhash64("page_id", "html").alias("place"), "html")
    # Hashes alone find the last place that is taken; pages then stay where they are read.
    last = marked.select("place").distinct().orderBy("place").limit(labelled).agg(F.max("place")).first()[0]
    chosen = marked.filter(F.col("place") <= F.lit(last)).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                total.update(token_counts(html))
        yield pa.RecordBatch.from_pydict(
            {
                "inside": pa.array([k[0] for k in total], pa.bool_()),
                "kind": pa.array([k[1] for k in total], pa.string()),
                "n": pa.array(list(total.values()), pa.int64()),
            }
        )

    counts = chosen.mapInArrow(run, "inside boolean, kind string, n long").groupBy("kind")
    within = F.when(F.col("inside"), F.col("n")).otherwise(0)
    counts = counts.agg(F.sum(within).alias("here"), F.sum("n").alias("all"))
    rows = counts.orderBy(F.desc("all"), "kind").limit(KINDS).collect()
    if not rows:
        return Weights()
    here, there = sum(r.here for r in rows) + len(rows), sum(r["all"] - r.here for r in rows) + len(rows)
    ratio = {r.kind: float(np.log((r.here + 1) / here) - np.log((r["all"] - r.here + 1) / there)) for r in rows}
    clip = lambda value, bounds: float(np.clip(value, *bounds))
    often = {r.kind for r in rows if r["all"] >= SEEN}
    tags = {kind[1:-1]: clip(v, TAG_RANGE) for kind, v in ratio.items() if kind.startswith("<") and kind in often}
    return Weights(
        clip(ratio.get("word", WORD), WORD_RANGE), clip(ratio.get("linked", LINKED), LINKED_RANGE), tags
    )


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(weights or learn(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, held.value) for html in batch.column(2).to_pylist()]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
