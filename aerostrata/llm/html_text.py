"""Main text of HTML pages by two passes of block rules.

Markup is cut into blocks at block-level tags. The first pass decides a block by its place (a region of the page that
holds menus, adverts, forms, comments and the like, or the article), its link density, its length and its density of
stop words. Blocks that stay open, short ones above all, inherit in the second pass the label of the nearest decided
block, looked up first within their own article region and then on the whole page (ties: the block before; headings look
at the block after them).

Tags and names are evidence, densities decide: where the stop words don't cover the text (letters of another script, or a
page whose longer blocks hold hardly any), length and full sentences decide instead; signs of scripts without spaces count threefold.
An article region with far less text than there is in long blocks beside it counts for nothing, and one with not much more doesn't
rule these out. The wrapper of a page without other text is not layout, whatever its name. Links make a block a menu, but
not in an ordered list of the article, as references are. Names such as ads, comments, notice or related count alone or with words of layout
(related-posts), not in a subject (related-work, comments-on-the-law). A form, header or other region by its tag alone that holds nearly
all long text of the page, as forms around whole pages and headers that never end do, counts for nothing; what lies inside it is judged
by its own.

The reader is linear in the page: it keeps the places of open tags by name, and what names and attributes say by their text.

Cases: null html counts as empty and gives an empty text; unclosed tags, stray end tags, unterminated comments and
scripts are read to the end of the page; a page on which no block is decided to be text keeps the open blocks of its article, if it
has one, and all open blocks with no link in them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table

#: Tags whose content is never text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "button", "textarea", "audio", "video", "title", "datalist", "head"}
#: Of these, the ones whose content is read up to their end tag without markup.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "blockquote", "form", "aside", "nav", "body"}
MAIN_TAGS = {"article", "main"}
#: Words in class, id and role values that name a part of the layout beside the article (an article may lie in a wrapper so named) ...
LAYOUT_WORDS = "banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation sidebar toolbar widget widgets complementary contentinfo search skip toc hidden modal".split()
#: ... words that name what is never the article ...
OTHER_WORDS = (
    "ad ads advert adverts advertisement advertisements advertising comment comments consent cookie cookies disqus gdpr newsletter pagination pager popup "
    "promo promos promoted sponsor sponsors sponsored signup login outbrain taboola"
).split()
#: ... and words that do so alone or with the companions, but not in a subject such as related-work or notice-board.
WEAK_WORDS = "notice notices related respond reply replies share sharing social subscribe alert alerts disclaimer promotion promotions".split()
COMPANIONS = (
    "post posts article articles link links list item items content contents bar box widget widgets button buttons icon icons banner panel block area section container "
    "wrapper story stories news media nav modal overlay form message messages module sidebar inner outer site page top bottom reader user more also"
).split()
#: Further words that stand beside names of adverts, comments and notices in names of layout.
MORE_COMPANIONS = (
    "slot unit units leaderboard mpu google dfp gpt native sticky floating mobile desktop left right center thread count author meta avatar settings accept dismiss close text "
    "title heading label wrap row col column grid holder space zone placement image img video pre after before in inline submit email field input users new all load loop root "
    "app component js css react ui tag script frame iframe skyscraper rectangle billboard big small show hide toggle tab tabs pane group popover tooltip gate required"
).split()
LAYOUT_NAME = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(LAYOUT_WORDS)})(?:$|[\s_-]|\d)", re.I)
_COMPANY = rf"(?:{'|'.join(COMPANIONS)}|\d+)"
_WEAK = rf"(?:{_COMPANY}[_-]+)*(?:{'|'.join(WEAK_WORDS)})(?:[_-]*\d+|[_-]+(?:{_COMPANY}|{'|'.join(WEAK_WORDS)}))*"
WEAK_NAME = re.compile(rf"(?:^|\s){_WEAK}(?:$|\s)", re.I)
HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
COMMENT_PART = re.compile(r"comment(?:list|s?form)\w*")
_OTHER = frozenset(OTHER_WORDS)
_BESIDE_OTHER = frozenset((*OTHER_WORDS, *WEAK_WORDS, *COMPANIONS, *MORE_COMPANIONS, *LAYOUT_WORDS))
#: Whole class, id or role values of the article on pages without article or main tags.
MAIN_NAMES = {"main", "content", "main-content", "article", "article-body", "article-content", "post", "post-content", "post-body", "entry-content", "story", "story-body", "articlebody"}
HAS_MAIN = re.compile(r"<(?:article|main)[\s>/]", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would "
        "their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do "
        "de la le et les des en un une du que est pour qui dans par sur pas au plus ne se ce il sont avec son elle aux ou mais nous "
        "der die und in den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem "
        "el los las y del se por con una su para al lo como más pero sus este ya o fue ha si sin sobre entre cuando muy"
    ).split()
)

#: Letters beyond the Latin script, which no stop word holds, and signs of scripts without spaces.
OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")
LETTER = re.compile(r"[^\W\d_]")
DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE = re.compile(r"[.!?…。！？؟।;:]['\"»”’）)\]]*$")

TAG = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass."""

    link_density: float = 0.34
    main_link_density: float = 0.6
    short_chars: int = 40
    long_chars: int = 160
    stop_low: float = 0.10
    stop_high: float = 0.22
    stop_none: float = 0.05
    main_share: float = 0.25
    lifted_share: float = 4.0
    wrapped_share: float = 0.8
    beside_share: float = 0.5


class Block:
    __slots__ = ("text", "linked", "aside", "main", "heading", "label", "soft", "listed", "hard")

    def __init__(self, text: str, linked: int, aside: bool, main: int, heading: bool, soft: bool = False, listed: bool = False, hard: int = 0):
        self.text, self.linked, self.aside, self.main, self.heading, self.label = text, linked, aside, main, heading, None
        self.soft = soft  # beside the article by the name of a layout part only
        self.listed = listed  # in an ordered list, as references are
        self.hard = hard  # the innermost region beside the article by its tag, its name or as it is hidden


def _is_other(name: str) -> bool:
    """Whether a name tells what is never the article: one of these words, alone or with words of layout."""
    parts = [p.rstrip("0123456789") for p in re.split("[_-]+", name.lower())]
    if not any(p in _OTHER or COMMENT_PART.fullmatch(p) for p in parts):
        return False
    return all(not p or p in _BESIDE_OTHER or COMMENT_PART.fullmatch(p) or len(p) == 1 or any(c.isdigit() for c in p) for p in parts)


@lru_cache(1 << 14)
def _facts(attrs: str, ids: bool) -> tuple[bool, bool, bool, bool, bool]:
    """What attributes say: (by name never the article, by name layout, hidden, named as a header, named as the article)."""
    values, names, hidden = [], [], False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "role", "aria-label") or name == "id" and ids:
            value = CAMEL.sub("-", value)
            values.append(value)
            names += ["-".join(value.split())] if name == "aria-label" else value.split()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and STYLE_HIDDEN.search(value):
            hidden = True
    other = any(map(_is_other, names)) or any(WEAK_NAME.search(v) for v in values)
    named = any(w in MAIN_NAMES for v in values for w in v.lower().split())
    return other, any(LAYOUT_NAME.search(v) for v in values), hidden, any(HEADER_NAME.search(v) for v in values), named


class Reader:
    """Reads tags in page order and keeps what is open: links, silent elements, places beside the article, article regions."""

    def __init__(self, named_main: bool):
        self.out: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, int, tuple[int, int] | None]] = []  # tag, kind of aside, state before an article region
        self.places: dict[str, list[int]] = defaultdict(list)  # of open tags by name
        self.holders: list[int] = []
        self.named_main = named_main
        self.links = self.silent = self.hard = self.soft = self.ordered = self.forms = 0
        self.regions = self.region = self.base = 0  # number of regions, the open one, soft asides around it
        self.around = [0]  # of each hard region: the one around it
        self.liftable = [False]  # whether only its tag makes it one
        self.form = [False]
        self.inner = 0  # the innermost open one

    def text(self, s: str) -> None:
        if not self.silent:
            self.parts.append((s, self.links > 0))

    def close_block(self, heading: bool = False) -> None:
        if self.parts:
            words = unescape("".join(p for p, _ in self.parts)).split()
            if words:
                linked = len(" ".join(unescape("".join(p for p, l in self.parts if l)).split()))
                soft = self.soft > self.base
                self.out.append(Block(" ".join(words), linked, self.hard > 0 or soft, self.region, heading, soft, self.ordered > 0, self.inner))
            self.parts.clear()

    def pop(self) -> str:
        tag, aside, before = self.stack.pop()
        self.places[tag].pop()
        if tag in HOLDERS:
            self.holders.pop()
        if aside == 2:
            self.hard -= 1
            self.forms -= tag == "form" and self.liftable[self.inner]
            self.inner = self.around[self.inner]
        self.soft -= aside == 1
        self.links -= tag == "a"
        self.ordered -= tag == "ol"
        self.silent -= tag in SILENT
        if before is not None:
            self.region, self.base = before
        return tag

    def open(self, tag: str, attrs: str) -> None:
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and not self.silent:
            # one of these ends the one before it, unless a container was opened in between
            last = self.places[tag]
            if last and (not self.holders or last[-1] > self.holders[-1]):
                k = last[-1]
                while len(self.stack) > k:
                    self.pop()
        # the id of a heading or paragraph is a mark to jump to and tells its subject
        other, layout, hidden, header, named = _facts(attrs, tag != "p" and tag not in HEADINGS) if attrs else (False,) * 5
        if tag not in BLOCK or tag in ("html", "body"):
            other = layout = header = named = False
        aside = 2 if tag in ASIDE_TAGS else 0
        if other or hidden:
            aside = 2
        elif tag not in MAIN_TAGS and layout:
            aside = max(aside, 1)
        if (tag == "header" or header) and self.region and self.hard == self.forms and not other:
            aside = 0  # the article's own heading
        main = tag in MAIN_TAGS or self.named_main and named
        before = None
        if main and aside < 2 and self.hard == self.forms and not self.region:
            before = (self.region, self.base)
            self.regions += 1
            self.region, self.base, aside = self.regions, self.soft, 0
        self.places[tag].append(len(self.stack))
        if tag in HOLDERS:
            self.holders.append(len(self.stack))
        self.stack.append((tag, aside, before))
        if aside == 2:
            self.hard += 1
            self.around.append(self.inner)
            self.liftable.append(tag in ASIDE_TAGS and not other and not hidden)
            self.form.append(tag == "form")
            self.inner = len(self.around) - 1
            self.forms += tag == "form" and self.liftable[-1]
        self.soft += aside == 1
        self.links += tag == "a"
        self.ordered += tag == "ol"
        self.silent += tag in SILENT

    def close(self, tag: str) -> None:
        if self.places[tag]:
            while self.pop() != tag:
                pass

    def lift(self, rules: Rules) -> None:
        """Take back regions by tag alone that hold nearly all long text of the page, and forms that hold nearly all of its blocks."""
        n = len(self.around)
        sizes = [_size(b.text) if b.linked <= rules.link_density * len(b.text) else 0 for b in self.out]
        long, some, count = [0] * n, [0] * n, [0] * n  # by region, those of inner ones that are taken back included; 0: in none
        for size, b in zip(sizes, self.out, strict=True):
            long[b.hard] += size if size >= rules.long_chars else 0
            some[b.hard] += size
            count[b.hard] += 1
        shut = [True] * n
        for r in range(n - 1, 0, -1):
            wraps = self.form[r] and count[r] >= rules.wrapped_share * len(self.out) and some[r] > rules.lifted_share * some[0]
            shut[r] = not (self.liftable[r] and (wraps or long[r] >= max(rules.long_chars, rules.lifted_share * long[0])))
            up = self.around[r]
            count[up] += count[r] if up else 0
            if not shut[r] and up:
                long[up] += long[r]
                some[up] += some[r]
        shut[0] = False
        for r in range(1, n):
            shut[r] = shut[r] or shut[self.around[r]]
        for b in self.out:
            b.soft = b.soft and not shut[b.hard]
            b.aside = shut[b.hard] or b.soft


def blocks(html: str, rules: Rules | None = None) -> list[Block]:
    """Blocks in page order; `main` numbers the article region they are in (0: none)."""
    reader = Reader(not HAS_MAIN.search(html))
    at, n = 0, len(html)
    last = html.rfind(">") + 1  # behind it nothing is a tag
    lower = None
    while at < n:
        m = TAG.search(html, at, last)
        if m is None:
            reader.text(html[at:])
            break
        if m.start() > at:
            reader.text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            if html.startswith((">", "->"), at):  # an empty comment
                at = html.index(">", at) + 1
                continue
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if not closing and tag in RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == n else html.find(f"</{tag}", at)
            close = -1 if end < 0 else html.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if tag == "br":
            reader.text(" ")
            continue
        if tag in BLOCK:
            reader.close_block(closing and tag in HEADINGS)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if closing:
            reader.close(tag)
        else:
            reader.open(tag, attrs)
    reader.close_block()
    reader.lift(rules or Rules())
    return reader.out


def _size(text: str) -> int:
    """Characters, signs of scripts without spaces threefold."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def _foreign(text: str) -> bool:
    """Whether most letters are of another script than the stop words'."""
    return not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) > len(LETTER.findall(text))


def decide(found: list[Block], rules: Rules) -> None:
    """First pass: label True (text), False (beside it) or None (open)."""
    if not any(not b.aside and b.linked <= rules.link_density * len(b.text) and _size(b.text) >= rules.long_chars for b in found):
        for b in found:
            b.aside = b.aside and not (b.soft and _size(b.text) >= rules.long_chars)
    sizes = [_size(b.text) for b in found]
    words = [b.text.split(" ") for b in found]
    counts = [sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in ws) for ws in words]
    open_ = [not b.aside and b.linked <= rules.link_density * len(b.text) for b in found]
    foreign = [_foreign(b.text) for b in found]
    longer = [i for i, b in enumerate(found) if open_[i] and not foreign[i] and sizes[i] >= rules.short_chars]
    unknown = sum(counts[i] for i in longer) < rules.stop_none * sum(len(words[i]) for i in longer)

    def prose(i: int) -> bool:
        n, stops = sizes[i], counts[i] / len(words[i])
        if foreign[i] or unknown:
            return n >= rules.long_chars or n >= rules.short_chars and not found[i].linked and SENTENCE.search(found[i].text) is not None
        return n >= rules.long_chars and stops >= rules.stop_low or n >= rules.short_chars and stops >= rules.stop_high

    texts = [open_[i] and prose(i) for i in range(len(found))]
    inside = sum(sizes[i] for i, b in enumerate(found) if b.main and open_[i])
    outside = sum(sizes[i] for i, b in enumerate(found) if not b.main and texts[i] and sizes[i] >= rules.long_chars)
    if inside < rules.main_share * outside:  # a teaser or the like: its place says nothing
        for b in found:
            b.main = 0
    alone = inside > 0 and outside <= rules.beside_share * inside and any(b.main for b in found)
    for i, b in enumerate(found):
        limit = 1.0 if b.main and b.listed else rules.main_link_density if b.main else rules.link_density
        if b.aside or b.linked / len(b.text) > limit or (alone and not b.main):
            b.label = False
        elif b.main and (sizes[i] >= rules.short_chars or counts[i] / len(words[i]) >= rules.stop_low) or prose(i):
            b.label = True


def _nearest(found: list[Block], usable: list[bool]) -> list[bool | None]:
    """Label of the nearest usable block of each place, the one before on ties; of a heading, the one after it."""
    n = len(found)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if usable[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if usable[i + 1] else after[i + 1]
    out: list[bool | None] = []
    for i in range(n):
        b, a = before[i], after[i]
        first = b >= 0 and (a == n or i - b <= a - i and not found[i].heading)
        out.append(None if b < 0 and a == n else found[b if first else a].label)
    return out


def inherit(found: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided one, of their own region where there is one."""
    decided = [b.label is not None for b in found]
    if all(decided):
        return
    if not any(b.label for b in found):  # nothing says what the text is: all that isn't beside it
        for b in found:
            b.label = b.label is None and (b.main > 0 or not b.linked)
        return
    anywhere = _nearest(found, decided)
    own: dict[int, list[bool | None]] = {}
    for region in {b.main for b, d in zip(found, decided, strict=True) if not d}:
        own[region] = _nearest(found, [d and b.main == region and not b.aside for b, d in zip(found, decided, strict=True)])
    for i, b in enumerate(found):
        if not decided[i]:
            label = own[b.main][i]
            if label is None:
                label = True if b.main else anywhere[i]
            b.label = not b.linked if label is None else label


def main_text(html: str | None, rules: Rules | None = None) -> str:
    """Text blocks of a page joined by one line feed."""
    rules = rules or Rules()
    found = blocks(html or "", rules)
    decide(found, rules)
    inherit(found)
    return "\n".join(b.text for b in found if b.label)


def extract(df: DataFrame, html: str = "html", rules: Rules | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds text and n_chars. A map over the scan, without a shuffle."""

    def run(pages):
        texts = [main_text(p, rules) for p in pages]
        return [texts, [len(t) for t in texts]]

    return append_columns(df, [F.col(html)], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], run, keep)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
