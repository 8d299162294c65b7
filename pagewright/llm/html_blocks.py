"""Leaf blocks of an HTML page with the tags around them, and features of each block."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np

#: Elements that start a block of their own, that never have content, and whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea xmp".split())
INLINE = frozenset("a abbr b big button cite code del dfn em font i ins kbd label mark q s small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
STOPS = ".!?。"
#: Tags whose presence around a block is told; of others, which a page may make up, only that they open and close.
KNOWN = BLOCK | INLINE
#: Open inline elements looked through for one of the same kind.
NEAR = 64
#: Open elements that a start tag closes, as end tags may be left out.
CLOSES = {
    **{t: ("p",) for t in BLOCK - {"option", "body", "head", "html", "title"}},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "tr": ("td", "th", "tr", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "body": ("head", "title"),
}
#: Elements that a tag left open inside cannot close past.
SCOPES = frozenset("table ul ol dl div section article aside nav footer header main form body html blockquote".split())

#: A quote counts only after an equals sign, so that a stray one does not swallow what follows the tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:(?<=[\s\"'/])|^)([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset(["class", "id", "role", "itemprop"])
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORDS = re.compile(r"[a-z]+")
#: Names that pages give to parts beside the main text and to the main text.
NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "topbar", "tabs", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "banner", "branding", "top"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon", "legal"],
    "aside": ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "more-links", "rail", "recent", "popular", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad", "adsense", "promotion"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "banner", "privacy", "disclaimer", "message"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact-form", "search-form"],
    "comments": ["comments", "comment", "responses", "discussion", "replies", "reader-comments", "disqus", "comment-list", "feedback"],
    "share": ["share", "social", "social-links", "follow", "author-box"],
}
CONTENT = ["content", "post", "entry", "article", "story", "main", "entry-content", "post-body", "article-body", "text", "body-text", "page"]
ITEMS = ["comment", "reply", "comment-body", "opinion", "post", "message", "user", "author", "date", "box", "complementary"]
#: Their words.
NAMED = frozenset(w for names in (*NAMES.values(), CONTENT, ITEMS) for n in names for w in WORDS.findall(n))
SPACES = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of controls, notices and reader comments, told apart in short blocks and headings.
SIGNS = frozenset(
    "about accept account ad advertisement advertising ago agree all also april archive august author back buy by categories close comment comments contact continue "
    "cookies copyright december discussion download edit email enter february follow friday from home hours january join july june latest leave like login logout march may "
    "menu minutes monday more name navigation newsletter next november now october offer ok opinions options order password policy popular posted previous privacy read "
    "readers recent register related replies reply report reserved response responses rights sale said saturday says search see send september settings share shop sign "
    "sponsored submit subscribe sunday tags terms thursday topics trending tuesday up use view votes wednesday wrote you your".split()
)


class Element:
    """An open element as blocks see it: what of tags and names is around it is shared with its parent where it adds nothing.

    home is the nearest block element around it or itself, but for html and body, and depth the number of block elements so far.
    """

    __slots__ = ("tag", "number", "tags", "names", "home", "own", "depth", "apart", "times")

    def __init__(self, tag: str, number: int, names: frozenset[str], parent: Element | None, apart: bool):
        self.tag, self.number, self.names, self.apart, self.times = tag, number, names, apart, 1
        tags = parent.tags if parent else frozenset()
        self.tags = tags if tag in tags or tag not in KNOWN else tags | {tag}
        self.home, self.own, self.depth = (parent.home, parent.own, parent.depth) if parent else (None, "", 0)
        if tag in BLOCK:
            self.own, self.depth = tag, self.depth + 1
            if tag not in ("html", "body"):
                self.home = Home(tag, number, self.home)


class Home:
    """A block element among block elements."""

    __slots__ = ("tag", "number", "around")

    def __init__(self, tag: str, number: int, around: Home | None):
        self.tag, self.number, self.around = tag, number, around


@dataclass(slots=True)
class Block:
    """Text of a leaf block (spaces made one), the tags and name words around it, characters in links, and where it stands:
    its block element, that element's tag (`own`, html and body too) and how many block elements it lies in."""

    text: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int
    home: Home | None = None
    own: str = ""
    depth: int = 0

    def homes(self) -> tuple[Home | None, Home | None, Home | None]:
        """Its block element, the one around it and the one around that."""
        mother = self.home.around if self.home else None
        return self.home, mother, mother.around if mother else None


def named(attrs: str) -> tuple[set[str], bool]:
    """Name words of a tag's attributes, and whether it hides what is inside."""
    words, hidden = set(), False
    for a in ATTRIBUTE.finditer(attrs):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or (key == "style" and UNSEEN.search(value)):
            hidden = True
        elif key == "aria-hidden" and value.lower() == "true":
            words.add("ariahidden")
        elif key in NAMING:
            words.update(w for w in WORDS.findall(value.lower()) if w in NAMED)
    return words | {"hidden"} if hidden else words, hidden


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order. Comments, scripts, styles and markup are no text.

    Two line breaks in a row end a block, as a paragraph does. Of name words only
    those in NAMED are kept. The cost grows with the page, however deep it nests:
    an inline element within one of its kind is only counted.
    """
    out: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}  # how often a tag is on the stack
    parts: list[str] = []
    linked = at = breaks = 0
    count = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                top = stack[-1] if stack else Element("", 0, frozenset(), None, False)
                out.append(Block(text, top.tags, top.names, min(linked, len(text)), top.home, top.own, top.depth))
            parts.clear()
        linked = 0

    def pop(n: int) -> None:
        """Take all from place n on off the stack."""
        if any(x.apart for x in stack[n:]):
            flush()
        for x in stack[n:]:
            opened[x.tag] -= 1
        del stack[n:]

    size = len(page)
    while at < size:
        lt = page.find("<", at)
        found = TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and found is None:  # a bare "<" is text
            lt = page.find("<", lt + 1)
            found = TOKEN.match(page, lt) if lt >= 0 else None
        piece = page[at : lt if lt >= 0 else size]
        if piece:
            parts.append(piece)
            linked += len(piece) if opened.get("a") else 0
            breaks = breaks if piece.isspace() else 0
        if lt < 0:
            break
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        stack[i].times -= 1
                        if not stack[i].times:
                            pop(i)
                        break
                    if tag not in SCOPES and stack[i].tag in SCOPES:
                        break
            continue
        attrs = found["attrs"]
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not attrs.endswith("/") else None
            at = close.end() if close else size if not attrs.endswith("/") else at
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            shut = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1) if any(opened.get(t) for t in shut) else ():
                if stack[i].tag in shut:
                    pop(i)
                elif stack[i].tag in SCOPES:
                    break
        if tag in VOID:
            continue
        more, hidden = named(attrs) if attrs and attrs != "/" else (set(), False)
        parent = stack[-1] if stack else None
        around = parent.names if parent else frozenset()
        single = attrs.endswith("/") and tag not in BLOCK
        if tag not in BLOCK and not hidden and more <= around and not single:
            # Nothing new inside one of its kind with no block element between: only its end has to be found again.
            same = next((x for x in reversed(stack[-NEAR:]) if x.tag == tag or x.tag in BLOCK), None)
            if same is not None and same.tag == tag:
                same.times += 1
                continue
        apart = hidden and tag not in BLOCK
        if apart:
            flush()
        if not single:
            count += 1
            stack.append(Element(tag, count, around if more <= around else around | more, parent, apart))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def share_of(part: float, whole: float) -> int:
    """A share in four steps."""
    share = part / whole if whole else 0
    return 3 if share >= 0.7 else 2 if share >= 0.3 else 1 if share >= 0.08 else 0


def said(text: str) -> list[str]:
    """SIGNS among the words of a short text."""
    return [w for w in LETTERS.findall(text.lower()) if w in SIGNS] if len(text) <= 60 else []


def is_heading(b: Block) -> bool:
    return b.own in HEADINGS


def forms(found: list[Block]) -> list[str]:
    """For each block the form of the section it heads or stands in, up to the next heading: items, that is short texts between
    the others as names, dates and controls are, or prose, or nothing at all."""
    out, start = [""] * len(found), 0
    for end in range(1, len(found) + 1):
        if end == len(found) or is_heading(found[end]):
            inside = found[start + is_heading(found[start]) : end]
            short = sum(b.text.count(" ") < 4 and b.text[-1] not in STOPS for b in inside)
            form = "empty" if not inside else "prose" if not short else "items" if 3 * short >= len(inside) else "mixed"
            out[start:end] = [form] * (end - start)
            start = end
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Named features of each block: tags and name words around it, its own form and place on the page, and how much text stands beside it in the same elements."""
    out = []
    n = len(found)
    longest = max((len(b.text) for b in found), default=1)
    number = lambda h: h.number if h else 0
    tag_of = lambda h: h.tag if h else ""
    plain: dict[int, int] = {0: 0}  # text out of links, by block element; 0 is the page
    known: dict[int, Home] = {}
    kids: dict[int, int] = {}
    shapes: dict[tuple, set[int]] = {}  # like elements of an element
    for b in found:
        own, mother, grandmother = b.homes()
        plain[number(own)] = plain.get(number(own), 0) + len(b.text) - b.linked
        kids[number(mother)] = kids.get(number(mother), 0) + 1
        shapes.setdefault((number(grandmother), tag_of(mother)), set()).add(number(mother))
        while own and own.number not in known:
            known[own.number] = own
            own = own.around
    for i in sorted(known, reverse=True):  # an element has a larger number than those around it
        around = number(known[i].around)
        plain[around] = plain.get(around, 0) + plain.get(i, 0)
    mass = lambda h: plain[number(h)]
    top = max((mass(b.homes()[1]) for b in found), default=1)
    form = forms(found)
    heading: list[str] = []
    for i, b in enumerate(found):
        size = len(b.text)
        share = b.linked / size
        stops = sum(b.text.count(c) for c in STOPS)
        words = b.text.count(" ") + 1
        _, mother, grandmother = b.homes()
        f = ["bias", f"size{min(int(np.log2(size + 1)), 9)}", f"words{min(words.bit_length(), 7)}", f"links{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"]
        f.append(f"stops{min(stops, 3)}")
        f.append(f"last{b.text[-1] if b.text[-1] in '.!?:;,' else 'x'}")
        f.append("first" if i == 0 else "end" if i == n - 1 else f"at{4 * i // n}")
        f.append(f"part{min(int(4 * size / longest), 3)}")
        f.append(f"mass{share_of(mass(mother), top)}")
        f.append(f"mass2{share_of(mass(grandmother), plain[0])}")
        f.append(f"kids{min(kids[number(mother)].bit_length(), 4)}")
        f.append(f"twins{min(len(shapes[number(grandmother), tag_of(mother)]).bit_length(), 3)}of{min(kids[number(mother)].bit_length(), 3)}")
        f.append(f"depth{min(b.depth, 8)}")
        f += [f"in:{t}" for t in b.tags if t not in ("html", "body", "div", "span")]
        f += [f"named:{w}" for w in b.names]
        f.append(f"tag:{b.own}")
        signs = said(b.text)
        f += [f"says:{w}" for w in signs] + (["says"] if signs else [])
        f.append(f"section:{form[i]}")
        if is_heading(b):
            # What a heading says counts by the form of what it heads: readers' comments come as items, an article's section as prose.
            heading = [f"{w}:{form[i]}" for w in signs]
            f += [f"heads:{w}" for w in heading] + [f"heads:{form[i]}"]
        else:
            f += [f"under:{w}" for w in heading]
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if re.search(r"\d", b.text) and size <= 60:
            f.append("digits")
        out.append(f)
    return out
