"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each leaf block of a page is labelled main text or not. The field's weights are
on the tags and names around a block, on its form and place, and on pairs of
neighbouring labels; it is trained on labelled pages by gradient ascent and
decoded by Viterbi.

The labelled pages are laid out here from many arrangements of the parts that
pages have, around texts taken from a bounded sample of the table's own pages,
so that layouts unseen in the table are known as well.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, small_batches, strings, unit_hash
from .html_blocks import CONTENT, NAMES, SIGNS, blocks, features

#: Pages of the table whose texts fill the labelled pages, about, and labelled pages made.
SAMPLE_PAGES, LABELLED = 200, 3000
#: Characters that a page of the sample has at most, so that the sample is bounded in bytes, too.
SAMPLE_CHARS = 200_000
#: Rounds of training at most, and the gain in log-likelihood per block, over so many rounds, below which they end.
ROUNDS, GAIN, SPAN = 150, 5e-4, 10
OTHER, MAIN = 0, 1


@dataclass(frozen=True)
class Field:
    """Weights by feature (of OTHER, MAIN), of label pairs (from, to) and of the first label."""

    emit: dict[str, tuple[float, float]]
    pair: np.ndarray
    start: np.ndarray

    def scores(self, named: list[list[str]]) -> np.ndarray:
        zero = (0.0, 0.0)
        get = self.emit.get
        out = np.zeros((len(named), 2))
        for i, f in enumerate(named):
            w = [get(x, zero) for x in f]
            out[i] = sum(x[0] for x in w), sum(x[1] for x in w)
        return out

    def decode(self, named: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to OTHER."""
        if not named:
            return []
        emit = self.scores(named).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = emit[0][0] + float(self.start[0]), emit[0][1] + float(self.start[1])
        back = []
        for x, y in emit[1:]:
            from_a, from_b = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + p00 if from_a else b + p10), y + (a + p01 if from_b else b + p11)
        labels = [OTHER if a >= b else MAIN]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit_field(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, ridge: float = 0.3) -> Field:
    """Maximum-likelihood weights (with a ridge) by gradient ascent with adaptive steps, from pages' features and labels."""
    names = sorted({x for f, _ in pages for b in f for x in b})
    number = {x: i for i, x in enumerate(names)}
    pages = [p for p in pages if p[0]]
    lengths = np.array([len(p[0]) for p in pages], np.int64)
    starts = offsets(lengths)
    cols = np.array([number[x] for f, _ in pages for b in f for x in b], np.int64)
    rows = np.repeat(np.arange(int(starts[-1])), [len(b) for f, _ in pages for b in f])
    labels = np.array([y for _, ys in pages for y in ys], np.int64)
    weights = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    square = [np.full_like(w, 1e-8) for w in weights]
    longest = int(lengths.max(initial=0))
    alive = [np.flatnonzero(lengths > t) for t in range(longest)]

    def counts(marginal, pairs, first) -> list[np.ndarray]:
        emit = np.column_stack([np.bincount(cols, marginal[rows, k], len(names)) for k in (0, 1)])
        return [emit, pairs, first]

    hard = np.eye(2)[labels]
    inner = np.ones(len(labels), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (labels[at - 1], labels[at]), 1)
    true = counts(hard, true_pairs, hard[starts[:-1]].sum(axis=0))
    history: list[float] = []
    for _ in range(rounds):
        emit = np.column_stack([np.bincount(rows, weights[0][cols, k], len(labels)) for k in (0, 1)])
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[starts[:-1]] = emit[starts[:-1]] + weights[2]
        for t in range(1, longest):
            here = starts[:-1][alive[t]] + t
            forward[here] = emit[here] + np.logaddexp.reduce(forward[here - 1][:, :, None] + weights[1], axis=1)
        for t in range(longest - 1, 0, -1):
            here = starts[:-1][alive[t]] + t
            backward[here - 1] = np.logaddexp.reduce((emit[here] + backward[here])[:, None, :] + weights[1], axis=2)
        total = np.repeat(np.logaddexp.reduce(forward[starts[1:] - 1], axis=1), lengths)
        marginal = np.exp(forward + backward - total[:, None])
        joint = forward[at - 1][:, :, None] + weights[1] + (emit[at] + backward[at])[:, None, :] - total[at][:, None, None]
        # The likelihood per block: what the true labels score, less what all labels of a page do together.
        likely = sum(float((a * w).sum()) for a, w in zip(true, weights)) - float(total[starts[:-1]].sum())
        likely /= len(labels)
        history.append(likely)
        if len(history) > SPAN and history[-1] - max(history[:-SPAN]) < GAIN:
            break
        found = counts(marginal, np.exp(joint).sum(axis=0), marginal[starts[:-1]].sum(axis=0))
        for k, w in enumerate(weights):
            slope = true[k] - found[k] - ridge * w
            square[k] += slope**2
            w += 0.5 * slope / np.sqrt(square[k])
    return Field({x: (float(a), float(b)) for x, (a, b) in zip(names, weights[0])}, weights[1], weights[2])


#: Short texts found in the parts beside the main text.
NOTICES = ["We use cookies to improve this site.", "Accept all", "Subscribe to our newsletter", "Sign in", "Your email", "All rights reserved.", "Advertisement", "Sponsored", "Read more", "Share this", "Reply", "Search", "Home", "About", "Contact", "Privacy policy", "Terms of use", "Buy now", "See our latest offer", "Follow us", "Next", "Back to top", "Related posts", "Most popular"]
PEOPLE = "Ann Bob Carla Dmitri Elif Femi Greta Hugo Inés Jun Kofi Lena Marc Nadia Omar Pia Quentin Rosa Sven Tove Uma Viktor Wanda Xin Yusuf Zoe".split()
TALK = ["Comments", "{n} comments", "Comments ({n})", "Responses", "Discussion", "What readers say", "Reader opinions", "Join the discussion", "{n} replies", "Leave a reply"]
WHEN = ["{n} May 2021", "{n} hours ago", "March {n}, 2020", "2019-04-{n}", "Posted on {n} June", "yesterday"]
HIDDEN = [' style="display:none"', ' style="display: none;"', " hidden", ' hidden="hidden"', ' style="visibility:hidden"']


class Layout:
    """A page of a random layout. `marks` tells of each text whether it is main text; each starts with a mark by which its label is found again."""

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts, self.marks = rng, texts, []
        #: Whether elements have telling names, and whether all are div elements.
        self.names, self.bare = rng.random() < 0.75, rng.random() < 0.3

    def maybe(self, chance: float) -> bool:
        return self.rng.random() < chance

    def mark(self, text: str, main: bool) -> str:
        self.marks.append(main)
        return f"\x02{len(self.marks) - 1}\x03" + escape(text, quote=False)

    def long(self, main: bool) -> str:
        return self.mark(self.rng.choice(self.texts), main)

    def few(self, least: int, most: int) -> str:
        """Some words of a text."""
        words = self.rng.choice(self.texts).split()
        a = self.rng.randrange(len(words))
        return " ".join(words[a : a + self.rng.randint(least, most)])

    def title(self) -> str:
        return self.mark(self.few(2, 10), True)

    def short(self) -> str:
        return self.mark(self.rng.choice([self.few(1, 4), self.rng.choice(NOTICES)]), False)

    def brief(self, main: bool) -> str:
        """One or two short sentences, now and then a word or two alone."""
        if self.maybe(0.15):
            return self.mark(self.few(1, 3).rstrip(".,") + self.rng.choice(["", "."]), main)
        return self.mark(" ".join(self.few(2, 7).rstrip(".,") + "." for _ in range(self.rng.randint(1, 2))), main)

    def name(self, kind: str) -> str:
        rng = self.rng
        if not self.names or self.maybe(0.15):
            odd = "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(1, 6)))
            return rng.choice(["", "", f' class="{odd}"', f' class="{odd}-{rng.randint(1, 9)}"', f' data-id="{rng.choice(CONTENT)}"', ' style="margin:0"'])
        n = rng.choice(NAMES[kind] if kind in NAMES else CONTENT)
        return rng.choice([f' class="{n}"', f' id="{n}"', f' class="{n} box"', f' class="{n}-{rng.randint(1, 9)}" role="complementary"' if kind in NAMES else f' class="{n}" '])

    def tag(self, *tags: str) -> str:
        return "div" if self.bare else self.rng.choice(tags)

    def links(self, n: int) -> str:
        made = [f'<a href="/{i}">{self.short()}</a>' for i in range(n)]
        form = self.rng.random()
        if form < 0.6 and not self.bare:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in made) if form < 0.8 else self.rng.choice([" | ", " ", "<br>"]).join(made)

    def wrap(self, tag: str, attrs: str, inside: str) -> str:
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def paragraph(self, main: bool = True) -> str:
        # Main text may hold a sentence that elsewhere is a notice, too.
        text = self.brief(main) if self.maybe(0.2) else self.mark(self.rng.choice(NOTICES), main) if not self.bare and self.maybe(0.06) else self.long(main)
        if self.bare:
            return self.wrap(self.rng.choice(["div", "div", "p"]), "", text)
        form = self.rng.random()
        if form < 0.7:
            return f"<p>{text}</p>" if form < 0.62 else f"<p>{text}"
        if form < 0.74:
            return f"<p>{text} <span{self.rng.choice(HIDDEN)}>{self.short()}</span></p>"
        if form < 0.78:
            return f"<figure><img src=x><figcaption>{text}</figcaption></figure>"
        if form < 0.81:
            n, cells = self.rng.randint(1, 3), lambda tag, n: "".join(f"<{tag}>{self.mark(self.few(1, 3), main)}</{tag}>" for _ in range(n))
            rows = [cells("th", n + 1)] if self.maybe(0.5) else []
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in [*rows, f"<td>{text}</td>" + cells("td", n), *[cells("td", n + 1) for _ in range(self.rng.randint(0, 2))]]) + "</table>"
        if form < 0.84:
            return f"<pre>{text}</pre>"
        if form < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if form < 0.93:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in [text, *[self.brief(main) for _ in range(self.rng.randint(0, 3))]]) + "</ul>"
        return f"<h2>{self.title()}</h2><p>{text}</p>" if main else f"<p>{text}</p>"

    def section(self) -> str:
        """A heading that holds a word of controls or comments, above prose of the article."""
        sign = self.rng.choice(sorted(SIGNS)).capitalize()
        said = self.rng.choice([f"{sign} {self.few(1, 4)}", f"{self.few(1, 3)} {sign.lower()}", sign])
        return self.wrap(self.rng.choice(["h2", "h3", "h4"]), "", self.mark(said, True)) + "".join(self.paragraph() for _ in range(self.rng.randint(1, 2)))

    def steps(self) -> str:
        """A list of short items."""
        end = self.rng.choice([".", ".", ""])
        items = [self.mark(self.few(1, 5).rstrip(".,") + end, True) for _ in range(self.rng.randint(2, 7))]
        return self.wrap(self.rng.choice(["ol", "ol", "ul"]), "", "".join(f"<li>{x}</li>" for x in items))

    def broken(self, least: int = 1) -> str:
        """Paragraphs parted by line breaks alone."""
        return self.rng.choice(["<br><br>", "<br/><br/>", "<br>\n<br>"]).join(self.rng.choice([self.long, self.long, self.brief])(True) for _ in range(self.rng.randint(least, 5)))

    def comments(self) -> str:
        """Readers' comments: like items of a name, a date, some text and a control or two."""
        rng = self.rng
        outer, item = self.tag("section", "div", "div", "ol", "ul"), self.tag("div", "li", "article", "div")
        item = "li" if outer in ("ol", "ul") else "div" if item == "li" else item
        inner = rng.choice(["comment", "reply", "comment-body", "opinion", "post", "message"])
        attrs = f' class="{inner}"' if self.names and self.maybe(0.7) else ""
        who, when, control = self.maybe(0.85), self.maybe(0.6), self.maybe(0.6)

        def one() -> str:
            head = []
            if who:
                person = rng.choice(PEOPLE) + rng.choice(["", f" {rng.choice('ABCDEFGHIK')}.", str(rng.randint(1, 99))]) + rng.choice(["", ":", " says:", " wrote:"])
                head.append(self.wrap(rng.choice(["b", "span", "div", "strong", "h4"]), "", self.mark(person, False)))
            if when:
                head.append(self.wrap(rng.choice(["span", "div", "time", "small"]), "", self.mark(rng.choice(WHEN).format(n=rng.randint(1, 28)), False)))
            body = self.brief(False) if self.maybe(0.6) else self.long(False)
            made = "".join(head) + self.wrap(self.tag("p", "p", "div"), "", body)
            return self.wrap(item, attrs, made + (f'<a href="#">{self.mark(rng.choice(["Reply", "Report", "Like", "Share"]), False)}</a>' if control else ""))

        title = self.wrap(self.tag("h2", "h3", "h4", "p"), "", self.mark(rng.choice(TALK).format(n=rng.randint(2, 90)), False)) if self.maybe(0.7) else ""
        items = "".join(one() for _ in range(rng.randint(1, 5)))
        if outer in ("ol", "ul"):
            return self.wrap("div", self.name("comments"), title + self.wrap(outer, "", items))
        return self.wrap(outer, self.name("comments"), title + items)

    def part(self, kind: str) -> str:
        """A part of the page beside its main text."""
        rng = self.rng
        if kind == "comments":
            return self.comments()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section")
        tag = "div" if self.bare or self.maybe(0.5) else own
        telling = tag == own and tag != "section"
        attrs = "" if telling and self.maybe(0.5) else self.name(kind)
        # Without a telling tag or name only the form of a part tells it from main text.
        prose = telling or (self.names and attrs and "data-id" not in attrs and "style" not in attrs)
        if kind == "hidden":
            return self.wrap(rng.choice(["div", "p", "section"]), rng.choice(HIDDEN), rng.choice([self.long, self.brief])(False))
        if kind == "nav" or (kind == "aside" and self.maybe(0.5)):
            inside = self.links(rng.randint(2, 7))
        elif kind == "form":
            inside = f"<label>{self.short()}</label><input><button>{self.short()}</button>"
        elif kind == "share":
            inside = " ".join(f"<a href='#'>{self.short()}</a>" for _ in range(rng.randint(1, 4)))
        elif kind == "footer":
            notice = self.mark(rng.choice(["© 2020 ", "Copyright 2019 ", "(c) ", ""]) + self.few(1, 3) + rng.choice(["", " All rights reserved."]), False)
            inside = rng.choice([notice, f"<p>{notice}</p>", notice + self.links(2)]) if not prose or self.maybe(0.6) else self.long(False)
        elif prose:
            inside = rng.choice([lambda: self.long(False), self.short, lambda: f"<p>{self.long(False)}</p>", lambda: f"<h3>{self.short()}</h3><p>{self.long(False)}</p>"])()
        else:
            inside = rng.choice([lambda: self.mark(rng.choice(NOTICES), False), lambda: self.mark(rng.choice(NOTICES), False) + self.links(1)])()
        return self.wrap(tag, attrs, inside)

    def content(self) -> str:
        rng = self.rng
        few = self.maybe(0.15)  # an article of a line or two
        heading = "".join(f"<{t}>{self.title()}</{t}>" for t in [rng.choice(["h1", "h2", "div", "div"] if self.bare else ["h1", "h1", "h2"])] if self.maybe(0.75))
        if heading and not self.bare and self.maybe(0.3):
            heading = f"<header{rng.choice(['', self.name('content')])}>{heading}</header>"
        inside = [self.wrap("p" if not self.bare else "div", "", self.brief(True))] if few else [self.paragraph() for _ in range(rng.randint(1, 8))]
        if self.maybe(0.12):
            inside = [self.broken()]
        if self.maybe(0.2):
            inside.append(self.section())
        if self.maybe(0.2):
            inside.insert(rng.randint(0, len(inside)), self.steps())
        for kind in rng.sample(["ad", "share", "aside", "form", "notice", "hidden", "hidden"], rng.choice([0, 0, 0, 1, 1, 2])):
            inside.insert(rng.randint(0, len(inside)), self.part(kind))
        if self.bare and self.maybe(0.3):
            inside = [f"<div>{x}</div>" for x in inside]
        made = heading + "".join(inside)
        if self.maybe(0.25):
            made += self.comments()
        tag = self.tag("article", "main", "div", "section", "article")
        named = self.names and (tag in ("div", "section") or self.maybe(0.4))
        made = self.wrap(tag, self.name("content") if named else "", made) if tag != "div" or named or self.maybe(0.6) else made
        return f"<main>{made}</main>" if tag != "main" and not self.bare and self.maybe(0.2) else made

    def page(self) -> str:
        rng = self.rng
        plenty = rng.choice([0, 0.3, 0.45, 0.45])
        form = rng.random()
        head = f"<head><title>{self.mark(self.few(2, 8), False)}</title></head>" if self.maybe(0.85) else ""
        if form > 0.985:  # nothing but a text
            text = rng.choice([lambda: self.mark(self.few(1, 6), True), lambda: self.brief(True), lambda: self.long(True)])()
            return rng.choice([text, f"<html><body>{text}</body></html>", self.wrap(rng.choice(["span", "p", "div"]), "", text)])
        if form < 0.06:  # no element around the text at all
            title = rng.choice(["", self.title() + "<br><br>", f"<b>{self.title()}</b><br><br>", f"<h1>{self.title()}</h1>"])
            links = self.rng.choice([" | ", " ", " - "]).join(f'<a href="/{i}">{self.short()}</a>' for i in range(rng.randint(2, 6)))
            foot = self.mark(rng.choice(["© 2020 ", "Copyright 2019 ", "(c) "]) + self.few(1, 3), False)
            text = rng.choice([lambda: self.broken(), lambda: self.long(True), lambda: self.brief(True), lambda: self.mark(self.few(1, 3), True), lambda: self.broken(2)])()
            parts = [links if self.maybe(0.5) else "", title + text, foot if self.maybe(0.5) else ""]
            body = rng.choice(["<br><br>", "<hr>"]).join(x for x in parts if x)
            return rng.choice([f"<html>{head}<body>{body}</body></html>", head + body, body])
        if form < 0.13:  # laid out by a table
            cell = lambda x, more="": f"<td{more}>{x}</td>"
            side = [cell(self.links(rng.randint(2, 6)), rng.choice(["", ' width="20%"', ' class="menu"']))] if self.maybe(0.8) else []
            top = f"<tr>{cell(rng.choice([self.links(rng.randint(2, 6)), self.short()]))}</tr>" if self.maybe(0.6) else ""
            row = [*side, cell(rng.choice([self.content, self.content, lambda: self.broken(2)])())]
            foot = f"<tr>{cell(self.mark(rng.choice(['© 2020 ', 'Copyright 2019 ']) + self.few(1, 3), False))}</tr>" if self.maybe(0.7) else ""
            return f"<html>{head}<body><table>{top}<tr>{''.join(row if self.maybe(0.8) else row[::-1])}</tr>{foot}</table></body></html>"
        before = [self.part(k) for k in ("header", "nav", "notice", "ad", "form", "aside", "hidden") if self.maybe(plenty)]
        middle = self.content()
        after = [self.part(k) for k in ("comments", "aside", "ad", "form", "share", "notice", "footer", "hidden") if self.maybe(plenty)]
        rng.shuffle(before)
        return f"<html>{head}<body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def layout(rng: random.Random, texts: list[str]) -> tuple[str, list[bool]]:
    """A page of a random layout, and for each of its texts whether it is main text."""
    made = Layout(rng, texts)
    return made.page(), made.marks


def labelled(rng: random.Random, texts: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a laid-out page; a block's label is that of its first mark."""
    page, marks = layout(rng, texts)
    found, labels, clean = blocks(page), [], []
    for b in found:
        first, _, rest = b.text.partition("\x03")
        labels.append(int(marks[int(first.rpartition("\x02")[2])]))
        plain = " ".join(x.rpartition("\x02")[0] if "\x02" in x else x for x in rest.split("\x03")).strip() or "x"
        clean.append(replace(b, text=plain, linked=min(b.linked, len(plain))))
    return features(clean), labels


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = LABELLED, seed: int = 4) -> Field:
    """Fit a field on `made` labelled pages around texts of about `sample` pages of at most SAMPLE_CHARS, chosen by a hash of page_id."""
    usable = pages.select("page_id", "html").filter((F.length("html") <= SAMPLE_CHARS) & F.col("page_id").isNotNull())
    n = usable.select("page_id").count()
    rows = usable.filter(unit_hash(F.col("page_id"), F.lit(seed)) < min(1.0, sample / max(n, 1))).orderBy("page_id").limit(2 * sample).collect()
    texts = [b.text for r in rows for b in blocks(r["html"]) if len(b.text) > 20 and b.text.count(" ") > 2] or ["A sentence of some length. Another one follows it."]
    rng = random.Random(seed)
    return fit_field([labelled(rng, texts) for _ in range(made)])


def main_text(field: Field, page: str) -> tuple[str, int, int]:
    """Main text of a page, its blocks, and how many of them are main text."""
    found = blocks(page)
    chosen = field.decode(features(found))
    kept = [b.text for b, y in zip(found, chosen) if y == MAIN]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks, n_kept.

    text: the main blocks in page order, joined by one space; white space in a
    block is one space and character references are decoded. A null or empty
    page has no text. Repeated rows each get a row; other columns are ignored;
    no rows give no rows.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(field)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(sent.value, p) for p in strings(b.column(2))]
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), long([len(g[0]) for g in got]), long([g[1] for g in got]), long([g[2] for g in got])],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_kept long")
