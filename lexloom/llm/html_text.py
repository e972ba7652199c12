"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page, decoded by Viterbi.

No table holds labelled pages, so the field is trained on pages that `labelled_pages` writes by rule: many layouts, each block
known to be article or not. Features are the tags and class words above a block and the form of its text, never words of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import carry, column_bytes, table

Block = tuple[str, list[str]]
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: These stand in a line too, with what drawings and formulas are made of.
INLINE |= frozenset("canvas math noscript object svg annotation mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics circle defs ellipse g line path polygon polyline rect text tspan use".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw, no text of the page: up to the end tag, or to the page's end, as browsers read them.
SILENT = frozenset("script style iframe textarea".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


class _Open:
    """The open elements, with the features they give to what stands in them: kept up to date as elements come and go, so that no
    block walks up to the root. With weights, the features that have one are added up instead."""

    def __init__(self, weights: dict[str, float] | None):
        self.weights, self.sum = weights, 0.0
        self.stack: list[tuple[str, list[str], str]] = []
        self.count: dict[str, int] = {}
        self.active: dict[str, int] = {}
        self.own: list[int] = []  # places of elements that stand on lines of their own

    def push(self, name: str, words: list[str]) -> None:
        parent = self.stack[-1][2] if self.stack else ""
        given: list[str] = []
        if name not in INLINE:
            self.own.append(len(self.stack))
            if name not in ("html", "body"):
                given = [f"in {name}", *(f"class {w}" for w in words), *([f"{parent} > {name}"] if parent else ())]
                parent = name
        self.stack.append((name, given, parent))
        self.count[name] = self.count.get(name, 0) + 1
        for f in given:
            n = self.active[f] = self.active.get(f, 0) + 1
            if n == 1 and self.weights:
                self.sum += self.weights.get(f, 0.0)

    def cut(self, at: int) -> None:
        """Closes the elements from a place on."""
        while len(self.stack) > at:
            name, given, _ = self.stack.pop()
            self.count[name] -= 1
            if self.own and self.own[-1] == len(self.stack):
                self.own.pop()
            for f in given:
                if self.active[f] > 1:
                    self.active[f] -= 1
                else:
                    del self.active[f]
                    if self.weights:
                        self.sum -= self.weights.get(f, 0.0)
        if not self.active:
            self.sum = 0.0

    def close(self, name: str) -> None:
        """The innermost open element of this name and what is open in it; none, if there is none."""
        if self.count.get(name):
            at = len(self.stack) - 1
            while self.stack[at][0] != name:
                at -= 1
            self.cut(at)

    def leaf(self) -> str:
        return f"leaf {self.stack[-1][2] if self.stack else ''}"


def _tags(page: str):
    """(kind, from, to, name, attributes) of the page's pieces, in order: text, start, end.

    Every piece is looked at once: a tag whose quotes are not closed ends at the next `>`, and so do all tags after it.
    """
    at, end, quoted, last = 0, len(page), True, page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", at, end, "", ""
            return
        if lt > at:
            yield "text", at, lt, "", ""
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if after in "!?" and after:
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = START.match(page, lt) if lt < last else None
        if not m:
            yield "text", lt, lt + 1, "", ""
            at = lt + 1
            continue
        stop, from_ = -1, m.end()
        while quoted and stop < 0:
            found = STOP.search(page, from_)
            if found and found[0] == ">":
                stop = found.start()
                continue
            from_ = page.find(found[0], found.end()) + 1 if found else 0
            quoted = from_ > 0
        if stop < 0:
            stop = page.find(">", m.end())
        name, attributes, at = m[2].lower(), page[m.end() : stop], stop + 1
        if name in SILENT and not m[1]:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        yield "end" if m[1] else "start", lt, at, name, attributes


def blocks(page: str, weights: dict[str, float] | None = None) -> list[Block] | list[tuple[str, float]]:
    """Leaf blocks in page order: text with references decoded and white space made one space, and features of its ancestors; with
    weights, the sum of the weights of the features in their place.

    Unclosed and stray tags, bare `<` and unended comments are read as browsers read them or nearly so; nothing is dropped but
    comments, declarations and the content of SILENT elements. Time goes with the length of the page, however deep it nests.
    """
    out: list = []
    run: list[str] = []
    open_ = _Open(weights)
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        text = "".join(run)
        run.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            form = [open_.leaf(), *_form(text, linked / max(1, total))]
            out.append((text, [*open_.active, *form] if weights is None else open_.sum + sum(weights.get(f, 0.0) for f in form)))
        linked = total = 0

    for kind, from_, to, name, attributes in _tags(page):
        if kind == "text":
            run.append(page[from_:to])
            total += to - from_
            if open_.count.get("a"):
                linked += to - from_
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            run.append(" ")
        if name in VOID:
            continue
        if kind == "end":
            open_.close(name)
            continue
        if name in CLOSES and open_.own and open_.stack[open_.own[-1]][0] in CLOSES[name]:
            open_.cut(open_.own[-1])
        if not attributes.rstrip().endswith("/"):
            named = NAMES.findall(attributes) if "=" in attributes else ()
            open_.push(name, [w for x in named for w in WORD.findall("".join(x).lower())])
    flush()
    return out


def _form(text: str, linked: float) -> list[str]:
    out = ["any", "size " + ("1" if len(text) < 25 else "2" if len(text) < 80 else "3" if len(text) < 250 else "4")]
    if linked > 0.6:
        out.append("links")
    if text[-1:] in ".!?":
        out.append("sentence")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "»" in text:
        out.append("bars")
    return out


class Field:
    """Labels 0 and 1 (article); weights of features in favour of 1, and of steps from one label to the next."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.steps = np.zeros((2, 2))

    def scores(self, page: list[Block]) -> np.ndarray:
        get = self.weights.get
        return np.array([sum(get(f, 0.0) for f in own) for _, own in page])

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi, from the scores of the blocks."""
        if not len(scores):
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        best0, best1, back = 0.0, 0.0, []
        for i, s in enumerate(scores):
            if i:
                a, b = best0 + s00, best1 + s10
                c, d = best0 + s01, best1 + s11
                back.append((a < b, c < d))
                best0, best1 = max(a, b), max(c, d)
            best1 += s
        label = int(best1 > best0)
        out = [label]
        for came in reversed(back):
            label = int(came[label])
            out.append(label)
        return out[::-1]

    def gradient(self, page: list[Block], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: by block in favour of label 1, and by step; forward and backward in log space."""
        s, n = self.scores(page), len(page)
        score = np.column_stack([np.zeros(n), s])
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = score[0]
        for i in range(1, n):
            fore[i] = score[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.steps, axis=0)
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(self.steps + score[i + 1] + aft[i + 1], axis=1)
        z = np.logaddexp.reduce(fore[-1])
        y = np.array(labels)
        block = y - np.exp(fore[:, 1] + aft[:, 1] - z)
        step = np.zeros((2, 2))
        for i in range(1, n):
            step -= np.exp(fore[i - 1][:, None] + self.steps + score[i] + aft[i] - z)
            step[y[i - 1], y[i]] += 1
        return block, step


def train(pages: list[tuple[str, list[int]]], rounds: int = 12, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """Stochastic gradient steps with per-feature rates; pages: html and the label of each of its blocks."""
    field, seen, steps_seen = Field(), {}, np.full((2, 2), 1e-6)
    read = [(blocks(page), labels) for page, labels in pages]
    for _ in range(rounds):
        for page, labels in read:
            if not page:
                continue
            block, step = field.gradient(page, labels)
            grad: dict[str, float] = {}
            for g, (_, own) in zip(block.tolist(), page):
                for f in own:
                    grad[f] = grad.get(f, 0.0) + g
            for f, g in grad.items():
                g -= decay * field.weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                field.weights[f] = field.weights.get(f, 0.0) + rate * g / seen[f] ** 0.5
            steps_seen += step**2
            field.steps += rate * step / np.sqrt(steps_seen)
    return field


#: Elements around articles, and around all else, as the training pages have them.
ARTICLE = ("article", "main", "div content", "div article body", "div post", "div entry content", "section story", "div main text", "article post", "")
OTHER = (
    "nav", "header", "footer", "aside", "form", "div sidebar", "div ad", "div ads", "div advert", "div advertisement", "div banner", "div sponsor", "div sponsored", "div promo", "div cookie notice",
    "div cookie consent", "div notice", "div alert", "div newsletter", "div subscribe", "div signup", "div comments", "section comments", "div comment", "ol comment list", "div respond", "div related",
    "div share", "div social", "div breadcrumb", "div breadcrumbs", "div menu", "ul menu", "div nav", "div navbar", "div pagination", "div copyright", "div disclaimer", "div footer", "div header",
    "div login", "div search", "div popup", "div modal", "div widget", "aside sidebar", "dialog", "div tags", "div toolbar", "section reviews", "div feedback",
)


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def prose(low: int, high: int, stop: str = ".") -> str:
        words = ["".join(pick("aeioubcdlmnrst") for _ in range(rng.integers(2, 9))) for _ in range(rng.integers(low, high))]
        return " ".join(words).capitalize() + stop

    def opened(kind: str) -> tuple[str, str]:
        if not kind:
            return "", ""
        tag, *words = kind.split()
        name = f' {pick(["class", "class", "id"])}="{pick([" ", "-", "_"]).join(words)}"' if words else ""
        return f"<{tag}{name}>", f"</{tag}>"

    def other(kind: str, inside: bool = False) -> tuple[str, list[int]]:
        a, z = opened(kind)
        shape = "p" if inside and rng.random() < 0.4 else pick(["links", "links", "text", "p", "p", "list", "lines"])
        k = int(rng.integers(1, 6))
        if shape == "links":
            return f"{a}<ul>" + "".join(f'<li><a href="/">{prose(1, 3, "")}</a></li>' for _ in range(k)) + f"</ul>{z}", [0] * k
        if shape == "text":
            return f"{a}{pick(['&copy; ', '', ''])}{prose(3, 40)}{z}" if a else "", [0] if a else []
        if shape == "list":
            return f"{a}<ul>" + "".join(f"<li>{prose(4, 30)}</li>" for _ in range(k)) + f"</ul>{z}", [0] * k
        if shape == "lines":
            return f"{a}" + "".join(f"<div>{prose(1, 25, pick(['', '.']))}</div>" for _ in range(k)) + z, [0] * k
        return f"{a}{pick(['', '<h3>' + prose(1, 5, '') + '</h3>'])}" + "".join(f"<p>{prose(3, 60)}</p>" for _ in range(k)) + z, []

    out = []
    for _ in range(n):
        parts: list[tuple[str, list[int] | int]] = [(f"<head><title>{prose(2, 9, '')}</title></head><body>", 0)]
        parts += [(other(pick(OTHER))[0], 0) for _ in range(rng.integers(0, 5))]
        kind = pick(ARTICLE)
        a, z = opened(kind)
        wrap = pick(["", "", "<div>"])
        parts.append((wrap + a, 1))
        head = f"<{(h := pick(['h1', 'h1', 'h2']))}>{prose(2, 12, pick(['', '.']))}</{h}>"
        parts.append((f"<header>{head}</header>" if kind == "article" and rng.random() < 0.3 else head, 1))
        for _ in range(rng.integers(1, 9)):
            roll = rng.random()
            if roll < 0.72:
                parts.append((pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} <a href='/x'>link</a> more text.</p>", "<div>{}</div>"]).format(prose(2, 90)), 1))
            elif roll < 0.8:
                parts.append(("<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(3)) + "</ul>", 1))
            elif roll < 0.86:
                parts.append((f"<h2>{prose(1, 7, '')}</h2>", 1))
            elif roll < 0.9:
                parts.append((f"<blockquote><p>{prose(5, 40)}</p></blockquote>", 1))
            elif roll < 0.93:
                parts.append((f"<table><tr><td>{prose(1, 4, '')}</td><td>{prose(1, 9)}</td></tr></table><pre>{prose(3, 9)}</pre>", 1))
            else:
                parts.append((other(pick(OTHER), True)[0], 0))
        parts.append((z + ("</div>" if wrap else ""), 1))
        parts += [(other(pick(OTHER))[0], 0) for _ in range(rng.integers(0, 5))]
        page, labels, before = "", [], 0
        for text, label in parts:
            page += text
            now = len(blocks(page))
            labels += [int(label)] * (now - before)
            before = now
        out.append((f"<html>{page}</body></html>", labels))
    return [(page, labels) for page, labels in out if len(blocks(page)) == len(labels)]


@cache
def trained() -> Field:
    return train(labelled_pages())


def main_text(field: Field, page: str) -> str:
    own = blocks(page, field.weights)
    return "\n\n".join(text for (text, _), label in zip(own, field.decode([s for _, s in own])) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages (with html) and `text`, `n_chars` in place of columns of these names; one pass, no shuffle.

    Null and empty pages, and pages without an article, give empty text. Very long and deeply nested pages are read whole, in time
    that goes with their length. Repeated rows are read alike, whatever their ids; an empty table gives an empty result.
    """
    kept = pages.drop("text", "n_chars")
    carried = carry(pages.sparkSession, field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(carried(), x.decode()) if x else "" for x in column_bytes(batch, "html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return kept.mapInArrow(run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
