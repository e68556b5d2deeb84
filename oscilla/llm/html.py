"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a sparse vector of hashed tag-path parts (tags, classes,
ids, roles), hashed words and a few measures; a bidirectional LSTM in numpy reads the whole sequence both ways and
classifies every block with the document as its context. The weights beside this module come from
:mod:`oscilla.llm.html_train`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 1024, 128, 8, 24
SLOTS = PATH_SLOTS + WORD_SLOTS + MEASURES
WEIGHTS = Path(__file__).with_name("html_weights.npz")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)",
    re.S,
)
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea noembed noframes".split())
#: Their text is no markup: without a closing tag they go on to the end of the page, as in browsers.
_OPAQUE = frozenset("script style".split())
_FOREIGN = frozenset("svg math".split())
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("table ul ol dl div section article main aside nav header footer form body html blockquote td th select".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Ends:
    """Where tags end: at the next ``>`` that isn't quoted; a quote that nothing closes quotes nothing."""

    def __init__(self, page: str):
        self.page = page
        self.alone: set[str] = set()  # quotes that don't occur any more
        self.plain = False  # all that is left stands in quotes: they count no more, so that no page is read again and again

    def after(self, start: int) -> int:
        """The place after the tag whose name ends at ``start``; -1 if it has no end."""
        at = start
        while not self.plain:
            m = _STOP.search(self.page, at)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            else:
                closed = -1 if m[0] in self.alone else self.page.find(m[0], m.end())
                if closed < 0:
                    self.alone.add(m[0])
                at = max(m.end(), closed + 1)
        return self.page.find(">", start) + 1 or -1


class Leaf:
    """One block: its text, the names on its path, and how much of it is links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        found += [f"{m[1][0].lower()}:{n}" for n in _NAME.findall(value.lower())]
    return tuple(found)


def leaves(page: str) -> list[Leaf]:
    """The page's blocks in order: text between tags that aren't inline, references decoded, white space one space."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    above: list[tuple[str, ...]] = [()]  # the distinct names of all elements open before each; one tuple while none is new
    found: list[Leaf] = []
    runs: list[str] = []
    closers: dict[str, re.Pattern[str]] = {}
    unclosed: set[str] = set()
    ends = _Ends(page)
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                path = above[-1] + (stack[-2][1] if len(stack) > 1 else ()) + (stack[-1][1] if stack else ())
                found.append(Leaf(text, path, min(linked, len(text))))
            runs.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            runs.append(text)
            if links:
                linked += len(text.strip())

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            links -= stack.pop()[0] == "a"
            above.pop()

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m[2] is not None:
            end = ends.after(m.end())
            if end < 0:  # no tag is left
                add(page[at:])
                break
            attributes = page[m.end() : end - 1]
        add(page[at : m.start()])
        at = end if m[2] is not None else m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in _INLINE
        if not inline:
            flush()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None and not (inline and any(t in _SCOPES for t, _ in stack[k:])):
                close(k)
            continue
        if tag == "br":
            runs.append(" ")
        if tag in _FOREIGN and attributes.endswith("/"):
            continue
        if tag in _RAW or tag == "xmp":
            if tag not in closers:
                closers[tag] = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I)
            # No closing tag after one place: none after a later one either.
            end = None if tag in unclosed else closers[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
            if tag == "xmp":
                runs.append(page[at : end.start() if end else len(page)])
                flush()
            if end or tag in _OPAQUE or tag == "xmp":
                at = end.end() if end else len(page)
                continue
        if tag in _VOID or attributes.endswith("/") and tag not in _SCOPES and tag != "p":
            continue
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in _SCOPES and not (tag == "tr" and stack[k][0] in ("td", "th")):
                    break
        stack.append((tag, _names(tag, attributes)))
        above.append(above[-1] + new if (new := tuple(dict.fromkeys(n for n in stack[-1][1] if n not in above[-1]))) else above[-1])
        links += tag == "a"
    flush()
    return found


@lru_cache(maxsize=200_000)
def _slot(name: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) % size


def vectors(blocks: list[Leaf]) -> list[tuple[list[int], list[float]]]:
    """Slots and values of each block."""
    found = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        path = {_slot(x, PATH_SLOTS) for x in b.path} | {_slot("^" + ">".join(b.path[-2:]), PATH_SLOTS)}
        words = b.text.split()
        some = {PATH_SLOTS + xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "replace")) % WORD_SLOTS for w in words}
        marks = sum(b.text.count(c) for c in ".!?")
        base = PATH_SLOTS + WORD_SLOTS
        measures = [
            1.0, min(8.0, np.log1p(len(words))) / 4, b.linked / len(b.text), min(1.0, marks / (1 + len(words)) * 8),
            1.0 if b.text[-1] in ".!?\"'" else 0.0, k / n, 1.0 if len(words) < 4 else 0.0, 1.0 if len(words) > 25 else 0.0,
        ]
        found.append(([*path, *some, *range(base, base + MEASURES)], [1.0] * len(path) + [len(some) ** -0.5] * len(some) + measures))
    return found


class Labeller:
    """x: input weights (SLOTS, 8 HIDDEN), forward gates first; h: recurrent ones (2, HIDDEN, 4 HIDDEN); o: output weights and bias."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.x, self.h, self.o = (weights[k].astype(np.float32) for k in ("x", "h", "o"))

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Labeller:
        with np.load(path) as file:
            return cls(dict(file))

    def inputs(self, pages: list[list[tuple[list[int], list[float]]]]) -> tuple[np.ndarray, np.ndarray]:
        """(T, B, 8 HIDDEN) gate inputs, and the mask (T, B) of the blocks there are."""
        longest = max(map(len, pages))
        gates = np.zeros((longest, len(pages), 8 * HIDDEN), dtype=np.float32)
        mask = np.zeros((longest, len(pages)), dtype=np.float32)
        for b, page in enumerate(pages):
            if page:
                slot = np.concatenate([s for s, _ in page])
                value = np.concatenate([v for _, v in page]).astype(np.float32)
                starts = np.cumsum([0] + [len(s) for s, _ in page[:-1]])
                gates[: len(page), b] = np.add.reduceat(self.x[slot] * value[:, None], starts, axis=0)
                mask[: len(page), b] = 1
        return gates, mask

    def states(self, gates: np.ndarray, mask: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """(T, B, HIDDEN) outputs of one direction; padding leaves the state as it is."""
        n, width, _ = gates.shape
        h = np.zeros((width, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((n, width, HIDDEN), dtype=np.float32)
        for t in range(n) if side == 0 else range(n - 1, -1, -1):
            z = gates[t, :, side * 4 * HIDDEN : (side + 1) * 4 * HIDDEN] + h @ self.h[side]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -15, 15)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def probabilities(self, pages: list[list[tuple[list[int], list[float]]]]) -> list[np.ndarray]:
        """For each page, the probability of each block to be main text."""
        result: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = [order[at]]
            # Pages of like length together, 20,000 blocks with padding at most, or one page.
            while at + len(group) < len(order) and len(group) < 128 and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 20_000:
                group.append(order[at + len(group)])
            at += len(group)
            gates, mask = self.inputs([pages[k] for k in group])
            both = np.concatenate([self.states(gates, mask, 0), self.states(gates, mask, 1)], axis=2)
            p = 1 / (1 + np.exp(-np.clip(both @ self.o[:-1] + self.o[-1], -30, 30)))
            for b, k in enumerate(group):
                result[k] = p[: len(pages[k]), b]
        return result


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    blocks = [leaves(p) for p in pages]
    chosen = labeller.probabilities([vectors(b) for b in blocks])
    return ["\n".join(x.text for x, k in zip(b, p, strict=True) if k >= 0.5) for b, p in zip(blocks, chosen, strict=True)]


def extract(pages: DataFrame, weights: Path = WEIGHTS) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null or empty html, and html without main text, give an empty text; a null page_id or url stays null; repeated
    rows are extracted each; other columns are ignored.
    """
    labeller = Labeller.load(weights)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(batch.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    body = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return body.mapInArrow(run, "page_id long, url string, text string, n_chars long")
