"""Training of the block labeller on invented pages: ``python -m oscilla.llm.html_train``.

Pages are drawn from many layouts with known main text: semantic tags or classes or neither, menus, headers, adverts,
notices, forms, sidebars, comments and footers around and inside the article, some deep in plain elements, in words of
invented languages.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .html import HIDDEN, SLOTS, WEIGHTS, Labeller, leaves, vectors

_SYLLABLES = "the an er on in re th es ti or ed st nd he ha is ou ea ng al ar le de ra la ro co mo ver sch ein ung lich eau ion que ment ado os ción é è ü ö ß".split()
_NEUTRAL = ["wrapper", "container", "row", "page", "col", "inner", "outer", "site", "grid", "block", "clearfix", "layout", "box", "center", ""]
_MAIN = [
    "<article>", "<article class='{}'>", "<main>", "<main id='content'>", "<div class='content'>", "<div id='content'>", "<div class='post'>",
    "<div class='entry-content'>", "<div class='article-body'>", "<div class='story'>", "<div class='post-content text'>", "<section id='main'>",
    "<section class='article'>", "<div itemprop='articleBody'>", "<div role='main'>", "<div class='{}'>", "<div>", "<td class='text'>", "<section>",
]
_KINDS: dict[str, list[str]] = {
    "menu": ["<nav>", "<nav class='{}'>", "<div class='menu'>", "<div id='nav'>", "<div class='navbar'>", "<div class='breadcrumb'>", "<ul class='nav'>", "<div role='navigation'>", "<div class='main-menu'>", "<div class='toc'>", "<div class='pagination'>", "<div class='tags'>"],
    "header": ["<header>", "<div id='header'>", "<div class='site-header'>", "<div class='masthead'>", "<div class='topbar'>", "<div role='banner'>", "<div class='logo'>"],
    "footer": ["<footer>", "<div id='footer'>", "<div class='footer'>", "<div class='site-footer'>", "<div class='copyright'>", "<div role='contentinfo'>", "<div class='legal'>", "<small class='footer'>"],
    "side": ["<aside>", "<aside class='{}'>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related'>", "<div class='recommended'>", "<section class='related-posts'>", "<div class='trending'>", "<div class='author-box'>", "<div class='more-stories'>"],
    "ad": ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='banner-ad'>", "<div class='sponsored'>", "<div class='promo'>", "<div id='ad-top'>", "<div class='sponsor'>", "<aside class='ad'>", "<section class='adslot'>", "<p class='ad'>", "<ins class='adsbygoogle'>"],
    "notice": ["<div class='cookie'>", "<div class='cookie-banner'>", "<div id='cookie-notice'>", "<div class='notice'>", "<div class='consent'>", "<div class='gdpr'>", "<div class='alert'>", "<div class='popup'>", "<div class='modal'>", "<div role='alert'>", "<div role='dialog'>", "<section class='cookies'>", "<p class='notice'>", "<div class='paywall'>"],
    "form": ["<form>", "<form class='{}'>", "<div class='newsletter'>", "<div class='subscribe'>", "<div class='search'>", "<div class='login'>", "<div class='signup'>", "<fieldset>", "<div role='search'>"],
    "social": ["<div class='share'>", "<div class='social'>", "<ul class='sharing'>", "<div class='share-buttons'>", "<div class='follow'>"],
    "comment": ["<section id='comments'>", "<div class='comments'>", "<div id='disqus'>", "<div class='comment-list'>", "<ol class='commentlist'>", "<div class='discussion'>", "<section class='reader-comments'>", "<div class='responses'>", "<div class='replies'>", "<div class='comment'>"],
}


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.out, self.kept = r, [], []
        self.syllables = r.sample(_SYLLABLES, 12)
        self.quote = r.choice("\"'")

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(max(1, n))]
        words[0] = words[0].capitalize()
        if n > 8 and self.r.random() < 0.4:
            words[self.r.randrange(n - 1)] += ","
        if self.r.random() < 0.04:
            words[-1] += " &amp; " + self.word()
        return " ".join(words) + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence(self.r.randint(1, 22)) for _ in range(self.r.randint(least, most)))

    def open(self, kind: list[str]) -> str:
        head = self.r.choice(kind).format(self.r.choice([self.word(), *_NEUTRAL])).replace("'", self.quote)
        self.out.append(head)
        return f"</{head[1:].split()[0].rstrip('>')}>"

    def nest(self) -> str:
        """Sometimes plain elements, up to sixteen in one another, between an element that tells and its text."""
        r = self.r
        if r.random() > 0.3:
            return ""
        heads = [r.choice(("<div>", "<div>", f"<div class='{r.choice(_NEUTRAL)}'>", "<section>")) for _ in range(r.choice((1, 2, 3, 5, 8, 12, 16)))]
        self.out += heads
        return "".join("</section>" if h == "<section>" else "</div>" for h in reversed(heads))

    def text(self, text: str, kept: bool) -> None:
        self.out.append(text)
        self.kept.append(kept)

    def tagged(self, tag: str, text: str, kept: bool) -> None:
        self.out.append(f"<{tag}>")
        self.text(text, kept)
        if tag not in ("p", "li") or self.r.random() < 0.9:
            self.out.append(f"</{tag}>")

    def links(self, n: int) -> None:
        for _ in range(n):
            words = " ".join(self.word() for _ in range(self.r.randint(1, 4)))
            inner = f"<a href={self.quote}/{self.word()}{self.quote}>{words}</a>"
            self.tagged(self.r.choice(("li", "li", "div", "p")), inner, False)

    def junk(self, kind: str) -> None:
        r = self.r
        end = self.open(_KINDS[kind])
        end = self.nest() + end
        if kind in ("menu", "social") or kind in ("side", "footer", "header") and r.random() < 0.5:
            self.out.append("<ul>")
            self.links(r.randint(1, 8))
            self.out.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.tagged(r.choice(("label", "button", "p", "div", "legend")), self.sentence(r.randint(1, 6)), False)
                self.out.append("<input type='text' name='q'>")
        elif kind == "comment":
            for _ in range(r.randint(1, 6)):
                inner = self.out.append(r.choice(("<div class='comment'>", "<li>", "<div>", "<article class='comment'>", "<div class='reply'>")))
                if r.random() < 0.6:
                    self.tagged(r.choice(("div", "h4", "p")), self.sentence(r.randint(1, 3)), False)
                for _ in range(r.randint(1, 3)):
                    self.tagged("p", self.prose(1, 4), False)
                self.out.append({"<li>": "</li>", "<article class='comment'>": "</article>"}.get(next(x for x in reversed(self.out) if x in ("<div class='comment'>", "<li>", "<div>", "<article class='comment'>", "<div class='reply'>")), "</div>"))
                del inner
        elif r.random() < 0.5:
            self.text(self.prose(1, 2), False)
        else:
            if r.random() < 0.4:
                self.tagged(r.choice(("h3", "h4", "strong", "div")) if r.random() < 0.8 else "p", self.sentence(r.randint(1, 4)), False)
            for _ in range(r.randint(1, 3)):
                self.tagged(r.choice(("p", "p", "div", "li")), self.prose(1, 3), False)
        self.out.append(end)

    def article(self) -> None:
        r = self.r
        end = self.open(_MAIN)
        end = self.nest() + end
        if r.random() < 0.8:
            self.tagged(r.choice(("h1", "h1", "h2")), self.sentence(r.randint(2, 12)), True)
        paragraphs = r.choice((1, 2, 3, 5, 8, 12, 18))
        for k in range(paragraphs):
            x = r.random()
            text = self.prose(1, 7) if x > 0.2 else self.sentence(r.randint(1, 5))
            if k == 0 and r.random() < 0.3 or r.random() < 0.05:
                self.out.append("<p><b>")
                self.text(text + "<br>", True)
                continue
            if r.random() < 0.15:
                words = text.split()
                at = r.randrange(len(words))
                words[at] = f"<a href='/x'>{words[at]}</a>" if r.random() < 0.5 else f"<em>{words[at]}</em>"
                text = " ".join(words)
            tag = r.choices(("p", "h2", "h3", "blockquote", "pre", "div"), (40, 2, 2, 2, 1, 3))[0]
            self.tagged(tag, text, True)
            y = r.random()
            if y < 0.05:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.tagged("li", self.sentence(r.randint(3, 14)), True)
                self.out.append("</ul>")
            elif y < 0.08:
                self.out.append("<figure><img src='a.png'>")
                self.tagged("figcaption", self.sentence(r.randint(3, 12)), True)
                self.out.append("</figure>")
            elif y < 0.10:
                self.out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.tagged("td", self.sentence(r.randint(1, 3)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif y < 0.17 and k < paragraphs - 1:
                self.junk(r.choice(("ad", "side", "social", "form", "notice")))
        if r.random() < 0.2:
            self.junk(r.choice(("social", "side", "comment", "menu")))
        self.out.append(end)

    def build(self) -> tuple[str, list[bool]]:
        r = self.r
        self.out.append("<!DOCTYPE html><html><head><meta charset='utf-8'><title>")
        self.text(self.sentence(r.randint(3, 10)), False)
        self.out.append("</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        ends = []
        for _ in range(r.randint(0, 3)):
            ends.append(self.open([f"<div class='{c}'>" for c in _NEUTRAL] + ["<div>", "<div id='page'>", "<section>"]))
        before = r.sample(("menu", "menu", "header", "ad", "notice", "form", "side"), r.randint(0, 4))
        for kind in before:
            self.junk(kind)
        self.article()
        for kind in r.sample(("side", "ad", "comment", "comment", "form", "notice", "social", "menu"), r.randint(0, 4)) + ["footer"] * (r.random() < 0.8):
            self.junk(kind)
        if r.random() < 0.9:
            self.out += ends[::-1] + ["</body></html>"]
        return "".join(self.out), self.kept


def example(seed: int) -> tuple[list, np.ndarray]:
    """Block vectors and labels of one invented page."""
    page, kept = _Page(random.Random(seed)).build()
    blocks = leaves(page)
    if len(blocks) != len(kept):  # an unclosed tag joined two texts: the page isn't used
        return [], np.zeros(0)
    return vectors(blocks), np.array(kept, dtype=np.float32)


def gradients(model: Labeller, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy a block, and its gradient by back-propagation through time."""
    gates, mask = model.inputs(pages)
    kept: list[list] = [[], []]
    out = [model.states(gates, mask, side, kept[side]) for side in (0, 1)]
    both = np.concatenate(out, axis=2)
    p = 1 / (1 + np.exp(-np.clip(both @ model.o[:-1] + model.o[-1], -30, 30)))
    y = np.zeros_like(p)
    for b, v in enumerate(labels):
        y[: len(v), b] = v
    total = mask.sum()
    loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
    d = mask * (p - y) / total
    grad = {"o": np.r_[np.einsum("tb,tbh->h", d, both), d.sum()].astype(np.float32), "h": np.zeros_like(model.h), "x": np.zeros_like(model.x)}
    d_gates = np.zeros_like(gates)
    for side in (0, 1):
        part = model.o[side * HIDDEN : (side + 1) * HIDDEN]
        d_h = np.zeros((gates.shape[1], HIDDEN), dtype=np.float32)
        d_c = np.zeros_like(d_h)
        for t, h, c, i, f, o, g, tc, m in reversed(kept[side]):
            d_h = d_h + d[t][:, None] * part
            new_h, new_c = d_h * m, d_c * m
            new_c = new_c + new_h * o * (1 - tc**2)
            z = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), new_h * tc * o * (1 - o), new_c * i * (1 - g**2)], axis=1)
            d_gates[t, :, side * 4 * HIDDEN : (side + 1) * 4 * HIDDEN] = z
            grad["h"][side] += h.T @ z
            d_c = new_c * f + d_c * (1 - m)
            d_h = z @ model.h[side].T + d_h * (1 - m)
    for b, page in enumerate(pages):
        slot = np.concatenate([s for s, _ in page])
        value = np.concatenate([v for _, v in page]).astype(np.float32)
        which = np.repeat(np.arange(len(page)), [len(s) for s, _ in page])
        np.add.at(grad["x"], slot, d_gates[which, b] * value[:, None])
    return float(loss), grad


def train(pages: int = 14000, epochs: int = 6, batch: int = 24, rate: float = 6e-3, seed: int = 0, say=print) -> Labeller:
    rng = np.random.default_rng(seed)
    data = [e for e in map(example, range(seed, seed + pages)) if len(e[1]) and len(e[1]) < 200]
    model = Labeller({"x": rng.normal(0, 0.05, (SLOTS, 8 * HIDDEN)), "h": rng.normal(0, 0.15, (2, HIDDEN, 4 * HIDDEN)), "o": rng.normal(0, 0.1, 2 * HIDDEN + 1)})
    parts = {k: getattr(model, k) for k in ("x", "h", "o")}
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = np.argsort([len(y) for _, y in data] + rng.normal(0, 4, len(data)))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng.shuffle(groups)
        losses = []
        for group in groups:
            step += 1
            loss, grad = gradients(model, [data[k][0] for k in group], [data[k][1] for k in group])
            losses.append(loss)
            speed = rate * (1 - (step - 1) / (epochs * len(groups)))
            for k, v in parts.items():
                g = np.clip(grad[k], -1, 1) + (1e-5 * v if k == "x" else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                v -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        say(f"epoch {epoch}: {np.mean(losses):.4f}")
    return model


def accuracy(model: Labeller, seeds: range) -> tuple[float, float]:
    """Shares of blocks and of whole pages labelled rightly."""
    data = [e for e in map(example, seeds) if len(e[1])]
    right = [(p >= 0.5) == (y > 0) for p, (_, y) in zip(model.probabilities([x for x, _ in data]), data, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    found = train()
    print(accuracy(found, range(1_000_000, 1_001_000)))
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else WEIGHTS, **{k: getattr(found, k).astype(np.float16) for k in ("x", "h", "o")})
