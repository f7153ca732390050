"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks. Each block enters as the mean vector of its path's hashed tokens, the mean vector of
its hashed words and a few measures; a bidirectional LSTM reads the whole sequence, so a block is judged in the
context of the page before and behind it. The network is written in numpy and trained on a bounded sample of pages:
as they are, labelled by the elements that name their role, and recomposed, their texts set into layouts drawn from a
list of containers, so that it also knows roles that only a class name or the context tells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare
from costurero.llm.html_blocks import Block, blocks

# Containers as tag and attribute names, by role.
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "article-body"), ("section", "story"), ("div", "entry-content"), ("div", "main"), ("div", "post"), ("div", "text"), ("div", "")]
OTHER = {
    "menu": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "navigation"), ("div", "breadcrumb"), ("div", "topbar"), ("div", "tags"), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-title"), ("div", "banner")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("div", "colophon")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("div", "popular"), ("div", "share"), ("div", "social"), ("section", "more-stories")],
    "notice": [("div", "cookie"), ("div", "cookie-notice"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "gdpr-banner"), ("div", "message")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("section", "banner-ad"), ("ins", "adsbygoogle")],
    "form": [("form", ""), ("form", "newsletter"), ("form", "search"), ("div", "subscribe"), ("div", "login"), ("div", "signup")],
    "comment": [("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "disqus"), ("div", "responses"), ("div", "reviews"), ("div", "reply")],
}
ROLE_TAGS = {"nav", "header", "footer", "aside", "form"}
# End of the fixed values.
OTHER_WORDS = {w for group in OTHER.values() for _, name in group for w in name.split("-") if w} - {"more", "site", "title", "list", "message"}
MEASURES = 8


@dataclass(frozen=True)
class Settings:
    """`pages` bounds the pages fitted on, `longest` their characters, `composed` the layouts made of their texts."""

    buckets: int = 4096
    size: int = 16
    hidden: int = 24
    pages: int = 300
    longest: int = 100_000
    composed: int = 600
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    cached: int = 300_000


# ---------------------------------------------------------------- features


class Features:
    """Buckets and measures of blocks; the bucket of a word is remembered, up to a bound."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.settings.cached:
                self.known.clear()
            found = self.known[word] = xxhash.xxh32_intdigest(word, 1) % self.settings.buckets
        return found

    def page(self, page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Buckets of path tokens and of words of each block, and its measures."""
        paths = [[self.bucket("<" + t) for t in b.path] or [0] for b in page]
        words = [[self.bucket(w) for w in b.text.lower().split()] for b in page]
        total = sum(len(b.text) for b in page)
        seen, rows = 0, []
        for i, (b, w) in enumerate(zip(page, words)):
            n = len(b.text)
            stops = sum(b.text.count(c) for c in ".,;:!?")
            rows.append([np.log1p(n) / 6, np.log1p(len(w)) / 5, b.linked / n, min(1.0, 10 * stops / n), b.text[-1] in ".!?…\"”", seen / total, i / len(page), n / total])
            seen += n
        return paths, words, np.array(rows, np.float32).reshape(-1, MEASURES)


def mean_rows(table: np.ndarray, bags: list[list[int]]) -> np.ndarray:
    size = np.array([len(b) for b in bags])
    flat = np.fromiter((x for b in bags for x in b), np.int64, size.sum())
    return np.add.reduceat(table[flat], np.cumsum(size) - size, axis=0) / size[:, None]


# ---------------------------------------------------------------- the network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, alive: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
    """Outputs (steps, pages, hidden) of x (steps, pages, inputs); dead steps leave the state as it is."""
    steps, pages, _ = x.shape
    n = w["u"].shape[0]
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    drive = x @ w["w"] + w["b"]
    out, tape = np.zeros((steps, pages, n), np.float32), []
    for t in range(steps):
        z = drive[t] + h @ w["u"]
        i, f, o = (sigmoid(z[:, k * n : (k + 1) * n]) for k in range(3))
        g = np.tanh(z[:, 3 * n :])
        m = alive[t][:, None]
        c_new = f * c + i * g
        tanh = np.tanh(c_new)
        tape.append((h, c, i, f, o, g, tanh, m))
        h, c = np.where(m, o * tanh, h), np.where(m, c_new, c)
        out[t] = h
    return out, tape


def lstm_back(x: np.ndarray, grad: np.ndarray, w: dict[str, np.ndarray], tape: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients of the inputs and of the weights."""
    n = w["u"].shape[0]
    steps, pages, _ = x.shape
    dz = np.zeros((steps, pages, 4 * n), np.float32)
    dh, dc = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    du = np.zeros_like(w["u"])
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tanh, m = tape[t]
        dh = dh + grad[t]
        own, rest = dh * m, dh * ~m
        d_c = dc * m + own * o * (1 - tanh**2)
        dz[t] = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), own * tanh * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
        du += h.T @ dz[t]
        dh, dc = rest + dz[t] @ w["u"].T, dc * ~m + d_c * f
    flat = x.reshape(-1, x.shape[2])
    return dz @ w["w"].T, {"w": flat.T @ dz.reshape(-1, 4 * n), "u": du, "b": dz.sum((0, 1))}


class Labeller:
    """Weights, the forward pass over many pages at once, and training."""

    def __init__(self, settings: Settings):
        self.settings = s = settings
        rng = np.random.default_rng(7)
        inputs = 2 * s.size + MEASURES
        self.paths, self.words = (rng.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32) for _ in range(2))
        self.cells = []
        for _ in range(2):
            b = np.zeros(4 * s.hidden, np.float32)
            b[s.hidden : 2 * s.hidden] = 1
            self.cells.append({"w": rng.normal(0, inputs**-0.5, (inputs, 4 * s.hidden)).astype(np.float32), "u": rng.normal(0, s.hidden**-0.5, (s.hidden, 4 * s.hidden)).astype(np.float32), "b": b})
        self.out = rng.normal(0, 0.1, 2 * s.hidden + inputs).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def forward(self, pages: list[tuple]) -> tuple:
        """Pages are (path bags, word bags, measures); all are padded to the longest."""
        size = np.array([len(p[0]) for p in pages])
        x = np.zeros((size.max(), len(pages), 2 * self.settings.size + MEASURES), np.float32)
        at = np.repeat(np.arange(len(pages)), size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x[step, at] = np.concatenate([mean_rows(self.paths, [b for p in pages for b in p[0]]), mean_rows(self.words, [b for p in pages for b in p[1]]), np.concatenate([p[2] for p in pages])], axis=1)
        alive = np.arange(len(x))[:, None] < size[None, :]
        ahead, tape_a = lstm(x, alive, self.cells[0])
        back, tape_b = lstm(x[::-1], alive[::-1], self.cells[1])
        both = np.concatenate([ahead, back[::-1], x], axis=2)
        return sigmoid(both @ self.out + self.bias), x, alive, both, tape_a, tape_b, step, at

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probability of each block to be main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p[0]), key=lambda i: len(pages[i][0]))
        start = 0
        while start < len(order):
            # At most 64 pages and about 20,000 padded blocks at a time.
            end = start + 1
            while end < len(order) and end - start < 64 and (end - start + 1) * len(pages[order[end]][0]) <= 20_000:
                end += 1
            group = order[start:end]
            p = self.forward([pages[i] for i in group])[0]
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i][0]), k]
            start = end
        return out

    def train(self, pages: list[tuple], labels: list[np.ndarray]) -> None:
        s = self.settings
        rng = np.random.default_rng(13)
        dense = {("out",): self.out, ("bias",): self.bias} | {(k, n): v for k, c in enumerate(self.cells) for n, v in c.items()}
        first, second = ({k: np.zeros_like(v) for k, v in dense.items()} for _ in range(2))
        spread = [np.full(s.buckets, 1e-4, np.float32) for _ in range(2)]
        turn = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(pages))
            # Pages of like length share a batch; batches come in random order.
            order = sorted(order, key=lambda i: len(pages[i][0]))
            batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
            for b in rng.permutation(len(batches)):
                group = [pages[i] for i in batches[b]]
                p, x, alive, both, tape_a, tape_b, step, at = self.forward(group)
                y = np.zeros_like(p)
                y[step, at] = np.concatenate([labels[i] for i in batches[b]])
                error = np.where(alive, p - y, 0.0).astype(np.float32) / alive.sum()
                grads = {("out",): np.tensordot(error, both, ([0, 1], [0, 1])), ("bias",): error.sum(keepdims=True).reshape(1)}
                d_both = error[:, :, None] * self.out
                n = s.hidden
                dx_a, w_a = lstm_back(x, d_both[:, :, :n], self.cells[0], tape_a)
                dx_b, w_b = lstm_back(x[::-1], d_both[::-1, :, n : 2 * n], self.cells[1], tape_b)
                grads |= {(0, k): v for k, v in w_a.items()} | {(1, k): v for k, v in w_b.items()}
                turn += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    dense[k] -= s.rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-7)
                dx = (dx_a + dx_b[::-1] + d_both[:, :, 2 * n :])[step, at]
                for k, table in enumerate((self.paths, self.words)):
                    bags = [bag for g in group for bag in g[k]]
                    size = np.array([len(bag) for bag in bags])
                    part = np.repeat(dx[:, k * s.size : (k + 1) * s.size] / size[:, None], size, axis=0)
                    flat = np.array([i for bag in bags for i in bag])
                    total = np.zeros_like(table)
                    np.add.at(total, flat, part)
                    used = np.unique(flat)
                    spread[k][used] += (total[used] ** 2).mean(1)
                    table[used] -= s.rate * total[used] / np.sqrt(spread[k][used])[:, None]


# ---------------------------------------------------------------- training pages


def named_role(block: Block) -> int | None:
    """What the names on a block's path say: 0 for a container of another role, 1 inside main text, else nothing."""
    if ROLE_TAGS & set(block.path) or OTHER_WORDS & set(block.path):
        return 0
    return 1 if {"article", "main"} & set(block.path) else None


def wrapped(rng: np.random.Generator, container: tuple[str, str], inner: str, y: int) -> str:
    tag, name = container
    if name and rng.random() < 0.3:
        name = f"{name}-{rng.choice(['1', 'box', 'wrap', 'inner'])}"
    kind = rng.choice(["class", "id"])
    return f'<{tag} data-y="{y}"' + (f' {kind}="{name}"' if name else "") + f">{inner}</{tag}>"


def composed(rng: np.random.Generator, prose: list[str], short: list[str]) -> str:
    """A page of given texts in a layout drawn at random; data-y carries each container's label."""

    def some(texts: list[str], low: int, high: int) -> list[str]:
        return [texts[i] for i in rng.integers(0, len(texts), rng.integers(low, high + 1))]

    def links() -> str:
        items = [" ".join(x.split()[:3]) for x in some(short, 3, 8)]
        return "<ul>" + "".join(f'<li><a href="#">{x}</a></li>' for x in items) + "</ul>" if rng.random() < 0.7 else " ".join(f'<a href="#">{x}</a>' for x in items)

    def paragraphs(texts: list[str]) -> str:
        return "".join(f"<p>{x}</p>" if rng.random() < 0.85 else f"<div>{x}</div>" for x in texts)

    def other(kind: str) -> str:
        if kind == "menu":
            inner = links()
        elif kind == "comment":
            inner = "".join(f"<{t}>{x}</{t}>" for x in some(prose, 1, 5) for t in [rng.choice(["p", "div", "li"])])
        elif kind == "form":
            inner = f"<label>{some(short, 1, 1)[0]}</label><input>" + f"<p>{some(short, 1, 1)[0]}</p>"
        elif kind == "side" and rng.random() < 0.5:
            inner = f"<h3>{some(short, 1, 1)[0]}</h3>" + links()
        else:
            inner = paragraphs(some(short, 1, 2)) if rng.random() < 0.6 else some(short if rng.random() < 0.8 else prose, 1, 1)[0]
        return wrapped(rng, OTHER[kind][rng.integers(len(OTHER[kind]))], inner, 0)

    parts = []
    title = some(short, 1, 1)[0]
    for x in some(prose, 1, 7):
        parts.append(f"<p>{x}</p>" if rng.random() < 0.9 else f"<p>{x} <a href='#'>{some(short, 1, 1)[0]}</a></p>")
        if rng.random() < 0.1:
            parts.append(f"<h2>{some(short, 1, 1)[0]}</h2>")
        if rng.random() < 0.1:
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in some(short, 2, 4)) + "</ul>")
        if rng.random() < 0.08:
            parts.append(f"<blockquote>{some(prose, 1, 1)[0]}</blockquote>")
        if rng.random() < 0.1:
            parts.append(other(rng.choice(["advert", "side", "notice", "form"])))
    if rng.random() < 0.4:
        parts.append(f"<p>{some(short, 1, 1)[0]}</p>")
    head = f"<h1>{title}</h1>" if rng.random() < 0.85 else ""
    main = wrapped(rng, MAIN[rng.integers(len(MAIN))], head + "".join(parts), 1)
    before = [other(k) for k in ("header", "menu", "notice", "advert", "side") if rng.random() < 0.45]
    after = [other(k) for k in ("side", "comment", "form", "advert", "notice", "menu", "footer") if rng.random() < 0.45]
    return "<body>" + "".join(before) + main + "".join(after) + "</body>"


def training_set(pages: list[list[Block]], settings: Settings) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages whose blocks all have a role by name, as they are; and layouts composed of the sample's texts."""
    out, labels = [], []
    prose, short = [], []
    for page in pages:
        roles = [named_role(b) for b in page]
        for b, y in zip(page, roles):
            (short if y == 0 or len(b.text) < 100 else prose).append(b.text[:1500])
        if page and None not in roles:
            out.append(page)
            labels.append(np.array(roles, np.float32))
    prose, short = prose or short, short or prose
    rng = np.random.default_rng(3)
    for _ in range(settings.composed if prose else 0):
        page = [b for b in blocks(composed(rng, prose, short)) if b.label is not None]
        if page:
            out.append(page)
            labels.append(np.array([b.label for b in page], np.float32))
    return out, labels


def fit(pages: DataFrame, settings: Settings = Settings()) -> Labeller:
    """Train on at most `pages` pages, in the order of a hash of page_id; longer pages than `longest` are not used, and
    of rows that share a page_id one.

    Without a page of any text the labeller is untrained.
    """
    few = pages.where("page_id IS NOT NULL").where(F.length("html") <= settings.longest).select("page_id", "html")
    # The ids are chosen first, so that no task sends more pages than are wanted in all.
    chosen = few.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(settings.pages)
    wanted = few.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    rows = sorted(wanted.collect(), key=lambda r: r.page_id)
    model = Labeller(settings)
    used, labels = training_set([blocks(r.html, labelled=False) for r in rows], settings)
    if used:
        features = Features(settings)
        model.train([features.page(p) for p in used], labels)
    return model


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row; a null or empty page has the empty text.

    Rows are labelled one by one, whatever their page_id; no other column is read.
    """
    prepare(pages.sparkSession)

    def make():
        features = Features(model.settings)

        def run(cols):
            read = [blocks(h, labelled=False) for h in cols["html"]]
            marked = model.label([features.page(p) if p else ([], [], None) for p in read])
            kept = [[b.text for b, p in zip(page, m) if p >= 0.5] for page, m in zip(read, marked)]
            texts = ["\n\n".join(k) for k in kept]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(p) for p in read], "n_main": [len(k) for k in kept]}

        return run

    return map_batches(pages.select("page_id", "url", "html"), "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint", make)


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the sample, then label every page."""
    prepare(pages.sparkSession)
    return main_text(pages, fit(pages, settings))
