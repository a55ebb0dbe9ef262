"""Main-text extraction: a bidirectional LSTM labels the leaf blocks of a page."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.samples import within

# Element names by their role in HTML, and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe canvas".split())
TO_THE_END = frozenset(["script", "style"])  # without a closing tag, the rest of the page belongs to them
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY = {  # an open element that the start of another one ends
    "p": BLOCK - {"button", "option", "select", "legend", "summary"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
CLOSES = {name: [held for held, by in CLOSED_BY.items() if name in by] for name in sorted(frozenset().union(*CLOSED_BY.values()))}
STAYS_OPEN_IN = {"li": frozenset(["ul", "ol", "menu"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
GOOD_TAGS = frozenset(["article", "main"])
BAD_TAGS = frozenset("nav header footer aside form head title button select dialog menu".split())
GOOD_WORDS = "content article post entry story body main text".split()
BAD_WORDS = (
    "ad ads advert advertisement banner sponsor promo comment comments comment-list respond reply discussion nav navbar menu breadcrumb breadcrumbs "
    "sidebar side widget related recommended share social subscribe newsletter signup login cookie cookies consent notice notices alert popup modal "
    "footer header masthead copyright legal pagination pager tags search skip"
).split()

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|<[!?][^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HEADING = re.compile(r"h[1-6]$")


class Path:
    """The marks (tags with their classes) of an element and of all around it, held as a step from the path around it."""

    __slots__ = ("outer", "marks", "size")

    def __init__(self, outer: Path | None, marks: tuple[str, ...]):
        self.outer, self.marks = outer, marks
        self.size = len(marks) + (outer.size if outer else 0)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        steps, at = [], self
        while at is not None:
            steps.append(at.marks)
            at = at.outer
        return (t for marks in reversed(steps) for t in marks)

    def last(self, n: int) -> tuple[str, ...]:
        held, at = (), self
        while at is not None and len(held) < n:
            held, at = (*at.marks, *held), at.outer
        return held[-n:]


class Paths(dict):
    """(path, marks) -> the path one step further in, the same object whenever it is asked for."""

    def __missing__(self, key: tuple[Path, tuple[str, ...]]) -> Path:
        made = self[key] = Path(*key)
        return made


@dataclass
class Block:
    path: Path | tuple[str, ...]
    text: str
    linked: float = 0.0


def blocks(page: str | None, paths: Paths | None = None) -> list[Block]:
    """Leaf blocks in page order: the path of tags (with their classes) and the text with single spaces.

    Paths share what they have in common, and the open elements of each name are kept, so that the work is in
    proportion to the page, however many elements are left open. paths: to share between pages.
    """
    page, paths = page or "", Paths() if paths is None else paths
    top = paths[None, ()]
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: dict[str, list[int]] = {}  # places in the stack by name
    parts: list[str] = []
    unclosed: set[str] = set()
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1][1] if stack else top, text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    at = 0
    while at < len(page):
        m = MARKUP.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if any(tag == "a" for tag, _ in stack[-4:]):
                linked += m.start() - at
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name in BLOCK:
                flush()
            if (k := innermost([name])) >= 0:
                close(k)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            if name in unclosed:
                continue
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in TO_THE_END:
                at = len(page)
            else:
                unclosed.add(name)
            continue
        if name in BLOCK:
            flush()
        if (k := innermost(CLOSES.get(name, ()))) > innermost(STAYS_OPEN_IN.get(name, ())):
            close(k)
        if name not in VOID and not m["rest"].endswith("/"):
            marks = [name]
            for values in ATTRIBUTE.findall(m["rest"]):
                marks += [f".{w}" for w in "".join(values).lower().split()]
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, paths[stack[-1][1] if stack else top, tuple(marks)]))
    flush()
    return out


def weak_label(path: Path | tuple[str, ...]) -> int | None:
    """1 inside an article or main element and outside what is marked as extra; None if the page must tell."""
    bad = any(t in BAD_TAGS or t.lstrip(".") in BAD_WORDS for t in path if t in BAD_TAGS or t[0] == ".")
    return int(not bad and any(t in GOOD_TAGS for t in path))


PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, HIDDEN, PLAIN = 1 << 12, 1 << 13, 12, 6, 12, 4
X_DIM = PATH_DIM + WORD_DIM + PLAIN


def _row(mark: str) -> int:
    return crc32(mark.encode("utf-8", "surrogatepass")) % PATH_ROWS


def path_rows(path: Path | tuple[str, ...]) -> np.ndarray:
    """Each mark of the path, and its last two together."""
    marks = tuple(path)
    return np.array([_row(t) for t in [*marks, "/".join(marks[-2:])]], dtype=np.int64)


def word_rows(text: str) -> np.ndarray:
    return np.array([crc32(w) for w in text.lower().encode("utf-8", "surrogatepass").split()], dtype=np.uint32) % WORD_ROWS


class Labeller:
    """Embeddings of tag paths and words, one LSTM a direction, a logistic layer on both states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "path": rng.normal(0, 0.3, (PATH_ROWS, PATH_DIM)),
            "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)),
            "out": rng.normal(0, 0.3, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for way in ("f", "b"):
            self.p[f"w{way}"] = rng.normal(0, 0.25, (X_DIM + HIDDEN, 4 * HIDDEN))
            self.p[f"c{way}"] = np.zeros(4 * HIDDEN)
            self.p[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember by default

    def inputs(self, page: list[Block], seen: dict | None = None) -> np.ndarray:
        """(blocks, X_DIM); seen keeps the vectors of paths, which repeat from page to page."""
        x = np.zeros((len(page), X_DIM))
        seen = {} if seen is None else seen
        marks = [self.placed(b.path, seen) for b in page]
        x[:, :PATH_DIM] = [m[0] for m in marks]
        split = [b.text.lower().encode("utf-8", "surrogatepass").split() for b in page]  # never empty: a block has text
        sizes = np.array([len(w) for w in split])
        rows = np.array([crc32(w) for words in split for w in words], dtype=np.uint32) % WORD_ROWS
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(self.p["word"][rows], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        x[:, -PLAIN:] = [(len(b.text), b.linked, b.text[-1] in ".!?", m[1]) for b, m in zip(page, marks, strict=True)]
        x[:, -PLAIN] = np.log1p(x[:, -PLAIN]) / 6
        return x

    def placed(self, path: Path | tuple[str, ...], seen: dict) -> tuple[np.ndarray, float]:
        """The summed vectors of a path's marks and of its last two together, and whether a heading is among its last three."""
        if path not in seen:
            if isinstance(path, tuple):
                seen[path] = self.p["path"][path_rows(path)].sum(0), float(any(HEADING.match(t) for t in path[-3:]))
            else:
                both = self.p["path"][_row("/".join(path.last(2)))]
                seen[path] = self.summed(path, seen) + both, float(any(HEADING.match(t) for t in path.last(3)))
        return seen[path]

    def summed(self, path: Path, seen: dict) -> np.ndarray:
        """The sum of the vectors of a path's marks, from that of the nearest path around it that is known."""
        steps, at = [], path
        while at is not None and (at, "sum") not in seen:
            steps.append(at)
            at = at.outer
        total = np.zeros(PATH_DIM) if at is None else seen[at, "sum"]
        for step in reversed(steps):
            for mark in step.marks:
                total = total + self.p["path"][_row(mark)]
            seen[step, "sum"] = total
        return total

    def run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States over time of a (time, pages, X_DIM) batch that is read in the given order."""
        w, c = self.p[f"w{way}"], self.p[f"c{way}"]
        w, c = w.astype(x.dtype), c.astype(x.dtype)
        h = s = np.zeros((x.shape[1], HIDDEN), x.dtype)
        ahead, out = x @ w[:X_DIM] + c, np.empty((*x.shape[:2], HIDDEN), x.dtype)
        for t in range(len(x)):
            z = ahead[t] + h @ w[X_DIM:]
            gates = 1 / (1 + np.exp(-np.maximum(z[:, : 3 * HIDDEN], -80)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            if keep is not None:
                keep.append((h, s, i, f, o, g))
            s = f * s + i * g
            h = o * np.tanh(s)
            out[t] = h
        return out

    def scores(self, pages: list[list[Block]], room: int = 1 << 15) -> list[np.ndarray]:
        """Probability of main text for each block; pages of like length run side by side, `room` blocks at a time."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at, seen = 0, {}
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= room:
                n += 1
            group = order[at : at + n]
            at += n
            xs = [self.inputs(pages[k], seen) for k in group]
            long = max(map(len, xs))
            ahead, back = (np.zeros((long, n, X_DIM), np.float32) for _ in range(2))
            for j, x in enumerate(xs):
                ahead[: len(x), j], back[: len(x), j] = x, x[::-1]
            hf, hb = self.run(ahead, "f"), self.run(back, "b")
            for j, (k, x) in enumerate(zip(group, xs, strict=True)):
                both = np.concatenate((hf[: len(x), j], hb[: len(x), j][::-1]), axis=1)
                out[k] = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])))
        return out

    def step(self, page: list[Block], y: np.ndarray, blind: bool, acc: dict, rate: float) -> None:
        """One page through time and back, and an Adagrad step. blind: without its words."""
        x = self.inputs(page)
        if blind:
            x[:, PATH_DIM : PATH_DIM + WORD_DIM] = 0
        kept: dict[str, list] = {"f": [], "b": []}
        hf, hb = self.run(x[:, None], "f", kept["f"])[:, 0], self.run(x[::-1][:, None], "b", kept["b"])[:, 0]
        both = np.concatenate((hf, hb[::-1]), axis=1)
        p = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])))
        err = (p - y) / len(y)
        grad = {"out": err @ both, "bias": err.sum(keepdims=True)}
        dx = np.zeros_like(x)
        back = err[:, None] * self.p["out"]
        for way, dh_all, xs in (("f", back[:, :HIDDEN], x), ("b", back[::-1, HIDDEN:], x[::-1])):
            w = self.p[f"w{way}"]
            gw, gc, dh, ds, part = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros_like(x)
            for t in range(len(x) - 1, -1, -1):
                h, s, i, f, o, g = (v[0] for v in kept[way][t])
                dh = dh + dh_all[t]
                tanh = np.tanh(f * s + i * g)
                ds = ds + dh * o * (1 - tanh**2)
                dz = np.concatenate((ds * g * i * (1 - i), ds * s * f * (1 - f), dh * tanh * o * (1 - o), ds * i * (1 - g**2)))
                gw += np.outer(np.concatenate((xs[t], h)), dz)
                gc += dz
                full = w @ dz
                part[t], dh, ds = full[:X_DIM], full[X_DIM:], ds * f
            grad[f"w{way}"], grad[f"c{way}"] = gw, gc
            dx += part if way == "f" else part[::-1]
        for name, g in grad.items():
            g = np.clip(g, -1, 1)
            acc[name] += g * g
            self.p[name] -= rate * g / np.sqrt(acc[name])
        for k, b in enumerate(page):
            self._rows("path", path_rows(b.path), dx[k, :PATH_DIM], acc, rate)
            words = word_rows(b.text)
            if len(words) and not blind:
                self._rows("word", np.unique(words), dx[k, PATH_DIM : PATH_DIM + WORD_DIM] / len(words), acc, rate)

    def _rows(self, name: str, rows: np.ndarray, g: np.ndarray, acc: dict, rate: float) -> None:
        acc[name][rows] += g * g
        self.p[name][rows] -= rate * g / np.sqrt(acc[name][rows])


def varied(page: list[Block], y: list[int], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """A training variant: the main element under another name, and extra parts around and inside it.

    The extra parts are made of the page's own sentences, so only their place and marks tell them apart.
    """
    page, y = list(page), list(y)
    if rng.random() < 0.4:
        other = rng.choice([("div", f".{rng.choice(GOOD_WORDS)}"), ("section", f".{rng.choice(GOOD_WORDS)}"), ("main",), ("main", "article")])
        page = [Block(tuple(x for t in b.path for x in (other if t in GOOD_TAGS else (t,))), b.text, b.linked) for b in page]
    good = [k for k, v in enumerate(y) if v]
    for _ in range(rng.randrange(7)):
        if not good:
            break
        tag, word = rng.choice(sorted(BAD_TAGS - {"head", "title"}) + ["div", "section", "ul"] * 4), rng.choice(BAD_WORDS)
        marks = (tag, f".{word}") if tag in ("div", "section", "ul") or rng.random() < 0.3 else (tag,)
        k = rng.choice([0, good[0], good[-1] + 1, rng.choice(good), len(page)])
        near = page[min(k, len(page) - 1)].path
        lead = near[: rng.randrange(len(near) + 1)] if rng.random() < 0.5 else ("html", "body")
        kids = rng.choice([("p",), ("li",), ("div",), ()])
        made = [Block((*lead, *marks, *kids), page[rng.choice(good)].text[: rng.choice([20, 60, 200])], rng.choice([0.0, 0.0, 1.0])) for _ in range(rng.randrange(1, 4))]
        page[k:k], y[k:k] = made, [0] * len(made)
        good = [j for j, v in enumerate(y) if v]
    return page, np.array(y, dtype=float)


def fit(pages: list[str], epochs: int = 6, rate: float = 0.1, marks: int = 500_000) -> Labeller:
    """Train on pages whose own markup names the main part (an article or main element); others teach nothing.

    marks: pages whose paths hold more marks together (thousands of elements left open) are left out of fitting.
    """
    net, rng = Labeller(), random.Random(9)
    acc = {k: np.full_like(v, 1e-2) for k, v in net.p.items()}
    known = []
    for page in pages:
        b = blocks(page)
        if sum(len(x.path) for x in b) > marks:
            continue
        b = [Block(tuple(x.path), x.text, x.linked) for x in b]
        y = [weak_label(x.path) for x in b]
        if any(y):
            known.append((b, y))
    for _ in range(epochs):
        rng.shuffle(known)
        for b, y in known:
            page, target = varied(b, y, rng)
            net.step(page, target, rng.random() < 0.5, acc, rate)
    return net


def train(pages: DataFrame, bound: int = 300, room: int = 6_000_000) -> Labeller:
    """Fit on at most `bound` whole pages of at most `room` characters together, chosen by a hash of their url and id.

    Tasks send the driver hashes and lengths only; the chosen pages, one row of each, follow. Repeated rows count once.
    """
    own = pages.where("html is not null").select(F.xxhash64("url", "page_id").alias("h"), "html")
    sizes = own.groupBy("h").agg(F.min(F.length("html")).alias("n")).orderBy("h").limit(bound).collect()
    fitting = within([(r["h"], r["h"], r["n"]) for r in sizes], room)
    if not fitting:
        return fit([])
    rows = own.where(F.col("h").isin(fitting)).groupBy("h").agg(F.min_by("html", F.struct(F.length("html"), "html")).alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: r["h"])])


def extract(pages: DataFrame, net: Labeller, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    text is the blocks that the net takes for main text, in page order, joined by a line feed; empty for
    null and empty pages and where nothing is main text. Whole pages are read; repeated rows are kept.
    Map-only, in Arrow batches.
    """
    sent = pages.sparkSession.sparkContext.broadcast(net)

    def run(batch: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(batch), 256):
            paths = Paths()
            parsed = [blocks(p, paths) for p in batch.iloc[at : at + 256]]
            scored = sent.value.scores(parsed)
            out += ["\n".join(b.text for b, s in zip(p, q, strict=True) if s >= threshold) for p, q in zip(parsed, scored, strict=True)]
        return pd.Series(out, dtype=object)

    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.pandas_udf(run, "string")(F.col("html").cast("string")).alias("text"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
