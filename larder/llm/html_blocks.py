"""HTML main text: a recurrent labeller over the page's leaf blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bounded_batches, read, spread

PATH_BINS, WORD_BINS = 96, 32
NUMBERS = 10
INPUTS = PATH_BINS + WORD_BINS + NUMBERS
#: Padded block steps that run through the network together.
STEPS = 1 << 15

#: Elements whose content is no text of the page: the first end with it, whatever is inside; the others only count if
#: they are closed.
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("template noscript iframe svg select object".split())
#: A tag, with its attributes; nothing in it is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in RAW | DROPPED}
MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements inside a line of text; all others begin and end a block. br and wbr stand for white space.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of the other kind, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table body article main section div nav aside header footer form blockquote".split())


class Place:
    """An open element within those around it; inline elements are passed over. It carries what the path's features add
    up to, so a block costs the same at any depth."""

    __slots__ = ("around", "name", "marks", "sum", "_row")

    def __init__(self, around: Place | None, name: str, marks: tuple[str, ...]):
        self.around, self.name, self.marks = around, name, marks
        self.sum = _hashed({name, *marks}) * np.float32(0.7)
        if around:
            self.sum += around.sum
        self._row: np.ndarray | None = None

    def __iter__(self) -> Iterator[tuple[str, tuple[str, ...]]]:
        place: Place | None = self
        while place:
            yield place.name, place.marks
            place = place.around

    def row(self) -> np.ndarray:
        """Hashed names and marks of the path; the two innermost elements count more, and by their position."""
        if self._row is None:
            row, place = np.zeros(PATH_BINS, np.float32), self
            for depth in range(2):
                if place:
                    row += _hashed({place.name, *place.marks, f"{depth}:{place.name}"})
                    place = place.around
            self._row = np.clip(row + place.sum if place else row, -2, 2)
        return self._row


def _hashed(tokens: set[str]) -> np.ndarray:
    row = np.zeros(PATH_BINS, np.float32)
    for token in tokens:
        at, sign = _bin("p" + token, PATH_BINS)
        row[at] += sign
    return row


@dataclass
class Block:
    text: str
    path: Place | None
    linked: int


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, element, closes, attributes) of each tag in page order; the last has no element.

    Comments, declarations and the content of RAW and DROPPED elements are left out; a comment or RAW element that is
    never closed takes the rest of the page, any other element nothing. A tag ends at the first ``>`` outside quotes. If
    a tag has none, quotes end no more tags: from there on each tag ends at its first ``>``, and without one before the
    next ``<``. Each position is looked at a bounded number of times: no page takes more than linear time.
    """
    at = start = 0  # text from ``at`` is not yet given out; ``start``: where the next < is looked for
    quotes = True
    never: set[str] = set()  # what is closed nowhere in the rest
    while (i := page.find("<", start)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            yield page[at:i] + " ", "", False, ""
            at = start = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i) if ">" not in never else -1
            if end < 0:
                never.add(">")
                start = i + 1
                continue
            yield page[at:i] + " ", "", False, ""
            at = start = end + 1
            continue
        m = NAME.match(page, i)
        if not m:
            start = i + 1
            continue
        whole = TAG.match(page, i) if quotes else None
        if whole:
            end, marks = whole.end(), whole[3]
        else:
            close = page.find(">", m.end()) if ">" not in never else -1
            follow = page.find("<", m.end())
            if close < 0:
                never.add(">")
            elif quotes and follow >= 0 and follow < close:
                close = -1  # a tag that another one interrupts
            else:
                quotes = quotes and '"' not in page[m.end() : close] and "'" not in page[m.end() : close]
            end = close + 1 if close >= 0 else follow if follow >= 0 else len(page)
            marks = page[m.end() : end]
        name = m[2].lower()
        if not m[1] and (name in RAW or name in DROPPED) and name not in never:
            closed = ENDS[name].search(page, end)
            if closed or name in RAW:
                yield page[at:i] + " ", "", False, ""
                at = start = closed.end() if closed else len(page)
                continue
            never.add(name)
        yield page[at:i], name, bool(m[1]), marks
        at = start = end
    yield page[at:], "", False, ""


class OpenElements:
    """The stack of open elements, with the positions of each name, so that no look-up depends on its depth."""

    def __init__(self):
        self.stack: list[tuple[str, Place | None]] = []
        self.at: dict[str, list[int]] = {}
        self.holds: list[int] = []

    def place(self) -> Place | None:
        return self.stack[-1][1] if self.stack else None

    def open(self, name: str, marks: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in HOLDS:
            self.holds.append(len(self.stack))
        self.stack.append((name, self.place() if name in INLINE else Place(self.place(), name, marks)))

    def close(self, i: int) -> None:
        for name, _ in self.stack[i:]:
            self.at[name].pop()
            if name in HOLDS:
                self.holds.pop()
        del self.stack[i:]

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def make_room(self, name: str) -> None:
        """Close what an element of this name ends, up to the container."""
        while (i := self.last("p", *CLOSES.get(name, ()))) > (self.holds[-1] if self.holds else -1):
            self.close(i)
            if name != "tr":
                break


def leaf_blocks(page: str) -> list[Block]:
    """Leaf text blocks in page order; character references decoded, white space runs one space, ends trimmed."""
    elements = OpenElements()
    out: list[Block] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, elements.place(), min(linked, len(text))))
            held.clear()
        linked = 0

    for raw, name, closes, attributes in pieces(page):
        if raw:
            held.append(raw)
            if elements.at.get("a"):
                linked += len(raw.strip())
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if name in VOID:
            if name in ("br", "wbr"):
                held.append(" ")
        elif closes:
            if (i := elements.last(name)) >= 0:
                elements.close(i)
        else:
            if not inline:
                elements.make_room(name)
            words = MARKS.findall(attributes) if attributes and not inline else ()
            elements.open(name, tuple(p.lower() for w in words for p in PIECES.findall(w[0] or w[1] or w[2])))
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _bin(text: str, bins: int) -> tuple[int, float]:
    h = crc32(text.encode("utf-8", "replace"))
    return h % bins, 1.0 if h >> 31 else -1.0


def features(blocks: list[Block]) -> np.ndarray:
    """A row a block: hashed tag path with its class and id words, all its hashed words, and counts."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    words = [b.text.lower().encode("utf-8", "replace").split() for b in blocks]
    sizes = np.array([len(w) for w in words])
    first = crc32(b"w")
    hashes = np.array([crc32(w, first) for ws in words for w in ws], np.uint32)
    cells = np.repeat(np.arange(len(blocks)) * WORD_BINS, sizes) + hashes % WORD_BINS
    signed = np.bincount(cells, np.where(hashes >> 31, 1.0, -1.0), len(blocks) * WORD_BINS).reshape(-1, WORD_BINS)
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = signed / np.sqrt(np.maximum(sizes, 1))[:, None] / 2
    for i, b in enumerate(blocks):
        if b.path:
            x[i, :PATH_BINS] = b.path.row()
        n = len(b.text)
        x[i, PATH_BINS + WORD_BINS :] = (
            min(np.log1p(n) / 6, 2), min(np.log1p(sizes[i]) / 4, 2), b.linked / n, b.text[-1] in ".!?…\"'”»", sum(map(b.text.count, ".,;:!?")) / n * 10,
            i / len(blocks), min(i, 20) / 20, min(len(blocks) - 1 - i, 20) / 20, b.text[0].isupper(), b.path.name in ("h1", "h2", "h3") if b.path else 0,
        )
    return x


class BiLstm:
    """One layer each way and a logistic output on both states, in numpy."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(hidden: int, seed: int) -> BiLstm:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[f"{side}x"] = rng.normal(0, INPUTS**-0.5, (INPUTS, 4 * hidden)).astype(np.float32)
            w[f"{side}h"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            w[f"{side}b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        w["out"] = rng.normal(0, (2 * hidden) ** -0.5, 2 * hidden).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return BiLstm(w)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (time, pages, inputs), mask: (time, pages) of 0 and 1. Returns logits (time, pages), and the trace."""
        states, trace = [], {}
        for side in "fb":
            steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
            wx = x @ self.w[f"{side}x"] + self.w[f"{side}b"]
            n = self.w[f"{side}h"].shape[0]
            h, c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            hs = np.zeros((len(x), x.shape[1], n), np.float32)
            kept = {}
            for t in steps:
                z = wx[t] + h @ self.w[f"{side}h"]
                gates = 1 / (1 + np.exp(-z[:, : 3 * n]))
                i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
                m = mask[t][:, None]
                new = f * c + i * g
                th = np.tanh(new)
                if keep:
                    kept[t] = (i, f, o, g, c, th, h, m)
                c = m * new + (1 - m) * c
                h = m * (o * th) + (1 - m) * h
                hs[t] = h
            states.append(hs)
            trace[side] = (kept, list(steps))
        both = np.concatenate(states, axis=2)
        return both @ self.w["out"] + self.w["bias"], (both, trace)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logits, (both, trace) = self.run(x, mask, keep=True)
        p = 1 / (1 + np.exp(-logits))
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
        d = (mask * (p - y) / total).astype(np.float32)
        grad = {"out": np.einsum("tp,tpn->n", d, both), "bias": d.sum(keepdims=True).reshape(1)}
        n = both.shape[2] // 2
        d_both = d[:, :, None] * self.w["out"]
        for k, side in enumerate("fb"):
            kept, steps = trace[side]
            d_h, d_c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            d_z = np.zeros((len(x), x.shape[1], 4 * n), np.float32)
            grad[f"{side}h"] = np.zeros_like(self.w[f"{side}h"])
            for t in reversed(steps):
                i, f, o, g, c, th, h, m = kept[t]
                d_h = d_h + d_both[t, :, k * n : (k + 1) * n]
                now, past = d_h * m, d_h * (1 - m)
                cell = d_c * m + now * o * (1 - th * th)
                d_z[t] = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), now * th * o * (1 - o), cell * i * (1 - g * g)], axis=1)
                grad[f"{side}h"] += h.T @ d_z[t]
                d_h = past + d_z[t] @ self.w[f"{side}h"].T
                d_c = d_c * (1 - m) + cell * f
            grad[f"{side}x"] = np.einsum("tpi,tpz->iz", x, d_z, optimize=True)
            grad[f"{side}b"] = d_z.sum((0, 1))
        return float(loss), grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for main text, for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            batch = order[-max(1, STEPS // longest) :]
            del order[-len(batch) :]
            x, mask = padded([pages[i] for i in batch])
            logits, _ = self.run(x, mask)
            for k, i in enumerate(batch):
                out[i] = logits[: len(pages[i]), k] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUTS), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, rows in enumerate(pages):
        x[: len(rows), k] = rows
        mask[: len(rows), k] = 1
    return x, mask


def trained() -> BiLstm:
    """The labeller that larder.llm.train_blocks fits."""
    with resources.files("larder.llm").joinpath("block_labeller.npz").open("rb") as f, np.load(f) as stored:
        return BiLstm({k: stored[k] for k in stored.files})


def main_text(pages: DataFrame, model: BiLstm | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The input columns and text, n_chars (long), n_blocks (long): the main text of each page.

    Each page is cut into leaf blocks and a bidirectional LSTM labels every block from its tag path, its words and the
    blocks around it. Blocks of main text are joined by one \\n in page order. Scripts, styles, comments and form
    controls are no blocks. Whole pages in linear time, no shuffle; the weights travel with the task.

    Null or empty html, and pages without main text: empty text, 0. Rows may repeat, ids may be null; input columns of
    these names are replaced. Unclosed or misnested tags are fine: text after an element that is never closed is kept,
    but for script, style, textarea, title and comments. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    weights = (model or trained()).w
    given = pages.drop("text", "n_chars", "n_blocks")
    names = given.columns

    def run(stream):
        net = BiLstm(weights)
        for whole in stream:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                blocks = [leaf_blocks(x or "") for x in batch.column(html_col).to_pylist()]
                labels = net.label([features(b) if b else np.zeros((0, INPUTS), np.float32) for b in blocks])
                texts = ["\n".join(b.text for b, keep in zip(bs, ls, strict=True) if keep) if bs else "" for bs, ls in zip(blocks, labels, strict=True)]
                columns = [batch.column(i) for i in range(len(names))]
                columns += [pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())]
                columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars", "n_blocks"])

    schema = given.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long"), "n_blocks": F.lit(0).cast("long")}).schema
    return given.mapInArrow(run, schema)


def op7_html_text(spark, sf_dir):
    return main_text(spread(read(spark, sf_dir, "pages").select("page_id", "url", "html"))).select("page_id", "url", "text", "n_chars")
