"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks, each with the path of tags (with class and id words) above it. Blocks are read as vectors of hashed path
parts, hashed words and a few measures; a bidirectional LSTM in numpy runs over the whole sequence, so each label draws on the whole
document. There are no labelled pages, so it learns from a bounded sample of pages whose own mark-up tells (article and main against menus, headers, footers, asides,
forms and telling class names), each also in disguise: with its sections renamed to neutral or telling classes, and with boilerplate sections added.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches

#: Pages to learn from (the first by hash of their id), disguises of each, passes, and sizes of the network.
SAMPLE, DISGUISES, PASSES, HIDDEN, PATH_DIM, WORD_DIM = 200, 6, 6, 16, 128, 32
DIM = PATH_DIM + WORD_DIM + 8
#: Blocks that are read in one go; longer pages are read stretch by stretch, each from the state that the one before has left.
STRETCH = 512

TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg|iframe|select|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
                 r"|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|</?[a-zA-Z][^>]*>", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:\-]*)")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Mark-up that tells main text and boilerplate while learning.
GOOD_TAGS, BAD_TAGS = frozenset("article main".split()), frozenset("nav header footer aside form head button dialog".split())
BAD_WORDS = ("nav navbar menu header masthead footer foot sidebar side aside widget ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert popup modal "
             "newsletter subscribe signup form search login comment comments reply replies discussion respond share social related recommended breadcrumb breadcrumbs pagination copyright").split()
GOOD_WORDS = "article content post entry story body text main prose".split()
NEUTRAL = "wrap wrapper container page site row col inner outer left center box block section layout grid root app area region".split()
BAD = frozenset(BAD_WORDS)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each block; white space is one blank, references are decoded, empty blocks are left out."""
    found: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            found.append((tuple(x for _, parts in stack for x in parts), text, linked))
        linked = 0

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            buffer.append(piece)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(piece)
        at = m.end()
        tag = NAME.match(m[0])
        if not tag or m[1] is not None:
            continue
        name = tag[1].lower()
        if m[0][1] == "/":
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name not in INLINE:
            flush()
            ends = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS_END_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ends:
                    break
        if name not in VOID and not m[0].rstrip(">").endswith("/"):
            words = [w for a in ATTRIBUTE.findall(m[0]) for w in re.split(r"[^a-z0-9]+", (a[0] or a[1] or a[2]).lower()) if w]
            stack.append((name, () if name in INLINE else (name, *("." + w for w in words))))
    buffer.append(page[at:])
    flush()
    return found


def told(path: tuple[str, ...]) -> int:
    """Label by mark-up: 1 inside an article or main without telling parts, else 0."""
    names = [p.lstrip(".") if p.startswith(".") else p for p in path]
    if any(p in BAD_TAGS for p in path) or any(p.startswith(".") and n in BAD for p, n in zip(path, names)):
        return 0
    return int(any(p in GOOD_TAGS for p in path) or any(p.startswith(".") and n in GOOD_WORDS for p, n in zip(path, names)))


class _Slots(dict):
    """Hash of a word, kept for the words of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def path_vector(path: tuple[str, ...], slots: _Slots) -> np.ndarray:
    row = np.zeros(PATH_DIM, dtype=np.float32)
    for p in path:
        h = slots[p]
        row[h % PATH_DIM] += 1.0 if h & 0x80000000 else -1.0
        row[(h >> 8) % PATH_DIM] += 1.0 if h & 0x40000000 else -1.0
    return row


def vectors(page: list[tuple], slots: _Slots | None = None, paths: dict | None = None) -> np.ndarray:
    """One row per block: signed hashed path parts, hashed words of the whole block and measures."""
    slots = _Slots() if slots is None else slots
    paths = {} if paths is None else paths
    out = np.zeros((len(page), DIM), dtype=np.float32)
    for i, (path, text, linked) in enumerate(page):
        row = out[i]
        known = paths.get(path)
        if known is None:
            if len(paths) > 20_000:
                paths.clear()
            known = paths[path] = path_vector(path, slots)
        row[:PATH_DIM] = known
        words = text.lower().split(" ")
        n, m = len(words), len(text)
        h = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=n)
        row[PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(h & (WORD_DIM - 1), weights=np.where(h & 0x80000000, 0.5, -0.5), minlength=WORD_DIM) / np.sqrt(1 + n / 8)
        row[PATH_DIM + WORD_DIM:] = (np.log1p(n) / 4, min(linked / m, 1), text[-1] in ".!?\"", sum(map(text.count, ".,;:")) / n, m / n / 8, len(path) / 8, i / len(page), 1.0)
    return np.clip(out, -3, 3)


class Labeller:
    """Bidirectional LSTM with a logistic output, trained by back-propagation through time with Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p["w" + side] = (rng.normal(size=(DIM + HIDDEN, 4 * HIDDEN)) / np.sqrt(DIM + HIDDEN)).astype(np.float32)
            self.p["c" + side] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)
        self.p["o"] = (rng.normal(size=(2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["q"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        steps, n, _ = x.shape
        w, c0 = self.p["w" + side], self.p["c" + side]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        tape = []
        read = x @ w[:DIM] + c0
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = read[t] + h @ w[DIM:]
            s = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            if keep:
                tape.append((t, h, c, f, i, o, g, th, m))
            h, c = h2, c2
            out[t] = h
        return out, tape, (h, c)

    def chances(self, pages: list[np.ndarray]) -> np.ndarray:
        """Chance of main text (blocks, pages) of pages of like length; the state goes on from stretch to stretch, forward and backward."""
        longest = max(map(len, pages))
        z = np.zeros((longest, len(pages)), np.float32)
        for k, side in enumerate("fb"):
            state = None
            starts = range(0, longest, STRETCH)
            for a in starts if side == "f" else reversed(starts):
                h, _, state = self._run(*padded([p[a:a + STRETCH] for p in pages]), side, False, state)
                z[a:a + STRETCH] += h @ self.p["o"][k * HIDDEN:(k + 1) * HIDDEN, 0]
        return 1 / (1 + np.exp(-np.clip(z + self.p["q"], -30, 30)))

    def _slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        runs = {s: self._run(x, mask, s, True) for s in "fb"}
        h = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip((h @ self.p["o"])[:, :, 0] + self.p["q"], -30, 30)))
        d = np.where(mask, p - y, 0).astype(np.float32) / max(mask.sum(), 1)
        grad = {"o": np.einsum("tnh,tn->h", h, d)[:, None], "q": np.array([d.sum()], dtype=np.float32)}
        for k, side in enumerate("fb"):
            w = self.p["w" + side]
            dw, dc0 = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            to_h = d[:, :, None] * self.p["o"][k * HIDDEN:(k + 1) * HIDDEN, 0]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, f, i, o, g, th, m in reversed(runs[side][1]):
                dh = dh + to_h[t]
                live = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + live * o * (1 - th * th)
                dz = np.concatenate([dcell * c0 * f * (1 - f), dcell * g * i * (1 - i), live * th * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dw[:DIM] += x[t].T @ dz
                dw[DIM:] += h0.T @ dz
                dc0 += dz.sum(0)
                dh = np.where(m, 0, dh) + dz @ w[DIM:].T
                dc = np.where(m, dcell * f, dc)
            grad["w" + side], grad["c" + side] = dw, dc0
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(passes):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda k: len(pages[k][0]) // 8)
            parts = [[]]
            for k in order:  # fewer long pages share a matrix
                if len(parts[-1]) == 16 or len(parts[-1]) * max([len(pages[j][0]) for j in parts[-1]] + [len(pages[k][0])]) > 15 * STRETCH:
                    parts.append([])
                parts[-1].append(k)
            parts = [p for p in parts if p]
            rng.shuffle(parts)
            for part in parts:
                x, mask = padded([pages[k][0] for k in part])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(part):
                    y[:len(pages[k][1]), j] = pages[k][1]
                step += 1
                for k, g in self._slopes(x, mask, y).items():
                    a, b = moment[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.p[k] -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max((len(p) for p in pages), default=1), len(pages), DIM), np.float32)
    mask = np.zeros(x.shape[:2], dtype=bool)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, True
    return x, mask


def _class(words: list[str], rng: random.Random) -> tuple[str, ...]:
    """Parts of a class such as post-content: a telling word, often with others."""
    parts = [rng.choice(words)]
    if rng.random() < 0.5:
        parts.insert(rng.randint(0, 1), rng.choice(words if rng.random() < 0.4 else NEUTRAL))
    return tuple("." + p for p in parts)


def _boilerplate(texts: list[str], rng: random.Random) -> list[tuple[tuple, str, int, int]]:
    """A section of boilerplate made of the page's own words, under a telling tag or class."""
    tag = rng.choice([("aside",), ("form",), ("header",), ("footer",), ("nav",)] + [(rng.choice(["div", "section", "ul"]), *_class(BAD_WORDS, rng)) for _ in range(6)])
    inner = rng.choice([(), ("p",), ("ul", "li"), ("div",), ("h3",), ("li",), ("label",), ("button",)])
    long, links = rng.random() < 0.5, rng.random() < 0.4
    out = []
    for _ in range(rng.randint(1, 4)):
        words = rng.choice(texts).split(" ")
        k = rng.randint(1, 40 if long else 6)
        s = rng.randrange(max(1, len(words) - k))
        text = " ".join(words[s:s + k])
        out.append(((*tag, *inner), text, len(text) if links else 0, 0))
    return out


def disguise(page: list[tuple], rng: random.Random) -> list[tuple[tuple, str, int, int]]:
    """The blocks of a page with their labels under another mark-up: other wrappers, sections with telling classes instead of telling tags, other
    tags for blocks, fewer blocks, and boilerplate added around and within the main text."""
    texts = [t for _, t, _ in page] or ["x"]
    main = [b for b in page if told(b[0])]
    rest = [b for b in page if not told(b[0])]
    if main and rng.random() < 0.6:
        n = rng.randint(1, len(main))
        s = rng.randint(0, len(main) - n)
        main = main[s:s + n]
    if main and rng.random() < 0.15:  # a block may repeat a few words without end
        k = rng.randrange(len(main))
        words = main[k][1].split(" ")[:rng.randint(1, 3)] * rng.randint(5, 60)
        main[k] = (main[k][0], " ".join(words), 0)
    wrap = ("html", "body", *[x for _ in range(rng.randint(0, 2)) for x in ("div", "." + rng.choice(NEUTRAL))])
    kind = rng.random()
    good = ("article",) if kind < 0.2 else ("main",) if kind < 0.3 else (rng.choice(["div", "div", "section", "main", "article"]), *_class(GOOD_WORDS, rng))
    body = []
    for k, (path, text, linked) in enumerate(main):
        tag = ("h1",) if k == 0 and rng.random() < 0.5 else rng.choice([("p",)] * 8 + [("h2",), ("ul", "li"), ("blockquote",), ("div",), ("td",), ("pre",)])
        if tag[0] in ("h1", "h2", "ul") and rng.random() < 0.7:
            text = " ".join(text.split(" ")[:rng.randint(1, 9)])
        body.append(((*wrap, *good, *tag), text, min(linked, len(text)), 1))
        if rng.random() < 0.06:
            body.extend(((*wrap, *good, *p), t, n, y) for p, t, n, y in _boilerplate(texts, rng))
    before = [(path if rng.random() < 0.5 else tuple(x for p in path for x in (("div", *_class(BAD_WORDS, rng)) if p in BAD_TAGS and p != "head" else (p,))), t, n, 0) for path, t, n in rest]
    cut = rng.randint(0, len(before))
    top = [((*wrap, *p), t, n, y) for _ in range(rng.randint(0, 2)) for p, t, n, y in _boilerplate(texts, rng)]
    end = [((*wrap, *p), t, n, y) for _ in range(rng.randint(0, 3)) for p, t, n, y in _boilerplate(texts, rng)]
    return before[:cut] + top + body + end + before[cut:]


def learn(pages: list[str | None], seed: int = 11) -> Labeller:
    rng = random.Random(seed)
    seen = []
    for page in pages:
        b = blocks(page)
        if not b:
            continue
        seen.append((vectors(b), np.array([told(p) for p, _, _ in b], np.float32)))
        for _ in range(DISGUISES):
            d = disguise(b, rng)
            seen.append((vectors([x[:3] for x in d]), np.array([x[3] for x in d], np.float32)))
    model = Labeller()
    if seen:
        model.train(seen)
    return model


def labels_of(model: Labeller, pages: list[list[tuple]]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length share a matrix."""
    slots, paths = _Slots(), {}
    jobs = [(len(page), k, vectors(page, slots, paths)) for k, page in enumerate(pages) if page]
    out = [np.zeros(len(p), dtype=bool) for p in pages]
    jobs.sort(key=lambda j: j[0])
    for s in range(0, len(jobs), 64):
        part = jobs[s:s + 64]
        for c, (n, k, _) in zip(model.chances([j[2] for j in part]).T, part):
            out[k] = c[:n] > 0.5
    return out


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``pages`` in ``row`` with ``main``, the text of its main blocks joined by line ends.

    Null, empty and text-free pages have an empty text; repeated rows get equal texts. Without pages to learn from the untrained network judges.
    """
    small_batches(pages.sparkSession)
    hashed = pages.select("html", F.xxhash64("page_id").alias("k"))
    cut = hashed.select("k").orderBy("k").limit(sample).agg(F.max("k")).first()[0]  # so that no partition offers whole pages beyond the sample
    taken = hashed.where(F.col("k") <= F.lit(cut).cast("long")).withColumn("j", F.xxhash64("html")).orderBy("k", "j").limit(sample)
    model = learn([r.html for r in taken.collect()])  # bounded by ``sample``
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    schema = T.StructType([*pages.select(row).schema.fields, T.StructField("main", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(x) for x in b.column(1).to_pylist()]
            texts = ["\n".join(t for (_, t, _), k in zip(page, keep.tolist()) if k) for page, keep in zip(found, labels_of(model, found))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "main"])

    return pages.select(row, "html").mapInArrow(run, schema)
