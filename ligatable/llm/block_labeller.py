"""Main text of web pages: a recurrent network labels every block of a page."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.llm.common import LOWER, hash_table, pieces, rows_out, small_batches, word_hashes
from ligatable.llm.gru import Adam, sigmoid

#: Hash buckets of tag paths and of words, and plain numbers, of a block.
PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 48, 32, 7
HIDDEN = 12
#: Pages that training reads at most, and the longest of these.
TRAIN_PAGES, TRAIN_CHARS = 600, 200_000
EPOCHS = 8

PAGE_ROWS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
)

#: Elements of HTML by their role in the layout.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK_TAGS - {"button", "option", "caption", "td", "th"}
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("aside button dialog footer form header menu nav option search select".split())
OTHER_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|rail|widget|menu|nav\w*|breadcrumbs?|footer|header|"
    r"masthead|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|"
    r"social|comments?|reply|replies|disqus|related|recommended|copyright|legal|pagination|pager|toolbar|skip)(?:$|[-_ ])",
    re.I,
)

#: Elements whose content is no markup; an unclosed one runs to the end of the page.
RAW_TAGS = frozenset("script style title textarea".split())
#: Elements that are not shown, from tag to tag.
HIDDEN_TAGS = frozenset("noscript template iframe svg object".split())
#: HTML that ends an open drawing, as drawings cannot hold it.
ENDS_SVG = BLOCK_TAGS - {"a", "button", "caption", "option", "search", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}

START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
#: The same, where a quote is never closed.
PLAIN_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<rest>[^>]*+)>", re.S)
#: Quotes never closed after which a page's tags are read without regard to quotes, to stay linear.
BROKEN_QUOTES = 32
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A leaf of the page: its text, where it stands, and how much of it is links."""

    text: str
    path: tuple[str, ...]
    linked: int


@dataclass
class _Reader:
    """Turns a page into blocks; open elements are kept as tag and path tokens."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    #: The first open element that is not shown.
    hidden: int | None = None

    def flush(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            self.blocks.append(Block(text, tuple(t for _, tokens in self.open for t in tokens), self.linked))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if self.hidden is not None:
            return
        self.parts.append(raw)
        if self.in_link:
            self.linked += len(raw)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                if self.hidden is not None and self.hidden >= i:
                    self.hidden = None
                return

    def in_svg(self) -> bool:
        return next((t for t, _ in reversed(self.open) if t in ("svg", "foreignobject", "template")), "") == "svg"

    def hide(self, name: str, closing: bool, empty: bool) -> None:
        """An element that is not shown opens or closes; paragraphs around it go on."""
        if closing:
            self._close(name)
        elif not empty:
            if self.hidden is None:
                self.hidden = len(self.open)
            self.open.append((name, ()))

    def _tag_in_hidden(self, name: str, closing: bool, empty: bool) -> bool:
        """Notes a tag inside of what is not shown; false if the tag ends that."""
        if not closing and name in ENDS_SVG and self.in_svg():
            self._close("svg")
            return self.hidden is not None
        if name not in BLOCK_TAGS and name != "foreignobject":
            return True
        at = max((i for i, (t, _) in enumerate(self.open) if t == name), default=-1)
        if closing:
            if 0 <= at < self.hidden:
                del self.open[self.hidden :]
                self.hidden = None
                return False
            self._close(name)
        elif name not in VOID_TAGS and not empty:
            self.open.append((name, ()))
        return True

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if self.hidden is not None and self._tag_in_hidden(name, closing, attributes.endswith("/")):
            return
        if name == "a":
            self.in_link = not closing
        elif name == "br":
            self.parts.append(" ")
        elif name in BLOCK_TAGS:
            self.flush()
            self.in_link = False
            if closing:
                self._close(name)
                return
            if name in ENDS_P and self.open and self.open[-1][0] == "p":
                self.open.pop()
            elif name in ("li", "option", "dt", "dd", "tr", "td", "th") and self.open and self.open[-1][0] == name:
                self.open.pop()
            if name not in VOID_TAGS and not attributes.endswith("/"):
                named = [n for m in NAMES.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()]
                self.open.append((name, (name, *(f".{n}" for n in named))))


def _last_close(page: str, name: str) -> int:
    return max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)


def _token(page: str, at: int, quoted: bool) -> tuple[int, int, re.Match | None, bool] | None:
    """First and end of the next tag, with its match, or comment, and whether its quotes are closed."""
    m = START.search(page, at)
    if not m:
        return None
    first = m.start()
    if m[0] == "<!--":
        end = page.find("-->", first + 4)
        return first, len(page) if end < 0 else end + 3, None, True
    end = page.find(">", first) + 1
    if not end:
        # no tag ends any more; only a comment can follow
        comment = page.find("<!--", first)
        return None if comment < 0 else (comment, len(page), None, True)
    if not m[0][-1].isalpha():
        return first, end, None, True
    tag = TAG.match(page, first) if quoted else None
    closed = tag is not None
    tag = tag or PLAIN_TAG.match(page, first)
    return first, tag.end(), tag, closed


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; markup, comments, scripts and the head's title are none.

    Scripts, styles, titles and text areas hold no markup and run to the page's end if
    not closed. Drawings, objects, templates, frames and ``noscript`` end with their
    own end tag or with that of an element around them; those that are closed in
    their own tag, or never closed behind it, are empty.
    """
    reader, last, broken = _Reader(), 0, 0
    closes: dict[str, int] = {}
    while token := _token(page, last, broken < BROKEN_QUOTES):
        first, end, m, closed = token
        broken += not closed
        if first > last:
            reader.text(page[last:first])
        last = end
        if not m:
            continue
        name, closing, rest = m["tag"].lower(), bool(m["close"]), m["rest"]
        # a name goes on until white space, a slash or the end of the tag
        whole = not rest or rest[0] in "/ \t\n\r\f"
        if whole and name in RAW_TAGS and not closing:
            if rest.endswith("/") and reader.in_svg():
                continue
            behind = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, last)
            last = behind.end() if behind else len(page)
        elif whole and name in HIDDEN_TAGS:
            if name not in closes:
                closes[name] = _last_close(page, name)
            empty = closes[name] < last or (name in ("svg", "object") and rest.endswith("/"))
            reader.hide(name, closing, empty)
        elif whole:
            reader.tag(name, closing, rest)
    reader.text(page[last:])
    reader.flush()
    return reader.blocks


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 for what semantic markup calls the article, by block.

    Where a page marks no article, running text outside of marked-up furniture counts.
    """
    marked = any(t in MAIN_TAGS for b in blocks for t in b.path)
    labels = []
    for b in blocks:
        at = max((i for i, t in enumerate(b.path) if t in MAIN_TAGS), default=-1)
        inside = b.path[at + 1 :]
        other = any(t in OTHER_TAGS if t[0] != "." else OTHER_WORDS.search(t[1:]) for t in inside)
        if marked and at < 0:
            other = True
        if not marked and (len(b.text.split()) < 8 or b.linked * 3 > len(b.text)):
            other = True
        labels.append(0.0 if other else 1.0)
    return np.array(labels, np.float32)


def features(blocks: list[Block], table: np.ndarray) -> np.ndarray:
    """A row a block: hashed tag path, hashed words of the whole text, and numbers."""
    x = np.zeros((len(blocks), PATH_BUCKETS + WORD_BUCKETS + NUMBERS), np.float32)
    known: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(blocks):
        path = known.get(b.path)
        if path is None:
            path = np.zeros(PATH_BUCKETS, np.float32)
            for t in b.path:
                path[zlib.crc32(t.encode()) % PATH_BUCKETS] += 1
            # the innermost element once more
            for t in b.path[-2:]:
                path[zlib.crc32(b"in " + t.encode()) % PATH_BUCKETS] += 1
            known[b.path] = path = np.tanh(path)
        x[i, :PATH_BUCKETS] = path
    joined = "\n".join(b.text for b in blocks).encode().translate(LOWER)
    hashes, starts, _ = word_hashes(joined, table)
    ends = np.cumsum([len(b.text.encode()) + 1 for b in blocks])
    owner = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(
        owner * WORD_BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=len(blocks) * WORD_BUCKETS
    ).reshape(len(blocks), WORD_BUCKETS)
    words = counts.sum(axis=1)
    x[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts / np.sqrt(np.maximum(words, 1))[:, None]
    sizes = np.array([len(b.text) for b in blocks], np.float32)
    place = np.arange(len(blocks)) / max(1, len(blocks) - 1)
    x[:, -NUMBERS:] = np.stack(
        (
            np.log1p(words) / 5,
            np.log1p(sizes) / 7,
            np.minimum([b.linked for b in blocks] / sizes, 1),
            [b.text[-1] in ".!?…" for b in blocks],
            place,
            1 - place,
            [b.text[0].isupper() for b in blocks],
        ),
        axis=1,
    )
    return x


class Labeller:
    """A bidirectional LSTM over the blocks of a page, with a logistic output a block."""

    def __init__(self, seed: int = 21):
        rng = np.random.default_rng(seed)
        width = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
        self.p: dict[str, np.ndarray] = {"o": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}
        for way in "fb":
            self.p[f"w{way}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            self.p[f"u{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"s{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _read(self, way: str, x: np.ndarray, keep: np.ndarray, tape: list | None) -> np.ndarray:
        """States by ``(time, page)``; padding in front or behind leaves them alone."""
        n, u = HIDDEN, self.p[f"u{way}"]
        given = x @ self.p[f"w{way}"] + self.p[f"s{way}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape[:2], n), np.float32)
        for t in range(len(x)):
            a = given[t] + h @ u
            gates, g = sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            k = keep[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if tape is not None:
                tape.append((h, c, i, f, o, g, tc))
            c = np.where(k > 0, c_new, c)
            h = np.where(k > 0, o * tc, h)
            out[t] = h
        return out

    def _back(self, way: str, x: np.ndarray, keep: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        u = self.p[f"u{way}"]
        d_given = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_u = np.zeros_like(u)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[t]
            k = keep[t][:, None]
            dh = dh + d_out[t]
            dk = dh * k
            d_c = dc * k + dk * o * (1 - tc * tc)
            d_a = np.concatenate(
                (d_c * g * i * (1 - i), d_c * c * f * (1 - f), dk * tc * o * (1 - o), d_c * i * (1 - g * g)), axis=1
            )
            d_given[t] = d_a
            d_u += h.T @ d_a
            dh = dh * (1 - k) + d_a @ u.T
            dc = dc * (1 - k) + d_c * f
        flat = d_given.reshape(-1, 4 * HIDDEN)
        return {f"w{way}": x.reshape(-1, x.shape[2]).T @ flat, f"u{way}": d_u, f"s{way}": flat.sum(axis=0)}

    def _batch(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, pages))
        x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
        keep = np.zeros((longest, len(pages)), np.float32)
        for i, page in enumerate(pages):
            x[: len(page), i], keep[: len(page), i] = page, 1
        return x, keep

    def _states(self, x: np.ndarray, keep: np.ndarray, tapes: tuple | None = None) -> np.ndarray:
        f = self._read("f", x, keep, tapes and tapes[0])
        b = self._read("b", x[::-1], keep[::-1], tapes and tapes[1])[::-1]
        return np.concatenate((f, b), axis=2)

    def probabilities(self, pages: list[np.ndarray], most: int = 1 << 14) -> list[np.ndarray]:
        """By page, the probability of each block to be main text."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            # pages of like length together, as many as have most blocks with padding
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= most:
                end += 1
            x, keep = self._batch([pages[i] for i in order[at:end]])
            p = sigmoid(self._states(x, keep) @ self.p["o"] + self.p["c"])
            for lane, i in enumerate(order[at:end]):
                out[i] = p[: len(pages[i]), lane]
            at = end
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 22) -> None:
        """Backpropagation through time.

        Some pages are shown without tag paths, so that words and neighbours have a say too.
        """
        rng, adam, size = np.random.default_rng(seed), Adam(0.01), 16
        for _ in range(epochs):
            order = np.argsort([len(p) for p in pages] + rng.random(len(pages)), kind="stable")
            for at in rng.permutation(np.arange(0, len(order), size)):
                chosen = order[at : at + size]
                x, keep = self._batch([pages[i] for i in chosen])
                y, _ = self._batch([labels[i][:, None] for i in chosen])
                blind = rng.random(len(chosen)) < 0.15
                x[:, blind, :PATH_BUCKETS] = 0
                tapes: tuple[list, list] = ([], [])
                states = self._states(x, keep, tapes)
                d = (sigmoid(states @ self.p["o"] + self.p["c"]) - y[:, :, 0]) * keep / keep.sum()
                back = d[:, :, None] * self.p["o"]
                grads = {"o": np.einsum("tp,tph->h", d, states), "c": np.array([d.sum()], np.float32)}
                grads |= self._back("f", x, keep, tapes[0], back[:, :, :HIDDEN])
                grads |= self._back("b", x[::-1], keep[::-1], tapes[1], back[::-1, :, HIDDEN:])
                adam.step(self.p, grads)


def learn(pages: DataFrame, most: int = TRAIN_PAGES) -> Labeller:
    """A labeller from at most ``most`` pages, by hash of id and address; semantic markup gives the labels."""
    key = F.xxhash64(F.lit(8), "page_id", "url")
    # keys are chosen first, so that no task gathers more pages than are wanted
    chosen = F.broadcast(pages.select(key.alias("key")).orderBy("key").limit(most))
    keyed = pages.select(key.alias("key"), F.col("html").cast("string").alias("html"))
    usable = keyed.join(chosen.distinct(), "key").filter(f"html is not null and length(html) <= {TRAIN_CHARS}")
    sample = sorted(usable.limit(most).collect(), key=lambda r: (r.key, r.html))
    table, labeller = hash_table(), Labeller()
    read = [b for b in (page_blocks(r.html) for r in sample) if b]
    if read:
        labeller.train([features(b, table) for b in read], [weak_labels(b) for b in read])
    return labeller


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages (page_id, url, html)``.

    The whole page is cut into leaf blocks. The network reads the tag path and the words
    of every block, forwards and backwards over the page, and decides for each whether
    it is main text. Chosen blocks are joined by newlines in page order; inside a block
    character references are decoded and white space is one space. Null, empty and
    textless pages give an empty text. Rows stand alone: repeated rows and null ids come
    back. Without a ``labeller`` one is trained on a bounded sample of these pages.
    """
    small_batches(pages.sparkSession)
    labeller = labeller or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        for piece in pieces(batches, 2 << 20):
            read = [page_blocks(h or "") for h in piece.column(2).to_pylist()]
            found = labeller.probabilities([features(b, table) if b else np.empty((0, 0)) for b in read])
            texts = ["\n".join(b.text for b, p in zip(blocks, ps) if p > 0.5) for blocks, ps in zip(read, found)]
            yield rows_out(PAGE_ROWS, [piece.column(0), piece.column(1), texts, [len(t) for t in texts]])

    picked = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
