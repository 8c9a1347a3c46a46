"""Main-text extraction: a recurrent block labeller over a page's leaf blocks.

A page is parsed into blocks of text, each with its tag path. A bidirectional LSTM in
numpy reads the sequence of tag-path and hashed-word vectors and labels every block as
article or not, with the whole page as context. `html_train` trains the weights.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices

WEIGHTS = "block_labeller.npz"
PATH_SIZE, OWN_SIZE, WORD_SIZE, STATS = 192, 64, 96, 20
WIDTH = PATH_SIZE + OWN_SIZE + WORD_SIZE + STATS
#: Blocks that are labelled at a time; a longer page goes through in chunks of as many.
CHUNK = 1 << 13

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>")
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)")
#: Attributes whose quoted values all end; and the pieces of attributes otherwise.
_CLOSED = re.compile(r"""(?:[^="']++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))|["'])*+""")
_PIECE = re.compile(r"""[^>=]++|=\s*+""")
_BARE_SLASH = re.compile(r"""=\s*[^\s"'>]*/$""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements by their kind in HTML. RAW holds no markup; the text of HIDDEN isn't shown.
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
HIDDEN = {"select", "datalist", "svg", "object", "template", "audio", "video", "canvas", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
INLINE |= HIDDEN | {"math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_DIGIT = re.compile(r"\d")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"li", "dt", "dd", "td", "th", "option"}


class _Hash(dict):
    def __init__(self, size: int, seed: int):
        super().__init__()
        self.size, self.seed = size, seed

    def __missing__(self, word):
        if len(self) > 1 << 16:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), self.seed) % self.size
        return value


_path, _own, _words = _Hash(PATH_SIZE, 1), _Hash(OWN_SIZE, 2), _Hash(WORD_SIZE, 3)


@lru_cache(maxsize=1 << 14)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    names = ["<" + tag]
    for m in _ATTRIBUTE.finditer(attributes):
        names += [w.lower() for w in _NAME.findall(m[2] or m[3] or m[4] or "") if not w.isdigit()]
    return tuple(dict.fromkeys(names))


class _Markup:
    """Where a page's tags end; no part of the page is searched again after a search failed there."""

    def __init__(self, page: str):
        self.page, self.failed, self.last = page, set(), {}

    def find(self, said: str, at: int) -> int:
        """The next place of a string, or -1."""
        if said in self.failed:
            return -1
        found = self.page.find(said, at)
        if found < 0:
            self.failed.add(said)
        return found

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag that begins here, if it is one.

        A quoted value may hold `>`. One that nothing ends is no value, and if quotes leave
        no end to the tag, it ends at its first `>`.
        """
        m = _TAG.match(self.page, at)
        if m and ("=" not in m[3] or _CLOSED.fullmatch(m[3])):
            return m.end(), m[1], m[2].lower(), m[3]
        m = _OPEN.match(self.page, at)
        if not m or (close := self.find(">", m.end())) < 0:
            return None
        end = m.end()
        while "broken" not in self.failed:
            piece = _PIECE.match(self.page, end)
            if piece:
                end = piece.end()
                quote = self.page[end : end + 1]
                if piece[0][0] == "=" and quote in ('"', "'") and (after := self.find(quote, end + 1)) >= 0:
                    end = after + 1
            elif end < len(self.page):
                return end + 1, m[1], m[2].lower(), self.page[m.end() : end]
            else:
                self.failed.add("broken")
        return close + 1, m[1], m[2].lower(), self.page[m.end() : close]

    def raw_end(self, tag: str, at: int) -> int:
        """The end of an element that holds no markup, or -1."""
        if tag in self.failed:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>?", re.I).search(self.page, at)
        if not m:
            self.failed.add(tag)
        return m.end() if m else -1

    def ends_later(self, tag: str, at: int) -> bool:
        """Whether an end tag of this name comes after a place."""
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).finditer(self.page)), default=-1)
        return self.last[tag] > at


class _Stack:
    """Open elements: where each name and each block element stands, and the names on the path as counters."""

    def __init__(self):
        self.open: list[tuple[str, tuple, int]] = [("", (), 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.names: dict[int, int] = {}
        self.links, self.hidden, self.opened = 0, -1, 0

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, own: tuple) -> None:
        at = len(self.open)
        self.opened += 1
        self.open.append((tag, own, self.opened))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        for w in own:
            k = _path[w]
            self.names[k] = self.names.get(k, 0) + 1
        self.links += tag == "a"

    def close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            tag, own, _ = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            for w in own:
                k = _path[w]
                self.names[k] -= 1
                if not self.names[k]:
                    del self.names[k]
            self.links -= tag == "a"


def blocks(page: str | None) -> list[tuple[str, tuple, tuple, str, float, int, int]]:
    """(text, columns of the names on the tag path, names of the innermost block element, its tag, share of characters in links, numbers of the two block elements around that).

    Takes time in proportion to the page, whatever its markup.
    """
    if not page:
        return []
    out: list = []
    stack, markup = _Stack(), _Markup(page)
    text: list[str] = []
    linked = total = 0

    def flush():
        nonlocal text, linked, total
        if text:
            said = " ".join("".join(text).split())
            if said:
                tag, own, _ = stack.open[stack.blocks[-1]]
                around = [stack.open[i][2] for i in stack.blocks[-3:-1]]
                out.append((said, tuple(sorted(stack.names)), own, tag, linked / max(total, 1), *([0, 0] + around)[-2:]))
        text, linked, total = [], 0, 0

    def say(said: str):
        nonlocal linked, total
        if said and stack.hidden < 0:
            text.append(entities.unescape(said) if "&" in said else said)
            total += len(said)
            linked += len(said) * (stack.links > 0)

    def leave(down_to: int):
        """Close elements; a block that ends outside of a hidden element ends the text before that."""
        if 0 <= down_to <= stack.hidden:
            hidden, stack.hidden = stack.hidden, -1
            stack.close(hidden)
            if down_to < hidden and down_to <= stack.blocks[-1]:
                flush()
        stack.close(down_to)

    begin = at = 0
    while (at := page.find("<", at)) >= 0:
        tag = ""
        if page.startswith("<!--", at):
            end = markup.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?") or (page[at + 1 : at + 2] == "/" and not _OPEN.match(page, at)):
            end = markup.find(">", at) + 1
        else:
            end, slash, tag, attributes = markup.tag(at) or (0, "", "", "")
        if not end:
            at += 1
            continue
        say(page[begin:at])
        begin = at = end
        if not tag:
            continue
        if tag == "br":
            say("\n")
            continue
        inline = tag in INLINE or tag in RAW
        if not inline and stack.hidden < 0:
            flush()
        if slash:
            place = stack.last((tag,))
            if place and (tag in HIDDEN or not (inline and place < stack.blocks[-1])):
                leave(place)
            continue
        closed = attributes.endswith("/") and not _BARE_SLASH.search(attributes)
        if tag in RAW:
            end = markup.raw_end(tag, at)
            if end >= 0:
                begin = at = end
            elif tag in ("script", "style"):
                begin = at = len(page)
            continue
        if tag in VOID or (tag in HIDDEN and (closed or not markup.ends_later(tag, at))):
            continue
        if not inline and stack.hidden < 0:
            # A block ends an open paragraph; items and cells end their predecessors.
            if tag in CLOSES:
                ends, until = CLOSES[tag]
                place = stack.last(ends)
                if place > stack.last(until):
                    stack.close(place)
            elif stack.open[stack.blocks[-1]][0] == "p":
                stack.close(stack.blocks[-1])
        if tag in HIDDEN and stack.hidden < 0:
            stack.hidden = len(stack.open)
        stack.push(tag, _names(tag, attributes))
    say(page[begin:])
    stack.hidden = -1
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def _columns(path: tuple, own: tuple) -> np.ndarray:
    return np.array([*path, *{PATH_SIZE + _own[w] for w in own}], np.int64)


def surroundings(found: list) -> np.ndarray:
    """For each block of a page: the shares of the page's characters in the elements around it, and whether its neighbours have the same parent."""
    out = np.zeros((len(found), 4), np.float32)
    if not found:
        return out
    chars = np.array([len(b[0]) * (1 - b[4]) for b in found])
    for k, numbers in enumerate(zip(*(b[5:7] for b in found))):
        _, which = np.unique(numbers, return_inverse=True)
        out[:, k] = np.bincount(which, chars)[which] / max(chars.sum(), 1)
    parent = np.array([b[6] for b in found])
    same = parent[1:] == parent[:-1]
    out[1:, 2], out[:-1, 3] = same, same
    return out


def vectors(found: list, first: int = 0, total: int | None = None, around: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of a page's blocks, or of those from `first` on of `total`."""
    n = len(found)
    total = n if total is None else total
    around = surroundings(found) if around is None else around
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    split = [b[0].split(" ") for b in found]
    size = np.array([len(w) for w in split])
    ids = np.fromiter((_words[w] for words in split for w in words), np.int64, int(size.sum()))
    counts = np.bincount(np.repeat(np.arange(n), size) * WORD_SIZE + ids, minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
    weight = np.log1p(counts)
    x[:, PATH_SIZE + OWN_SIZE : PATH_SIZE + OWN_SIZE + WORD_SIZE] = weight / np.sqrt((weight**2).sum(axis=1, keepdims=True))
    columns = [_columns(b[1], b[2]) for b in found]
    x[np.repeat(np.arange(n), [len(c) for c in columns]), np.concatenate(columns)] = 1
    chars = np.array([len(b[0]) for b in found])
    marks = np.array([sum(map(b[0].count, ".,。、")) for b in found])
    place = first + np.arange(n)
    x[:, WIDTH - STATS :] = np.stack(
        [
            np.log1p(chars) / 8, np.log1p(size) / 6, [b[4] for b in found], marks / size,
            [b[0][-1] in ".!?:;\"'”»。" for b in found], [b[3] in HEADINGS for b in found], [b[3] == "p" for b in found],
            place / total, np.full(n, total < 4), chars > 200,
            np.array([len(_DIGIT.findall(b[0])) for b in found]) / chars, np.array([sum(w[:1].isupper() for w in words) for words in split]) / size,
            ["©" in b[0] or "copyright" in b[0].lower() for b in found], [b[3] in CELLS for b in found],
            np.minimum(chars / size, 20) / 10, [b[3] == "div" for b in found], *around.T,
        ],
        axis=1,
    )
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run_lstm(x: np.ndarray, mask: np.ndarray, p: dict, side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states over time; x: (steps, pages, inputs), mask: (steps, pages). `keep` gets what training needs."""
    return _lstm(x, mask, p, side, None, keep)[0]


def _lstm(x: np.ndarray, mask: np.ndarray, p: dict, side: str, state: tuple | None, keep: list | None = None) -> tuple[np.ndarray, tuple]:
    """Hidden states over time from a state on, and the state after the last step."""
    steps, pages, _ = x.shape
    wx, wh, b = p[f"{side}x"], p[f"{side}h"], p[f"{side}b"]
    size = wh.shape[0]
    given = (x.reshape(-1, x.shape[2]) @ wx + b).reshape(steps, pages, 4 * size)
    h, c = state or (np.zeros((pages, size), x.dtype), np.zeros((pages, size), x.dtype))
    out = np.zeros((steps, pages, size), x.dtype)
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    for t in order:
        z = given[t] + h @ wh
        gates = sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        new = f * c + i * g
        tc = np.tanh(new)
        on = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, on))
        c = np.where(on, new, c)
        h = np.where(on, o * tc, h)
        out[t] = h
    return out, (h, c)


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k] = v
        mask[: len(v), k] = True
    return x, mask


def logits(x: np.ndarray, mask: np.ndarray, p: dict) -> np.ndarray:
    both = np.concatenate([run_lstm(x, mask, p, "f"), run_lstm(x, mask, p, "r")], axis=2)
    return both @ p["w"] + p["b"] + x @ p["s"]


@lru_cache(maxsize=1)
def weights() -> dict:
    import pkgutil
    from io import BytesIO

    if Path(__file__).with_name(WEIGHTS).exists():
        raw = Path(__file__).with_name(WEIGHTS).read_bytes()
    else:  # inside a zip archive
        raw = pkgutil.get_data(__package__, WEIGHTS)
    with np.load(BytesIO(raw)) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def label_long(found: list, p: dict, chunk: int = CHUNK) -> np.ndarray:
    """Labels of one long page: both directions go through in chunks that pass their states on."""
    n, size = len(found), p["fh"].shape[0]
    z, around = np.full(n, float(p["b"]), np.float32), surroundings(found)
    starts = range(0, n, chunk)
    for side, order, k in (("f", starts, 0), ("r", reversed(starts), 1)):
        state = (np.zeros((1, size), np.float32), np.zeros((1, size), np.float32))
        for at in order:
            x = vectors(found[at : at + chunk], at, n, around[at : at + chunk])
            hidden, state = _lstm(x[:, None], np.ones((len(x), 1), bool), p, side, state)
            z[at : at + chunk] += hidden[:, 0] @ p["w"][k * size : (k + 1) * size]
            if side == "f":
                z[at : at + chunk] += x @ p["s"]
    return z > 0


def label(pages: list[list], p: dict | None = None, batch: int = 128) -> list[np.ndarray]:
    """For each page's blocks, whether they belong to the article."""
    p = p or weights()
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, x in enumerate(pages) if x), key=lambda i: len(pages[i]))
    while order and len(pages[order[-1]]) > CHUNK:
        out[order[-1]] = label_long(pages[order[-1]], p)
        order.pop()
    at = 0
    while at < len(order):
        longest = len(pages[order[min(at + batch, len(order)) - 1]])
        take = max(1, min(batch, 40_000 // longest))
        some = order[at : at + take]
        x, mask = pad([vectors(pages[i]) for i in some])
        found = logits(x, mask, p) > 0
        for k, i in enumerate(some):
            out[i] = found[: len(pages[i]), k]
        at += take
    return out


def main_text(pages: list[str | None]) -> list[str]:
    """The article text of each page: its blocks in page order, joined by an empty line."""
    found = [blocks(x) for x in pages]
    return ["\n\n".join(b[0] for b, keep in zip(f, k) if keep) for f, k in zip(found, label(found))]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Each page's `keep` columns with `text`, the article's text, and `n_chars`, its code points.

    Null or empty pages and pages without an article give an empty text; pages of any
    length and depth are read whole, in time proportional to their length; markup that is
    broken off or nested badly is read as far as it goes; repeated rows and ties are each
    extracted alike; an empty table gives an empty result; columns that aren't asked for
    are ignored, and `text` and `n_chars` replace columns of that name.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    (source,) = fresh([*keep, "text", "n_chars"], "source")
    chosen = pages.select(*[pages[c] for c in keep], pages[html_col].alias(source))

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                text = main_text(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(text, pa.string())], names=[*keep, "text"])

    kinds = dict(chosen.dtypes)
    out = chosen.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", " if keep else "") + "text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
