"""Secret scans: base patterns plus assignment-aware lexing.

The base patterns find credentials by shape. The lexer reads source and
configuration syntax into name-literal pairs, propagates constants through plain
names and concatenations, and scores each literal by the words of the names that
it reaches. One pass over the documents, no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Kinds in listed order; ties of a start go by this order.
KINDS = ("assign", "access", "hex", "named")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A token's beginning; comments and strings are closed by `tokens`, which never looks at a text's rest twice.
TOKEN = re.compile(
    r"""(?P<comment>/\*)
      | (?P<string>(?:\b[rbuf]{1,2})?["'`])
      | (?P<element><(?P<tag>[A-Za-z][\w.\-]*+)[^<>\n]*+>(?P<inner>[^<>\n]++)</(?P=tag)>)
      | (?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+])
      | (?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+)
      | (?P<bare>[\w+/~!@\#%^&*.\-]+)
      | (?P<end>[\n;,{}])
      | (?P<other>\S)""",
    re.X | re.A,
)
NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+", re.A)
BARE = re.compile(r"[\w+/~!@\#%^&*.\-]+", re.A)
INSIDE = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+"), "`": re.compile(r"(?:[^`\\]|\\.)*+")}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Weights of words (or pairs of words) in a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "apikey": 1.0, "api key": 1.0,
    "private key": 1.0, "access key": 1.0, "secret key": 1.0, "signing key": 0.9, "encryption key": 0.9,
    "client secret": 1.0, "bearer": 0.8, "salt": 0.6, "signature": 0.5,
}
#: A sensitive name holds one of these (the last words of SENSITIVE); only texts with one are lexed.
TARGET_STEMS = tuple(sorted({k.split()[-1] for k in SENSITIVE}))
#: Words that turn a name into something that isn't the secret itself.
BENIGN = {"count", "limit", "max", "min", "length", "len", "url", "uri", "file", "path", "dir", "name", "field", "label", "hint", "type", "policy", "expiry", "ttl", "prompt", "header", "id", "public", "column", "regex", "pattern"}
DECLARE = {"const", "let", "var", "final", "static", "public", "private", "protected", "export", "set", "def", "val", "string", "String", "char", "auto", "readonly"}
PLACEHOLDER = re.compile(r"""^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|change_?me|your[\w\-]*|example\w*|none|null|true|false|todo|redacted)$""", re.I)


@lru_cache(maxsize=1 << 14)
def name_score(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name.replace("-", "_"))]
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    score = max([SENSITIVE.get(w, 0.0) for w in words + pairs], default=0.0)
    return score * 0.3 ** len(BENIGN & set(words))


def literal_score(value: str, quoted: bool) -> float:
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    return _spread(Counter(value), n, quoted)


def _spread(counts: Counter, n: int, quoted: bool) -> float:
    """How random characters look."""
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digit, alpha = any(c.isdigit() for c in counts), any(c.isalpha() for c in counts)
    if not quoted and not (digit and alpha):
        return 0.0
    return min(1.0, entropy / 3.0) * (1.0 if digit or not all(c.isalpha() for c in counts) else 0.75)


def tokens(text: str):
    """(kind, start, end, match) of each token; comments are left out, an opener that nothing closes is a token of its own.

    Whether a quote is escaped depends only on the backslashes before it. So if no quote
    closes a string up to some place, none closes one that begins before that place
    either, and the search isn't repeated; nor is that for the end of a comment.
    """
    at, n, open_comment, dead = 0, len(text), False, dict.fromkeys(INSIDE, -1)
    search = TOKEN.search
    while m := search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "comment":
            end = -1 if open_comment else text.find("*/", at)
            if end >= 0:
                at = end + 2
                continue
            open_comment = True
            kind, at = "bare", BARE.match(text, start).end()
        elif kind == "string":
            quote = text[at - 1]
            end = at if start < dead[quote] else INSIDE[quote].match(text, at).end()
            if start >= dead[quote] and end < n and text[end] == quote:
                at = end + 1
            else:
                dead[quote] = max(dead[quote], end)
                if at - start > 1:
                    kind, at = "name", NAME.match(text, start).end()
                else:
                    kind = "other"
        elif m["element"] is not None:
            kind = "element"
        yield kind, start, at, m


def lex(text: str):
    """(name, right side, whether it goes on with the list before) statements; the right side holds names and literals with their spans."""
    pend: list[tuple[str, str, int, int]] = []
    target, right = None, []
    depth, more, outer = 0, False, []  # open brackets of the target's list, lists around an object
    closed = _closed(text) if "[" in text else set()

    def flush():
        if target is not None and right:
            yield target, list(right), more

    for kind, begin, stop, m in tokens(text):
        if kind == "element":
            yield from flush()
            target, right, pend = None, [], []
            inner = m["inner"]
            start = m.start("inner") + len(inner) - len(inner.lstrip())
            yield m["tag"], [("literal", inner.strip(), start, start + len(inner.strip()), False)], False
            depth, more = 0, False
            continue
        word = text[begin:stop]
        if kind == "other" and word == "[" and target is not None and (depth or begin in closed):
            depth += 1
        elif kind == "other" and word == "]" and depth:
            depth -= 1
        elif kind == "end" and depth and word == "\n":
            pass
        elif kind == "end" and depth and word == ",":
            yield from flush()
            more, right = more or bool(right), []
        elif kind == "end" and depth and word == "{":
            yield from flush()
            outer.append((target, depth, more or bool(right)))
            target, right, pend, depth, more = None, [], [], 0, False
        elif kind == "end" and word == "{" and outer:
            yield from flush()
            outer.append((None, 0, False))
            target, right, pend, depth, more = None, [], [], 0, False
        elif kind == "end" and word == "}" and outer:
            yield from flush()
            (target, depth, more), right, pend = outer.pop(), [], []
        elif kind == "end":
            yield from flush()
            target, right, pend, depth, more = None, [], [], 0, False
        elif kind == "string":
            quote = min(i for i in (word.find(q) for q in "\"'`") if i >= 0)
            item = ("literal", word[quote + 1 : -1], begin + quote + 1, stop - 1, True)
            if target is None:
                pend = [("name", word[quote + 1 : -1], begin, stop)]
            else:
                right.append(item)
        elif kind == "op" and word in (":=", "=>", "=", ":", "+="):
            if target is not None and word == "=" and not any(x[0] == "literal" for x in right):
                right = []  # `name: type = value`
            elif pend and target is None:
                target, right = pend[0][1], []
        elif kind in ("name", "bare"):
            if target is None:
                if word not in DECLARE or kind == "bare":
                    pend = [("name", word, begin, stop)]
            elif right and right[-1][0] in ("ref", "word") and right[-1][3] == begin:
                _, before, start, _, _ = right.pop()
                right.append(("word", before + word, start, stop, False))
            else:
                right.append(("ref" if kind == "name" else "word", word, begin, stop, False))
        elif kind == "op" and word == "=" and right:
            pass
    yield from flush()


def _closed(text: str) -> set[int]:
    """Places of the brackets that are closed."""
    left, out = [], set()
    for kind, start, _, _ in tokens(text):
        if kind == "other" and text[start] == "[":
            left.append(start)
        elif kind == "other" and text[start] == "]" and left:
            out.add(left.pop())
    return out


class _Value:
    """What a name stands for: its own literals, the values it takes over, the characters of both."""

    __slots__ = ("literals", "taken", "chars", "weight", "joint")

    def __init__(self):
        self.literals: list[tuple[int, int, bool, float]] = []
        self.taken: list[_Value] = []
        self.chars: Counter = Counter()
        self.weight = self.joint = 0.0


def named_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Literals that reach a sensitive name: (start, end, name, score).

    A literal's score is its own, or that of all characters that one statement joins, its
    own literals and those of the names in it. Each value takes part again only when a
    more sensitive name or a better statement reaches it.
    """
    bound: dict[str, _Value] = {}
    best: dict[tuple[int, int], tuple[float, str]] = {}

    def offer(start: int, end: int, score: float, name: str) -> None:
        if score >= 0.5 and end > start and score > best.get((start, end), (0.0, ""))[0]:
            best[start, end] = (score, name)

    for target, right, more in lex(text):
        value = _Value()
        for kind, said, start, end, quoted in right:
            if kind == "literal" or (len(right) == 1 and not (kind == "ref" and said in bound)):
                quoted = quoted and kind == "literal"
                value.literals.append((start, end, quoted, literal_score(said, quoted)))
                value.chars.update(said)
            elif kind == "ref" and said in bound:
                value.taken.append(bound[said])
                value.chars.update(bound[said].chars)
        weight = name_score(target)
        size = value.chars.total()
        if weight > 0 and len(right) > 1 and size >= 6 and not any(c.isspace() for c in value.chars):
            joint = weight * _spread(value.chars, size, True)
            for part in (value, *value.taken):
                if joint > part.joint:
                    part.joint = joint
                    for start, end, quoted, _ in part.literals:
                        if quoted:
                            offer(start, end, joint, target)
        if more and target in bound:
            value.taken.append(bound[target])
        bound[target] = value
        reached = [value] if weight > 0 else []
        while reached:
            part = reached.pop()
            if weight > part.weight:
                part.weight = weight
                for start, end, _, score in part.literals:
                    offer(start, end, weight * score, target)
                reached += part.taken
    return sorted((s, e, name, score) for (s, e), (score, name) in best.items())


def scan(text: str | None) -> list[dict]:
    """All spans of one text, by start, then kind as listed."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m.group(1), 1.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None, 1.0) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None, 1.0) for m in HEX.finditer(text)]
    if any(w in low for w in TARGET_STEMS):
        # Base spans, joined where they overlap.
        begins, ends = [], []
        for _, a, b, _, _ in sorted(out, key=lambda x: x[1]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        for s, e, name, score in named_spans(text):
            k = bisect_left(begins, e) - 1
            if k < 0 or ends[k] <= s:
                out.append(("named", s, e, name, score))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return [{"kind": k, "start": s, "end": e, "name": n, "score": v} for k, s, e, n, v in out]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and `spans`, all findings of the whole text.

    spans: array of (kind, start, end, name, score), code point offsets, end exclusive,
    by start, then kind (assign, access, hex, named). `named` are literals that the
    lexer ties to a sensitive name and no base pattern overlaps. Null or empty texts
    give an empty array; repeated rows are scanned and returned each; an empty table
    gives an empty result; columns besides id and text are ignored, whatever their names.
    Time grows in proportion to a text's length.
    """
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scan(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, type=SPANS)], names=["id", "spans"])

    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>").withColumnRenamed("id", id_col)
