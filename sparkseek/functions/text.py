"""Text, HTML and lemma expressions: built-in column functions only."""

from __future__ import annotations

import json
import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation except the full stop.
PUNCTUATION = r"[!-\-/:-@\[-`{-~]+"
#: Dotted tokens stay whole; full stops behind a word are tokens of their own.
TOKEN = r"[^ \t\r\n.]+(\.[^ \t\r\n.]+)*|\.+"
#: The same for Java, whose matcher calls itself for each turn of a loop that may give back what it took.
TOKEN_JAVA = r"[^ \t\r\n.]++(?:\.[^ \t\r\n.]++)*+|\.+"
KEPT = r"^[a-zA-Z0-9]+$"
SPACE = r"[ \t\r\n]+"
HIDDEN = r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->"
INLINE_TAG = r"(?i)</?(a|abbr|b|cite|code|em|i|mark|s|small|span|strong|sub|sup|u)(\s[^>]*)?/?>"
NESTED = r"(?is)<(a|b|cite|code|em|i|span|strong|u)\b[^>]*>.*?(</(a|b|cite|code|em|i|span|strong|u)>|\z)"
PARAGRAPH_END = r"(?is)^(.*?)(?:</?(?:p|div|article|aside|section|footer|nav|ul|ol|li|table|h[1-6])\b|\z)"
#: HTML's named characters; the no-break space counts as a space.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
#: An attribute's value in any quoting.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = rf"""(?is)<a\s[^>]*?\bhref\s*=\s*{VALUE}"""
BASE = rf"""(?is)<base\s[^>]*?\bhref\s*=\s*{VALUE}"""
META = r"""(?is)<meta\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
META_JAVA = META.replace(")*>", ")*+>")
META_NAME = r"""(?is)\bname\s*=\s*["']?description["'\s/>]"""
META_CONTENT = rf"""(?is)\bcontent\s*=\s*{VALUE}"""
#: Words of this length and above are left out of the inverted index.
LONG_WORD = 30

#: Irregular forms and (suffix, replacement, shortest word) rules of the rule lemmatiser.
IRREGULAR = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "did": "do", "done": "do", "went": "go", "gone": "go", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "feet": "foot"}
SUFFIXES = (("ies", "y", 5), ("sses", "ss", 6), ("xes", "x", 5), ("ches", "ch", 6), ("shes", "sh", 6), ("ing", "", 7), ("ed", "", 6), ("s", "", 4))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def tokens(c: Column) -> Column:
    """All tokens in order; positions are indices into this array."""
    return F.regexp_extract_all(c, F.lit(TOKEN_JAVA), F.lit(0))


def is_word(c: Column) -> Column:
    return c.rlike(KEPT)


def lemma(c: Column, kind: str = "identity") -> Column:
    """`identity` keeps lower case words; `rules` maps irregular forms and strips English suffixes."""
    word = F.lower(c)
    if kind == "identity":
        return word
    if kind != "rules":
        raise ValueError(f"no lemmatiser named {kind}")
    out = F.when(word.isin(*IRREGULAR), F.element_at(F.create_map(*[F.lit(x) for p in IRREGULAR.items() for x in p]), word))
    for suffix, to, least in SUFFIXES:
        fits = word.endswith(suffix) & (F.length(word) >= least)
        if suffix == "s":
            fits = fits & ~word.endswith("ss")
        out = out.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(to)))
    return out.otherwise(word)


def lemma_of(word: str, kind: str = "identity") -> str:
    """The lemma of one word, as `lemma` gives it."""
    word = word.lower()
    if kind == "identity" or word in IRREGULAR:
        return IRREGULAR.get(word, word) if kind == "rules" else word
    for suffix, to, least in SUFFIXES:
        if word.endswith(suffix) and len(word) >= least and not (suffix == "s" and word.endswith("ss")):
            return word[: -len(suffix)] + to
    return word


def query_words(text: str, lemmatizer: str = "identity") -> list[str]:
    """A query's words: analysed like a document, but its punctuation isn't stripped first."""
    return [lemma_of(m[0], lemmatizer) for m in re.finditer(TOKEN, text) if re.fullmatch(r"[a-zA-Z0-9]+", m[0])]


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal character references, each once; others stay as they are."""
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folded to one literal

    def piece(p: Column) -> Column:
        named = F.try_element_at(table, F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1))
        number = F.regexp_extract(p, "^#([0-9]{1,7});", 1).try_cast("int")
        digits = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.coalesce(number, F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("int"))
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(code == 160, " ").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        rest = F.regexp_replace(p, "^[^;]*;", "")
        return F.coalesce(F.concat(F.coalesce(named, char), rest), F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 100_000_000), piece), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def unquote(c: Column) -> Column:
    """An attribute's value without its quotes."""
    return F.regexp_replace(c, r"""^["']|["']$""", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def markup_text(c: Column) -> Column:
    """Text of a fragment: inline tags vanish, others part words."""
    return collapse(decode_entities(F.regexp_replace(F.regexp_replace(c, INLINE_TAG, ""), "<[^>]*>", " ")))


def html_text(c: Column) -> Column:
    """Visible text of a page, its title included."""
    return markup_text(F.regexp_replace(c, HIDDEN, " "))


def html_title(c: Column) -> Column:
    return collapse(decode_entities(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_description(c: Column) -> Column:
    """Content of the first description meta element, empty if there is none; attributes in any order and quoting."""
    told = F.filter(F.regexp_extract_all(c, F.lit(META_JAVA), F.lit(0)), lambda m: m.rlike(META_NAME))
    first = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(""))
    return collapse(decode_entities(unquote(F.regexp_extract(first, META_CONTENT, 1))))


def html_links(c: Column) -> Column:
    """Raw href values of all anchors in any quoting, in page order, duplicates kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(HREF), F.lit(1)), unquote)


def html_base(c: Column) -> Column:
    """Raw href of the page's base element, empty if there is none."""
    return unquote(F.regexp_extract(c, BASE, 1))


def html_paragraphs(c: Column) -> Column:
    """Markup inside each p element, up to the next block."""
    pieces = F.split(F.regexp_replace(c, HIDDEN, " "), r"(?i)<p\b[^>]*>")
    return F.transform(F.slice(pieces, 2, 100_000_000), lambda x: F.regexp_extract(x, PARAGRAPH_END, 1))


def own_text(c: Column) -> Column:
    """Text of a paragraph that isn't inside a nested element."""
    return markup_text(F.regexp_replace(c, NESTED, " "))


def truncate(c: Column, n: int) -> Column:
    """Cut to n characters with an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def highlight(c: Column, words: list[str]) -> Column:
    """Wrap whole-word matches, upper-cased, in b elements; inserted tags are never matched again. Letters, digits and the underscore of ASCII make words."""
    for word in dict.fromkeys(w for w in words if w):
        c = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])", "\x01" + word.upper().replace("\\", "\\\\").replace("$", "\\$") + "\x02")
    return F.replace(F.replace(c, F.lit("\x01"), F.lit("<b>")), F.lit("\x02"), F.lit("</b>"))
