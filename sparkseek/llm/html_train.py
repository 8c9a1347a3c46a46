"""Trains the block labeller on generated pages: python -m sparkseek.llm.html_train.

Pages are drawn from a grammar of layouts (FAMILIES): semantic elements, divisions with
telling or with opaque class names, tables, and bare markup, with menus, headers, notices,
adverts, forms, sidebars, reader comments and footers around and inside articles. Words
are made up anew for each page. Nothing is read from disk. With `--families`, each family
is left out of the training in turn and labelled by what was learned from the others.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from .html import WEIGHTS, WIDTH, blocks, label, logits, pad, run_lstm, sigmoid, vectors

MARK = ""  # starts the text of article blocks in generated pages
HIDDEN = 32

#: Words that name the parts of a page in class names, ids and boilerplate.
CONTENT = "article post content entry main story body text post-content article-body entry-content main-content blog-post page-content prose markdown".split()
PARTS = {
    "nav": "nav navbar menu navigation main-menu top-nav breadcrumb breadcrumbs site-nav links pagination pager toc".split(),
    "header": "header site-header masthead top-bar banner branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "side": "sidebar aside side widget related related-posts recommended popular trending more-stories tags tag-list share social follow author-box".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert banner-message popup modal overlay paywall announcement disclaimer".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion sponsor adsbygoogle ad-slot banner-ad".split(),
    "form": "form newsletter subscribe signup login search search-form contact-form subscription".split(),
    "comments": "comments comment comment-list responses discussion replies disqus reader-comments feedback comment-body reply".split(),
}
SAID = {
    "nav": "Home About Contact News Products Login Blog Archive Sitemap Support Sports World Politics Previous Next Docs Pricing Careers Help FAQ Accueil Startseite Inicio".split(),
    "header": ["Skip to content", "Welcome", "The Daily News", "Your trusted source", "Menu", "Sign in", "Search", "Free delivery", "My account", "Log in"],
    "footer": ["&copy; 2024 All rights reserved.", "Copyright 2019-2023", "© The Company Ltd", "Privacy Policy", "Terms of Service", "Powered by WordPress", "Contact us", "Impressum", "Mentions légales", "Site map", "Back to top"],
    "side": ["Related articles", "Most read", "Share this", "Follow us", "About the author", "Tags", "Recent posts", "You may also like", "Read more", "Popular", "Trending now", "More from this section", "Categories"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies", "Please enable JavaScript", "Subscribe to continue reading", "Wir verwenden Cookies.", "Manage preferences", "Your browser is out of date."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Click here", "Limited offer", "Anzeige", "Shop now", "Ad", "Promoted", "Order today"],
    "form": ["Subscribe to our newsletter", "Enter your email", "Sign up", "Username", "Password", "Send", "Search", "Your name", "Subscribe", "Submit"],
    "comments": ["Leave a reply", "Great post, thanks!", "I disagree with this.", "Comments (12)", "Reply", "says:", "Log in to comment", "3 comments", "Discussion", "Opinions", "What readers say", "Join the conversation", "Responses", "Kommentare"],
}
TAGS = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "notice": ["div", "section", "dialog", "noscript"], "ad": ["div", "aside", "section"], "form": ["form"], "comments": ["section", "div"]}
#: Layouts: the share of plain divisions instead of semantic elements, and of opaque instead of telling names.
FAMILIES = {"semantic": (0.15, 0.1), "telling": (0.9, 0.0), "opaque": (1.0, 1.0), "table": (1.0, 0.6), "bare": (0.5, 0.5)}
COMMON = "the of and to in is that for it on as with was by from at this are be or la de el que en der die und le les des et un una por con das den von".split()


class Pages:
    def __init__(self, seed: int, families: tuple[str, ...] = tuple(FAMILIES)):
        self.r = random.Random(seed)
        self.families = families

    def lexicon(self) -> list[str]:
        """Words of consonants and vowels, some with common short words among them."""
        r = self.r
        heads = r.sample("b c d f g h j k l m n p r s t v w z st tr pl ch sh gr".split(), 12)
        tails = r.sample("a e i o u ai ou ee ia an en in or er al é ü ñ ö es is um".split(), 9)
        words = ["".join(r.choice(heads) + r.choice(tails) for _ in range(r.randint(1, 4))) for _ in range(300)]
        return words + r.sample(COMMON, 12) * r.choice([0, 6, 12])

    def word(self) -> str:
        return self.r.choice(self.known)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [self.word() for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            x = r.random()
            out[i] += "." if x < 0.08 else "," if x < 0.14 else ""
            if x < 0.08 and i + 1 < len(out):
                out[i + 1] = out[i + 1].capitalize()
        return " ".join(out).capitalize() + r.choice([".", ".", ".", ""])

    def odd(self) -> str:
        """Text of an article that doesn't look like prose: numbers, marks, one word over and over, capitals."""
        r = self.r
        kind = r.randrange(8)
        n = r.randint(1, r.choice([12, 40, 40, 900]))
        if kind == 0:
            return " ".join(str(r.randint(0, 99999)) for _ in range(n))
        if kind == 1:
            return " ".join(r.choice(["|", "#", "%%", "--", "~", self.word(), "***", "::"]) for _ in range(n))
        if kind == 2:
            return " ".join([self.word()] * n)
        if kind == 7:
            return ", ".join(self.word() for _ in range(n)) + r.choice(["", "."])
        if kind == 6:
            return " ".join(r.choice([" ", " ", ", "]).join([w] * r.randint(2, 90)) for w in (self.word() for _ in range(r.randint(1, 12))))
        if kind == 3:
            return self.words(1, 30).upper()
        if kind == 4:
            return " ".join(f"{self.word()}{r.choice('=:_/@')}{r.choice([self.word(), str(r.randint(0, 999))])}" for _ in range(n))
        return self.word()

    def opaque(self) -> str:
        r = self.r
        return r.choice(["css-", "sc-", "x", "_", "w", "b", ""]) + "".join(r.choices("abcdefghkmqrtwxyz0123456789", k=r.randint(4, 7)))

    def attributes(self, part: str | None, need: bool = False) -> str:
        names, r = (PARTS[part] if part else CONTENT), self.r
        if not need and r.random() < 0.35:
            return ""
        name = self.opaque() if r.random() < self.blur else r.choice(names)
        extra = r.choice(["", "", " wrap", " container", " block-1", " col-md-8", " " + self.opaque()])
        return r.choice([f' class="{name}{extra}"', f' class="{name}{extra}"', f" id='{name}'", f" class={name}", f' data-x="1" class="{name}{extra}"'])

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a href='/x'", "code"])
            words[i] = f"<{tag}>{words[i]}" + (f"</{tag.split()[0]}>" if self.r.random() < 0.9 else "")
        return " ".join(words)

    def date(self) -> str:
        r = self.r
        return r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}", f"20{r.randint(10, 25)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(2, 23)} hours ago", f"May {r.randint(1, 30)}, 20{r.randint(10, 25)} at {r.randint(1, 12)}:{r.randint(10, 59)} pm"])

    def phrase(self, part: str) -> str:
        """What such a part says."""
        r = self.r
        if part == "footer" and r.random() < 0.5:
            year, who = r.choice([str(r.randint(1996, 2025)), f"{r.randint(1996, 2010)}-{r.randint(2011, 2025)}"]), f"{self.word().capitalize()} {self.word()}"
            return r.choice(["Copyright {0} by {1}.", "&copy; {0} {1}", "© {1} {0} · <a href=/i>Imprint</a>", "Copyright (c) {0} {1}. All rights reserved.", "{1} {0} | All rights reserved", "Last updated {0} by {1}"]).format(year, who)
        return r.choice(SAID[part])

    def reader(self) -> str:
        """One reader's comment."""
        r, own = self.r, self.attributes("comments", need=True)
        who = r.choice([self.word().capitalize(), f"{self.word()}{r.randint(1, 99)}", f"{self.word().capitalize()} {self.word().capitalize()}"])
        said = self.words(2, r.choice([8, 25, 60]))
        # Where names tell nothing, a date or a button does.
        dated = f" {self.date()}" if self.family not in ("semantic", "telling") or r.random() < 0.5 else ""
        reply = r.choice(["<a href='#'>Reply</a>", "<span>Reply</span>", "<a href='#'>Like</a> <a href='#'>Reply</a>", "<button>Report</button>", "" if dated else "<a href='#'>Answer</a>"])
        form = r.choice(
            [
                "<div{o}><b>{w}</b>{d}<p>{s}</p>{r}</div>", "<div{o}><div>{w}</div><div>{d}</div><div>{s}</div><div>{r}</div></div>", "<div{o}><span>{w}{d}</span><p>{s}</p><p>{r}</p></div>",
                "<li{o}><cite>{w}</cite><span>{d}</span><p>{s}</p>{r}</li>", "<article{o}><h4>{w}{d}</h4><p>{s}</p>{r}</article>", "<div{o}><p><strong>{w}</strong>{d}</p><p>{s}</p></div>",
            ]
        )
        return form.format(o=own, w=who, d=dated, s=said, r=reply)

    def boiler(self, part: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[part])
        plain = r.random() < self.plain and tag in ("nav", "header", "footer", "aside", "form", "section")
        tag = "div" if plain else tag
        own = self.attributes(part, need=tag in ("div", "section", "dialog", "noscript"))
        said = lambda: self.phrase(part) if r.random() < 0.6 else self.words(1, 12)
        if part == "nav" or (part in ("footer", "side") and r.random() < 0.45):
            items = [f'<a href="/{i}">{r.choice(SAID["nav"]) if r.random() < 0.4 else self.words(1, 7 if part == "side" else 2)}</a>' for i in range(r.randint(2, 9))]
            shape = r.random()
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if shape < 0.5 else "".join(f"<div>{x}</div>" for x in items) if shape < 0.7 else r.choice([" | ", " ", " &middot; "]).join(items)
            if part == "side":
                body = f"<{(h := r.choice(['h3', 'h4', 'div', 'b']))}>{r.choice(SAID['side'])}</{h}>" + body
        elif part == "comments":
            h = r.choice(["h2", "h3", "h4", "div", "p"])
            items = "".join(self.reader() for _ in range(r.randint(1, 6)))
            body = f"<{h}>{r.choice(SAID['comments'])}</{h}>" * (r.random() < 0.85) + r.choice(["{}", "<ul>{}</ul>", "<div>{}</div>"]).format(items)
        elif part == "form":
            body = f"<label>{said()}</label><input name=q><p>{r.choice(SAID['form'])}</p><button>{said()}</button>" + "<select><option>1<option>2</select>" * (r.random() < 0.2)
        elif r.random() < 0.4:
            body = self.phrase(part)
        else:
            body = "".join(f"<{t}>{said()}</{t}>" for t in r.choices(["p", "div", "span", "h4", "a href=/x"], k=r.randint(1, 3))).replace("</a href=/x>", "</a>")
            if r.random() < 0.25 and self.blur < 0.5:
                body += f"<p>{self.words(10, 40)}</p>"
        return f"<{tag}{own}>{body}</{tag}>" + r.choice(["", "\n", "<!-- end -->"])

    def article(self) -> list[str]:
        r, out = self.r, []
        strange = r.random() < 0.25
        said = lambda a, b: self.odd() if strange and r.random() < 0.7 else self.words(a, b)
        # What stands inside an element that is named as the article belongs to it, whatever it says.
        named = self.family in ("semantic", "telling")
        if r.random() < 0.85:
            out.append(f"<h1>{MARK}{said(2, 12)}</h1>")
        para = r.choice(["p", "p", "p", "div"]) if self.plain > 0.5 else "p"
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.74:
                text = self.inline(said(1, r.choice([6, 30, 90, 90, 500]))) if not named or r.random() < 0.94 else r.choice(SAID[r.choice(list(SAID))])
                start = r.choice([f"<{para}>", f"<{para}>", f"<{para}{self.attributes(None)}>"])
                out.append(start + MARK + text + (r.choice([f"</{para}>", f"</{para}>", "<br>" + self.word() + f"</{para}>", ""]) if para == "p" else f"</{para}>"))
            elif x < 0.82:
                h = r.randint(2, 4)
                out.append(f"<h{h}>{MARK}{said(1, 8)}</h{h}>")
            elif x < 0.88:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{MARK}{self.inline(self.words(1, 20))}" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif x < 0.91:
                out.append(f"<blockquote><p>{MARK}{self.words(5, 30)}</p></blockquote>")
            elif x < 0.94:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.words(2, 10)}</figcaption></figure>")
            elif x < 0.97 and "table" != self.family:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<pre>{MARK}{said(3, 20)}</pre>")
        if strange and r.random() < 0.4:
            out = out[: r.randint(1, 2)]
        return out

    def page(self) -> str:
        r = self.r
        self.family = r.choice(self.families)
        self.plain, self.blur = FAMILIES[self.family]
        self.known = self.lexicon()
        inner = self.article()
        if r.random() < 0.3:
            for part in r.sample(["ad", "side", "form", "notice", "nav"], r.randint(1, 2)):
                inner.insert(r.randint(1, len(inner)), "</p>" + self.boiler(part))
        late = self.boiler("comments") if r.random() < 0.35 else ""
        within = r.random() < 0.4
        body = "".join(inner) + "</p>" + late * within
        if self.family == "semantic":
            tag = r.choice(["article", "article", "article", "main", "section"])
            body = f"<{tag}{self.attributes(None, need=tag == 'section')}>{body}</{tag}>"
        elif self.family != "bare":
            body = f"<div{self.attributes(None, need=True)}>{body}</div>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.attributes(None) if self.family == 'telling' else self.attributes(None) if r.random() < 0.2 else ''}>{body}</div>"
        before = [self.boiler(p) for p in ("header", "nav", "notice", "ad", "form", "side") if r.random() < 0.4]
        after = [self.boiler(p) for p in ("side", "ad", "form", "notice", "nav", "footer") if r.random() < 0.4]
        r.shuffle(before)
        if late and not within:
            after.insert(r.randint(0, 1), late)
        if self.family == "table":
            cells = [f"<td>{x}</td>" for x in ("".join(before[1:]) or "&nbsp;", body, "".join(after[:1]) or "&nbsp;")]
            top = f"<tr><td colspan=3>{before[0]}</td></tr>" if before else ""
            body = f"<table width=100%>{top}<tr>{''.join(cells)}</tr><tr><td colspan=3>{''.join(after[1:])}</td></tr></table>"
        else:
            body = "".join(before) + body + "".join(after)
        if r.random() < 0.5:
            return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>.a{{}}</style><script>var a = 1;</script></head><body>{body}</body></html>"
        return f"<body>{body}"

    def sample(self) -> tuple[list, np.ndarray]:
        found = blocks(self.page())
        y = np.array([MARK in b[0] for b in found], bool)
        return [(b[0].replace(MARK, ""), *b[1:]) for b in found], y


def start(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    p = {}
    for side in "fr":
        p[f"{side}x"] = rng.normal(0, 1 / np.sqrt(12), (WIDTH, 4 * HIDDEN)) * 0.5
        p[f"{side}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p[f"{side}b"] = np.zeros(4 * HIDDEN)
        p[f"{side}b"][HIDDEN : 2 * HIDDEN] = 1
    p["w"], p["b"], p["s"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(()), np.zeros(WIDTH)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean loss of a batch and its gradients, by back-propagation through time."""
    kept: dict[str, list] = {"f": [], "r": []}
    hidden = {side: run_lstm(x, mask, p, side, kept[side]) for side in "fr"}
    both = np.concatenate([hidden["f"], hidden["r"]], axis=2)
    z = both @ p["w"] + p["b"] + x @ p["s"]
    n = mask.sum()
    loss = float((np.logaddexp(0, z) - y * z)[mask].sum() / n)
    dz = (sigmoid(z) - y) * mask / n
    g = {"w": np.einsum("tp,tph->h", dz, both), "b": dz.sum(), "s": np.einsum("tp,tpi->i", dz, x)}
    for k, side in enumerate("fr"):
        wh, size = p[f"{side}h"], HIDDEN
        given = dz[..., None] * p["w"][k * size : (k + 1) * size]
        dh = np.zeros((x.shape[1], size), np.float32)
        dc = np.zeros_like(dh)
        dpre = np.zeros((*x.shape[:2], 4 * size), np.float32)
        gh = np.zeros_like(wh)
        for t, h, c, i, f, o, cell, tc, on in reversed(kept[side]):
            dh = dh + given[t]
            do, through = dh * tc, dc + dh * o * (1 - tc**2)
            pre = np.concatenate([through * cell * i * (1 - i), through * c * f * (1 - f), do * o * (1 - o), through * i * (1 - cell**2)], axis=1) * on
            dpre[t] = pre
            gh += h.T @ pre
            dh = np.where(on, pre @ wh.T, dh)
            dc = np.where(on, through * f, dc)
        flat = dpre.reshape(-1, 4 * size)
        g |= {f"{side}x": x.reshape(-1, WIDTH).T @ flat, f"{side}h": gh, f"{side}b": flat.sum(axis=0)}
    return loss, g


def train(pages: int = 24000, epochs: int = 6, batch: int = 48, seed: int = 11, rate: float = 4e-3, families: tuple[str, ...] = tuple(FAMILIES), say=print) -> dict:
    source = Pages(seed, families)
    data = [s for s in (source.sample() for _ in range(pages)) if s[0]]
    data.sort(key=lambda s: len(s[0]))
    p = start()
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    mean, since = {k: a.astype(np.float64) for k, a in p.items()}, (epochs - 2) * len(groups)
    for epoch in range(epochs):
        source.r.shuffle(groups)
        losses = []
        for group in groups:
            x, mask = pad([vectors(s[0]) for s in group])
            y = np.zeros(mask.shape, np.float32)
            for k, s in enumerate(group):
                y[: len(s[1]), k] = s[1]
            loss, g = gradients(x, mask, y, p)
            losses.append(loss)
            step += 1
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((a**2).sum()) for a in g.values())) + 1e-9))
            lr = rate * min(1.0, step / 50) * (1 - 0.85 * step / (epochs * len(groups)))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (scale * g[k]) ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                if step > since:  # the weights' mean over the last two epochs
                    mean[k] += (p[k] - mean[k]) / (step - since)
        say(f"epoch {epoch}: loss {np.mean(losses):.4f}")
    return {k: a.astype(np.float32) for k, a in mean.items()}


def accuracy(p: dict, pages: int = 500, seed: int = 99, families: tuple[str, ...] = tuple(FAMILIES)) -> float:
    source = Pages(seed, families)
    data = [source.sample() for _ in range(pages)]
    found = label([s[0] for s in data], p)
    return float(np.mean(np.concatenate([a == y for a, (_, y) in zip(found, data)])))


if __name__ == "__main__":
    if "--families" in sys.argv:
        for left in FAMILIES:
            made = train(3000, 4, families=tuple(f for f in FAMILIES if f != left), say=lambda _: None)
            print(f"{left} left out: {accuracy(made, families=(left,)):.4f}")
    else:
        made = train()
        print("held-out accuracy:", {f: round(accuracy(made, 300, families=(f,)), 4) for f in FAMILIES})
        np.savez_compressed(Path(__file__).with_name(WEIGHTS), **{k: a.astype(np.float16) for k, a in made.items()})
