"""Fit the block labeller on generated pages: python -m larder.llm.train_blocks."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from larder.llm.html_blocks import BiLstm, features, leaf_blocks, padded

SYLLABLES = {
    "en": "the an in er on re at ed nd ha th es or ti ing of to it is ou ea st en".split(),
    "de": "der ein sch ung ver ich und ge keit en lich be zu ß ä ö ü st au".split(),
    "fr": "le la ou eau ai que é è ment on tion ez ç un re oi ier".split(),
    "es": "de la ción os que el ar ado ie ue ñ ó es mente ra do co".split(),
}
MAIN = ["content", "post", "entry", "story", "article", "article-body", "post-content", "main-content", "entry-content", "text", "body", "page-content", "story-body"]
#: What surrounds main text: elements and class or id words.
AROUND = {
    "nav": [("nav", "", ""), ("nav", "nav", "main"), ("div", "menu", "nav"), ("ul", "navbar", "navigation"), ("div", "breadcrumb", "breadcrumbs"), ("div", "topbar", "links"), ("nav", "pagination", "pager")],
    "header": [("header", "", ""), ("header", "site-header", "masthead"), ("div", "header", "top"), ("div", "banner", "logo")],
    "footer": [("footer", "", ""), ("div", "footer", "bottom"), ("footer", "site-footer", ""), ("div", "copyright", "legal"), ("div", "colophon", "imprint")],
    "aside": [("aside", "", ""), ("aside", "sidebar", "widget"), ("div", "sidebar", "side"), ("div", "related", "recommended"), ("section", "widget", "popular"), ("div", "trending", "more"), ("aside", "related-posts", "")],
    "ad": [("div", "ad", ""), ("div", "ads", "advert"), ("div", "sponsored", "promo"), ("aside", "advertisement", ""), ("div", "banner-ad", "sponsor"), ("section", "promotion", "ad")],
    "notice": [("div", "cookie", "notice"), ("div", "consent", "gdpr"), ("div", "alert", "banner"), ("section", "newsletter", "subscribe"), ("div", "modal", "popup"), ("div", "cookie-banner", ""), ("div", "notice", ""), ("p", "notice", ""), ("div", "paywall", "message")],
    "form": [("form", "", ""), ("form", "search", "search-form"), ("form", "login", "signup"), ("form", "contact", "subscribe")],
    "comments": [("section", "comments", ""), ("div", "comments", "discussion"), ("div", "comment-list", "replies"), ("ol", "commentlist", "thread"), ("div", "disqus", "responses"), ("section", "reader-comments", "")],
    "share": [("div", "share", "social"), ("ul", "social-links", "sharing"), ("div", "meta", "tags"), ("div", "author-box", "bio")],
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES[self.lang]) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.word() for _ in range(n)]
        if self.r.random() < 0.85:
            for i in range(0, n, self.r.randint(6, 14)):
                out[i] = out[i].capitalize()
                if i:
                    out[i - 1] += self.r.choice("...,!?")
            out[-1] += self.r.choice(("", ".", ".", ".", "!", "?", "&amp;", "&hellip;"))
        if self.r.random() < 0.06:
            mark = self.r.choice(("%%%", "***", "&amp;&amp;&amp;", "$$$", "!!"))
            out = [w + mark for w in out]
        if self.r.random() < 0.3:
            out[0] = out[0].capitalize()
        return " ".join(out)

    def length(self) -> tuple[int, int]:
        return self.r.choice(((1, 3), (3, 12), (10, 40), (30, 90), (60, 200)))

    def inline(self, text: str) -> str:
        if self.r.random() < 0.25:
            parts = text.split(" ")
            i = self.r.randrange(len(parts))
            t = self.r.choice(("b", "i", "em", "strong", "a href='/x'", "span", "code"))
            parts[i] = f"<{t}>{parts[i]}</{t.split()[0]}>"
            text = " ".join(parts)
        return text

    def start(self, name: str, *marks: str) -> str:
        words = " ".join(m for m in marks if m and self.r.random() < 0.9)
        return f"<{name} {self.r.choice(('class', 'class', 'id'))}=\"{words}\">" if words else f"<{name}>"

    def keep(self, text: str) -> str:
        """Main text is marked for the labels; marks go before the blocks are cut."""
        return "\x01" + text

    def around(self, kind: str) -> str:
        r = self.r
        name, one, two = r.choice(AROUND[kind])
        inner = []
        if kind in ("nav", "share"):
            links = [f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 9))]
            item = r.choice(("li", "li", "li", "span", "div"))
            inner.append("<ul>" * (item == "li" and name != "ul") + "".join(f"<{item}>{x}</{item}>" if r.random() < 0.97 else x for x in links) + "</ul>" * (item == "li" and name != "ul"))
            if kind == "share" and r.random() < 0.5:
                inner = [f"<p>{self.words(2, 30)}</p>"]
        elif kind == "header":
            inner.append(r.choice((f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 10)}</p>", f"<div>{self.words(1, 5)}</div>")))
            if r.random() < 0.4:
                inner.append(self.around("nav"))
        elif kind == "footer":
            inner.append(r.choice((f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}", f"<p>{self.words(2, 20)}</p>", f"<p>&copy; 20{r.randint(10, 25)} {self.words(1, 4)}</p>", f"<ul><li>{self.words(1, 3)}</li><li>{self.words(1, 3)}</li></ul>")))
        elif kind == "aside":
            if r.random() < 0.6:
                inner.append(f"<h3>{self.words(1, 4)}</h3>")
            inner += [r.choice((f"<li><a href='#'>{self.words(2, 8)}</a></li>", f"<p>{self.words(*self.length())}</p>", f"<div>{self.words(3, 30)}</div>")) for _ in range(r.randint(1, 5))]
        elif kind == "ad":
            inner.append(r.choice((self.words(2, 20), f"<p>{self.words(2, 40)}</p>", f"<a href='#'>{self.words(2, 8)}</a>", f"<span>{self.words(2, 10)}</span>")))
        elif kind == "notice":
            inner.append(r.choice((self.words(3, 40), f"<p>{self.words(4, 40)}</p><button>{self.words(1, 2)}</button>", f"<h4>{self.words(1, 4)}</h4><p>{self.words(4, 30)}</p>")))
        elif kind == "form":
            inner += [f"<label>{self.words(1, 3)}</label><input name='x'>", f"<button>{self.words(1, 2)}</button>", r.choice(("", f"<p>{self.words(2, 15)}</p>"))]
        elif kind == "comments":
            inner.append(r.choice(("", f"<h3>{self.words(1, 3)}</h3>")))
            for _ in range(r.randint(1, 6)):
                tag = r.choice(("div", "li", "article"))
                text = self.words(*self.length())
                inner.append(self.start(tag, r.choice(("comment", "reply", "comment-body", ""))) + r.choice((f"<p>{text}</p>", f"<b>{self.word()}</b> {text}", f"<span>{self.word()}</span><p>{text}</p>")) + f"</{tag}>")
        if r.random() < 0.08:
            return self.start(name, one, two) + "".join(inner)  # left open, but for what encloses it
        return self.start(name, one, two) + "".join(inner) + f"</{name}>"

    def article(self) -> str:
        r = self.r
        parts = []
        title = self.words(1, 14)
        if r.random() < 0.85:
            parts.append(f"<{(h := r.choice(('h1', 'h1', 'h1', 'h2')))}>{self.keep(title)}</{h}>")
        for i in range(r.randint(1, 14)):
            text = self.inline(self.words(*self.length()))
            if i == 0 and r.random() < 0.3:
                text = title + " " + text
            kind = r.random()
            if kind < 0.62:
                parts.append(f"<p>{self.keep(text)}</p>")
            elif kind < 0.76:
                parts.append(f"<p><b>{self.keep(text)}<br>" if r.random() < 0.7 else f"<p>{self.keep(text)}")
            elif kind < 0.82:
                tag = r.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{self.keep(self.words(1, 20))}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.88:
                parts.append(f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{self.keep(self.words(1, 8))}</{h}>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{self.keep(text)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<div>{self.keep(text)}</div>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{self.keep(self.words(1, 3))}</td><td>{self.keep(self.words(1, 3))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append(f"<pre>{self.keep(text)}</pre>")
            if r.random() < 0.06:
                parts.append(self.around(r.choice(("ad", "aside", "share", "notice"))))
        style = r.random()
        inner = "".join(parts)
        if style < 0.45:
            return "<article>" + inner + "</article>"
        if style < 0.6:
            return self.start("article", r.choice(MAIN)) + inner + "</article>"
        if style < 0.72:
            return "<main>" + r.choice(("", "<article>")) + inner + "</main>"
        name = r.choice(("div", "section", "div"))
        return self.start(name, r.choice(MAIN), r.choice(("", *MAIN))) + inner + f"</{name}>"

    def page(self) -> str:
        r = self.r
        self.lang = r.choice(list(SYLLABLES))
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside", "nav") if r.random() < 0.4]
        after = [k for k in ("share", "ad", "aside", "comments", "form", "nav", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(map(self.around, before)) + (self.article() if r.random() < 0.96 else "") + "".join(map(self.around, after))
        if r.random() < 0.8:
            body += self.around("footer")
        if r.random() < 0.25:
            body = self.start("div", r.choice(("wrapper", "page", "container", "site", "layout"))) + body + "</div>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html lang='{self.lang}'><head><meta charset='utf-8'><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}{end}"

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        blocks = leaf_blocks(self.page())
        y = np.array(["\x01" in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace("\x01", "") or "."
            b.linked = min(b.linked, len(b.text))
        return features(blocks) if blocks else np.zeros((0, 1), np.float32), y


def fit(pages: int = 6000, epochs: int = 8, hidden: int = 24, batch: int = 32, seed: int = 7) -> BiLstm:
    source = Pages(seed)
    data = [d for d in (source.labelled() for _ in range(pages)) if len(d[0])]
    data.sort(key=lambda d: len(d[0]))
    batches = [data[i : i + batch] for i in range(0, len(data), batch)]
    net = BiLstm.start(hidden, seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    rng, step = random.Random(seed), 0
    for epoch in range(epochs):
        rng.shuffle(batches)
        losses = []
        for part in batches:
            x, mask = padded([d[0] for d in part])
            y = np.zeros_like(mask)
            for k, d in enumerate(part):
                y[: len(d[1]), k] = d[1]
            loss, grad = net.gradients(x, mask, y)
            losses.append(loss)
            step += 1
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            rate = 0.006 * (1 - step / (epochs * len(batches) + 1))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(epoch, round(float(np.mean(losses)), 4), flush=True)
    return net


def accuracy(net: BiLstm, pages: int = 500, seed: int = 99) -> float:
    source = Pages(seed)
    data = [d for d in (source.labelled() for _ in range(pages)) if len(d[0])]
    found = net.label([d[0] for d in data])
    return float(np.mean(np.concatenate(found) == np.concatenate([d[1] > 0 for d in data])))


if __name__ == "__main__":
    model = fit()
    print("held-out accuracy of blocks", accuracy(model))
    np.savez_compressed(Path(__file__).with_name("block_labeller.npz"), **{k: v.astype(np.float32) for k, v in model.w.items()})
