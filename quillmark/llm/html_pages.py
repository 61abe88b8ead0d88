"""Labelled pages that the extractor is trained on, written by rule from a seed.

They vary in elements, class names, order, nesting and faults. Text is made of invented words;
a block of the article begins with MARK, which training takes for its label and removes.
"""

from __future__ import annotations

import random

MARK = "\ue000"
#: Class names and ids that pages use for the article and for what surrounds it.
_ARTICLE = "content main-content article-body post-body entry-content story text post article body".split()
_AROUND = {
    "nav": "nav menu navbar main-menu breadcrumb breadcrumbs navigation topnav pagination".split(),
    "header": "header masthead site-header top banner branding".split(),
    "footer": "footer site-footer copyright bottom legal foot".split(),
    "aside": "sidebar aside related widget recommended side rail tags share social popular".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner-ad adbox".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal message disclaimer paywall".split(),
    "form": "form search subscribe newsletter login signup search-form".split(),
    "comments": "comments comment reply respond discussion user-comment comment-list reader-comments".split(),
}


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.rng.choice("bdfgklmnprst") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(lo, hi)))

    def sentence(self, lo: int = 3, hi: int = 25) -> str:
        return self.words(lo, hi).capitalize() + self.rng.choice("....!?")

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def named(self, tag: str, kind: str, inner: str, p_tag: float = 0.5) -> str:
        """The kind's own element, or a div with one of its class names, or both."""
        own = tag not in {"ad", "notice", "comments"} and self.maybe(p_tag)
        name = tag if own else self.rng.choice(["div", "div", "section", "aside"] if kind in {"ad", "notice", "comments", "aside"} else ["div", "div", "section"])
        mark = "" if own and self.maybe(0.6) else f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(_AROUND[kind])}"'
        return f"<{name}{mark}>{inner}</{name}>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def around(self, kind: str) -> str:
        rng = self.rng
        loose = rng.choice([self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.sentence()} {self.sentence()}</p><p>{self.sentence()}</p>", f'<a href="#">{self.words(2, 8)}</a>'])
        if kind == "nav":
            inner = rng.choice([self.links(rng.randint(2, 9)), " ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(5))])
        elif kind == "header":
            inner = rng.choice([f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 4)}</h2>", ""]) + loose
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "", "© 2020 "]) + loose + (self.links(3) if self.maybe(0.4) else "")
        elif kind == "aside":
            inner = f"<h3>{self.words(1, 4)}</h3>" + rng.choice([self.links(4), loose, f"<p>{self.sentence(10, 40)}</p>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentence()}</p>" if self.maybe(0.5) else "")
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(self.sentence(3, 60) + " " + self.sentence()) for _ in range(rng.randint(1, 4)))
        else:
            inner = loose
        return self.named(kind, kind, inner)

    def menu(self) -> str:
        return self.rng.choice([self.links(4), "".join(f'<a href="/{i}">{self.words(1, 2)}</a><br>' for i in range(4)), " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(4))])

    def bare(self, p: float) -> str:
        """A menu or a line of rights in an element without a name, or nothing."""
        return "" if self.maybe(p) else self.rng.choice([self.menu(), f"<div>{self.menu()}</div>", f"<p>{self.menu()}</p>", f"<p>&copy; {self.words(1, 4)}</p>", f"<div><small>© 2020 {self.words(1, 3)}</small></div>"])

    def paragraph(self) -> str:
        text = MARK + " ".join(self.sentence(1, 40) for _ in range(self.rng.choice([1, 1, 2, 4, 8])))
        if self.maybe(0.2):
            text += f' <a href="/x">{self.words(1, 5)}</a> {self.sentence()}'
        kind = self.rng.random()
        if kind < 0.6:
            return f"<p>{text}</p>"
        if kind < 0.75:
            return f"<p><b>{text}<br><p>" + MARK + self.sentence()
        if kind < 0.8:
            return f"<h2>{MARK}{self.words(1, 8)}</h2>"
        if kind < 0.85:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{MARK}{self.sentence(1, 12)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.95:
            return "<table><tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(4)) + "</tr></table>"
        return f"<pre>{text}</pre>" if self.maybe(0.5) else f"<div>{text}</div>"

    def article(self) -> str:
        rng = self.rng
        inner = f"<h1>{MARK}{self.words(1, 10)}</h1>" if self.maybe(0.85) else ""
        if self.maybe(0.1):
            inner += MARK + self.sentence() + "<br>" + MARK + self.sentence()
        for _ in range(rng.choice([1, 2, 4, 8, 12])):
            inner += self.paragraph()
            if self.maybe(0.15):
                inner += self.around(rng.choice(["ad", "aside", "form", "notice", "ad"]))
        if self.maybe(0.3):
            inner += self.around("comments")
        if self.maybe(0.25):  # without a name, or without any element of its own
            return rng.choice(["{}", "<div>{}</div>", "<div><div>{}</div></div>", "<center>{}</center>"]).format(inner)
        name = rng.choice(["article"] * 4 + ["main", "div", "div", "section"])
        mark = f' {rng.choice(["class", "class", "id"])}="{rng.choice(_ARTICLE)}"' if name != "article" or self.maybe(0.3) else ""
        return f"<{name}{mark}>{inner}</{name}>"

    def page(self) -> str:
        before = [self.around(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if self.maybe(0.45)]
        after = [self.around(k) for k in ("comments", "aside", "ad", "form", "footer", "notice") if self.maybe(0.45)]
        self.rng.shuffle(before)
        if self.maybe(0.1):  # no names but those of elements
            before, after = [self.bare(0.5)], [self.bare(0.5)]
        if self.maybe(0.08):  # a layout table
            body = f"<table><tr><td>{''.join(before)}{self.menu()}</td><td>{self.article()}</td></tr><tr><td>{''.join(after)}</td></tr></table>"
        else:
            body = "".join([*before, self.article(), *after])
        if self.maybe(0.3):
            body = f'<div class="{self.rng.choice(["wrapper", "page", "container", "site"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{body}" + ("" if self.maybe(0.2) else "</body></html>")


def labelled_pages(n: int, seed: int) -> list[str]:
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
