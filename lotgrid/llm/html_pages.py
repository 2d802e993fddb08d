"""Labelled pages to learn from: made from layouts that vary in tags, names, order and text."""

from __future__ import annotations

import random

#: Put before the text of the article in a labelled page; never in a page that is read.
MARK = ""

_SYLLABLES = "an be ci da el fo gu ha in jo ka le mi no or pe qu ra se ti un ve wo xi yo ze ing tion ment eau sch ung ado ción é ü".split()
_MENU = "Home About Contact Login Archive Shop News Sport Help Terms Privacy Search Cart Blog".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.rng.choice(["."] * 8 + ["?", "!", "", " %%%", "&amp;"])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def name(self, *names: str) -> str:
        n = self.rng.choice(names)
        return self.rng.choice([f' class="{n}"', f' id="{n}"', f' class="{n} {self.word()}"', f" class={n}"])

    def main(self, text: str) -> str:
        return MARK + text

    def links(self, wrap: str) -> str:
        items = [f'<a href="/{self.word()}">{self.rng.choice([self.word(), self.rng.choice(_MENU), self.words(1, 4)])}</a>' for _ in range(self.rng.randint(3, 9))]
        if wrap == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" if self.rng.random() < 0.8 else f"<li>{x}" for x in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items)

    def menu(self) -> str:
        tag, attrs = self.rng.choice([("nav", ""), ("nav", self.name("menu", "navbar")), ("div", self.name("menu", "navigation", "nav", "topnav", "breadcrumb", "breadcrumbs")), ("header", ""), ("ul", self.name("menu", "nav")), ("div", ' role="navigation"')])
        inner = self.links("ul" if self.rng.random() < 0.7 and tag != "ul" else "")
        if tag == "ul":
            inner = "".join(f"<li>{self.links('')}</li>" for _ in range(3))
        if tag == "header":
            inner = f"<h2>{self.words(1, 3)}</h2><p>{self.sentence(2, 8)}</p>" + inner
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def top(self) -> str:
        tag, attrs = self.rng.choice([("header", ""), ("header", self.name("header", "masthead")), ("div", self.name("header", "banner", "masthead", "topbar"))])
        return f"<{tag}{attrs}><a href='/'>{self.words(1, 3)}</a><span>{self.sentence(2, 9)}</span></{tag}>"

    def advert(self) -> str:
        tag = self.rng.choice(["div", "div", "aside", "section", "p"])
        inner = self.rng.choice([self.prose(2), f'<a href="#">{self.sentence()}</a>', f"<p>{self.prose(2)}</p><p>{self.sentence()}</p>"])
        return f"<{tag}{self.name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad')}>{inner if tag != 'p' else self.sentence()}</{tag}>"

    def notice(self) -> str:
        return f"<{(t := self.rng.choice(['div', 'section', 'div', 'dialog']))}{self.name('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'newsletter', 'subscribe', 'paywall')}><p>{self.prose(3)}</p><button>{self.word()}</button></{t}>"

    def side(self) -> str:
        tag, attrs = self.rng.choice([("aside", ""), ("aside", self.name("sidebar", "related")), ("div", self.name("sidebar", "widget", "related", "recommended", "share", "social", "side", "rail", "tags"))])
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.rng.choice([self.links("ul"), f"<p>{self.prose(3)}</p>", f"<p>{self.sentence()}</p>{self.links('')}"])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def form(self) -> str:
        return f'<form action="/x"><label>{self.words(1, 4)}</label><input type=text><p>{self.sentence()}</p><button>{self.word()}</button></form>'

    def comments(self) -> str:
        tag = self.rng.choice(["div", "section", "ol", "aside"])
        one = lambda: f"<{(t := 'li' if tag == 'ol' else self.rng.choice(['div', 'article', 'div']))}{self.name('comment', 'reply', 'comment-body', 'user-comment')}><b>{self.word()}</b><p>{self.prose(4)}</p></{t}>"
        head = "" if tag == "ol" else self.rng.choice(["", f"<h3>{self.words(1, 3)}</h3>"])
        return f"<{tag}{self.name('comments', 'comment-list', 'responses', 'discussion', 'disqus', 'replies')}>{head}{''.join(one() for _ in range(self.rng.randint(1, 4)))}</{tag}>"

    def foot(self) -> str:
        tag, attrs = self.rng.choice([("footer", ""), ("footer", ""), ("footer", self.name("footer")), ("div", self.name("footer", "copyright", "site-footer", "bottom"))])
        return f"<{tag}{attrs}>{self.rng.choice([f'&copy; {self.word()}.example &middot; {self.prose(2)}', f'<p>{self.prose(2)}</p>', f'{self.links(str())} &copy; 20{self.rng.randint(10, 26)}'])}</{tag}>"

    def paragraph(self) -> str:
        r, text = self.rng.random(), self.prose()
        if r < 0.55:
            return f"<p>{self.main(text)}</p>"
        if r < 0.65:
            return f"<p><b>{self.main(text)}<br><p>{self.main(self.prose())}"
        if r < 0.72:
            return f'<p>{self.main(self.sentence())} <a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentence()}</p>'
        if r < 0.78:
            return f"<h{(k := self.rng.randint(2, 4))}>{self.main(self.words(1, 7))}</h{k}>"
        if r < 0.84:
            return "<ul>" + "".join(f"<li>{self.main(self.sentence())}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if r < 0.88:
            return f"<blockquote><p>{self.main(text)}</p></blockquote>"
        if r < 0.91:
            return "<table><tr>" + "".join(f"<td>{self.main(self.words(1, 3))}</td>" for _ in range(self.rng.randint(2, 6))) + "</tr></table>"
        if r < 0.94:
            return f"<pre>{self.main(self.words(3, 20))}</pre>"
        if r < 0.97:
            return f"<div>{self.main(text)}</div>"
        return f"<figure><img src=x><figcaption>{self.main(self.sentence())}</figcaption></figure>"

    def article(self, title: str) -> str:
        tag, attrs = self.rng.choice([("article", ""), ("article", ""), ("article", self.name("post", "entry")), ("main", ""), ("div", self.name("content", "article", "post", "entry-content", "story", "article-body", "main", "text", "body")), ("section", self.name("content", "article", "story"))])
        inside = [f"<h1>{self.main(title)}</h1>", *(self.paragraph() for _ in range(self.rng.choice([1, 2, 3, 5, 8, 13, 20])))]
        for make, chance in ((self.advert, 0.2), (self.side, 0.12), (self.notice, 0.08), (self.form, 0.08)):
            if self.rng.random() < chance:
                inside.insert(self.rng.randint(1, len(inside)), make())
        if self.rng.random() < 0.12:
            inside.append(self.comments())
        body = f"<{tag}{attrs}>{''.join(inside)}</{tag}>"
        return f"<main>{body}</main>" if tag != "main" and self.rng.random() < 0.2 else f"<div{self.name('wrapper', 'container', 'page', 'row')}>{body}</div>" if self.rng.random() < 0.2 else body

    def page(self) -> str:
        title = self.sentence(1, 10)
        rest = lambda makes: "".join(m() for m, chance in makes if self.rng.random() < chance)
        before = rest([(self.notice, 0.25), (self.top, 0.35), (self.menu, 0.85), (self.advert, 0.5), (self.form, 0.15), (self.side, 0.2)])
        after = rest([(self.comments, 0.35), (self.side, 0.35), (self.advert, 0.25), (self.form, 0.2), (self.notice, 0.2), (self.menu, 0.1), (self.foot, 0.9)])
        end = self.rng.choice(["</body></html>", "</body></html>", "", "</html>"])
        return f'<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>{title[:60]}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{before}<!-- x -->{self.article(title)}{after}{end}'


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]
