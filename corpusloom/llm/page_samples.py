"""Labelled pages to fit the block classifier on: made by rule, as crawled pages carry no labels.

A page is a list of regions in the order in which sites put them.  Each region is written in
one of several ways: with the element meant for it, with a telling class name, or as plain
boxes without either.  Every block of text starts with a mark that says whether it is main text.
"""

from __future__ import annotations

import random

MAIN, REST = "", ""
SYLLABLES = "ba den ka lor mi nus pe ris so tal un ver wo xi zem ar".split()


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        one = lambda: "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        text = " ".join(one() for _ in range(self.rng.randint(low, high)))
        return text.capitalize() + self.rng.choice([".", ".", ".", "", "!"])

    def links(self, n: int, mark: str) -> str:
        return "".join(f"<li>{mark}<a href=x>{self.words(1, 3)}</a></li>" for _ in range(n))

    def boxed(self, inner: str, ways: list[str]) -> str:
        """`inner` in an element: `tag`, `tag.class` or a plain box."""
        tag, _, name = self.rng.choice(ways).partition(".")
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def paragraphs(self, n: int, mark: str, low: int, high: int) -> str:
        return "".join(f"<{t}>{mark}{self.words(low, high)}</{t}>" for t in self.rng.choices(["p", "p", "p", "div"], k=n))

    def article(self) -> str:
        r, parts = self.rng, [f"<h1>{MAIN}{self.words(2, 8)}</h1>"]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.55:
                parts.append(f"<p>{MAIN}{self.words(12, 70)}</p>")
            elif kind < 0.75:
                parts.append(f"<p>{MAIN}{self.words(1, 6)}</p>")
            elif kind < 0.82:
                parts.append(f"<h2>{MAIN}{self.words(1, 5)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{MAIN}{self.words(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<p>{MAIN}<a href=x>{self.words(2, 6)}</a> {self.words(0, 4)}</p>")
            else:
                parts.append(f"<figure><img><figcaption>{MAIN}{self.words(3, 10)}</figcaption></figure>")
            if r.random() < 0.08:
                parts.append(self.boxed(f"<p>{REST}{self.words(4, 30)}</p>" if r.random() < 0.5 else REST + self.words(3, 12), ["div.ad", "div.advert-box", "aside", "div.promo"]))
        return self.boxed("".join(parts), ["article", "main", "article.post", "div.post-content", "div.entry", "div", "div", "section"])

    def page(self) -> str:
        r = self.rng
        top = self.boxed(f"<h1>{REST}{self.words(1, 3)}</h1>" + (f"<p>{REST}{self.words(2, 8)}</p>" if r.random() < 0.3 else ""), ["header", "div.masthead", "div.header", "div"])
        menu = self.boxed(f"<ul>{self.links(r.randint(3, 8), REST)}</ul>", ["nav", "div.menu", "div.navbar", "div"])
        notice = self.boxed(f"<p>{REST}{self.words(4, 25)}</p>", ["div.cookie-notice", "div.alert", "div.newsletter", "div.ad", "div.ad", "div"])
        side = self.boxed(f"<h3>{REST}{self.words(1, 3)}</h3><ul>{self.links(r.randint(2, 6), REST)}</ul>" + self.paragraphs(r.randint(0, 2), REST, 3, 30), ["aside", "div.sidebar", "div.related", "div"])
        talk = self.boxed(
            "".join(self.boxed(f"<p>{REST}{self.words(1, 3)}</p><p>{REST}{self.words(3, 50)}</p>", ["div.comment", "article.comment", "div", "li"]) for _ in range(r.randint(1, 4))),
            ["div.comments", "section.comments", "div.discussion"],
        )
        foot = self.boxed(f"{REST}&copy; {self.words(1, 12)}" + (f"<ul>{self.links(3, REST)}</ul>" if r.random() < 0.5 else ""), ["footer", "div.footer", "div"])
        body = [x for x, share in ((top, 0.8), (menu, 0.9), (notice, 0.5), (self.article(), 1), (notice, 0.2), (side, 0.5), (talk, 0.4), (foot, 0.9)) if r.random() < share]
        return f"<html><head><title>x</title></head><body>{''.join(body)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]
