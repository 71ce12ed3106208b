"""Labelled pages made by rule, to train and to measure the block classifier.

A page is laid out from parts in many manners: with and without elements or names
that say what is content, with long and with very short paragraphs, readers'
comments inside or outside the article. The words are strings of syllables, so
only layout, punctuation and the wording of a page's own furniture can be learnt.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka re mo ti san der lin po vu est al ni tor be qua mes".split()
#: Wordings of a page's furniture. Fixed lists.
NOTICES = ["We use cookies to improve this site. Accept?", "This site uses cookies. Read our privacy policy.", "Wir verwenden Cookies. Einverstanden?", "Nous utilisons des cookies.", "Utilizamos cookies propias y de terceros."]
ADVERTS = ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad"]
LETTERS = ["Subscribe to our newsletter", "Sign up for free", "Newsletter abonnieren", "Abonnez-vous", "Suscríbete"]
REPLIES = ["Comments", "3 comments", "Leave a reply", "Kommentare (2)", "2 commentaires", "Comentarios"]
RELATED = ["Related", "Read more", "Most popular", "Mehr zum Thema", "À lire aussi", "Más noticias"]


class _Maker:
    """One page; content blocks carry ``data-keep``."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3))) for _ in range(n))

    def sentences(self, n: int) -> str:
        out = []
        while n > 0:
            size = min(n, self.r.randint(3, 14))
            out.append(self.words(size).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", " + self.words(3) + "."]))
            n -= size
        return " ".join(out)

    def links(self, n: int) -> str:
        return "".join(f"<li><a href=/{i}>{self.words(self.r.randint(1, 6)).capitalize()}</a></li>" for i in range(n))

    def box(self, inner: str, elements: str, names: str) -> str:
        """``inner`` in an element that tells, in one whose class tells, or in a plain one."""
        kind = self.r.random()
        if kind < 0.4 and elements:
            tag = self.r.choice(elements.split())
            return f"<{tag}>{inner}</{tag}>"
        if kind < 0.75:
            return f"<div {self.r.choice(['class', 'id'])}={self.r.choice(names.split())}>{inner}</div>"
        return f"<div>{inner}</div>"

    def furniture(self) -> str:
        r = self.r
        make = r.choice(
            [
                lambda: self.box(f"<ul>{self.links(r.randint(3, 8))}</ul>", "nav menu", "menu navbar nav breadcrumb"),
                lambda: self.box(f"<p>{r.choice(NOTICES)}</p>", "", "cookie-banner notice consent"),
                lambda: self.box(f"<b>{r.choice(ADVERTS)}</b><p>{self.sentences(r.randint(4, 15))}</p>", "aside", "ad advert sponsor"),
                lambda: self.box(self.sentences(r.randint(4, 15)), "aside", "ad advert promo"),
                lambda: self.box(f"<p>{r.choice(LETTERS)}</p><label>{self.words(1)}</label>", "form", "newsletter subscribe signup"),
                lambda: self.box(f"<h3>{r.choice(RELATED)}</h3><ul>{self.links(r.randint(2, 5))}</ul>", "aside nav", "sidebar related popular"),
                lambda: self.box(f"<h4>{self.words(2)}</h4><p>{self.sentences(r.randint(5, 30))}</p>", "aside", "sidebar widget"),
            ]
        )
        return make()

    def comments(self) -> str:
        said = [f"<div><b>{self.words(2).title()}</b><p>{self.sentences(self.r.randint(2, 25))}</p></div>" for _ in range(self.r.randint(1, 4))]
        return self.box(f"<h3>{self.r.choice(REPLIES)}</h3>" + "".join(said), "", "comments commentlist replies")

    def article(self) -> str:
        r = self.r
        parts = [f"<h1 data-keep>{self.words(r.randint(2, 8)).capitalize()}</h1>"]
        tag = r.choice(["p", "p", "p", "div"])
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if kind < 0.78:
                size = r.choice([1, 3, 8, 20, 40, 80])
                text = self.sentences(size) if size > 1 else self.words(2).capitalize()
                if r.random() < 0.2:
                    text = f"{text} <a href=/x>{self.words(2)}</a> {self.sentences(6)}"
                parts.append(f"<{tag} data-keep>{text}</{tag}>")
            elif kind < 0.86:
                parts.append(f"<h2 data-keep>{self.words(3).capitalize()}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li data-keep>{self.sentences(r.randint(2, 10))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote data-keep>{self.sentences(12)}</blockquote>")
            else:
                parts.append(self.furniture())
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        inner = self.article()
        after = self.comments() if r.random() < 0.4 else ""
        if r.random() < 0.5:
            inner, after = inner + after, ""
        body = self.box(inner, "article main", "content post entry-content story") + after
        head = self.box(f"<h2>{self.words(2).title()}</h2><p>{self.words(4)}</p>", "header", "header masthead") if r.random() < 0.5 else ""
        foot = self.box(f"<p>&copy; {self.words(2)} &middot; {self.sentences(4)}</p>", "footer", "footer copyright") if r.random() < 0.8 else ""
        before = "".join(self.furniture() for _ in range(r.randint(1, 3)))
        return f"<html><body>{head}{before}{body}{''.join(self.furniture() for _ in range(r.randint(0, 2)))}{foot}</body></html>"


def labelled_page(seed: int) -> str:
    """A page whose content blocks are the text of the elements with ``data-keep``."""
    return _Maker(seed).page()
