"""Labelled training pages: made-up pages of many layouts whose blocks are known to be article or not.

The layouts vary independently: which elements and class names mark each part of a page, which parts it has, their order
and their nesting. Labels come with the construction. Nothing is taken from the tables that are extracted later.
"""

from __future__ import annotations

import random

SYLLABLES = "an ar be ca de el en er fo ga he in ka la lo ma me ne no on or pa ra re sa se st ta te th ti to un ve wi ü é ß ñ".split()

#: How the parts of pages are marked up: openings of the element that holds them.
ARTICLE = ["<article>", '<article class="post">', '<main><article>', '<main>', '<div id="content"><article>', '<div class="post-body">', '<div class="entry-content">', '<div class="article-text">', '<section class="story">', '<div id="main-content">', '<div class="content">', '<div role="main">', '<article class="entry hentry">', '<div itemprop="articleBody" class="article-body">', "<section>", '<div class="page"><div class="text">']
#: Articles whose mark-up does not say so; {} is a made-up name.
BARE = ["<div>", "<div>", "<div><div>", "<div><div><div>", '<div class="{}">', '<div id="{}">', '<div class="{} {}">', '<div class="{}"><div class="{}">', '<div class="post">', "<table><tr><td>", "<center>", "<div><section>", "<font>", "<span>", ""]
MENU = ["<nav>", '<nav class="menu">', '<div class="nav">', '<div id="navigation">', '<ul class="menu">', '<div class="breadcrumbs">', '<div role="navigation">', '<ul id="nav">', '<div class="navbar">', '<nav class="pagination">', '<div class="topbar">', '<div class="main-menu">']
HEADER = ["<header>", '<header class="site-header">', '<div id="header">', '<div class="masthead">', '<div class="banner">', '<div class="page-header">', '<div role="banner">', '<div class="top logo">']
FOOTER = ["<footer>", '<footer class="site-footer">', '<div id="footer">', '<div class="footer">', '<div class="colophon">', '<div role="contentinfo">', '<div class="copyright">', '<div class="legal">']
SIDEBAR = ["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="secondary">', '<div class="widget">', '<div class="related">', '<div class="rail">', '<div role="complementary">', '<section class="sidebar">', '<div class="side">', '<div class="related-posts">', '<div class="recommended">', '<div class="toc">']
NOTICE = ['<div class="cookie-notice">', '<div id="cookies">', '<div class="notice">', '<div class="alert">', '<p class="notice">', '<div id="gdpr" role="dialog">', '<div role="alert">', '<section class="consent">', '<div class="banner-message">', '<dialog>', '<div class="paywall">', '<div class="disclaimer">', '<div class="warning">']
ADVERT = ['<div class="ad">', '<aside class="ad">', '<div class="ads">', '<div id="advert">', '<div class="advertisement">', '<section class="sponsored">', '<div class="promo">', '<div class="banner-ad">', '<p class="ad">', '<div class="sponsor">', '<div class="ad-slot">', '<div class="adbox">']
FORM = ["<form>", '<form class="newsletter">', '<form id="search">', '<div class="subscribe"><form>', '<div class="login"><form>', '<form action="/go">', '<div class="newsletter">', '<fieldset>']
COMMENTS = ['<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus">', '<div class="comment">', '<section class="comments"><article class="comment">', '<div class="replies">', '<div class="discussion">', '<ul class="comment-list">', '<div class="reader-comments">', '<div class="responses">']
SHARE = ['<div class="share">', '<ul class="social">', '<div class="tags">', '<div class="share-buttons">']


def _close(opening: str) -> str:
    tags = [x.split()[0].strip("<>") for x in opening.split(">") if x.strip()]
    return "".join(f"</{t}>" for t in reversed(tags))


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))

    def sentence(self, low: int = 2, high: int = 24) -> str:
        return self.words(self.r.randint(low, high)).capitalize() + self.r.choice(["."] * 6 + ["?", "!"])

    def prose(self, most: int = 6) -> str:
        r = self.r
        text = " ".join(self.sentence() for _ in range(r.randint(1, most)))
        odd = r.random()  # texts are not all well written, in the article or elsewhere
        if odd < 0.05:
            text = " | ".join(text.split())
        elif odd < 0.09:
            text = " ".join(w + r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;&amp;"]) for w in text.split()[: r.choice([2, 3, 9, 99])])
        elif odd < 0.12:
            text = text.upper().replace(" ", "!! ")
        elif odd < 0.14:
            text = " ".join([self.words(1)] * r.randint(5, 40))
        elif odd < 0.17:
            text = r.choice(["Copyright", "(c)", "&copy; 2019", "Licensed under"]) + " " + text
        elif odd < 0.20:
            text = self.words(r.randint(1, 3))
        elif odd < 0.22:
            text += " " + " &middot; ".join([self.words(2)] * 2)
        return text

    def link(self) -> str:
        return f'<a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a>'

    def article(self) -> list[tuple[str, int]]:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.sentence(2, 10)}</h1>"
            out.append((f"<header>{title}</header>" if r.random() < 0.2 else title, 1))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.72:
                text = self.prose()
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                elif r.random() < 0.2:
                    text += " " + self.link() + " " + self.sentence()
                out.append((f"<p>{text}" + "</p>" * (r.random() < 0.85), 1))
            elif x < 0.80:
                out.append((f"<h{r.randint(2, 4)}>{self.sentence(1, 7)}</h2>", 1))
            elif x < 0.86:
                out.append(("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>", 1))
            elif x < 0.89:
                out.append((f"<blockquote>{self.prose(3)}</blockquote>", 1))
            elif x < 0.91:
                out.append((f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>", 1))
            elif x < 0.93:
                out.append(("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(3)) + "</table>", 1))
            elif x < 0.95:
                out.append((f"<div>{self.prose(3)}</div>", 1))
            elif x < 0.97:
                out.append((self.part(r.choice([ADVERT, SIDEBAR, NOTICE])), 0))
            else:
                out.append((self.part(r.choice([FORM, SHARE])), 0))
        return out

    def named(self, opening: str) -> str:
        return opening.format(*(self.words(1) for _ in range(opening.count("{}"))))

    def broken_lines(self) -> list[tuple[str, int]]:
        """An article whose paragraphs are parted by line breaks alone."""
        r = self.r
        out = [(f"<h{r.randint(1, 3)}>{self.sentence(2, 10)}</h3>", 1)] * (r.random() < 0.5)
        for _ in range(r.choice([1, 1, 2, 3])):
            out.append((r.choice(["<br>", "<br><br>", "<br/>\n<br/>"]).join(self.prose() for _ in range(r.randint(1, 8))), 1))
            if r.random() < 0.4:
                out.append((f"<h{r.randint(2, 4)}>{self.sentence(1, 7)}</h2>", 1))
        return out

    def part(self, openings: list[str]) -> str:
        """A part that is no article, of links, prose or both."""
        r, opening = self.r, self.r.choice(openings)
        inner, x = [], r.random()
        if openings in (MENU, SHARE) and x < 0.9 or x < 0.15:
            items = [self.link() for _ in range(r.randint(1, 8))]
            inner.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items))
        elif openings is FORM:
            inner.append(f"<label>{self.words(2)}</label><input name=q><p>{self.sentence()}</p><button>{self.words(1)}</button>")
        elif openings is FOOTER and r.random() < 0.7:
            inner.append(f"&copy; {self.words(2)} &middot; {self.sentence()}" if r.random() < 0.6 else f"<p>{self.sentence()}</p><p>{self.link()}</p>")
        else:
            if r.random() < 0.3:
                inner.append(f"<h{r.randint(2, 4)}>{self.words(2)}</h3>")
            for _ in range(r.choice([1, 1, 2, 4])):
                wrap = r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<li>{}</li>"])
                inner.append(wrap.format(self.prose(3 if openings is not COMMENTS else 5)))
        return opening + "".join(inner) + _close(opening)

    def page(self) -> list[tuple[str, int]]:
        """Pieces of a page, each with 1 for article, 0 for anything else."""
        r = self.r
        before = [x for x, chance in ((HEADER, 0.5), (MENU, 0.8), (NOTICE, 0.3), (ADVERT, 0.4), (FORM, 0.2), (SIDEBAR, 0.25), (MENU, 0.2)) if r.random() < chance]
        after = [x for x, chance in ((SHARE, 0.2), (COMMENTS, 0.4), (ADVERT, 0.3), (SIDEBAR, 0.35), (FORM, 0.25), (NOTICE, 0.15), (MENU, 0.15)) if r.random() < chance]
        alone = r.random() < 0.15  # a page that is nothing but its article
        if alone:
            before, after = [], []
        r.shuffle(before)
        r.shuffle(after)
        bare = r.random() < 0.45
        opening = self.named(r.choice(BARE)) if bare else r.choice(ARTICLE)
        article = self.broken_lines if bare and r.random() < 0.25 else self.article
        pieces = [(f'<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>', 0)]
        pieces += [(self.part(x), 0) for x in before]
        if r.random() < 0.1:  # paragraphs that stand in the body itself
            pieces += [x for x in article() if x[1]]
        else:
            nested = r.random() < 0.25
            pieces += [(opening, 0), *article()]
            if nested and after:
                pieces.append((self.part(after.pop()), 0))
            pieces.append((_close(opening), 0))
        pieces += [(self.part(x), 0) for x in after]
        if not alone and r.random() < 0.9:
            pieces.append((self.part(FOOTER), 0))
        return pieces + [("</body></html>", 0)] * (r.random() < 0.9)
