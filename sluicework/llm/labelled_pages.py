"""Labelled pages the extraction model is trained from.

Each layout is a page with `data-label` on the elements that are content (1)
or, inside content, are not (0). The slots are filled by rule: {S} a sentence or
more, {W} a few words, {L} a list of links.
"""

from __future__ import annotations

import random

LAYOUTS = [
    '<nav><ul>{L}</ul></nav><div class="ad">{S}</div><article data-label="1"><h1>{W}</h1><p>{S}</p><p>{W}</p><p>{S}</p></article><footer>&copy; {W}</footer>',
    '<nav><ul>{L}</ul></nav><div class="ad">{S}</div><article data-label="1"><h1>{S}</h1><p><b>{S}<br><p>{S}</p><p><b>{W}<br><p>{S}</p></article><footer>&copy; {S}</footer>',
    '<header><h1>{W}</h1><p>{S}</p></header><nav>{L}</nav><main data-label="1"><h1>{W}</h1><p>{S}</p><ul><li>{W}</li><li>{S}</li></ul><p>{S}</p></main><aside><h3>{W}</h3><ul>{L}</ul></aside><footer><p>{S}</p></footer>',
    '<div id="header"><div class="logo">{W}</div><div class="menu"><ul>{L}</ul></div></div><div id="content" data-label="1"><h2>{W}</h2><p>{S}</p><p>{S}</p><blockquote><p>{S}</p></blockquote><p>{S}</p></div><div id="sidebar"><div class="widget"><h3>{W}</h3><p>{S}</p><ul>{L}</ul></div></div><div id="footer"><p>{S}</p></div>',
    '<div class="cookie-notice"><p>{S}</p></div><div class="nav"><ul>{L}</ul></div><div class="post" data-label="1"><h1>{W}</h1><div class="entry-content"><p>{S}</p><p>{S}</p><h2>{W}</h2><p>{S}</p></div></div><div id="comments"><h3>{W}</h3><div class="comment"><p>{S}</p></div><div class="comment"><p>{S}</p><p>{S}</p></div></div>',
    '<div class="notice">{S}</div><main><article data-label="1"><h1>{W}</h1><p>{S}</p><div class="ad" data-label="0"><p>{S}</p></div><p>{S}</p><p>{W}</p></article><section class="comments"><h2>{W}</h2><article class="comment"><p>{S}</p></article><article class="comment"><p>{S}</p></article></section></main><footer><ul>{L}</ul></footer>',
    '<div class="container"><div class="row"><div class="story" data-label="1"><h1>{W}</h1><p>{S}</p><p>{S}</p><table><tr><td>{W}</td><td>{W}</td></tr></table><p>{S}</p></div><div class="related"><h4>{W}</h4><ul>{L}</ul></div></div></div><div class="newsletter"><form><p>{S}</p></form></div>',
    '<div><ul>{L}</ul></div><div data-label="1"><h1>{W}</h1><p>{S}</p><p>{S}</p><p>{S}</p></div><div><ul>{L}</ul></div>',
    '<header><nav><ul>{L}</ul></nav></header><article data-label="1"><h1>{W}</h1><p>{S}</p><aside data-label="0"><p>{S}</p></aside><p>{S}</p><figure><figcaption>{W}</figcaption></figure><p>{S}</p><footer data-label="0"><p>{W}</p></footer></article><form><p>{W}</p></form><footer>{S}</footer>',
    '<form class="search"><p>{W}</p></form><div class="breadcrumb">{L}</div><article data-label="1"><header data-label="0"><p>{W}</p></header><p>{S}</p><p>{S}</p><ol><li>{S}</li><li>{W}</li></ol></article><div class="share"><ul>{L}</ul></div><section id="respond"><h3>{W}</h3><form><p>{S}</p></form></section>',
    '<div class="banner">{S}</div><div class="promo"><p>{S}</p></div><article data-label="1"><p>{S}</p></article><div class="sponsored"><h3>{W}</h3><p>{S}</p></div><div class="tags">{L}</div>',
    '<article data-label="1"><h1>{W}</h1></article><footer>{S}</footer>',
    '<nav><ul>{L}</ul></nav><article data-label="1"><h1>{W}</h1><p>{W}</p><pre>{S}</pre><h2>{W}</h2><p>{S}</p></article><aside class="sidebar"><p>{S}</p><p>{S}</p></aside><div class="reader-comments"><p>{S}</p></div><footer>{W}</footer>',
    '<div class="alert"><p>{S}</p></div><section class="article-body" data-label="1"><h2>{W}</h2><p>{S}</p><div><p>{S}</p></div><p>{S} <a href="/x">{W}</a> {S}</p></section><section class="comments-area"><ul><li><p>{S}</p></li><li><p>{S}</p></li></ul></section><div class="footer"><p>{S}</p></div>',
    '<dialog><p>{S}</p></dialog><article data-label="1"><h1>{W}</h1><section><h2>{W}</h2><p>{S}</p></section><section><h2>{W}</h2><p>{S}</p></section><section class="comments" data-label="0"><h2>{W}</h2><p>{S}</p><p>{S}</p></section></article><aside><p>{S}</p></aside>',
    '<body data-label="1">{S}</body>',
    '<body data-label="1"><p>{S}</p><p>{S}</p></body>',
    '<body data-label="1"><h1>{W}</h1><p>{S}</p><p>{S}</p><ul><li>{W}</li><li>{S}</li></ul><p>{S}</p></body>',
    '<body data-label="1"><div class="nav" data-label="0"><ul>{L}</ul></div><h1>{W}</h1><p>{S}</p><p>{S}</p><p>{S}</p><div class="footer" data-label="0"><p>{S}</p></div></body>',
    '<body data-label="1"><h1>{W}</h1><p>{S}</p><table><tr><td>{W}</td><td>{S}</td></tr></table><p>{S}</p><footer data-label="0">{S}</footer></body>',
    '<nav><ul>{L}</ul></nav><article data-label="1"><p><a href="/x">{S}</a></p><p>{S}</p></article><footer>{S}</footer>',
    '<div class="site has-sidebar"><div class="content sidebar-right" data-label="1"><h1>{W}</h1><p>{S}</p><p>{S}</p></div><div class="sidebar"><p>{S}</p><ul>{L}</ul></div></div>',
    '<div><ul>{L}</ul></div><div data-label="1"><h1>{W}</h1><p>{S}</p><p>{S}</p></div><div>Copyright 2020 {W}</div>',
    '<div class="page no-footer"><div data-label="1"><p>{S}</p><p>{S}</p></div><div><p>&copy; {W}</p></div></div>',
    '<header><h2>{W}</h2></header><article data-label="1"><header><h1>{W}</h1></header><p>{S}</p><p>{S}</p></article><footer>{S}</footer>',
    '<main data-label="1"><header><h1>{W}</h1></header><p>{S}</p><div class="newsletter" data-label="0"><p>{S}</p></div><p>{S}</p></main><div class="user-talk"><p>{S}</p><p>{S}</p></div>',
    '<article data-label="1"><h1>{W}</h1><p>{S}</p><div class="newsletter-box" data-label="0"><h3>{W}</h3><p>{S}</p></div><p>{S}</p></article><div class="feedback"><p>{S}</p></div>',
]
VARIANTS = 12


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(least, most)))


def _fill(layout: str, rng: random.Random) -> str:
    out = layout
    while "{S}" in out:
        sentence = ". ".join(_words(rng, 4, 22).capitalize() for _ in range(rng.randint(1, 5))) + "."
        out = out.replace("{S}", sentence, 1)
    while "{W}" in out:
        out = out.replace("{W}", _words(rng, 1, 6) + rng.choice(["", "", "."]), 1)
    while "{L}" in out:
        out = out.replace("{L}", "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(2, 7))), 1)
    return out


def labelled_pages() -> list[str]:
    rng = random.Random(7)
    return [_fill(layout, rng) for layout in LAYOUTS for _ in range(VARIANTS)]
