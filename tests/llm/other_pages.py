"""Pages with known main texts in layouts written by hand, apart from those that the model learns from."""

import random

WORDS = "river stone market window garden letter summer paper bridge village doctor engine harbour island journey kitchen lantern mountain needle orchard".split()


def sentence(r, n):
    out = [r.choice(WORDS) for _ in range(n)]
    if n > 9:
        out[n // 2] += ","
    return " ".join(out).capitalize() + "."


def plain_blog(r, body):
    side = "".join(f"<li><a href='/t/{i}'>{r.choice(WORDS)}</a></li>" for i in range(6))
    inner = "".join(f"<p>{x}</p>" for x in body)
    return f"<!doctype html><html><head><title>x</title><meta charset=utf-8></head><body><div id=header><a href=/>Home</a> <a href=/a>About</a></div><div id=main><div class=post>{inner}</div></div><div id=sidebar><h4>Tags</h4><ul>{side}</ul></div><div id=footer>Copyright {r.choice(WORDS)}</div></body></html>"


def news(r, body):
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:])
    half = len(inner) // 2
    cut = inner.find("</p>", half) + 4
    ad = '<div class="ad-slot"><p>Advertisement: buy one now.</p></div>'
    return f'<html><body><header class="masthead"><nav><a href=/1>World</a><a href=/2>Sport</a></nav></header><main><article class="story" itemprop="articleBody">{inner[:cut]}{ad}{inner[cut:]}</article><section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree.</p></div></section></main><aside class="related"><h2>Read more</h2><a href=/3>{r.choice(WORDS)} {r.choice(WORDS)}</a></aside><footer><p>All rights reserved. <a href=/p>Privacy</a></p></footer></body></html>'


def docs(r, body):
    rows = "".join(f"<li>{x}</li>" for x in body[2:])
    nav = "".join(f"<a href='#{i}'>{r.choice(WORDS)}</a>" for i in range(8))
    return f'<html><body><nav class="toc">{nav}</nav><main role="main"><article><h2>{body[0]}</h2><p>{body[1]}</p><ol>{rows}</ol></article></main><footer role="contentinfo">Built with care.</footer></body></html>'


def table_layout(r, body):
    inner = "".join(f"<p>{x}</p>" for x in body)
    return f'<table><tr><td class="menu"><a href=/>Start</a><br><a href=/x>Links</a></td><td class="content">{inner}</td></tr></table><p class="footer"><a href=/c>Contact</a></p>'


def pages(count, seed=3):
    """(page, blocks of its main text)"""
    r = random.Random(seed)
    for i in range(count):
        body = [sentence(r, r.choice((8, 15, 30, 60))) for _ in range(r.randint(3, 9))]
        yield (plain_blog, news, docs, table_layout)[i % 4](r, body), body
