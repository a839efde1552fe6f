"""The small labelled table that the block tree is grown on: invented pages whose blocks are marked as main text or as something else.

In a page ``[+n]`` stands for n words of main text and ``[-n]`` for n words of another block. Each page is taken with its numbers as they are, shorter and longer,
and with and without its menu and foot, so that word counts and link densities vary where the markup stays.
"""

from __future__ import annotations

import re

MENU = '<nav><ul><li><a href="/">[-1]</a></li><li><a href="/n">[-1]</a></li><li><a href="/a">[-2]</a></li></ul></nav>'
FOOT = '<footer><p>&copy; [-6]</p><p><a href="/p">[-1]</a> <a href="/t">[-1]</a></p></footer>'
LINKS = '<ul><li><a href="/1">[-4]</a></li><li><a href="/2">[-9]</a></li><li><a href="/3">[-6]</a></li></ul>'

PAGES = [
    # an article among menus, adverts, notices and comments
    f"<body>{MENU}<article><h1>[+4]</h1><p>[+21]</p><p>[+1]</p><p>[+40]</p></article>{FOOT}</body>",
    f'<body>{MENU}<div class="ad">[-16]</div><article><h1>[+1]</h1><p>[+2]</p><p>[+25]</p><p>[+90]</p></article>{FOOT}</body>',
    f'<body><header><h1>[-2]</h1><p>[-14]</p></header><main><h2>[+1]</h2><p>[+30]</p><ul><li>[+2]</li><li>[+3]</li></ul><p>[+22]</p></main><aside><h3>[-2]</h3><p>[-24]</p></aside>{FOOT}</body>',
    f'<body><div id="cookie-notice"><p>[-22]</p></div><article><h1>[+2]</h1><p>[+35]</p><blockquote>[+4]</blockquote><div class="advert">[-12]</div><p>[+28]</p></article><section class="comments"><h3>[-1]</h3><p>[-19]</p><p>[-2]</p></section>{FOOT}</body>',
    f'<body><article class="post"><h1>[+3]</h1><p>[+26]</p><p>[+1]</p><div id="comments"><article class="comment"><p>[-33]</p></article><form><p>[-11]</p></form></div></article>{FOOT}</body>',
    f'<body><article><header><h1>[+3]</h1><p class="byline">[-4]</p></header><p>[+44]</p><table><tr><th>[+1]</th><th>[+1]</th></tr><tr><td>[+1]</td><td>[+1]</td></tr></table><p>[+20]</p><nav><a href="/2">[-2]</a></nav></article><div class="related"><h3>[-1]</h3>{LINKS}</div></body>',
    f'<body>{MENU}<article><h1>[+2]</h1><p><a href="/l">[+21]</a></p><p>[+18]</p><aside><p>[-25]</p></aside><p>[+1]</p></article><div class="newsletter-signup"><p>[-20]</p></div>{FOOT}</body>',
    f'<body>{MENU}<article><h1><a href="/t">[+2]</a></h1><p>[+30]</p><p><a href="/m">[+1]</a></p><ul><li><a href="/n">[+2]</a></li><li><a href="/s">[+7]</a></li></ul><p>[+1]</p><p><a href="/z">[+12]</a></p></article>{FOOT}</body>',
    '<body><main><h1>[+1]</h1><p><a href="/1">[+1]</a></p><p><a href="/2">[+1]</a></p><p>[+33]</p><p><a href="/3">[+1]</a></p></main><div><a href="/4">[-1]</a></div></body>',
    '<body><div>[-18]</div><article><h1>[+1]</h1><p>[+26]</p><p>[+3]</p><p>[+31]</p></article><div>[-23]</div><p>[-2]</p></body>',
    '<body><p>[-3]</p><div>[-24]</div><main><p>[+24]</p><p>[+27]</p></main><div>[-4]</div><p>[-50]</p></body>',
    f'<body><main><section><h2>[+2]</h2><p>[+25]</p></section><section><h2>[+2]</h2><p>[+20]</p><p>[+2] <a href="/m">[+1]</a>.</p></section></main><div role="contentinfo">[-14]</div>{FOOT}</body>',
    f'<body>{MENU}<div class="entry-content"><p>[+40]</p><p>[+2]</p></div><div class="sidebar"><p>[-17]</p>{LINKS}</div></body>',
    f'<body><form action="/all"><article><p>[+30]</p><p>[+2]</p></article></form>{FOOT}</body>',
    # names that say little, inside an article: their blocks' words and links decide
    f'<body>{MENU}<article><h1>[+3]</h1><p class="dialog">[+2]</p><div class="recommended"><p>[+24]</p><p>[+15]</p></div><div class="share"><a href="/f">[-1]</a> <a href="/x">[-1]</a></div></article>{FOOT}</body>',
    f'<body><article><p>[+30]</p><div class="meta">[-2]</div><div class="header"><p>[+26]</p></div><div class="tags"><a href="/a">[-1]</a> <a href="/b">[-2]</a></div><p>[+20]</p></article></body>',
    f'<body><article><p>[+28]</p><div class="widget"><p>[+30]</p></div><div class="social">[-2]</div><div class="related"><p>[-1]</p>{LINKS}</div><div class="teaser"><p>[+21]</p></div></article>{FOOT}</body>',
    f'<body><article><p>[+50]</p><div class="search"><p>[-2]</p></div><div class="popular"><a href="/1">[-8]</a></div><div class="latest"><a href="/2">[-12]</a></div><p>[+14]</p></article></body>',
    f'<body><article><p>[+22]</p><div class="alert">[-18]</div><div class="disclaimer">[-30]</div><div class="promo"><p>[-26]</p></div><div class="subscribe">[-9]</div><p>[+2]</p></article></body>',
    # no article is named: words, links and neighbours decide
    '<body><div class="top"><a href="/">[-1]</a> | <a href="/a">[-1]</a> | <a href="/b">[-1]</a></div><div id="text"><h1>[+4]</h1><p>[+24]</p><p>[+30]</p><p>[+41]</p></div><div class="bottom"><a href="/c">[-1]</a> <a href="/d">[-1]</a></div></body>',
    f'<body>{MENU}<div><h2>[+2]</h2><p>[+22]</p><p>[+35]</p></div><div class="sidebar"><p>[-15]</p></div><form action="/s"><p>[-9]</p><input name="q"></form>{FOOT}</body>',
    '<body><div><a href="/1">[-1]</a><a href="/2">[-1]</a></div><p>[+20]</p><p>[+26] <a href="/m">[+1]</a></p><p><a href="/r">[-13]</a></p></body>',
    '<body><div><a href="/">[-1]</a></div><div><p>[+23]</p></div><div><p>[+27]</p></div><div>[-2]</div><div><a href="/k">[-1]</a></div></body>',
    f"<body>{LINKS}<p>[+60]</p><p>[+33]</p><p>[+45]</p>{LINKS}</body>",
    f"<body><p><a href='/h'>[-2]</a> <a href='/i'>[-3]</a></p><h1>[+5]</h1><p>[+32]</p><p>[+3]</p><p>[+29]</p>{LINKS}<p><a href='/c'>[-2]</a></p></body>",
    f"<body><table><tr><td><a href='/1'>[-2]</a></td><td><a href='/2'>[-1]</a></td></tr></table><p>[+38]</p><p>[+25] <a href='/x'>[+3]</a> [+8]</p>{FOOT}</body>",
    f"<body><div><a href='/a'>[-3]</a></div><div><a href='/b'>[-5]</a></div><div>[+70]</div><div>[+34]</div><div><a href='/c'>[-4]</a></div></body>",
    f'<body><p>[-1] <a href="/u">[-2]</a></p><p>[+28]</p><h2>[+3]</h2><p>[+31]</p><ul><li>[+9]</li><li>[+12]</li></ul><p>[+22]</p><p><a href="/n">[-2]</a> <a href="/o">[-2]</a> [-1]</p></body>',
    # little pages
    "<article><p>[+21]</p></article>",
    "<p>[+1]</p>",
    "<body><p>[+24]</p><p>[+2]</p><p>[+22]</p></body>",
    "<body><article><p>[+1]</p><p>[+21]</p><p>[+1]</p></article></body>",
    "<body><article><h1>[+1]</h1></article></body>",
    "<body><h1>[+1]</h1><p>[+22]</p><p>[+5]</p></body>",
    f"<body>{MENU}<h1>[+1]</h1><p>[+24]</p><p>[+2]</p>{FOOT}</body>",
    '<body><article><p>[+22]</p><p><a href="/q">[+1]</a></p></article></body>',
]

#: How much longer the texts are in each taking of a page.
SCALES = (1.0, 0.5, 2.5)
SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve".split()


def labelled() -> list[tuple[str, set[str]]]:
    """(page, texts of main blocks, words joined by one space) of all takings; no text comes twice."""
    found, count = [], 0
    for page in PAGES:
        cuts = dict.fromkeys(page.replace(MENU, a).replace(FOOT, b) for a in (MENU, "") for b in (FOOT, ""))
        for scale in SCALES:
            for cut in cuts:
                wanted: set[str] = set()

                def fill(m: re.Match, scale: float = scale, wanted: set[str] = wanted) -> str:
                    nonlocal count
                    words = []
                    for _ in range(max(1, round(int(m[2]) * scale))):
                        count += 1
                        words.append("".join(SYLLABLES[count // 12**k % 12] for k in range(4)))
                    if m[1] == "+":
                        wanted.update(words)
                    return " ".join(words)

                found.append((re.sub(r"\[([+-])(\d+)\]", fill, cut), wanted))
    return found
