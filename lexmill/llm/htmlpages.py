"""Labelled pages that the HTML model is trained from: written for this package, data-content marks the labels."""

from __future__ import annotations

LONG = "The committee met on Tuesday to hear the report of the engineers, who had spent the summer on the bridge and its piers. They found that the northern span would carry the new loads without further work, and that the southern span needed two more seasons of repair before any lorry could pass it."
MID = "Nobody had expected the vote to be that close, and the count went on until midnight."
SHORT = "It was late."
TITLE = "Bridge work to last two more seasons"
LINKS = "<li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>Sport</a></li><li><a href='/d'>About us</a></li>"
MENU = f"<nav><ul>{LINKS}</ul></nav>"
#: What a body is made of: paragraphs of several lengths, headings, lists, quotes and tables.
BODIES = (
    f"<h1>{TITLE}</h1><p>{LONG}</p><p>{MID}</p><ul><li>{SHORT}</li><li>{MID}</li><li>{SHORT}</li></ul><p>{SHORT}</p><p>{LONG}</p>",
    f"<h1>{TITLE}</h1><p>{SHORT}</p><h2>What the report says</h2><p>{LONG}</p><ul><li>The northern span is sound.</li><li>The southern span is not</li></ul><p>{MID}</p>",
    f"<h1>{TITLE}</h1><p>{LONG}</p><blockquote><p>{MID}</p></blockquote><h3>Costs</h3><p>{MID} <a href='/x'>See the report</a>.</p><table><tr><td>Span</td><td>Cost</td></tr><tr><td>North</td><td>1.2</td></tr></table>",
    f"<p>{LONG}</p><p>{LONG}</p><div>{MID}</div><pre>load = 3 * span</pre><ol><li>{MID}</li><li>{SHORT}</li></ol><p>On site</p><figure><figcaption>{SHORT}</figcaption></figure>",
    f"<h1>{TITLE}</h1><p>On.</p><p>{SHORT}</p><ol><li>{MID}</li><li>{SHORT}</li><li>Piers</li></ol><p>{MID}</p><p>Engineers said</p><ul><li>Spans</li></ul>",
    f"<h1>{TITLE}</h1><p>{MID}</p>",
    f"<h2>{TITLE}</h2><p>{LONG}</p>",
    f"<h2>{TITLE}</h2><ul><li>{MID}</li><li>{SHORT}</li><li>{SHORT}</li><li>{MID}</li></ul><p>{SHORT}</p><dl><dt>Pier</dt><dd>{MID}</dd></dl>",
)
#: Containers of the body: (opening, closing).
FRAMES = (
    ("<article data-content='1'>", "</article>"),
    ("<main><article data-content='1'>", "</article></main>"),
    ("<main data-content='1'>", "</main>"),
    ("<div id='content' class='main content' data-content='1'>", "</div>"),
    ("<div class='post entry' data-content='1'><div class='post-body entry-content'>", "</div></div>"),
    ("<div class='article-body story' data-content='1'>", "</div>"),
    ("<div id='wrapper' class='container page'><section class='article text' role='main' data-content='1'>", "</section></div>"),
    ("<div data-content='1'>", "</div>"),
    ("<div class='wrap outer'><div class='row inner'><div class='col box' data-content='1'>", "</div></div></div>"),
    ("<div><div data-content='1'>", "</div></div>"),
    ("<div><div><div data-content='1'>", "</div></div></div>"),
    ("<div class='grid'><div class='cell block' data-content='1'>", "</div></div>"),
    ("<article data-content='1'><section>", "</section></article>"),
    ("", ""),
)
#: What stands before the body, after it, and inside it, none of it content.
BEFORE = (
    MENU,
    f"<header><div class='logo site-header banner'><h1>The Daily Span</h1></div>{MENU}</header>",
    f"<div id='header' class='top header masthead'><p>{SHORT}</p></div><div class='menu navigation navbar' role='navigation'><ul>{LINKS}</ul></div>",
    f"<div class='cookie-notice consent banner gdpr' role='dialog'><p>We use cookies to make this site work, to count visits and to show adverts. {MID}</p><button>Accept</button></div>{MENU}",
    f"<div class='breadcrumb breadcrumbs'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='ad ads advert advertisement'>{MID}</div>",
    f"<div class='notice alert message' role='alert'>{MID}</div><form class='search' role='search'><label>Search this site</label><button>Go</button></form>",
    f"<div class='ad'>{LONG}</div>{MENU}",
    f"<div class='sponsored promo promotion sponsor'><h3>{MID}</h3><p>{LONG}</p></div>{MENU}",
    f"<div class='skip hidden popup modal overlay'><p>{MID}</p></div>{MENU}",
)
AFTER = (
    f"<footer>&copy; span.example.com &middot; {LONG}</footer>",
    f"<footer><p>{MID}</p><ul>{LINKS}</ul></footer>",
    f"<aside class='sidebar'><h3>Most read</h3><ul>{LINKS}</ul><p>{LONG}</p></aside><footer>{MID}</footer>",
    f"<div id='sidebar' class='side right widget'><h2>Latest</h2><p>{MID}</p><ul>{LINKS}</ul></div><div id='footer' class='footer bottom copyright legal' role='contentinfo'><p>{LONG}</p></div>",
    f"<section id='comments' class='comments'><h2>Comments</h2><div class='comment'><p>{MID}</p></div><div class='comment reply'><p>{LONG}</p></div></section><footer>{SHORT}</footer>",
    f"<div class='comment-list discussion responses feedback' id='disqus'><h3>2 replies</h3><ul><li class='comment'><p>{LONG}</p></li><li class='comment'><p>{SHORT}</p></li></ul></div><footer>{MID}</footer>",
    f"<form action='/s' class='newsletter subscribe signup'><p>{MID}</p><label>Your address</label><button>Subscribe</button><select><option>One</option></select><textarea>{SHORT}</textarea><fieldset><legend>Options</legend></fieldset></form><footer>{MID}</footer>",
    f"<aside><p>{LONG}</p></aside><div class='related recommended more popular'><h3>Read next</h3><ul>{LINKS}</ul></div><footer>{MID}</footer>",
    f"<aside role='complementary'>{MID}</aside><div class='ad sponsored'><p>{LONG}</p></div><footer><p>{LONG}</p></footer>",
    f"<div class='author bio meta byline'><p>{MID}</p></div><div class='tags pagination pager'><a href='/t'>bridges</a></div><footer>{MID}</footer>",
)
INSIDE = (
    "",
    "",
    f"<div class='ad advert' data-content='0'>{MID}</div>",
    "<div class='share social sharing' data-content='0'><ul><li><a href='/s'>Share</a></li><li><a href='/m'>Mail</a></li></ul></div>",
    f"<aside class='related' data-content='0'><p>{MID}</p></aside>",
    f"<nav class='toc' data-content='0'><ul>{LINKS}</ul></nav>",
    f"<form data-content='0'><p>{MID}</p><button>Send</button></form>",
    f"<section class='comments' data-content='0'><p>{LONG}</p><p>{SHORT}</p></section>",
    f"<footer data-content='0'><p>{MID}</p></footer>",
    f"<header data-content='0'><p>{SHORT}</p></header>",
    f"<div class='reader comments responses' data-content='0'><h3>{SHORT}</h3><p>{LONG}</p><p>{MID}</p></div>",
    f"<div class='newsletter signup notice' data-content='0'><p>{MID}</p></div>",
    f"<div class='sidebar widget menu' data-content='0'><p>{LONG}</p><ul>{LINKS}</ul></div>",
    f"<div class='comment' data-content='0'><p>{MID}</p></div>",
    f"<section class='comments' data-content='0'><div class='comment'><p>{MID}</p></div></section>",
    f"<div class='notice cookie banner' data-content='0'>{MID}</div>",
    f"<div class='sponsored promo ad' data-content='0'><p>{LONG}</p></div>",
)


#: Texts that take the places of the three above by turns, so that length and marks say little by themselves.
TEXTS = (
    "No.", "Nobody knew.", "Read the whole report", "On the other side of the river", "It was late, and the lamps were out.",
    "They walked back along the towpath without a word", "The span is closed to lorries from Monday until the end of the month.",
    "The council will meet again in the first week of May to hear what the contractors have to say about the delay and its price.",
    "A second survey, paid for by the county", MID, LONG, f"{MID} {LONG}", f"{LONG} {LONG}", f"{MID} {SHORT} {MID}",
    "All rights reserved by the owners and their heirs", "What happens next? Nobody can say for sure!", "By our own reporter, with pictures",
)


def labelled_pages() -> list[str]:
    """Every container with every surrounding, each with a body and an insert by turns."""
    pages, k, turn = [], 0, 0
    for opening, closing in FRAMES:
        for before in BEFORE:
            for after in AFTER:
                body, inside = BODIES[k % len(BODIES)], INSIDE[(k // 3) % len(INSIDE)]
                if not opening:
                    body = body.replace("<p>", "<p data-content='1'>").replace("<div>", "<div data-content='1'>")
                    for tag in ("h1", "h2", "h3", "ul", "ol", "blockquote", "table", "pre", "figure"):
                        body = body.replace(f"<{tag}>", f"<{tag} data-content='1'>")
                cut = body.find("</p>") + 4
                page = f"{before}{opening}{body[:cut]}{inside}{body[cut:]}{closing}{after}"
                for old in (LONG, MID, SHORT, TITLE):
                    parts = page.split(old)
                    page = parts[0]
                    for part in parts[1:]:
                        page += TEXTS[turn % len(TEXTS)] + part
                        turn += 5
                    turn += 1
                pages.append(f"<html><body>{page}</body></html>")
                k += 7
    return pages
