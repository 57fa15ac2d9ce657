"""Pages written by hand after layouts that are common on the web, and their articles."""

A = "The river rose again on Tuesday, and the old bridge was closed to all traffic before noon."
B = "Nobody was hurt, the town said in the evening, but the road stays closed for at least a week."
C = "Engineers will look at the two middle pillars once the water has gone down far enough."
P = f"<p>{A}</p><p>{B}</p>"
NAV = "<ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li><li><a href=/c>Weather</a></li></ul>"
FOOT = "<footer><p>Copyright 2020 Daily River. All rights reserved.</p></footer>"

LAYOUTS = {
    # class words that once lost the article
    "top story": (f'<div class="top-story">{P}</div>', [A, B]),
    "no comments": (f'<div id="main-content" class="no-comments">{P}</div>', [A, B]),
    "states on body": (f'<html><body class="page with-nav header-fixed"><div>{P}</div></body></html>', [A, B]),
    "closed menu": (f'<div class="wrapper menu-closed"><div class="content">{P}</div></div>', [A, B]),
    "page in a form": (f'<html><body><form id="aspnetForm"><div class="content">{P}</div></form></body></html>', [A, B]),
    "legal advice": (f'<div class="legal-advice"><h1>Your rights</h1>{P}</div>', ["Your rights", A, B]),
    "search result body": (f'<div class="formatted search-result-body">{P}</div>', [A, B]),
    "breaks": (f'<div class="post">{A}<br><br>{B}</div>', [f"{A} {B}"]),
    "text top": (f'<div class="text-top"><p>{A}</p></div><div class="text"><p>{B}</p></div>', [A, B]),
    "head of an article": (f"<article><header><h1>River rises</h1></header>{P}</article>", ["River rises", A, B]),
    "inline advert": (f'<article><p>{A} <span class="ad">Buy now</span></p><p>{B}</p></article>', [A, B]),
    "hidden span": (f"<article><p>{A} <span hidden>secret</span></p><p>{B}</p></article>", [A, B]),
    "hidden by style": (f'<article><p>{A} <i style="display:none">secret</i></p><p>{B}</p></article>', [A, B]),
    # layouts
    "blog": (
        f"""<html><body class="single single-post has-sidebar logged-out"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href=/>My blog</a></p><nav id="site-navigation" class="main-navigation">{NAV}</nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">River rises</h1></header><div class="entry-content">{P}</div></article>
<nav class="post-navigation"><a href=/p>Older</a> <a href=/n>Newer</a></nav><div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li><p>I saw it too, it was quite a sight from the hill that day.</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><h2>Recent</h2>{NAV}</aside></div><footer class="site-footer"><p>Proudly made by hand.</p></footer></div></body></html>""",
        ["River rises", A, B],
    ),
    "bootstrap": (f'<body><div class="navbar navbar-fixed-top">{NAV}</div><div class="container"><div class="row"><div class="col-md-8"><h1>River rises</h1>{P}</div><div class="col-md-4 sidebar"><h4>Links</h4>{NAV}</div></div></div>{FOOT}</body>', ["River rises", A, B]),
    "mail archive": (f"<html><body><h1>Re: the river</h1><pre>{A}</pre></body></html>", ["Re: the river", A]),
    "table layout": (f"<body><table><tr><td class=menu>{NAV}</td><td><h1>River rises</h1><p>{A}</p><p>{B}</p></td></tr></table></body>", ["River rises", A, B]),
    "wiki": (f'<body class="mediawiki ltr sitedir-ltr"><div id="content" class="mw-body" role="main"><h1 id="firstHeading">River</h1><div id="bodyContent"><div id="mw-content-text"><p>{A}</p><div id="toc" class="toc"><h2>Contents</h2>{NAV}</div><p>{B}</p></div></div></div><div id="mw-navigation">{NAV}</div><div id="footer" role="contentinfo"><p>This page was last edited in May.</p></div></body>', ["River", A, B]),
    "documentation": (f'<body><div class="sphinxsidebar"><div class="sidebar-nav">{NAV}</div></div><div class="document"><div class="body" role="main"><h1>Install</h1><p>{A}</p><pre>pip install river</pre><p>{B}</p></div></div></body>', ["Install", A, "pip install river", B]),
    "magazine": (f'<body><div class="ad-slot ad-slot--top">Advertisement</div><main><h1>River rises</h1><div class="byline">By Jo</div><div class="article-body"><p>{A}</p><aside class="related-posts"><h3>Read on</h3><a href=/x>The flood of 1994</a></aside><p>{B}</p><div class="newsletter-signup"><p>Get our letter each week.</p></div><p>{C}</p></div></main>{FOOT}</body>', ["River rises", A, B, C]),
    "cookie wall": (f'<body class="modal-open"><div class="cookie-consent" role="dialog"><p>We and our 812 partners store cookies on your device.</p><button>Accept</button></div><article>{P}</article></body>', [A, B]),
    "forum": (f'<body><div class="breadcrumbs"><a href=/>Home</a> <a href=/f>River</a></div><div class="post-body"><p>{A}</p><p>{B}</p></div></body>', [A, B]),
    "recipe": (f"<article><h1>Soup</h1><p>{A}</p><h2>You need</h2><ul><li>One onion</li><li>Two leeks</li></ul><h2>Steps</h2><ol><li>Cut the onion and the leeks.</li><li>Boil them for an hour or so.</li></ol></article>", ["Soup", A, "You need", "One onion", "Two leeks", "Steps", "Cut the onion and the leeks.", "Boil them for an hour or so."]),
    "data table": (f"<article><p>{A}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.1 m</td></tr></table><p>{B}</p></article>", [A, "Day", "Level", "Monday", "3.1 m", B]),
    "quotes": (f"<main><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></main>", [A, B, C]),
    "figure": (f"<article><p>{A}</p><figure><img src=x><figcaption>The bridge in spring.</figcaption></figure><p>{B}</p></article>", [A, "The bridge in spring.", B]),
    "inline markup": (f"<article><p>The <b>river</b> <i>rose</i> <a href=/x>again</a> on <span class=date>Tuesday</span>, and the bridge was closed.</p><p>{B}</p></article>", ["The river rose again on Tuesday, and the bridge was closed.", B]),
    "camel case": (f'<body><div class="siteHeader"><a href=/>Daily</a></div><div class="navBar">{NAV}</div><div class="articleBody">{P}</div><div class="siteFooter">Terms</div></body>', [A, B]),
    "underscores": (f'<body><div id="main_navigation">{NAV}</div><div id="main_content">{P}</div><div id="page_footer">Terms and conditions</div></body>', [A, B]),
    "sidebar wrap": (f'<body><div class="content-sidebar-wrap"><main class="content"><article>{P}</article></main><aside class="sidebar sidebar-primary">{NAV}</aside></div></body>', [A, B]),
    "share bar": (f'<article><h1>River rises</h1><div class="social-share"><a href=/f>Post</a> <a href=/t>Send</a></div>{P}<div class="tags">river, bridge</div></article>', ["River rises", A, B]),
    "login form": (f'<body><div class="login"><form><p>Name and password</p><button>Go</button></form></div><div class="content">{P}</div></body>', [A, B]),
    "hidden block": (f'<article>{P}<div hidden><p>A draft that nobody should see on the page at all.</p></div></article>', [A, B]),
    "folded block": (f'<article><p>{A}</p><div style="display: none"><p>A draft that nobody should see on the page at all.</p></div><p>{B}</p></article>', [A, B]),
    "old center": (f"<html><body><center><font size=5>River</font></center><p>{A}<p>{B}</body></html>", ["River", A, B]),
    "plain text": (f"{A}\n\n{B}", [f"{A} {B}"]),
    "text with breaks in a body": (f"<html><body>{A}<br>{B}</body></html>", [f"{A} {B}"]),
    "sections": (f"<main><section><h2>Monday</h2><p>{A}</p></section><section><h2>Tuesday</h2><p>{B}</p></section></main>", ["Monday", A, "Tuesday", B]),
    "nested divs": (f'<body><div class="outer"><div class="inner"><div><div><p>{A}</p></div><div><p>{B}</p></div></div></div></div></body>', [A, B]),
    "comment thread": (f'<body><article>{P}</article><section class="comments"><div class="comment"><p>I do not believe a word of what is written here, and I was there.</p></div><div class="comment"><p>Same, and so was my brother, who took a picture of it.</p></div></section></body>', [A, B]),
    "more comments than article": (f'<body><article><p>{A}</p></article><div id="disqus_thread">{"<p>I do not believe a word of what is written here, and I was there.</p>" * 8}</div></body>', [A]),
    "header with a menu": (f"<body><header><h2>Daily River</h2>{NAV}</header><article>{P}</article>{FOOT}</body>", [A, B]),
    "header around the page": (f'<body><div class="header"><div class="inner"><h1>River rises</h1>{P}<p>{C}</p></div></div></body>', ["River rises", A, B, C]),
    "sponsored box": (f'<article><p>{A}</p><div class="sponsored-content"><p>Ten tricks that plumbers hate, number four is a surprise.</p></div><p>{B}</p></article>', [A, B]),
    # written after the model was settled, then kept
    "amp": (f'<body class="amp-mode-mouse"><amp-sidebar id="sb"><ul><li><a href=/>Home</a></li></ul></amp-sidebar><main id="content" role="main"><h1>School</h1>{P}</main></body>', ["School", A, B]),
    "shop": (f'<body class="template-article"><div id="shop-section-header"><a href=/>Shop</a></div><div class="page-container"><div class="rte">{P}</div></div><div id="shop-section-footer"><p>Quick links</p></div></body>', [A, B]),
    "fields": (f'<body class="html not-front logged-in one-sidebar sidebar-first page-node"><div class="region region-content"><div class="node node-article"><div class="field-items"><div class="field-item even">{P}</div></div></div></div><div class="region region-sidebar-first"><h2>Menu</h2><ul><li><a href=/a>A</a></li></ul></div></body>', [A, B]),
    "spans": (f'<div id="story"><span>{A}</span> <span>{B}</span></div>', [f"{A} {B}"]),
    "definitions": (f"<main><h1>Terms</h1><dl><dt>River</dt><dd>{A}</dd><dt>Bridge</dt><dd>{C}</dd></dl></main>", ["Terms", "River", A, "Bridge", C]),
    "cells of links": (f"<html><body bgcolor=#fff><table width=600><tr><td colspan=2><img src=l.gif></td></tr><tr><td valign=top><a href=1>One</a><br><a href=2>Two</a></td><td><font face=Arial>{A}<br><br>{B}</font></td></tr></table></body></html>", [f"{A} {B}"]),
    "modal": (f'<body><div id="gdpr-modal" class="overlay"><h2>Your privacy</h2><p>We value it and use small files.</p></div><div class="l-page"><div class="l-main">{P}</div></div></body>', [A, B]),
    "search in the header": (f'<body><header class="header-search"><form action=/s><input name=q><button>Go</button></form></header><div class="story-text">{P}</div></body>', [A, B]),
    "paywall": (f'<article class="has-paywall">{P}<div class="paywall"><p>Subscribe to read on.</p></div></article>', [A, B]),
    "contents inside": (f'<div class="markdown-body"><h1>Guide</h1><ul class="toc"><li><a href=#a>Start</a></li></ul>{P}</div>', ["Guide", A, B]),
}
