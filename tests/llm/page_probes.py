"""Pages written by hand, not by the generator that the field is trained on: (kind, html, main text)."""

LEAD = "The river rose two metres overnight, and the old mill at the bend of the valley stood in water up to its windows."
MORE = "Nobody in the village had seen anything like it. The ferryman, who has kept a diary since 1961, found no such flood in its pages."
LAST = "By noon the bridge was open again, though only to people on foot."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer><p>© 2021 Valley News. All rights reserved.</p></footer>"
BODY = f"{LEAD} {MORE} {LAST}"

PROBES = [
    ("bare body", f"<html><body><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></body></html>", f"High water {LEAD} {MORE}"),
    (
        "article between menus",
        f"<html><head><title>High water | Valley News</title></head><body>{NAV}<article><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p><p>{LAST}</p></article>{FOOT}</body></html>",
        f"High water {BODY}",
    ),
    ("short page", f"<html><head><title>Notes</title></head><body>{NAV}<main><p>Short one.</p></main>{FOOT}</body></html>", "Short one."),
    ("short article", f"<html><body>{NAV}<article><h1>Closed today</h1><p>The library is closed.</p></article>{FOOT}</body></html>", "Closed today The library is closed."),
    (
        "divs only",
        f'<html><body><div><div><a href="/">Home</a></div><div><a href="/n">News</a></div><div><a href="/c">Contact</a></div></div><div><div>High water</div><div>{LEAD}</div><div>{MORE}</div></div>'
        "<div>© 2021 Valley News</div></body></html>",
        f"High water {LEAD} {MORE}",
    ),
    (
        "divs with names that tell nothing",
        f'<html><body><div class="x1"><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></div><div class="x2"><h1>High water</h1><div class="x3">{LEAD}</div><div class="x3">{MORE}</div>'
        f'<div class="x3">{LAST}</div></div><div class="x4">Copyright 2021 Valley News. All rights reserved.</div></body></html>',
        f"High water {BODY}",
    ),
    (
        "title in a header of the article",
        f"<html><body>{NAV}<article><header><h1>High water</h1></header><p>{LEAD}</p><p>{MORE}</p></article>{FOOT}</body></html>",
        f"High water {LEAD} {MORE}",
    ),
    (
        "hidden parts",
        f'<html><body><article><h1>High water</h1><p>{LEAD}</p><div style="display:none">Open this page in the app to read on.</div><p>{MORE}</p><p hidden>Draft of the last paragraph.</p></article></body></html>',
        f"High water {LEAD} {MORE}",
    ),
    ("hidden words", f'<html><body><article><p>{LEAD} <span style="display: none">seo words here</span></p><p>{MORE}</p></article></body></html>', f"{LEAD} {MORE}"),
    (
        "comments in an element of an odd name",
        f'<html><body>{NAV}<article><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p><p>{LAST}</p></article><div class="user-opinions"><h3>What readers say</h3>'
        '<div class="opinion"><b>Ann</b><p>My cellar is still full of mud.</p><a href="#">Reply</a></div><div class="opinion"><b>Hugo K.</b><p>Thank you for the photographs.</p><a href="#">Reply</a></div>'
        '<div class="opinion"><b>Lena</b><p>Is the mill insured at all?</p><a href="#">Reply</a></div></div></body></html>',
        f"High water {BODY}",
    ),
    (
        "comments without names",
        f"<html><body><div><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p><p>{LAST}</p></div><div><div>3 comments</div><div><span>Ann</span> <span>2 hours ago</span><p>So sad.</p></div>"
        "<div><span>Marc</span> <span>1 hour ago</span><p>We could help to clean up.</p></div><div><span>Zoe</span> <span>yesterday</span><p>Me too!</p></div></div></body></html>",
        f"High water {BODY}",
    ),
    (
        "list of comments",
        f'<html><body><main><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></main><section id="comments"><h2>Responses</h2><ol><li><b>Femi</b><p>I walked there yesterday and it is worse than it looks in the pictures.</p></li>'
        "<li><b>Pia</b><p>Good article.</p></li></ol></section></body></html>",
        f"High water {LEAD} {MORE}",
    ),
    (
        "figure and caption",
        f'<html><body>{NAV}<article><h1>High water</h1><p>{LEAD}</p><figure><img src="m.jpg"><figcaption>The mill on Monday morning.</figcaption></figure><p>{MORE}</p></article>{FOOT}</body></html>',
        f"High water {LEAD} The mill on Monday morning. {MORE}",
    ),
    (
        "table and preformatted text",
        f"<html><body><article><h1>Levels</h1><p>{LEAD}</p><table><tr><th>Day</th><th>Metres</th></tr><tr><td>Monday</td><td>4.1</td></tr></table><pre>gauge  4.1 m\nflow   80</pre></article></body></html>",
        f"Levels {LEAD} Day Metres Monday 4.1 gauge 4.1 m flow 80",
    ),
    (
        "lists, quotes and headings",
        f"<html><body>{NAV}<article><h1>High water</h1><p>{LEAD}</p><h2>What was lost</h2><ul><li>Forty sacks of flour</li><li>The wheel of the mill, which dates from 1790</li></ul><blockquote>{MORE}</blockquote></article>{FOOT}</body></html>",
        f"High water {LEAD} What was lost Forty sacks of flour The wheel of the mill, which dates from 1790 {MORE}",
    ),
    (
        "blog",
        f'<html><head><title>High water</title></head><body class="home page"><div id="masthead"><a href="/">Valley News</a></div><div id="content"><div class="post"><h2 class="entry-title">High water</h2><div class="entry-content"><p>{LEAD}</p><p>{MORE}</p></div></div></div>'
        '<div id="sidebar"><h3>Recent posts</h3><ul><li><a href="/a">The new school</a></li><li><a href="/b">Market day</a></li></ul><h3>Archive</h3><ul><li><a href="/c">May 2021</a></li></ul></div><div id="footer">Powered by a press</div></body></html>',
        f"High water {LEAD} {MORE}",
    ),
    (
        "notices and adverts",
        f'<html><body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept all</button></div>{NAV}<main><h1>High water</h1><p>{LEAD}</p><div class="ad">Advertisement</div><p>{MORE}</p>'
        f'<form class="newsletter"><label>Your email</label><input><button>Subscribe</button></form><p>{LAST}</p></main><aside><h3>Related</h3><p><a href="/x">The mill in old pictures</a></p></aside>{FOOT}</body></html>',
        f"High water {BODY}",
    ),
    (
        "attributes with stray quotes and look-alikes",
        f'<html><body>{NAV}<article data-id="footer ad" data-class=\'nav\'><h1 class="t"">High water</h1><p class="a" ">{LEAD}</p><p title="a > b">{MORE}</p></article>{FOOT}</body></html>',
        f"High water {LEAD} {MORE}",
    ),
    ("drawing", f"<html><body><article><svg><title>logo</title><text>Valley</text></svg><h1>High water</h1><p>{LEAD}</p></article></body></html>", f"High water {LEAD}"),
    ("nothing but a menu", f"<html><body>{NAV}</body></html>", ""),
]

STEPS = ["Wash the leaves.", "Add salt.", "Stir.", "Serve."]

#: Written after the features were fixed: what an earlier version got wrong, and pages of other kinds.
LATER = [
    ("text alone", "hello", "hello"),
    ("text in body alone", "<html><body>hi there</body></html>", "hi there"),
    ("text in a span alone", "<span>Closed on Monday.</span>", "Closed on Monday."),
    ("text before a block", f"{LEAD} <p>{MORE}</p>", f"{LEAD} {MORE}"),
    ("line breaks alone", f"<html><body>{LEAD}<br><br>{MORE}<br><br>{LAST}</body></html>", BODY),
    ("line breaks below a title", f"<html><head><title>x</title></head><body><b>High water</b><br><br>{LEAD}<br><br>{MORE}</body></html>", f"High water {LEAD} {MORE}"),
    (
        "line breaks between links and a notice",
        f'<html><body><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a><br><br>{LEAD}<br><br>{MORE}<br><br>© 2021 Valley News</body></html>',
        f"{LEAD} {MORE}",
    ),
    (
        "short steps",
        f"<html><body>{NAV}<article><h1>Nettle soup</h1><p>{LEAD}</p><ol>{''.join(f'<li>{x}</li>' for x in STEPS)}</ol><p>{LAST}</p></article>{FOOT}</body></html>",
        f"Nettle soup {LEAD} {' '.join(STEPS)} {LAST}",
    ),
    (
        "comments from the mayor",
        f"<html><body>{NAV}<article><h1>High water</h1><p>{LEAD}</p><h3>Comments from the mayor</h3><p>{MORE}</p><p>{LAST}</p></article>{FOOT}</body></html>",
        f"High water {LEAD} Comments from the mayor {MORE} {LAST}",
    ),
    (
        "a section on privacy",
        f"<html><body>{NAV}<main><h1>Cameras in the valley</h1><p>{LEAD}</p><h2>What about privacy?</h2><p>{MORE}</p></main>{FOOT}</body></html>",
        f"Cameras in the valley {LEAD} What about privacy? {MORE}",
    ),
    (
        "tables for layout",
        '<html><body><table width="100%"><tr><td colspan="2"><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About</a></td></tr><tr><td><a href="/1">Mills</a><br><a href="/2">Bridges</a></td>'
        f"<td><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></td></tr><tr><td colspan='2'>Copyright 2021 Valley News</td></tr></table></body></html>",
        f"High water {LEAD} {MORE}",
    ),
    ("no scripts", f"<html><body><noscript>Please turn on scripts.</noscript><article><h1>High water</h1><p>{LEAD}</p></article></body></html>", f"High water {LEAD}"),
    (
        "an interview",
        f"<html><body>{NAV}<article><h1>The ferryman</h1><p><b>Were you afraid?</b></p><p>No.</p><p><b>And now?</b></p><p>{MORE}</p></article>{FOOT}</body></html>",
        f"The ferryman Were you afraid? No. And now? {MORE}",
    ),
    (
        "a news list beside",
        f'<html><body>{NAV}<div class="content"><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></div><div class="sidebar"><h3>Most popular</h3><p>The new school opens its doors to all children of the valley.</p></div>{FOOT}</body></html>',
        f"High water {LEAD} {MORE}",
    ),
    (
        "comments in a section of their own",
        f'<html><body><article><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></article><section class="discussion"><h2>12 comments</h2><div><strong>Omar</strong><time>3 May 2021</time><p>{LAST}</p></div>'
        "<div><strong>Sven</strong><time>4 May 2021</time><p>Glad that everybody is safe. The fire brigade did great work.</p></div></section></body></html>",
        f"High water {LEAD} {MORE}",
    ),
    (
        "a definition list",
        f"<html><body>{NAV}<main><h1>Words of the river</h1><p>{LEAD}</p><dl><dt>Weir</dt><dd>A low wall across the river that holds the water back.</dd><dt>Race</dt><dd>The channel that leads to the wheel.</dd></dl></main>{FOOT}</body></html>",
        f"Words of the river {LEAD} Weir A low wall across the river that holds the water back. Race The channel that leads to the wheel.",
    ),
    (
        "breadcrumbs and sharing",
        f'<html><body><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a> &gt; High water</div><article><h1>High water</h1><div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{LEAD}</p><p>{MORE}</p></article>{FOOT}</body></html>',
        f"High water {LEAD} {MORE}",
    ),
    (
        "a line of poetry at a time",
        "<html><body><div class='poem'><h2>The weir</h2><p>The water comes,<br>the water goes,<br>and what it takes<br>nobody knows.</p></div></body></html>",
        "The weir The water comes, the water goes, and what it takes nobody knows.",
    ),
]
