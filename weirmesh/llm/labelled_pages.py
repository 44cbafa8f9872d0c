"""Pages of many shapes whose blocks are labelled by hand; the tree of html_extract is trained on them.

data-main marks the elements whose blocks are main text. {n} stands for n words of filler. The
shapes are written after common ones: news, blogs, documentation, forums, shops, old table layouts
and pages generated by web frameworks. Nothing of them is taken from a site.
"""

from __future__ import annotations

import re

_WORDS = "the river rose after rain and people on both banks moved their boats higher while others watched from bridges until evening came".split()


def filled(page: str) -> str:
    """The page with its filler written out."""
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(_WORDS[i % len(_WORDS)] for i in range(int(m[1]))), page)


NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News today</a></li><li><a href=/c>Contact us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 {8}</p><ul><li><a href=/i>Imprint</a></li><li><a href=/p>Privacy</a></li></ul></footer>"

#: shape -> page
PAGES: dict[str, str] = {
    "news": f"""<body><header><div><a href=/>The Paper</a></div><p>{{6}}</p></header>{NAV}<div class="ad">{{7}}</div><article data-main><h1>{{8}}</h1><p>{{45}}</p><p>{{60}}</p><p>{{12}}</p><p>{{70}}</p></article>{FOOT}</body>""",
    "news with links": f"""<body>{NAV}<main><article data-main><h1>{{7}}</h1><p>{{80}}</p><p><a href=/x>{{9}}</a> {{3}}</p><p>{{75}}</p><ul><li><a href=/y>{{5}}</a></li><li>{{4}} <a href=/z>{{6}}</a></li></ul><p>{{40}} <a href=/q>{{3}}</a></p></article></main><aside><h3>Most read</h3><ul><li><a href=/1>{{8}}</a></li><li><a href=/2>{{9}}</a></li></ul></aside>{FOOT}</body>""",
    "short news": f"""<body>{NAV}<article data-main><h1>{{5}}</h1><p>{{9}}</p><p>{{6}}</p></article><div class="ad">{{12}}</div><footer>&copy; {{9}}</footer></body>""",
    "very short article": f"""<body>{NAV}<div class="ad">{{9}}</div><article data-main><h1>{{9}}</h1><p>{{3}}</p></article><footer>{{14}}</footer></body>""",
    "aside in article": f"""<body><article data-main><h1>{{6}}</h1><p>{{50}}</p><aside data-not><h4>{{3}}</h4><p>{{25}}</p></aside><p>{{55}}</p><div class="share-buttons" data-not><a href=/f>Share</a><a href=/t>Tweet</a></div><p>{{30}}</p></article>{FOOT}</body>""",
    "advert in article": f"""<body>{NAV}<article data-main><p>{{60}}</p><div class="advert" data-not><p>{{20}}</p></div><p>{{60}}</p><div class="newsletter-signup" data-not><p>{{14}}</p><form><label>Email</label><button>Subscribe now</button></form></div><p>{{40}}</p></article></body>""",
    "comments": f"""<body>{NAV}<div class="post" data-main><h2>{{7}}</h2><p>{{60}}</p><p>{{45}}</p></div><div id="comments"><h3>3 Comments</h3><div class="comment"><p>{{40}}</p></div><div class="comment"><p>{{55}}</p></div><div class="comment"><p>{{30}}</p></div></div>{FOOT}</body>""",
    "comments in article": """<body><article data-main><h1>{6}</h1><p>{70}</p><p>{30}</p><section class="reader-comments" data-not><h3>{2}</h3><ol><li><p>{50}</p></li><li><p>{35}</p></li></ol></section></article></body>""",
    "blog in plain divs": f"""<body><div class="header"><h1><a href=/>{{3}}</a></h1><p>{{7}}</p></div><div class="sidebar"><h3>About</h3><p>{{30}}</p><ul><li><a href=/a>{{2}}</a></li><li><a href=/b>{{3}}</a></li></ul></div><div class="content" data-main><h2>{{6}}</h2><p>{{65}}</p><p>{{8}}</p><blockquote><p>{{20}}</p></blockquote><p>{{50}}</p></div><div class="footer">{{11}}</div></body>""",
    "old tables": """<body><table><tr><td><a href=/a>{2}</a><br><a href=/b>{2}</a><br><a href=/c>{3}</a></td><td data-main><h2>{5}</h2>{70}<br><br>{55}<p>{25}</p></td></tr><tr><td><font size=1>{9} <a href=/m>{2}</a></font></td></tr></table></body>""",
    "framework form around all": f"""<body><form id="aspnetForm" action=/><div class="menu"><a href=/>{{1}}</a> <a href=/x>{{2}}</a></div><div id="main" data-main><h1>{{6}}</h1><p>{{80}}</p><p>{{40}}</p><p>{{5}}</p></div><div class="login"><label>{{2}}</label><input name=u><button>{{1}}</button></div><div class="footer">{{8}}</div></form></body>""",
    "social policy": f"""<body>{NAV}<div class="social-policy" data-main><p>{{80}}</p></div>{FOOT}</body>""",
    "legal news": f"""<body>{NAV}<div id="legal-news" data-main><h2>{{5}}</h2><p>{{80}}</p><p>{{40}}</p></div><div class="legal"><p>{{18}}</p></div></body>""",
    "search in name": f"""<body><div class="search"><form><input><button>Search</button></form></div><div class="research-side" data-main><h1>{{4}}</h1><p>{{55}}</p><p>{{35}}</p></div><div class="side"><p>{{15}}</p><a href=/a>{{4}}</a></div></body>""",
    "with-sidebar wrapper": f"""<body class="has-sidebar"><div class="with-sidebar"><div data-main><h1>{{5}}</h1><p>{{90}}</p><p>{{60}}</p><p>{{30}}</p></div><div class="sidebar-right"><p>{{12}}</p><ul><li><a href=/1>{{5}}</a></li><li><a href=/2>{{6}}</a></li></ul></div></div>{FOOT}</body>""",
    "two short paragraphs": "<body><p data-main>{9}</p><p data-main>{7}</p></body>",
    "one paragraph": "<body><p data-main>{14}</p></body>",
    "bare text": "<body><div data-main>{12}</div></body>",
    "short page in divs": f"""<body>{NAV}<div><h1 data-main>{{4}}</h1><p data-main>{{10}}</p><p data-main>{{13}}</p></div>{FOOT}</body>""",
    "documentation": f"""<body><div class="toc"><ul><li><a href=#a>{{2}}</a></li><li><a href=#b>{{3}}</a></li><li><a href=#c>{{2}}</a></li></ul></div><div class="document" data-main><h1>{{3}}</h1><p>{{30}}</p><pre>{{12}}</pre><h2>{{2}}</h2><p>{{35}}</p><ul><li>{{7}}</li><li>{{5}}</li></ul><dl><dt>{{1}}</dt><dd>{{14}}</dd></dl><h2>{{3}}</h2><p>{{22}}</p></div><div class="related"><a href=/p>Previous</a> <a href=/n>Next</a></div></body>""",
    "data table in article": f"""<body>{NAV}<article data-main><h1>{{5}}</h1><p>{{50}}</p><table><tr><th>{{1}}</th><th>{{2}}</th></tr><tr><td>{{1}}</td><td>{{2}}</td></tr></table><p>{{45}}</p><figure><img src=a><figcaption>{{9}}</figcaption></figure><p>{{40}}</p></article>{FOOT}</body>""",
    "cookie notice": f"""<body><div class="cookie-consent" role="dialog"><p>{{45}}</p><button>Accept</button></div>{NAV}<div class="story" data-main><h1>{{6}}</h1><p>{{50}}</p><p>{{40}}</p></div><div id="popup"><p>{{20}}</p></div></body>""",
    "long notice short text": f"""<body><div id="notice"><p>{{30}}</p></div><div class="entry" data-main><p>{{35}}</p><p>{{28}}</p></div><div class="copyright">{{10}}</div></body>""",
    "teasers": f"""<body>{NAV}<div class="lead" data-main><h1>{{6}}</h1><p>{{70}}</p><p>{{50}}</p></div><div class="related-stories"><div><h4><a href=/1>{{7}}</a></h4><p>{{12}} <a href=/1>more</a></p></div><div><h4><a href=/2>{{8}}</a></h4><p>{{14}} <a href=/2>more</a></p></div></div>{FOOT}</body>""",
    "shop": f"""<body><ul class="breadcrumb"><li><a href=/>{{1}}</a></li><li>{{2}}</li></ul><main data-main><h1>{{5}}</h1><p>{{40}}</p><p>{{25}}</p></main><div class="recommendations"><h3>{{4}}</h3><a href=/1>{{5}}</a><a href=/2>{{4}}</a></div><div class="widget"><p>{{10}}</p></div></body>""",
    "forum": f"""<body><div class="navbar"><a href=/>{{2}}</a></div><div class="question" data-main><p>{{45}}</p><p>{{20}}</p></div><div class="comments"><div>{{18}}</div><div>{{25}}</div></div><div class="sponsored"><p>{{16}}</p></div></body>""",
    "links only": f"""<body>{NAV}<ul><li><a href=/1>{{8}}</a></li><li><a href=/2>{{9}}</a></li><li><a href=/3>{{7}}</a></li></ul>{FOOT}</body>""",
    "login page": """<body><form><label>{2}</label><input><label>{1}</label><input><button>{1}</button><p>{6} <a href=/r>{2}</a></p></form><footer>{9}</footer></body>""",
    "letter in sections": """<body><section data-main><h2>{3}</h2><p>{20}</p></section><section data-main><h2>{4}</h2><p>{25}</p><p>{16}</p></section><section class="newsletter"><p>{15}</p></section></body>""",
    "side by side": f"""<body><div><div class="nav-left"><ul><li><a href=/a>{{2}}</a></li><li><a href=/b>{{2}}</a></li></ul></div><div data-main><p>{{100}}</p><p>{{6}}</p><p>{{90}}</p></div></div><div>{{5}} <a href=/x>{{3}}</a></div></body>""",
    "encyclopedia": f"""<body><div id="content" data-main><h1>{{3}}</h1><p>{{20}} <a href=/a>{{2}}</a> {{15}} <a href=/b>{{3}}</a> {{12}} <a href=/c>{{2}}</a></p><h2>{{2}}</h2><p>{{8}} <a href=/d>{{4}}</a> {{6}} <a href=/e>{{3}}</a></p><ul><li><a href=/f>{{2}}</a>, {{9}}</li><li>{{6}} <a href=/g>{{2}}</a></li></ul><p>{{30}}</p></div><div id="mw-navigation"><a href=/>{{2}}</a> <a href=/r>{{2}}</a></div>{FOOT}</body>""",
    "unmarked chrome": """<body><div><a href=/>{1}</a> | <a href=/a>{2}</a> | <a href=/b>{1}</a></div><div data-main><h2>{5}</h2><p>{40}</p><p>{25} <a href=/x>{6}</a></p><p>{50}</p></div><div><a href=/p>{3}</a> <a href=/n>{3}</a></div><div><ul><li><a href=/1>{6}</a></li><li><a href=/2>{7}</a></li><li><a href=/3>{5}</a></li></ul></div></body>""",
    "read more lines": f"""<body>{NAV}<div data-main><h1>{{6}}</h1><p>{{55}}</p><p data-not><a href=/m>Read more: {{6}}</a></p><p>{{60}}</p><p data-not>See also <a href=/s>{{8}}</a></p><p>{{45}}</p></div><div>{{3}} <a href=/t>{{2}}</a> <a href=/u>{{2}}</a></div></body>""",
    "linked paragraphs": f"""<body>{NAV}<div class="text" data-main><p>{{12}} <a href=/a>{{5}}</a></p><p>{{30}} <a href=/b>{{12}}</a> {{4}}</p><p>{{9}}</p><p><a href=/c>{{2}}</a> {{40}}</p></div><div class="tags"><a href=/t>{{1}}</a> <a href=/u>{{1}}</a></div></body>""",
    "article with many links": """<body><article data-main><h2><a href=/self>{6}</a></h2><p>{10} <a href=/a>{14}</a></p><p><a href=/b>{10}</a></p><p>{50}</p></article><div><p><a href=/n>{9}</a></p></div></body>""",
    "list of answers": f"""<body>{NAV}<div data-main><h1>{{4}}</h1><ol><li>{{20}}</li><li>{{14}} <a href=/x>{{2}}</a></li><li>{{30}}</li></ol></div><ol><li><a href=/1>{{4}}</a></li><li><a href=/2>{{3}}</a></li></ol>{FOOT}</body>""",
}
