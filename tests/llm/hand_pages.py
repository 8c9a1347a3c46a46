"""Pages written by hand, in layouts of their own, with the blocks of their articles."""

PAGES = {
    "opaque divisions": (
        """<!DOCTYPE html><html><head><title>The lighthouse keeper</title><style>.c1{color:red}</style></head><body>
<div class="x1f2"><div class="k9"><a href="/">Home</a></div><div class="k9"><a href="/n">News</a></div><div class="k9"><a href="/s">Sport</a></div><div class="k9"><a href="/w">Weather</a></div></div>
<div class="q7z"><div class="m3"><h1>The lighthouse keeper who stayed</h1>
<p>For thirty-one years Agnes Moray climbed the stairs of the northern light every evening, long after the lamp had been automated and nobody expected her to.</p>
<p>She kept a diary of the ships that passed, the birds that struck the glass, and the weather, which she measured with instruments that her father had left behind.</p>
<h2>A storm in November</h2>
<p>In the winter of her twentieth year on the island a storm broke the seaward windows, and she spent the night with a blanket nailed over the gap.</p>
<p>The diaries are now in the county archive, where they can be read on request.</p></div></div>
<div class="r5t"><div class="b2"><a href="/a">Ten walks along the coast</a></div><div class="b2"><a href="/b">The last ferry</a></div><div class="b2"><a href="/c">How lamps are made</a></div></div>
<div class="z0"><p>&copy; 2021 Northern Post Ltd. <a href="/p">Privacy</a> <a href="/t">Terms</a></p></div></body></html>""",
        [
            "The lighthouse keeper who stayed",
            "For thirty-one years Agnes Moray climbed the stairs of the northern light every evening, long after the lamp had been automated and nobody expected her to.",
            "She kept a diary of the ships that passed, the birds that struck the glass, and the weather, which she measured with instruments that her father had left behind.",
            "A storm in November",
            "In the winter of her twentieth year on the island a storm broke the seaward windows, and she spent the night with a blanket nailed over the gap.",
            "The diaries are now in the county archive, where they can be read on request.",
        ],
    ),
    "table layout": (
        """<html><body><table width="100%"><tr><td colspan="2"><a href="/">Home</a> | <a href="/b">Books</a> | <a href="/m">Music</a> | <a href="/c">Contact</a></td></tr>
<tr><td width="160"><a href="/1">Archive</a><br><a href="/2">Links</a><br><a href="/3">Guestbook</a></td>
<td><h1>Repairing a harmonium</h1><p>The bellows are the first thing to look at, because leather dries out and cracks along the folds long before the reeds go out of tune.</p>
<p>Take off the back panel and press the bellows by hand. If you hear air escape, mark the spot with chalk and let the glue dry for a full day.</p>
<p>Reeds can be cleaned with a soft brush; never scrape them, or the pitch will change.</p></td></tr>
<tr><td colspan="2">Copyright 1999 by the author. All rights reserved.</td></tr></table></body></html>""",
        [
            "Repairing a harmonium",
            "The bellows are the first thing to look at, because leather dries out and cracks along the folds long before the reeds go out of tune.",
            "Take off the back panel and press the bellows by hand. If you hear air escape, mark the spot with chalk and let the glue dry for a full day.",
            "Reeds can be cleaned with a soft brush; never scrape them, or the pitch will change.",
        ],
    ),
    "opinions after the article": (
        """<body><header class="site"><a href="/">The Gardener</a><nav><a href="/plants">Plants</a><a href="/soil">Soil</a><a href="/tools">Tools</a></nav></header>
<main><article><h1>When to prune roses</h1><p>Wait until the forsythia flowers. Cutting earlier wakes the buds, and a late frost will kill them.</p>
<p>Use sharp shears and cut a finger's breadth above a bud that points outwards, so that the middle of the bush stays open.</p></article>
<div class="voices"><h3>What readers say</h3><div class="voice"><b>Marta K.</b> 3 hours ago<p>I always prune in autumn and never had any trouble with it at all.</p><a href="#">Reply</a></div>
<div class="voice"><b>old_digger</b> 5 hours ago<p>Good advice, thank you! My roses were a mess last year.</p><a href="#">Reply</a></div></div></main>
<footer>© The Gardener 2023 · <a href="/imprint">Imprint</a></footer></body>""",
        [
            "When to prune roses",
            "Wait until the forsythia flowers. Cutting earlier wakes the buds, and a late frost will kill them.",
            "Use sharp shears and cut a finger's breadth above a bud that points outwards, so that the middle of the bush stays open.",
        ],
    ),
    "telling divisions with notices inside": (
        """<html><body><div id="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
<div class="navbar"><ul><li><a href="/">Start</a></li><li><a href="/p">Politics</a></li><li><a href="/e">Economy</a></li></ul></div>
<div class="content"><div class="post-content"><h1>Bridge to reopen in spring</h1><p>The council voted on Tuesday to reopen the old iron bridge to pedestrians from the first of April.</p>
<div class="advertisement"><p>Advertisement</p><a href="/x">Buy two tyres and get one free</a></div>
<p>Engineers had closed it four years ago after finding cracks in two of the main girders, which have since been replaced.</p>
<ul><li>Cyclists will have to dismount.</li><li>Cars stay banned for good.</li></ul>
<div class="related-posts"><h4>Related articles</h4><ul><li><a href="/1">New tram line delayed again</a></li><li><a href="/2">Ferry fares rise</a></li></ul></div></div></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/3">Five new restaurants</a></li></ul></div>
<div class="footer"><p>Contact us | Privacy policy</p></div></body></html>""",
        [
            "Bridge to reopen in spring",
            "The council voted on Tuesday to reopen the old iron bridge to pedestrians from the first of April.",
            "Engineers had closed it four years ago after finding cracks in two of the main girders, which have since been replaced.",
            "Cyclists will have to dismount.",
            "Cars stay banned for good.",
        ],
    ),
    "bare page": (
        """<h1>Notes on sourdough</h1><p>Flour and water are enough, if you are patient. After three days the mixture smells of yoghurt, after five of apples.<p>Feed it every day with as much flour as you took away. <b>Never</b> close the jar tightly.
<pre>100 g flour
100 g water</pre><p>Bake it hot, with steam, for forty minutes.""",
        [
            "Notes on sourdough",
            "Flour and water are enough, if you are patient. After three days the mixture smells of yoghurt, after five of apples.",
            "Feed it every day with as much flour as you took away. Never close the jar tightly.",
            "100 g flour 100 g water",
            "Bake it hot, with steam, for forty minutes.",
        ],
    ),
    "encyclopedia": (
        """<html><body><div id="page-base"></div><nav id="menu"><ul><li><a href="/m">Main page</a><li><a href="/r">Random article</a><li><a href="/d">Donate</a></ul></nav>
<main id="content"><h1>Basalt</h1><p><b>Basalt</b> is a dark, fine-grained <a href="/v">volcanic rock</a> that forms when lava rich in magnesium and iron cools quickly near the surface.</p>
<h2>Formation</h2><p>Most of the ocean floor is basalt. It wells up along the ridges where plates move apart &ndash; a process that never stops.</p>
<table><tr><th>Mineral</th><th>Share</th></tr><tr><td>Plagioclase</td><td>50 %</td></tr></table>
<p>Columns form as the rock shrinks: the formula is <math><mi>d</mi><mo>=</mo><mn>2</mn></math> for thin flows.</p></main>
<footer id="footer"><p>This page was last edited on 3 May 2022.</p><ul><li><a href="/privacy">Privacy policy</a><li><a href="/about">About</a></ul></footer></body></html>""",
        [
            "Basalt",
            "Basalt is a dark, fine-grained volcanic rock that forms when lava rich in magnesium and iron cools quickly near the surface.",
            "Formation",
            "Most of the ocean floor is basalt. It wells up along the ridges where plates move apart – a process that never stops.",
            "Mineral", "Share", "Plagioclase", "50 %",
            "Columns form as the rock shrinks: the formula is d=2 for thin flows.",
        ],
    ),
    "form and notice around": (
        """<!doctype html><body><div role="banner"><a class="logo" href="/">Trail Days</a><form class="search"><input name="q"><button>Search</button></form></div>
<noscript>Please enable JavaScript to use this site.</noscript>
<section class="entry"><h1>Two days on the ridge</h1><p class="lead">We started before dawn, with frost on the tents and the valley still under cloud.</p>
<p>By noon the path had turned to scree, and every step forward slid half a step back. Nobody spoke much.</p>
<blockquote>The mountain does not care, said Jonas, and it was the only thing he said all day.</blockquote>
<p>On the second evening we saw the lake.</p></section>
<div class="newsletter"><h3>Subscribe to our newsletter</h3><p>Get one mail a week.</p><input type="email"><button>Sign up</button></div>
<script src=https://stats.example/></script><footer><small>© Trail Days</small></footer></body>""",
        [
            "Two days on the ridge",
            "We started before dawn, with frost on the tents and the valley still under cloud.",
            "By noon the path had turned to scree, and every step forward slid half a step back. Nobody spoke much.",
            "The mountain does not care, said Jonas, and it was the only thing he said all day.",
            "On the second evening we saw the lake.",
        ],
    ),
    "opaque with opinions": (
        """<html><body><div class="css-1a"><span class="css-2b"><a href="/">Log in</a></span><span class="css-2b"><a href="/j">Join</a></span></div>
<div class="css-7k"><div class="css-8p"><div class="css-h"><h1>Why the library bought a kiln</h1></div>
<div class="css-t">It began with a broken vase. Someone had left it on the returns shelf, and the librarian, who had trained as a potter, could not bring herself to throw it away.</div>
<div class="css-t">Within a month there was a repair table, within a year a waiting list, and last week the kiln arrived on a lorry that could barely turn into the lane.</div>
<div class="css-t">Borrowers may fire one piece a month, as long as it fits on a standard shelf.</div></div></div>
<div class="css-9z"><div class="css-c"><div>ben_77</div><div>2 hours ago</div><div>Love this so much!</div><div><a href="#">Reply</a></div></div><div class="css-c"><div>Ilse</div><div>4 hours ago</div><div>Who pays for the electricity?</div><div><a href="#">Reply</a></div></div></div>
<div class="css-0f"><a href="/a">About</a> <a href="/h">Help</a> <span>© 2024</span></div></body></html>""",
        [
            "Why the library bought a kiln",
            "It began with a broken vase. Someone had left it on the returns shelf, and the librarian, who had trained as a potter, could not bring herself to throw it away.",
            "Within a month there was a repair table, within a year a waiting list, and last week the kiln arrived on a lorry that could barely turn into the lane.",
            "Borrowers may fire one piece a month, as long as it fits on a standard shelf.",
        ],
    ),
}
