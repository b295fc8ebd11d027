"""Hand-labelled page layouts to train the tree model on: ``data-main`` marks the elements of the article and what holds them."""

PAGES = (
    """<html data-main><body data-main><header class="site-header"><a href="/">Site name</a><nav class="menu"><ul><li><a href="/a">News</a></li>
<li><a href="/b">Sport</a></li><li><a href="/c">Culture</a></li></ul></nav></header><article data-main class="post"><h1 data-main>A long walk along the river</h1>
<p data-main>The river was low that summer. We could walk on the stones for a whole day, and nobody came by until the evening light was gone.</p>
<p data-main>Short one.</p><div class="ad">Buy new boots now!</div><p data-main>After the bridge the path turns away from the water and climbs to the village, where the
road begins. There we took the bus back to town and slept until noon of the next day.</p><h2 data-main>The way back</h2><ul data-main><li data-main>Take water.</li>
<li data-main>Take a map of the valley.</li></ul></article><aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Ten walks</a></li><li><a href="/y">Five hills</a></li></ul>
</aside><section class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>Great walk, I did it in May with my brother and we liked it.</p></div><div class="comment">
<p>Me too.</p></div><form class="comment-form"><textarea></textarea><button>Send</button></form></section><footer>Copyright by us. All rights reserved.</footer></body></html>""",
    """<html data-main><head><title>x</title></head><body data-main><div id="cookie-notice" class="notice banner">We use cookies. <a href="/p">Learn more</a><button>OK</button></div>
<div class="nav"><a href="/1">Home</a> <a href="/2">About</a> <a href="/3">Contact</a></div><div id="content" class="main content" data-main><h1 data-main>How bread rises</h1>
<div class="meta"><span>By A. Baker</span> <a href="/t">tag</a></div><div class="text body" data-main><p data-main>Yeast eats sugar and gives off gas, which the dough holds.</p>
<p data-main>Warm rooms help. In winter a dough may need four hours, and in summer it may need less than one; the hand that presses it knows best what to do.</p>
<blockquote data-main><p data-main>Patience is the best flour, said an old miller.</p></blockquote><pre data-main>500 g flour, 300 g water</pre></div>
<div class="share social"><a href="/s1">Share</a><a href="/s2">Send</a></div></div><div class="newsletter"><form><p>Sign up for our letter.</p><input></form></div>
<div id="footer" class="footer"><p>Imprint and terms. <a href="/i">Imprint</a></p></div></body></html>""",
    """<html data-main><body data-main><nav><ul><li><a href="/q">One</a></li><li><a href="/w">Two</a></li></ul></nav><div class="ad">An offer that you like.</div>
<article data-main><h1 data-main>Letters from the north</h1><p data-main><b>The first letter came late.</b><br></p><p data-main>It said little. It was written by hand, on thin paper, and
smelled of smoke and of the sea that we had left behind so many years ago.</p><p data-main>Then.</p><p data-main>More letters came, and each was shorter than the one before it.</p>
<table data-main><tr data-main><td data-main>March</td><td data-main>two letters</td></tr></table></article><footer>&copy; somebody. Some words at the end of a page.</footer></body></html>""",
    """<html data-main><body data-main><div class="header top"><p>The daily paper</p></div><div class="menu navigation" role="navigation"><ul><li><a href="/e">World</a></li></ul></div>
<main data-main><section data-main class="story"><h1 data-main>Rain</h1><p data-main>It rained for nine days. On the tenth the sun came out over the fields, and people opened their doors.</p>
<div class="promo advert sponsored"><p>Sponsored: cheap umbrellas for everyone in town, today only and while they last.</p></div>
<p data-main>Nobody had seen the like since the year of the flood.</p><figure data-main><figcaption data-main>The square on the tenth day</figcaption></figure></section></main>
<div class="sidebar widget"><p>Most read this week: nine days of rain.</p><a href="/m">More</a></div><div class="related"><a href="/r1">Snow</a><a href="/r2">Wind</a></div>
<div id="disqus_thread" class="replies comments"><p>I remember that flood well, we lost two cows and a barn.</p></div><form class="search" action="/s"><label>Search</label><input></form>
<div class="popup modal subscribe"><p>Subscribe now and read on.</p></div><footer class="footer"><div><p>Made in the hills.</p></div></footer></body></html>""",
    """<html data-main><body data-main><nav><ul><li><a href="/k">Start</a></li><li><a href="/l">Map</a></li></ul></nav><article data-main class="entry"><h1 data-main>What to pack</h1>
<p data-main>For the huts you need little.</p><ul data-main><li data-main>A warm coat</li><li data-main>Two pairs of socks</li><li data-main>A knife</li><li data-main>Bread and
<a href="/cheese">cheese</a></li></ul><p data-main>For the peaks you need more, and in the right order:</p><ol data-main><li data-main>Rope</li><li data-main>Axe</li><li data-main>Stove</li></ol>
<dl data-main><dt data-main>Rope</dt><dd data-main>Forty metres, dry</dd></dl></article><div class="ad">Ropes at half price.</div><footer>Words of the house.</footer></body></html>""",
)
