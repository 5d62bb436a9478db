"""Pages written by hand, none of the make that the field is trained on, with their main texts."""

PAGES = [
("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Bridge reopens - The Valley Post</title><link rel=stylesheet href=a.css></head><body class=page>
<header id=top><a href=/>The Valley Post</a><nav><a href=/news>News</a> <a href=/sport>Sport</a> <a href=/opinion>Opinion</a></nav></header>
<main><article><h1>Bridge reopens after two years of repairs</h1>
<p>The old stone bridge over the river opened to traffic on Monday, two years after a flood damaged its central pier.</p>
<p>Engineers replaced more than four hundred stones and laid a new roadway. &ldquo;It should last another century,&rdquo; said the county surveyor.</p>
<h2>What changes for drivers</h2><ul><li>Lorries above ten tonnes stay on the bypass.</li><li>The speed limit is thirty.</li></ul>
<p>The work cost 3.2&nbsp;million.</p></article>
<aside class=related><h3>Read next</h3><ul><li><a href=/1>Flood maps redrawn</a></li><li><a href=/2>Council votes on budget</a></li></ul></aside></main>
<footer><p>&copy; 2024 The Valley Post. All rights reserved.</p><a href=/privacy>Privacy</a></footer></body></html>""",
"Bridge reopens after two years of repairs\nThe old stone bridge over the river opened to traffic on Monday, two years after a flood damaged its central pier.\nEngineers replaced more than four hundred stones and laid a new roadway. “It should last another century,” said the county surveyor.\nWhat changes for drivers\nLorries above ten tonnes stay on the bypass.\nThe speed limit is thirty.\nThe work cost 3.2 million."),
("""<HTML><BODY><TABLE width=100%><TR><TD><A HREF=index.html>Home</A> | <A HREF=links.html>Links</A></TD></TR><TR><TD><DIV CLASS=content><H1>Growing tomatoes</H1><P>Tomatoes need sun, warmth and steady water. Sow the seeds indoors in early spring and keep the pots on a bright sill.<P>When the plants are a hand high, move them outside. Tie them to a stake.<BLOCKQUOTE>Water the soil and not the leaves, my grandmother used to say.</BLOCKQUOTE><P>Pick them ripe.</DIV></TD></TR></TABLE><DIV CLASS=footer>Last changed in May. Mail the webmaster.</DIV></BODY></HTML>""",
"Growing tomatoes\nTomatoes need sun, warmth and steady water. Sow the seeds indoors in early spring and keep the pots on a bright sill.\nWhen the plants are a hand high, move them outside. Tie them to a stake.\nWater the soil and not the leaves, my grandmother used to say.\nPick them ripe."),
("""<html><body><div id="cookie-consent"><p>We use cookies to make this site work. <button>Accept all</button></p></div><div class="navbar"><ul><li><a href="/">Start</a></li><li><a href="/blog">Blog</a></li></ul></div>
<div class="entry-content"><h1>Why I stopped using tabs</h1><p>For years I kept forty tabs open. Then my laptop died, and I found that I missed none of them.</p><div class="ad"><p>Sponsored: buy a better laptop today!</p></div><pre>close all
open one</pre><p>Now I write <a href="/lists">short lists</a> instead, and they do the job.</p></div>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>Great post, I do the same thing at work every day.</p></div><div class="comment"><p>I could never live without my tabs, sorry.</p></div><form><label>Your comment</label><textarea></textarea><button>Send</button></form></section><script>track("<p>hello</p>")</script></body></html>""",
"Why I stopped using tabs\nFor years I kept forty tabs open. Then my laptop died, and I found that I missed none of them.\nclose all open one\nNow I write short lists instead, and they do the job."),
("""<body><article class="post"><h1>Rezept: Linsensuppe</h1><p>Zwiebeln w&uuml;rfeln, in &Ouml;l and&uuml;nsten und mit Br&uuml;he abl&ouml;schen.</p><p>Linsen dazugeben und drei&szlig;ig Minuten kochen lassen.</p></article><div class="share"><a href=#>Teilen</a> <a href=#>Drucken</a></div><div class="newsletter-signup"><p>Jetzt den Newsletter abonnieren und kein Rezept verpassen.</p></div><footer>Impressum &middot; Datenschutz</footer></body>""",
"Rezept: Linsensuppe\nZwiebeln würfeln, in Öl andünsten und mit Brühe ablöschen.\nLinsen dazugeben und dreißig Minuten kochen lassen."),
("""<p>a &<b>lt;</b>c is no entity, and the sentence goes on for a while so that it reads as text.</p><p>Second paragraph of the fragment, with 1 &lt; 2 &amp;amp; more.</p>""",
"a &lt;c is no entity, and the sentence goes on for a while so that it reads as text.\nSecond paragraph of the fragment, with 1 < 2 &amp; more."),
]
