"""Pages written and labelled by hand, of layouts that sites have: lines of (html, whether its text is main text)."""

Y, N = True, False

PAGES = {
    "news": [
        ("<body><header class=site-header><a href=/>The Daily Note</a></header>", N), ("<nav><a href=/w>World</a> <a href=/s>Sports</a></nav>", N),
        ("<main><article><h1>Harbour reopens after the storm</h1>", Y), ("<p>The harbour of the old town opened again on Monday, three weeks after the storm.</p>", Y),
        ("<aside class='related-links'><h3>More on this</h3><ul><li><a href=/1>Storm damage in pictures</a></li></ul></aside>", N),
        ("<p>Ships had waited in the bay. “We are glad,” said the <a href=/h>harbour master</a>.</p></article></main>", Y),
        ("<footer><p>© 2024 The Daily Note. All rights reserved.</p></footer>", N),
    ],
    "blog": [
        ("<body><div id=page><div class=masthead><h1>Notes on bread</h1><p>One baker's diary</p></div>", N), ("<div class='post-content'><h2>Rye, again</h2>", Y),
        ("<p>Rye dough sticks to everything, and that is the first thing to accept.</p>", Y), ("<ul><li>500 g of rye flour</li><li>400 g of warm water</li></ul>", Y),
        ("<p>Mix, wait, and do not knead.</p></div>", Y), ("<div class='share-buttons'><a href=#>Tweet</a> <a href=#>Share</a></div>", N),
        ("<div id=comments><h3>2 comments</h3><div class=comment><p>I tried this and it worked very well for me, thank you!</p></div></div></div>", N),
    ],
    "documentation": [
        ("<body><div class=sidebar><ul><li><a href=a>Install</a><li><a href=b>Configure</a></ul></div>", N), ("<div role=main><h1>Configure</h1>", Y),
        ("<p>All settings are read from one file when the program starts.</p>", Y), ("<pre>port = 80\nhost = local</pre>", Y), ("<p>Restart it after a change.</p></div>", Y),
        ("<div class=pagination><a href=a>Previous</a><a href=c>Next</a></div>", N), ("<div class=footer>Built with care.</div>", N),
    ],
    "cookies": [
        ("<body><div class='cookie-banner' role=dialog><p>We use cookies to make this site work. By going on you accept them.</p><button>Accept</button></div>", N),
        ("<article><h1>Why wells run dry</h1>", Y), ("<p>Ground water sinks when more is pumped than rain brings back.</p>", Y), ("<p>It may take decades to return.</p></article>", Y),
        ("<div class='newsletter-signup'><form><label>Your address</label><input><button>Subscribe</button></form></div>", N),
    ],
    "adverts": [
        ("<body><div class='ad-slot'><p>Buy two shirts and get one more for free.</p></div>", N), ("<div class=story><h1>A walk along the wall</h1>", Y), ("<p>The wall runs for nine miles over the hills.</p>", Y),
        ("<div class=advertisement>Sponsored: shoes that last.</div>", N), ("<p>At its end stands a small chapel, always open.</p>", Y), ("<div class='sponsored promo'><p>Try our partner's tea today.</p></div>", N), ("<p>From there a bus goes back.</p></div>", Y),
    ],
    "table layout": [
        ("<body><table><tr><td class=menu><a href=1>Home</a><br><a href=2>Links</a></td>", N), ("<td id=content><h2>The village band</h2>", Y), ("<p>It was founded in 1921 by six men and a drum.</p>", Y), ("<p>Today it has forty members and plays every Sunday.</p></td></tr></table>", Y), ("<div id=footer>Last changed in May.</div>", N),
    ],
    "shop": [
        ("<body><header><form class=search><input><button>Search</button></form></header>", N), ("<main><h1>Copper kettle</h1>", Y), ("<p>A kettle of copper, tinned inside, for two litres of water.</p>", Y), ("<table><tr><td>Weight</td><td>1.2 kg</td></tr></table></main>", Y),
        ("<section class='recommended'><h2>You may also like</h2><p><a href=p>Iron pan</a></p></section>", N), ("<section class=reviews-comments><p>I have had it for years and it is still as new.</p></section>", N),
    ],
    "forum": [
        ("<body><nav class=breadcrumbs><a href=/>Forum</a> › <a href=/g>Garden</a></nav>", N), ("<article class=post><h1>How deep do tulips go?</h1>", Y), ("<p>The packet says ten centimetres, my neighbour says twenty. Who is right?</p></article>", Y),
        ("<div class=replies><div class=reply><p>Your neighbour. Deep bulbs flower for many more years.</p></div></div>", N), ("<div class=login>Log in to answer.</div>", N),
    ],
    "german": [
        ("<body><div class=navigation><ul><li><a href=1>Start</a><li><a href=2>Über uns</a></ul></div>", N), ("<div class='entry-content'><h1>Die Brücke am Fluss</h1>", Y), ("<p>Seit hundert Jahren führt die Brücke über den Fluss. Nun wird sie erneuert.</p>", Y), ("<blockquote>Wir brauchen sie jeden Tag, sagt die Lehrerin.</blockquote></div>", Y), ("<div class='legal imprint'>Impressum und Datenschutz</div>", N),
    ],
    "nested": [
        ("<body><div class=wrapper><div class=container><div class=row><div class='sidebar widget'><h4>Tags</h4><a href=t>rain</a></div>", N), ("<div class=column><div class='article-body'><h1>Rain in numbers</h1>", Y), ("<div>Last year it rained on 171 days, nine more than usual.</div>", Y), ("<div><b>July</b> was the wettest month, with 140 mm.</div></div></div></div></div></div>", Y), ("<footer><ul><li><a href=/c>Contact</a></li></ul></footer>", N),
    ],
    "figures": [
        ("<body><main id=main-content><h1>Kites</h1>", Y), ("<p>A kite needs wind, a line and patience.</p>", Y), ("<figure><img src=k.jpg><figcaption>A kite over the beach.</figcaption></figure>", Y), ("<h2>Lines</h2>", Y), ("<p>Cotton is kind to hands; nylon is lighter.</p></main>", Y), ("<div class=social-follow><a href=#>Follow us</a></div>", N),
    ],
    "paywall": [
        ("<body><nav><ul><li><a href=1>News</a></li></ul></nav>", N), ("<article><h1>Trains at night</h1>", Y), ("<p>Night trains are back on seven lines this winter.</p>", Y), ("<div class='paywall subscribe-box'><p>Read on with a subscription for one coin a week.</p></div></article>", N), ("<footer>© Rail Weekly</footer>", N),
    ],
    "alerts": [
        ("<body><div role=alert class=notice>This page is kept for the record and no longer changed.</div>", N), ("<section class=content><h1>Opening hours</h1>", Y), ("<dl><dt>Monday</dt><dd>Closed all day</dd><dt>Tuesday</dt><dd>From nine to five</dd></dl>", Y), ("<p>On holidays we open at ten.</p></section>", Y),
    ],
    "recipe": [
        ("<body><header><a href=/>Kitchen</a></header>", N), ("<article class=recipe><h1>Leek soup</h1>", Y), ("<ol><li>Cut the leeks into rings.</li><li>Fry them gently in butter.</li><li>Add stock and boil for twenty minutes.</li></ol>", Y), ("<p>Serve with bread.</p></article>", Y), ("<aside><h3>Popular recipes</h3><ul><li><a href=2>Bean stew</a></li></ul></aside>", N),
    ],
    "plain": [("<h1>Minutes of the meeting</h1>", Y), ("<p>Present were eleven members and one guest.</p>", Y), ("<p>The accounts were read and agreed to.</p>", Y)],
    "unclosed": [
        ("<body><nav><ul><li><a href=1>One<li><a href=2>Two</ul></nav>", N), ("<article><h1>Salt</h1>", Y), ("<p>Salt was once worth as much as silver in these hills.", Y), ("<p>The mine closed in 1954.", Y), ("</article><footer>© Museum of salt", N),
    ],
    "scripts": [
        ("<head><title>Owls</title><style>p{}</style><script>var p='<p>no</p>'</script></head><body>", N), ("<article><p>Owls fly without a sound, thanks to the soft edges of their feathers.</p>", Y), ("<script>show('<p>ad</p>')</script><noscript><p>Switch scripts on.</p></noscript>", N), ("<p>They hear a mouse under snow.</p></article>", Y),
    ],
    "author box": [
        ("<body><main><article><h1>Paper boats</h1>", Y), ("<p>Fold a sheet in half, then fold both corners to the middle line.</p></article>", Y), ("<div class='author-bio'><p>Kim writes about toys and lives by a lake.</p></div></main>", N), ("<div class=sharing><a href=#>Send</a></div>", N),
    ],
    "spanish": [
        ("<body><div id=header><h1>El faro</h1></div>", N), ("<div id=content><h2>La feria vuelve al puerto</h2>", Y), ("<p>La feria abre el viernes con cuarenta puestos y dos orquestas.</p>", Y), ("<p>La entrada es libre.</p></div>", Y), ("<div id=sidebar><h3>Lo más leído</h3><p><a href=1>El mercado de noche</a></p></div>", N), ("<div id=footer>Aviso legal</div>", N),
    ],
    "inline": [
        ("<body><div class=topbar-menu><a href=1>Map</a></div>", N), ("<article><h1>Stairs &amp; lifts</h1>", Y), ("<p>The tower has <em>four hundred</em> steps,<br>and <a href=l>one lift</a>.</p>", Y), ("<p>Both open at 9&nbsp;am.</p></article>", Y), ("<section class='discussion'><h2>What readers say</h2><p>The view from the top is worth every single step.</p></section>", N),
    ],
    "gallery": [
        ("<body><nav class=tabs><a href=1>Photos</a><a href=2>Films</a></nav>", N), ("<section class='article-text'><h1>A year of fog</h1>", Y), ("<p>We took one picture every morning, all from the same window.</p>", Y), ("<p>On ninety days there was nothing to see but grey.</p></section>", Y), ("<div class='modal popup'><p>Get our best pictures every month by mail!</p></div>", N),
    ],
}
