"""Labelled pages for the block classifier: a block of text that begins with + is content, with - it is not.

The pages are invented. They show the usual shapes: elements that name their purpose, classes that do, a mixture, and
plain divisions that say nothing, where only text and neighbours tell.
"""

LONG = ("The committee met twice in spring and agreed that the bridge would be repaired before the winter, "
        "although the cost had risen by a third since the first plan was drawn up.")
MIDDLE = "Nobody in the village had expected the river to rise so quickly that night."
SHORT = "Lamps at half price, today only."
LEGAL = ("No part of this site may be copied without the written consent of its owner, and all marks named here "
         "belong to those who hold them in their own countries.")

PAGES = (
    # Elements name their purpose.
    f"<header><a href=/>-Home</a> <a href=/a>About</a></header><nav><ul><li><a href=1>-News</a><li><a href=2>-Sport</a>"
    f"<li><a href=3>-Weather</a></ul></nav><article><h1>+Bridge to be repaired</h1><p>+{LONG}</p><p>+Yes.</p><p>+{MIDDLE}"
    f"</p><ul><li>+one arch<li>+two piers</ul></article><aside><p>-{SHORT}</p></aside><footer><p>-{LEGAL}</p></footer>",
    f"<nav><a href=1>-Start</a></nav><main><h1>+A river in spring</h1><p>+{MIDDLE}</p><blockquote><p>+{LONG}</p></blockquote>"
    f"<h2>+What came after</h2><p>+Little.</p><table><tr><td>+1901<td>+12 m<tr><td>+1902<td>+9 m</table></main>"
    f"<form><p>-Write to us</p><button>-Send</button></form><footer>-&copy; the owners</footer>",
    f"<main><article><header><h1>+How ferries are built</h1><p>+By a shipwright</p></header><p>+{LONG}</p><nav><a href=x>-Part two"
    f"</a></nav><p>+{MIDDLE}</p><aside>-Read this as well: {MIDDLE}</aside><p>+The end.</p><footer>-Filed under boats</footer>"
    f"</article></main><dialog>-We use small files to remember you.</dialog>",
    f"<body><div class=ad>-{MIDDLE}</div><article><h1>+Ten days of rain</h1><p>+{LONG}</p><p>+It rained.</p><p>+{LONG}</p>"
    f"</article><section class=comments><h3>-Two readers wrote</h3><p>-{LONG}</p><p>-{SHORT}</p></section>",
    # Remarks, adverts and links inside the article.
    f"<article><h1>+The old mill</h1><p>+{LONG}</p><div class=advert>-Buy one lamp and get another.</div><p>+So it stood.</p>"
    f"<div class='social-share'><a href=f>-Pass it on</a></div><p>+{MIDDLE}</p><div id=comments><p>-{MIDDLE}</p><p>-{LONG}</p>"
    f"</div></article><menu><li>-Print<li>-Save</menu>",
    f"<article><h1>+Bread without yeast</h1><ol><li>+Mix flour and water.<li>+Wait.<li>+Bake it for an hour.</ol><p>+{MIDDLE}</p>"
    f"<div class='related-posts'><h3>-More like this</h3><p><a href=1>-Cakes of the north</a></p><p>-{SHORT}</p></div></article>",
    # Classes name their purpose.
    f"<div class=header><div class=logo>-The Daily Lamp</div><p>-All the news that we could find today.</p></div><div id=menu>"
    f"<a href=1>-Towns</a></div><div class=content><h1>+Lamps go out</h1><p>+{LONG}</p><p>+No one knew why.</p><p>+{MIDDLE}</p></div>"
    f"<div class=sidebar><h4>-Most read</h4><p>-{MIDDLE}</p></div><div class=footer><p>-{LEGAL}</p></div>",
    f"<div class='cookie-notice'>-{SHORT} <a href=c>More</a></div><div class=post><h2>+Sheep on the hill</h2><div class=entry>"
    f"<p>+{LONG}</p><p>+Then snow.</p></div></div><div class=newsletter><p>-{LONG}</p></div><div class=copyright>-{LEGAL}</div>",
    f"<div class=breadcrumb><a href=1>-Home</a></div><div class='story-body'><h1>+A storm</h1><p>+{MIDDLE}</p><p>+{MIDDLE}</p><p>+Gone."
    f"</p></div><ul class=pagination><li><a href=2>-2</a><li><a href=3>-3</a></ul><div class=promo>-{MIDDLE}</div>"
    f"<div class=replies><div>-{SHORT}</div><div>-{LONG}</div></div>",
    f"<div role=banner>-The Lamp, every day since 1890.</div><div role=main><p>+{LONG}</p><p>+Quite so.</p><pre>+x = 1</pre></div>"
    f"<div role=contentinfo>-{LEGAL}</div><div role=complementary>-{MIDDLE}</div><div class=alert>-{LONG}</div>",
    # Nothing is named.
    f"<div><div><a href=1>-First</a> <a href=2>Second</a></div><div><a href=3>-Third</a></div></div><div><h1>+Snow in May</h1>"
    f"<div>+{LONG}</div><div>+It lay.</div><div>+{MIDDLE}</div></div><div><a href=4>-Terms</a> <a href=5>Help</a></div>",
    f"<table><tr><td><a href=1>-Index</a><td><a href=2>-Map</a></table><p>+{LONG}</p><p>+Why?</p><p>+{MIDDLE}</p><p>+{LONG}</p>"
    f"<div><a href=3>-Top of page</a></div>",
    f"<h1>+On clocks</h1><p>+{MIDDLE}</p><h2>+Hands</h2><p>+{LONG}</p><p>+They turn</p><p>+{MIDDLE}</p><ul><li><a href=1>-Next clock"
    f"</a><li><a href=2>-All clocks</a></ul><span>-Seen 400 times</span>",
    f"<div><span>-Log in</span></div><div><span>-12 May</span></div><div><h1>+A quiet harbour</h1><p>+{LONG}</p><p>+{LONG}</p><p>+At last"
    f"</p></div><div><p>-<a href=s>Like</a></p><p>-<a href=t>Dislike</a></p></div>",
    f"<div><div>-Lamp and Sons</div><div><a href=1>-Boats</a></div><div><a href=2>-Ropes</a></div><div>-Sails, sold out</div></div><div>"
    f"<div>+Knots</div><div>+{LONG}</div><div>+Tie it once</div><div>+{LONG}</div><div>+Pull</div><div>+{MIDDLE}</div></div><div><div>-Lamp"
    f" and Sons</div><div>-Open at nine</div><div><a href=3>-Find us</a></div></div>",
    f"<div><p><a href=1>-Home</a></p><p><a href=2>-Shop</a></p><p>-You are here</p><p><a href=3>-Basket</a></p></div><div><p>+{LONG}</p>"
    f"<p>+A list</p><p><a href=k>+The chart of all tides</a></p><p>+{LONG}</p><p>+{MIDDLE}</p></div><div><p><a href=4>-Privacy</a></p>"
    f"<p>-Printed in the north</p><p><a href=5>-Jobs</a></p></div>",
    f"<ul><li><a href=1>-Fish</a><li><a href=2>-Meat</a><li>-Bread (soon)<li><a href=3>-Milk</a></ul><div><h2>+Broth</h2><ul><li>+{MIDDLE}"
    f"<li>+Salt<li><a href=s>+Stock, as made here</a><li>+{MIDDLE}</ul><p>+{LONG}</p></div><ul><li><a href=4>-Up</a><li>-Back<li>"
    f"<a href=5>-Mail</a></ul>",
    f"<table><tr><td><a href=1>-Maps</a><tr><td>-Signed out<tr><td><a href=2>-Sign in</a></table><table><tr><td>+{LONG}<tr><td>+Height"
    f"<tr><td>+{MIDDLE}<tr><td>+12<tr><td>+{MIDDLE}</table><table><tr><td><a href=3>-Next</a><tr><td>-Page 2 of 9</table>",
    # Long remarks and notices in the middle of what is named content.
    f"<main class=content><article class='post entry'><h1>+Two bridges</h1><div class='entry text'><p>+{LONG} {LONG}</p><p>+Done.</p>"
    f"<aside><h2>-Our other papers.</h2><p>-{LONG} {LONG}</p></aside><p>+{MIDDLE}</p></div><div class=comments><h2>-What readers say."
    f"</h2><div class='comment-content text'><p>-{LONG} {LONG}</p><p>-{LONG} {MIDDLE} {LONG}</p></div></div><form><p>-{LONG} {LONG}</p>"
    f"</form></article></main><footer class=text><h2>-Rights.</h2><p>-{LEGAL} {LEGAL}</p></footer>",
    f"<div class='main content'><article class=story><header><h2>+Water rates.</h2></header><div class=body><p>+{MIDDLE}</p><div class="
    f"sponsored><p>-{LONG} {LONG}</p></div><p>+{LONG}</p><p>+Why</p></div><section id=comments><article class=post><header><h3>-A reader."
    f"</h3></header><p>-{LONG} {LONG}</p></article><article class=post><p>-{LONG} {LONG}</p></article></section></article></div>"
    f"<header><h1>-The Lamp, since 1890.</h1><p>-{LONG}</p></header>",
)
