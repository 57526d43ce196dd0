"""Pages labelled by hand that nothing is trained on (see ``labelgrid.llm.labelled_pages`` for the marks)."""

PAGES = [
    """<!doctype html><html><head><title>x</title></head><body><div class="skip-link" data-l=b><a href=#m>Skip to content</a></div><header class="global-header" data-l=b><a href=/>Northern Echoes</a><nav aria-label=main><a href=1>Home</a><a href=2>Culture</a><a href=3>Science</a></nav></header><main id=m><article class="story" data-l=c><h1>The last ice cutter</h1><p class="standfirst">He still goes out on the lake with a saw.</p><p>Every January, Olav Berg walks out on the lake, listens to the ice, and starts to cut.</p><p>The blocks used to go to Hamburg and London. Now they go into the cellar of the inn.</p><div class="advert" data-l=b><span>Advertisement</span><p>Warm socks for cold feet, now half price.</p></div><p>&ldquo;It keeps until September,&rdquo; he says.</p><ul class="article-tools" data-l=b><li><a href=p>Print</a></li><li><a href=m>E-mail</a></li></ul></article><section class="reader-comments" data-l=b><h2>Comments</h2><ol><li><p>My grandfather did the same work on our lake until 1962.</p></li><li><p>Lovely piece. More of these, please!</p></li></ol></section></main><aside class="trending" data-l=b><h2>Trending</h2><a href=8>Trains cancelled</a><a href=9>Fish prices rise</a></aside><footer data-l=b>&copy; Northern Echoes 2022 <a href=l>Legal</a></footer></body></html>""",
    """<html><body><div id=menu data-l=b><a href=a>Recipes</a><a href=b>Techniques</a></div><div id=main-column data-l=c><h1>Stock</h1><p>Keep the bones.</p><p>Cover them with cold water, bring it up slowly, and take off what rises. Four hours are enough.</p><ul><li>no salt</li><li>no lid</li></ul></div><div id=right-column data-l=b><b>Sponsors</b><br><a href=k>Knives and pans</a></div></body></html>""",
    """<html lang=de><body><div class="topleiste" data-l=b><a href=/>Gemeinde Au</a><a href=1>Rathaus</a><a href=2>Vereine</a></div><div class="hauptinhalt" data-l=c><h2>Sperrung der Hauptstra&szlig;e</h2><p>Ab Montag ist die Hauptstra&szlig;e zwischen Kirche und Bahnhof gesperrt.</p><p>Die Umleitung ist ausgeschildert.</p></div><div class="werbebanner" data-l=b>Anzeige: M&ouml;belhaus &ndash; alles muss raus</div><section class="leserkommentare" data-l=b><p>Schon wieder? Die war doch erst im letzten Jahr aufgerissen.</p></section><div class="fuss" data-l=b><a href=3>Impressum</a> <a href=4>Kontakt</a></div></body></html>""",
    """<html lang=fr><body><nav class="navigation-principale" data-l=b><ul><li><a href=1>Accueil</a></li><li><a href=2>Actualit&eacute;s</a></li></ul></nav><div class="contenu-article" data-l=c><h1>Le pont neuf a cent ans</h1><p>La ville f&ecirc;te dimanche le centenaire du pont.</p><p>Un bal aura lieu sur les quais, et les bateaux seront illumin&eacute;s toute la nuit.</p></div><div class="encart-pub" data-l=b>Offre sp&eacute;ciale : abonnez-vous pour un euro</div><div class="liste-commentaires" data-l=b><p>J'y serai avec mes enfants, merci pour l'information.</p></div><footer data-l=b>Tous droits r&eacute;serv&eacute;s</footer></body></html>""",
    """<html><body><div><div data-l=b><a href=1>first</a> <a href=2>second</a> <a href=3>third</a></div><div data-l=c><p>The well was dug by hand in 1804, and it has never run dry.</p><p>It is ninety feet deep.</p></div><div data-l=b><a href=4>back</a></div></div></body></html>""",
    """<html><body><article data-l=c><p>one<p>two</article></body></html>""",
    """<html><body><div data-l=b><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Contact</a></li></ul></div><div data-l=c><p>The mill stands at the end of the lane.</p><p>It no longer turns, sadly.</p></div></body></html>""",
    """<html><body><header data-l=b><a href=/>Field notes</a></header><article data-l=c><h1>Swifts</h1><p>The swifts came back on the fifth of May, as they do every year, and the sky over the church has been loud since then.</p><ul><li><a href=s1>Where swifts sleep</a></li><li><a href=s2>How to build a box</a></li></ul><p>They will leave again in August without a word, and the evenings will be very quiet for a week or two.</p></article><section id="responses" data-l=b><p>We have put up three boxes on our barn and two of them are taken this year.</p></section></body></html>""",
    """<html><body><main data-l=c><h1>Exhibits</h1><a href=1><div>The room of maps, with the globe from 1640</div></a><a href=2><div>The whale</div></a><p>Open every day but Monday.</p></main><div class="visit-newsletter" data-l=b><form><p>Join our mailing list</p><input><button>Join</button></form></div></body></html>""",
    """<html lang=de><body><article data-l=c><h1>Ausflug</h1><p>Wir waren am See.</p><section class="leserkommentare" data-l=b><p>Da will ich auch einmal hin, danke f&uuml;r den Tipp!</p></section></article></body></html>""",
    """<html lang=es><body><div class="barra-navegacion" data-l=b><a href=1>Inicio</a> <a href=2>Archivo</a></div><div class="entrada" data-l=c><h2>El olivo viejo</h2><p>Dicen que tiene mil a&ntilde;os.</p><p>Nadie los ha contado, pero caben cinco personas dentro del tronco.</p></div><div class="comentarios" data-l=b><p>Lo visit&eacute; en mayo y es impresionante.</p></div><div class="pie-pagina" data-l=b>Contacto y aviso legal</div></body></html>""",
    """<html><body><div class="c-page"><div class="c-page__top" data-l=b><button>Menu</button><a href=/>Journal</a></div><div class="c-page__body"><div class="c-article" data-l=c><h1>Measuring a glacier</h1><p>We drill, we wait, and we come back a year later to see how much of the stake sticks out.</p><table><tr><th>Year</th><th>Loss</th></tr><tr><td>2019</td><td>1.4 m</td></tr><tr><td>2020</td><td>2.1 m</td></tr></table><p>The glacier loses more every year.</p></div><div class="c-related" data-l=b><h3>Read next</h3><a href=1>Ice cores explained</a></div></div><div class="c-cookie" data-l=b><p>This journal uses cookies to count its readers.</p><button>OK</button></div></div></body></html>""",
    """<html><head><title>t</title><article data-l=c><p>A page whose head is never closed still has its text.</p></article></html>""",
    """<html lang=nl><body><div class="koptekst" data-l=b><a href=1>Krant</a><a href=2>Agenda</a></div><div class="artikelinhoud" data-l=c><h1>Fietspad klaar</h1><p>Het nieuwe fietspad langs het kanaal is klaar.</p><p>Het is acht kilometer lang.</p></div><div class="advertentie" data-l=b>Nu twee halen, een betalen</div><div class="lezersreacties" data-l=b><p>Eindelijk veilig naar school fietsen.</p></div></body></html>""",
    """<html><body><div class="entry-header" data-l=c><h1>On buying a boat</h1></div><div class="entry-content" data-l=c><p>Do not buy a boat.</p><p>If you must, buy a small one, and find somebody who has owned it for a long time and is sad to see it go.</p><div class="inline-promo" data-l=b><p>Our new podcast is out now</p></div><pre>length  18 ft
draught  2 ft</pre></div><div class="entry-meta" data-l=b>Filed under <a href=1>boats</a></div><div id="respond" class="comment-respond" data-l=b><h3>Leave a reply</h3><form><textarea>t</textarea><button>Post comment</button></form></div></body></html>""",
]
