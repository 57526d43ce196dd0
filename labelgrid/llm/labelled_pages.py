"""Pages labelled by hand, of several shapes and languages: what the extraction of main text is trained on.

``data-l`` says of an element whether it is content (``c``) or boilerplate (``b``); what is in it is the same unless it says
otherwise. Elements above all labels are frames. The pages are written for this purpose; others, for measuring, are with the tests.
"""

PAGES = [
    # a news site, English
    """<html><head><title>Bridge reopens</title><meta charset=utf-8></head><body class="home page-template"><div id="wrapper"><header data-l=b class="site-header"><div class="logo"><a href="/">The Harbour Post</a></div><nav class="main-nav" role="navigation"><ul><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li><li><a href=/o>Opinion</a></li></ul></nav></header><div data-l=b class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div><div class="container"><article data-l=c class="post"><h1>Old bridge reopens after two years of repairs</h1><p class="byline">By Ann Fields, 4 May</p><p>The stone bridge over the Alder was opened again on Monday, two years after a flood had carried away one of its piers.</p><p>Hundreds of people walked across it in the rain.</p><aside data-l=b class="related-links"><h3>Related</h3><ul><li><a href=1>Flood of the century</a></li><li><a href=2>What the river took</a></li></ul></aside><p>Engineers say the new pier should last for a hundred years, provided that the gravel below it is checked every spring.</p><div data-l=b class="share-buttons"><a href=#>Tweet</a> <a href=#>Share</a> <a href=#>Mail</a></div></article><aside data-l=b class="sidebar"><div class="widget"><h4>Most read</h4><ol><li><a href=3>Ten quiet beaches</a></li><li><a href=4>Market day moved</a></li></ol></div><div class="ad-slot">Advertisement</div></aside></div><section data-l=b id="comments" class="comments-area"><h3>2 Comments</h3><div class="comment"><p>At last! I have waited for this since the flood.</p></div><div class="comment"><p>They should have built a new one instead, it would have been cheaper.</p></div></section><footer data-l=b class="site-footer"><p>&copy; 2021 The Harbour Post. All rights reserved.</p><ul><li><a href=/about>About</a></li><li><a href=/terms>Terms</a></li></ul></footer></div></body></html>""",
    # no classes at all, tables for layout
    """<html><body><table><tr><td data-l=b colspan=2><a href=index.html>Home</a> | <a href=links.html>Links</a> | <a href=mail.html>Mail me</a></td></tr><tr><td data-l=b><a href=a.html>Engines</a><br><a href=b.html>Wagons</a><br><a href=c.html>Stations</a></td><td data-l=c><h2>The narrow line to Brae</h2><p>The line was laid in 1889 to carry slate from the quarries to the harbour. It was never meant for passengers.</p><p>Four engines were built for it. Only one is left, and it has not run since the war.</p><table><tr><th>Engine</th><th>Built</th></tr><tr><td>Fern</td><td>1889</td></tr><tr><td>Heather</td><td>1891</td></tr></table></td></tr></table><p data-l=b>Last changed in March. <a href=mail.html>Write to me</a></p></body></html>""",
    # short article, nothing else
    """<article data-l=c><h1>Closed today</h1><p>The shop is closed.</p><p>Back on Tuesday</p></article>""",
    """<!DOCTYPE html><html lang=en><head><title>t</title></head><body><nav data-l=b><a href=a>One</a> <a href=b>Two</a></nav><main data-l=c><p>Short note.<p>Another</main><footer data-l=b>&copy; example</footer></body></html>""",
    # unclassed divs
    """<html><body><div data-l=b><a href=/>Start</a> <a href=/t>Topics</a> <a href=/c>Contact</a></div><div data-l=c><p>Bread needs time more than anything else.</p><p>Let it rest overnight.</p></div><div data-l=b>&copy; baking notes</div></body></html>""",
    """<body><div><div data-l=b><ul><li><a href=1>Index</a><li><a href=2>Archive</a></ul></div><div><div data-l=c><h2>Notes on moss</h2><p>Moss has no roots.</p><p>It drinks through its leaves, which is why it can live on a bare stone and come back to life after months without rain.</p></div></div></div></body>""",
    # German newspaper
    """<html lang=de><body><div id="kopfzeile" data-l=b><a href=/>Talbote</a><ul class="hauptmenue"><li><a href=p>Politik</a></li><li><a href=w>Wirtschaft</a></li><li><a href=k>Kultur</a></li></ul></div><div id="inhalt"><div class="artikel" data-l=c><h1>Neue Schule wird gr&ouml;&szlig;er</h1><p class="vorspann">Der Gemeinderat hat dem Anbau zugestimmt.</p><p>Im Herbst soll gebaut werden. Die Kosten steigen auf vier Millionen Euro, zwei davon zahlt das Land.</p><div class="werbung" data-l=b>Anzeige: Jetzt Matratzen g&uuml;nstig kaufen!</div><p>Die Eltern hatten lange daf&uuml;r gestritten.</p></div><div class="kommentare" data-l=b><h2>Leserkommentare</h2><div class="kommentar"><p>Das wurde auch Zeit, finde ich.</p></div><div class="kommentar"><p>Und wer bezahlt das alles am Ende?</p></div></div><div class="seitenleiste" data-l=b><h3>Meistgelesen</h3><a href=1>Wetter am Wochenende</a><a href=2>Stau auf der A7</a></div></div><div id="fusszeile" data-l=b><a href=i>Impressum</a> <a href=d>Datenschutz</a> &copy; Talbote Verlag</div><div class="cookie-hinweis" data-l=b>Diese Seite verwendet Cookies. <a href=#>Mehr erfahren</a></div></body></html>""",
    # French blog
    """<html lang=fr><head><style>p{}</style></head><body><div class="conteneur"><div class="entete" data-l=b><h1><a href=/>Le carnet de Lise</a></h1><p>Jardins, soupes et promenades</p></div><div class="contenu"><div class="billet" data-l=c><h2>La soupe d'orties</h2><p>Il faut cueillir les orties au printemps, avant qu'elles ne fleurissent.</p><ul><li>300 g de jeunes orties</li><li>deux pommes de terre</li><li>un oignon</li></ul><p>Faites cuire vingt minutes, mixez, salez.</p></div><div class="partage" data-l=b><a href=#>Facebook</a> <a href=#>Courriel</a></div><div class="commentaires" data-l=b><h3>Commentaires</h3><p>Merci pour la recette, je l'ai faite hier et tout le monde en a repris.</p><form><label>Votre nom</label><input><label>Votre message</label><textarea>x</textarea><button>Envoyer</button></form></div></div><div class="barre-laterale" data-l=b><h4>Cat&eacute;gories</h4><ul><li><a href=j>Jardin</a></li><li><a href=c>Cuisine</a></li></ul><div class="publicite">Publicit&eacute; : vos graines livr&eacute;es chez vous</div></div><div class="pied-de-page" data-l=b>Mentions l&eacute;gales - <a href=c>Contact</a></div></div></body></html>""",
    # Spanish
    """<html lang=es><body><div id=cabecera data-l=b><img src=l.png alt="El Faro"><div class=menu><a href=1>Portada</a><a href=2>Deportes</a><a href=3>Sociedad</a></div></div><div id=principal><div class="noticia contenido" data-l=c><h1>El mercado vuelve a la plaza</h1><p>Despu&eacute;s de tres a&ntilde;os, los puestos regresan al centro.</p><p>Los vecinos celebran la noticia, aunque piden m&aacute;s sombra y menos coches.</p><blockquote><p>&laquo;Es el coraz&oacute;n del pueblo&raquo;, dice la alcaldesa.</p></blockquote></div><div class=publicidad data-l=b>Compra ahora y paga en enero</div><div class="comentarios-lectores" data-l=b><h3>Opiniones de los lectores</h3><div><p>Ya era hora, gracias a todos los que lo hicieron posible.</p></div></div></div><div id=pie data-l=b>Aviso legal | <a href=p>Privacidad</a></div></body></html>""",
    # Italian, HTML5, section comments
    """<html lang=it><body><header data-l=b><a href=/>Voce del Lago</a><nav><a href=1>Cronaca</a><a href=2>Cultura</a></nav></header><main><article data-l=c class="articolo"><header><h1>Il lago &egrave; di nuovo pulito</h1><p>di Marta Rossi</p></header><section class="testo-articolo"><p>Dopo dieci anni di lavori l'acqua &egrave; tornata limpida.</p><h2>I pescatori</h2><p>&laquo;Non lo speravamo pi&ugrave;&raquo;, dice uno di loro, che pesca qui da quando era bambino.</p></section></article><section class="commenti" data-l=b><h2>Commenti</h2><article><p>Bellissima notizia, finalmente!</p></article><article><p>Speriamo che duri.</p></article></section><aside data-l=b class="pubblicita">Offerte della settimana</aside></main><footer data-l=b>Contatti - Note legali</footer></body></html>""",
    # Portuguese
    """<html lang=pt><body><div class="topo" data-l=b><a href=/>Not&iacute;cias da Serra</a> <a href=2>Economia</a> <a href=3>Esporte</a></div><div class="aviso-cookies" data-l=b>Usamos cookies para melhorar o site.</div><div class="conteudo" data-l=c><h1>Caf&eacute; da montanha ganha pr&ecirc;mio</h1><p>Um produtor da serra recebeu o primeiro lugar entre quinhentos concorrentes.</p><p>A colheita &eacute; feita &agrave; m&atilde;o.</p></div><div class="lateral" data-l=b><h3>Mais lidas</h3><ul><li><a href=1>Chuva forte no s&aacute;bado</a></li></ul></div><div class="rodape" data-l=b>Todos os direitos reservados</div></body></html>""",
    # documentation page
    """<html><body><div class="navbar" data-l=b><a href=/>docs</a><a href=/api>API</a><form class="search"><input><button>Search</button></form></div><div class="sidebar-toc" data-l=b><ul><li><a href=#i>Install</a></li><li><a href=#u>Use</a></li><li><a href=#f>FAQ</a></li></ul></div><div class="document" role="main" data-l=c><h1>Getting started</h1><p>Install the package, then write a configuration file.</p><pre>tool init --name demo
tool run</pre><h2>Configuration</h2><table><thead><tr><th>Key</th><th>Meaning</th></tr></thead><tbody><tr><td>name</td><td>what it is called</td></tr><tr><td>port</td><td>where it listens</td></tr></tbody></table><p>See also:</p><ul><li><a href=x>Plugins</a></li><li><a href=y>Themes</a></li></ul><p>That is all you need to know to begin.</p></div><div class="prev-next" data-l=b><a href=p>Previous</a> <a href=n>Next</a></div><div class="footer" data-l=b>Built with a static site generator</div></body></html>""",
    # forum: the first post is the article, the rest reader comments
    """<html><body><div id="top-menu" data-l=b><a href=/>Forum</a> &gt; <a href=/g>Garden</a></div><div class="thread"><div class="post first-post" data-l=c><h1>My roses have black spots</h1><p>Since the rain last week all the leaves have black spots. I have cut off the worst of them.</p><p>What else can I do?</p></div><div class="replies" data-l=b><div class="reply"><p>Pick up every fallen leaf, the fungus lives in them over the winter.</p><span>3 likes</span></div><div class="reply"><p>Water them at the foot only and never in the evening.</p></div></div></div><div class="login-box" data-l=b><form><label>Name</label><input><label>Password</label><input><input type=submit value=Login></form></div><div class="legal" data-l=b>Terms of use. Privacy.</div></body></html>""",
    # recipe with steps, rating form and newsletter
    """<html><body><nav class="breadcrumb" data-l=b><a href=/>Home</a> / <a href=/r>Recipes</a></nav><div class="recipe entry-content" data-l=c itemscope><h1>Lentil soup</h1><div class="intro">A soup for cold evenings.</div><h3>You need</h3><ul class="ingredients"><li>200 g lentils</li><li>1 carrot</li><li>salt</li></ul><h3>Method</h3><ol><li>Wash the lentils.</li><li>Cook everything for 40 minutes.</li><li>Serve hot.</li></ol><div class="rating-form" data-l=b><form><p>Rate this recipe</p><button>1</button><button>2</button></form></div><p>It tastes even better on the second day.</p></div><div class="newsletter-signup" data-l=b><h4>Our newsletter</h4><p>Get a new recipe every week, straight to your inbox.</p><form><input><button>Subscribe</button></form></div><div class="related-posts" data-l=b><h4>You may also like</h4><a href=1>Pea soup</a><a href=2>Onion soup</a></div></body></html>""",
    # links as content
    """<html><body><header data-l=b><a href=/>Reading room</a></header><article data-l=c><h1>Five books for the summer</h1><p>These are the books that our readers borrowed most often this year, in no particular order.</p><ul><li><a href=1>The Salt Road</a></li><li><a href=2>A Year of Birds</a></li></ul><p>All of them can be ordered at the desk, and most of them are short enough for one afternoon.</p><ol><li><a href=3>Under the Ash</a></li><li><a href=4>Letters Home</a></li><li><a href=5>Night Ferry</a></li></ol><p>Good reading!</p></article><footer data-l=b><a href=i>Imprint</a></footer></body></html>""",
    """<html><body><div class="nav-wrap" data-l=b><a href=1>Issues</a><a href=2>Authors</a><a href=3>Shop</a></div><main data-l=c><h1>In this issue</h1><a href=4><div>The long way round the lake, on foot and in winter</div></a><a href=5><h2>A talk with the keeper</h2><p>He has lived on the rock for thirty years and does not want to leave it.</p></a><p>And much more on the other pages.</p></main><div class="bottom-bar" data-l=b><a href=6>Subscribe</a> <a href=7>Privacy</a></div></body></html>""",
    # old page with font and center
    """<html><body bgcolor=white><center data-l=b><font size=5>Tom's Kite Page</font><br><a href=1>kites</a> <a href=2>winds</a> <a href=3>friends</a></center><hr><div data-l=c><font>Kites need wind, but not too much of it. I built my first one from newspaper and sticks.<br><br>It flew for a minute and then fell into the river.</font></div><hr><center data-l=b><font size=1>You are visitor 1042. Best viewed at 800x600.</font></center></body></html>""",
    # paywall, modal, hidden
    """<html><body><div class="modal overlay" data-l=b aria-hidden=true><p>Sign in to continue reading</p><button>Sign in</button></div><div class="alert notice" data-l=b role=alert>Our office is closed on Friday.</div><div class="layout"><div class="story-body" data-l=c><h1>The clockmaker of Lane End</h1><p>He opens the shop at seven, winds forty clocks, and then waits.</p><figure><img src=a.jpg><figcaption>The shop in 1950</figcaption></figure><p>Nobody has bought a clock this year.</p><div class="paywall" data-l=b><p>You have read your last free article this month. Subscribe for full access.</p></div></div><div class="promo banner" data-l=b>Save 50 % this week only</div></div></body></html>""",
    # noscript and widget-heavy
    """<html><body><noscript data-l=b>Please enable JavaScript to use this site.</noscript><div id=app><div class="toolbar" data-l=b><button>Menu</button><a href=/>Acme News</a></div><div class="page-content"><div class="article-text" data-l=c><h1>Rain at last</h1><p>After ninety dry days it has rained in the valley.</p><p>Farmers danced in the fields.</p></div><div class="tags" data-l=b><a href=1>#rain</a> <a href=2>#valley</a></div><div class="author-bio" data-l=b><p>The author writes about the weather and lives in the valley with two dogs.</p></div><div class="recommended" data-l=b><h3>More stories</h3><div class="card"><a href=3><h4>Snow in June</h4><p>It happened once before.</p></a></div><div class="card"><a href=4><h4>The driest river</h4><p>A walk along its bed.</p></a></div></div></div></div></body></html>""",
    # long comments, short article
    """<html><body><h1 data-l=b><a href=/>Short Blog</a></h1><div class="entry" data-l=c><h2>Question of the day</h2><p>Do you eat the crust?</p></div><div id="disqus_thread" data-l=b><div class="post-message"><p>Always, and my grandmother would have been very cross with anybody who left it on the plate.</p></div><div class="post-message"><p>Never. I cut it off, dry it, and use it for the birds in winter, so nothing is wasted at all.</p></div></div><section id="responses" data-l=b><h3>Responses</h3><p>I linked to this post from my own page, where a long talk about bread has begun.</p></section></body></html>""",
    """<html lang=de><body><main><article data-l=c><h1>Kurz gemeldet</h1><p>Das Freibad &ouml;ffnet morgen.</p><section class="diskussion" data-l=b><h2>Diskussion</h2><div class="beitrag-leser"><p>Endlich, die Kinder freuen sich schon seit Wochen darauf!</p></div></section></article></main><footer data-l=b>Impressum</footer></body></html>""",
    # Dutch and Polish and Swedish
    """<html lang=nl><body><div class="menubalk" data-l=b><a href=1>Nieuws</a><a href=2>Sport</a></div><div class="inhoud" data-l=c><h1>Molen draait weer</h1><p>Na een jaar stilstand draaien de wieken weer.</p><p>De molenaar is blij.</p></div><div class="reacties" data-l=b><h3>Reacties</h3><p>Mooi om te zien, ik ben er gisteren met mijn dochter geweest.</p></div><div class="voettekst" data-l=b>Alle rechten voorbehouden</div></body></html>""",
    """<html lang=pl><body><div id="naglowek" data-l=b><a href=/>Gazeta</a></div><div id="tresc" data-l=c><h1>Nowy most</h1><p>Most otwarto w niedziel&#281;.</p><p>Kosztowa&#322; mniej, ni&#380; planowano.</p></div><div id="komentarze" data-l=b><p>Nareszcie, czekali&#347;my na to wiele lat.</p></div><div id="stopka" data-l=b>Polityka prywatno&#347;ci</div></body></html>""",
    """<html lang=sv><body><nav data-l=b><a href=1>Hem</a><a href=2>Om oss</a></nav><div class="innehall" data-l=c><h1>V&aring;ren &auml;r h&auml;r</h1><p>Isen har g&aring;tt och f&aring;glarna &auml;r tillbaka.</p></div><div class="sidfot" data-l=b>Kontakta oss</div></body></html>""",
    # CJK and Cyrillic
    """<html lang=ja><body><div class="header" data-l=b><a href=/>港新聞</a><a href=1>社会</a><a href=2>文化</a></div><div class="article-body" data-l=c><h1>古い橋が開通</h1><p>二年の工事のあと、月曜日に橋が開いた。</p><p>多くの人が雨の中を歩いた。</p></div><div class="ranking side" data-l=b><ol><li><a href=3>天気</a></li><li><a href=4>市場</a></li></ol></div><div class="footer" data-l=b>© 港新聞社</div></body></html>""",
    """<html lang=ru><body><div class="shapka header" data-l=b><a href=/>Вести</a> <a href=1>Спорт</a></div><div class="statya text" data-l=c><h1>Мост снова открыт</h1><p>Два года его чинили после наводнения.</p><p>Сотни людей прошли по нему под дождём.</p></div><div class="kommentarii comments" data-l=b><p>Наконец-то, спасибо всем строителям!</p></div><div class="podval footer" data-l=b>Все права защищены</div></body></html>""",
    # article split over several siblings, ads between
    """<html><body><div class="site"><div class="masthead" data-l=b><a href=/>Weekly</a></div><div class="body"><h1 data-l=c>Three days in the hills</h1><p data-l=c>On the first day we lost the path.</p><div class="adsbygoogle" data-l=b>Sponsored: boots for every path</div><p data-l=c>On the second day we found it again, far below us, beside a stream that was not on the map.</p><div class="sponsored-content" data-l=b><p>Partner content. Book your holiday now and save.</p></div><p data-l=c>On the third day it rained.</p></div><div class="pagination" data-l=b><a href=1>1</a> <a href=2>2</a></div></div></body></html>""",
    # product page with specification
    """<html><body><div class="header-top" data-l=b><a href=/>Shop</a><a href=/cart>Cart (0)</a></div><div class="breadcrumbs" data-l=b><a href=/>Shop</a> &raquo; <a href=/l>Lamps</a></div><div class="product-description main-content" data-l=c><h1>Desk lamp</h1><p>A lamp with a long arm and a warm light.</p><dl><dt>Height</dt><dd>45 cm</dd><dt>Weight</dt><dd>1.2 kg</dd></dl><p>The arm stays where you put it.</p></div><div class="reviews" data-l=b><h3>Customer reviews</h3><div class="review"><p>Bright enough for reading and it does not get hot.</p></div></div><div class="customers-also" data-l=b><a href=1>Floor lamp</a><a href=2>Bulb</a></div><div class="subscribe-popup" data-l=b><p>Get 10 % off your first order</p></div></body></html>""",
    # encyclopedia
    """<html><body><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 data-l=c id="firstHeading">Alder</h1><div id="bodyContent" data-l=c><p>Alders are trees of the birch family. They grow beside water.</p><div id="toc" class="toc" data-l=b><h2>Contents</h2><ul><li><a href=#1>Wood</a></li><li><a href=#2>Uses</a></li></ul></div><h2>Wood</h2><p>The wood is soft and does not rot under water, which is why whole towns stand on it.</p><h2>Uses</h2><ul><li>piles and pumps</li><li><a href=smoke>smoking fish</a></li></ul></div></div><div id="mw-navigation" data-l=b><ul><li><a href=1>Main page</a></li><li><a href=2>Random article</a></li><li><a href=3>Log in</a></li></ul></div><div id="footer" data-l=b><ul><li>This page was last edited on 2 June.</li><li><a href=p>Privacy policy</a></li></ul></div></body></html>""",
    # interview in dt/dd, contact form, social
    """<html><body><div class="page"><div class="branding" data-l=b>Voices</div><div class="post-content" data-l=c><h1>Talking to a lighthouse keeper</h1><dl><dt>What do you do all day?</dt><dd>I paint. Everything here rusts, so I paint it again.</dd><dt>Are you lonely?</dt><dd>No.</dd></dl></div><div class="social follow-us" data-l=b><a href=1>Follow</a><a href=2>RSS</a></div><div class="contact-form" data-l=b><form><p>Write to us</p><label>Mail</label><input><button>Send</button></form></div></div></body></html>""",
    # press release with legal boilerplate inside main
    """<html><body><main><div class="release" data-l=c><h1>New ferry ordered</h1><p>The island council has ordered a ferry that runs on electricity.</p><p>It will carry sixty cars and arrive in two years.</p></div><div class="disclaimer" data-l=b><p>This release contains forward-looking statements. All trademarks belong to their owners.</p></div><div class="contact-info" data-l=b><p>Press office: <a href=m>mail</a></p></div></main><div class="copyright" data-l=b>Copyright 2020</div></body></html>""",
    # nested wrappers with odd names
    """<html><body><div class="x1"><div class="x2"><div class="x3" data-l=b><a href=1>a</a><a href=2>b</a><a href=3>c</a></div><div class="x4"><div class="x5" data-l=c><p>The fox had come back in the night, and two of the hens were gone.</p><p>We found feathers by the gate.</p></div><div class="x6" data-l=b><a href=4>Earlier</a> <a href=5>Later</a></div></div></div></div></body></html>""",
    """<html><body><section data-l=b><a href=1>Blog</a><a href=2>Work</a><a href=3>Me</a></section><section data-l=c><h1>Why I walk</h1><p>Because the bus is slow.</p><p>Because thoughts come at three miles an hour, and not before the second hill.</p></section><section data-l=b><p>Made by hand. <a href=4>Source</a></p></section></body></html>""",
    # many parts, the names that sites of several languages give them
    """<html><body><div class="skip-nav" data-l=b><a href=#c>Skip</a></div><div id="header" class="header" data-l=b><div class="logo">Daily</div></div><div id="nav" class="navigation menu" data-l=b><a href=1>World</a><a href=2>Money</a></div><div class="banner ad advertisement" data-l=b>Buy two, pay for one</div><div id="content" class="content"><div class="article story" data-l=c><h1>Owls in the tower</h1><p>Four young owls have hatched in the tower.</p><p>The bells stay silent until they fly.</p><div class="comments" data-l=b><h3>Comments</h3><p>How lovely, I hear them every night.</p></div></div><div class="related" data-l=b><h3>Related</h3><a href=3>Bats under the bridge</a></div><div class="newsletter" data-l=b><p>The best of the week by mail.</p></div></div><div id="sidebar" class="sidebar widget" data-l=b><p>About this paper: we have been printed here since 1871.</p></div><div id="footer" class="footer" data-l=b>Copyright Daily</div></body></html>""",
    """<html><body><div class="page"><div class="topbar social" data-l=b><a href=1>Follow us</a></div><div class="post entry" data-l=c><h2 class="title entry-title">Sharpening a scythe</h2><p>Begin at the heel and draw the stone toward the point.</p><div class="advert sponsor" data-l=b>Stones and handles, sent to your door</div><p>Listen: it sings when it is right.</p><div class="share sharing" data-l=b><a href=2>Pin it</a></div><section class="comment-list discussion" data-l=b><p>Mine only sings after the third try, but then it does cut well.</p></section></div><div class="consent cookie" data-l=b><p>This site sets cookies. Choose which.</p></div><div class="copyright colophon" data-l=b>Set in Garamond</div></div></body></html>""",
    """<html lang=de><body><div class="kopf header" data-l=b>Heimatblatt</div><div class="navigation" data-l=b><a href=1>Orte</a><a href=2>Leute</a></div><div class="text artikeltext" data-l=c><h1>Der letzte Schmied</h1><p>Er h&auml;mmert seit f&uuml;nfzig Jahren.</p><p>Einen Nachfolger hat er nicht.</p><div class="anzeige" data-l=b>Anzeige: Hufeisen im Angebot</div><section class="kommentare" data-l=b><h3>Kommentare</h3><p>Mein Vater hat bei ihm gelernt, das waren noch Zeiten.</p></section></div><div class="randspalte" data-l=b><h4>Aus der Region</h4><a href=3>Markt am Samstag</a></div><div class="hinweis cookie" data-l=b>Wir verwenden Cookies.</div><div class="fussleiste" data-l=b>Impressum und Datenschutz</div></body></html>""",
    """<html lang=de><body><main class="seite"><article data-l=c><h2>Pilze im Oktober</h2><p>Nach dem Regen stehen sie &uuml;berall.</p><div class="werbung" data-l=b><p>K&ouml;rbe und Messer f&uuml;r den Sammler, jetzt bestellen.</p></div><p>Nimm nur, was du kennst.</p><section class="leserbriefe kommentar" data-l=b><p>Wir haben drei Steinpilze gefunden, so gro&szlig; wie Teller!</p></section></article><div class="fusszeile" data-l=b>Kontakt</div></main></body></html>""",
    """<html lang=fr><body><div class="menu-principal" data-l=b><a href=1>Une</a><a href=2>Sports</a></div><article class="article" data-l=c><h1>La neige en avril</h1><p>Elle est tomb&eacute;e toute la nuit.</p><aside class="publicite" data-l=b>Pneus d'hiver en promotion</aside><p>Les enfants sont ravis.</p><section class="commentaires" data-l=b><p>Chez nous il y en a trente centim&egrave;tres, du jamais vu.</p></section></article><div class="pied" data-l=b>Contact</div><div class="bandeau-cookies" data-l=b>Nous utilisons des cookies.</div></body></html>""",
    """<html lang=es><body><div class="cabecera" data-l=b><a href=/>Diario</a></div><div class="navegacion menu" data-l=b><a href=1>Local</a></div><div class="articulo contenido-principal" data-l=c><h1>Lluvia de estrellas</h1><p>Se ver&aacute; esta noche.</p><div class="anuncio publicidad" data-l=b>Telescopios a mitad de precio</div><p>Hace falta un cielo oscuro.</p><div class="comentarios" data-l=b><p>Lo vimos anoche desde la playa y fue precioso.</p></div></div><div class="pie" data-l=b>Derechos reservados</div></body></html>""",
    """<html lang=it><body><div class="testata intestazione" data-l=b>Il Corriere del Bosco</div><div class="menu" data-l=b><a href=1>Funghi</a><a href=2>Sentieri</a></div><div class="contenuto" data-l=c><h1>Il sentiero riapre</h1><p>Dopo la frana il sentiero &egrave; sicuro.</p><div class="pubblicita" data-l=b>Scarponi in offerta</div><p>Si consiglia di partire presto.</p><div class="commenti" data-l=b><p>Ci siamo stati domenica, tutto perfetto.</p></div></div><div class="piede" data-l=b>Note legali</div></body></html>""",
    """<html lang=nl><body><div class="kop" data-l=b>Streekblad</div><nav class="menu" data-l=b><a href=1>Nieuws</a></nav><div class="artikel inhoud" data-l=c><h1>Storm over zee</h1><p>De veerboot vaart niet.</p><div class="advertentie" data-l=b>Laarzen nu in de uitverkoop</div><p>Morgen wordt het rustiger.</p><div class="reacties" data-l=b><p>Wij zitten hier vast, maar het is prachtig om te zien.</p></div></div><div class="voet" data-l=b>Contact</div></body></html>""",
    """<html lang=pt><body><div class="cabecalho" data-l=b>Jornal</div><div class="materia conteudo" data-l=c><h1>Baleias na ba&iacute;a</h1><p>Tr&ecirc;s baleias entraram na ba&iacute;a.</p><div class="publicidade" data-l=b>Passeios de barco com desconto</div><p>Elas ficam at&eacute; agosto.</p><div class="comentarios" data-l=b><p>Vi da janela, que coisa linda!</p></div></div><div class="rodape" data-l=b>Contato</div></body></html>""",
    # articles with lists of links and linked blocks that are their text
    """<html><body><nav data-l=b><a href=1>Library</a><a href=2>Hours</a></nav><article data-l=c><h1>New in the map room</h1><p>Forty maps of the coast have been given to us, and they can now be seen by everybody.</p><ul><li><a href=a>The bay in 1702</a></li><li><a href=b>The bay in 1850</a></li><li><a href=c>The harbour works</a></li></ul><p>Ask at the desk.</p></article></body></html>""",
    """<html><body><header data-l=b>Museum</header><main data-l=c><h1>Rooms</h1><a href=1><div>The room of clocks, where all of them show another hour</div></a><a href=2><div>The boat</div></a><a href=3><p>The garden of stones</p></a><p>Closed in winter.</p></main><footer data-l=b><a href=4>Tickets</a></footer></body></html>""",
    """<html><body><article data-l=c><h2>Sources</h2><ol><li><a href=1>Parish register, 1703</a></li><li><a href=2>Letters of the miller</a></li></ol></article></body></html>""",
    """<html><body><div data-l=b><a href=1>Site</a></div><div class="content" data-l=c><h1>Reading list</h1><p>For the second week, please read these two.</p><ul><li><a href=a>On walls</a></li><li><a href=b>On gates</a></li></ul></div><div class="footer" data-l=b>Course 12</div></body></html>""",
]
