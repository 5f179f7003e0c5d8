"""Pages written by hand, in layouts of many kinds. Text of the article stands in {{...}}, one pair a block."""

import html
import re

PAGES = {
    "bare body": "<html><body><p>{{The harbour was quiet that morning, and nobody came.}}</p><p>{{By noon the boats had returned with very little.}}</p></body></html>",
    "bare body with a heading": "<html><head><title>x</title></head><body><h1>{{How to mend a net}}</h1><p>{{Lay it flat first, on a dry floor.}}</p><p>{{Then look for the smallest hole and start there.}}</p><hr><p>{{When all is done, hang it up to dry for a night.}}</p></body></html>",
    "details in article": "<body><header><a href='/'>Home</a></header><article><h1>{{Common questions}}</h1><p>{{We are asked the same things every week, so here they are.}}</p><details><summary>{{Is it safe?}}</summary><p>{{Yes, as long as you keep the lid closed while it boils.}}</p></details><p>{{Write to us if something is missing.}}</p></article><footer>2024 Example</footer></body>",
    "details and table": "<body><nav><a href='/a'>A</a><a href='/b'>B</a></nav><main><article><p>{{These are the figures of the year, by month.}}</p><table><tr><th>{{Month}}</th><th>{{Rain}}</th></tr><tr><td>{{May}}</td><td>{{41 mm}}</td></tr></table><details><summary>{{Method}}</summary><p>{{Rain was measured each morning at seven, on the roof.}}</p></details><p>{{The autumn was drier than any since the war.}}</p></article></main><section class='comments'><h3>Comments</h3><p>Nice table, thanks.</p></section></body>",
    "responses": "<body><div class='top'><a href='/'>Site</a></div><article><h1>{{Walking the old wall}}</h1><p>{{The wall runs for nine miles, most of it in fields.}}</p><p>{{Take water, for there is no shop on the way.}}</p><section class='responses'><h2>Responses</h2><div class='response'><p>I walked it last year and loved it.</p></div><div class='response'><p>Is the bridge open again?</p></div></section></article></body>",
    "responses outside": "<body><article><h1>{{A short note on bees}}</h1><p>{{They came early this spring, and stayed in the orchard.}}</p></article><section class='responses'><p><b>Ann</b> Ours came early too!</p><p><b>Tom</b> I have not seen any so far.</p></section></body>",
    "unnamed wrappers": "<body><div><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div><div><h1>{{Council votes for the new bridge}}</h1><p>{{After four hours of debate the council voted for the bridge on Tuesday.}}</p><p>{{Work begins in March, the mayor said, and will take two years.}}</p></div></div><div><a href='/about'>About</a> <a href='/terms'>Terms</a></div></div></body>",
    "unnamed columns": "<body><table><tr><td><a href='/1'>One</a><br><a href='/2'>Two</a><br><a href='/3'>Three</a></td><td><h2>{{Old recipes of the valley}}</h2><p>{{Every house had its own way with chestnuts, and few wrote it down.}}</p><p>{{This one comes from a woman who was ninety when she told it.}}</p></td></tr></table></body>",
    "blog with sidebar": "<body><div id='masthead'><h1>My blog</h1><p>Thoughts on paper</p></div><div id='primary'><div class='hentry'><h2 class='t'>{{Why I write by hand}}</h2><div class='postbody'><p>{{A pen is slow, and that is the point of it.}}</p><p>{{What I write on a screen I forget, what I write by hand stays.}}</p></div></div></div><div id='secondary'><h3>Archives</h3><ul><li><a href='/1'>May</a></li><li><a href='/2'>June</a></li></ul></div><div id='colophon'>Powered by nothing</div></body>",
    "news with lead": "<body><header class='site-header'><a href='/'>Daily</a><nav><ul><li><a href='/w'>World</a></li><li><a href='/b'>Business</a></li></ul></nav></header><main><article><h1>{{Storm closes northern ports}}</h1><p class='lead'>{{Ferries stayed in harbour on Sunday as winds rose to eighty miles an hour.}}</p><p>{{The ports expect to open again on Monday evening.}}</p><aside class='related'><h3>Read more</h3><a href='/x'>Flood warnings in the west</a></aside><p>{{Some five hundred lorries wait on the motorway.}}</p></article></main><footer><p>Copyright Daily 2024. All rights reserved.</p></footer></body>",
    "wiki": "<body><div id='siteNotice'>Help us keep the lights on.</div><div id='bodyContent'><h1>{{Lapwing}}</h1><p>{{The <b>lapwing</b> is a bird of <a href='/wet'>wet meadows</a>, common in the north.}}</p><h2>{{Nest}}</h2><p>{{It nests on the ground and draws dogs away by limping.}}</p><ul><li>{{Four eggs, seldom three.}}</li><li>{{Hatched after twenty-six days.}}</li></ul></div><div id='mw-navigation'><ul><li><a href='/m'>Main page</a></li><li><a href='/r'>Random</a></li></ul></div></body>",
    "manual": "<body><nav class='toc'><ul><li><a href='#a'>Install</a></li><li><a href='#b'>Use</a></li></ul></nav><main role='main'><h1>{{Installing the pump}}</h1><ol><li>{{Turn off the water at the main valve.}}</li><li>{{Fix the bracket with the four screws in the bag.}}</li><li>{{Open the valve slowly and look for drops.}}</li></ol><blockquote>{{Never run the pump dry, not even for a minute.}}</blockquote></main><div class='prev-next'><a href='/p'>Previous</a> <a href='/n'>Next</a></div></body>",
    "definition list": "<body><section><h1>{{Words of the trade}}</h1><dl><dt>{{Warp}}</dt><dd>{{The threads that run along the cloth, held under tension.}}</dd><dt>{{Weft}}</dt><dd>{{The thread that is carried across them, from side to side.}}</dd></dl></section><footer><a href='/i'>Imprint</a></footer></body>",
    "fieldset in article": "<body><article><h1>{{The card game of the coast}}</h1><p>{{It is played by four, with a pack of forty cards.}}</p><fieldset><legend>{{Scores}}</legend><p>{{A trick with the seven counts double, and the last trick ten.}}</p></fieldset><p>{{Whoever reaches a hundred first has lost.}}</p></article><form action='/s'><input name='q'><button>Search</button></form></body>",
    "cookie bar first": "<body><div class='cookie-consent'><p>We use cookies to make this site better. By going on you agree.</p><button>Accept</button></div><div class='wrap'><h1>{{Opening hours change in winter}}</h1><p>{{From November the museum opens at ten and closes at four.}}</p><p>{{On Mondays it stays closed, except on holidays.}}</p></div></body>",
    "newsletter inside": "<body><main><h1>{{A garden in the shade}}</h1><p>{{Ferns do best, and they ask for nothing but damp.}}</p><div class='newsletter'><p>Get our letter each week!</p><form><input type='email'><button>Sign up</button></form></div><p>{{Plant them in autumn, when the ground is still warm.}}</p></main></body>",
    "adverts between": "<body><div class='story'><p>{{The road climbs for an hour before the trees end.}}</p><div class='ad-slot'>Cheap boots, today only!</div><p>{{Above them there is wind, and a hut with a red door.}}</p><div class='sponsored'><a href='/ad'>Ten hotels you will love</a></div><p>{{The keeper makes soup for whoever arrives by dark.}}</p></div></body>",
    "share bar": "<body><article><h1>{{Bread without kneading}}</h1><div class='social'><a href='/f'>Share</a> <a href='/t'>Post</a></div><p>{{Mix it in the evening and leave it alone until morning.}}</p><p>{{Bake it in a heavy pot, with the lid on for half the time.}}</p></article></body>",
    "french": "<body><nav><a href='/'>Accueil</a> <a href='/c'>Contact</a></nav><article><h1>{{Le marché du samedi}}</h1><p>{{Dès six heures, les premiers marchands s'installent sur la place.}}</p><p>{{On y trouve du miel, des œufs et, au printemps, des asperges.}}</p></article><div class='commentaires comments'><p>Très beau marché, merci.</p></div></body>",
    "german": "<body><div class='kopf header'><a href='/'>Start</a></div><div class='inhalt content'><h1>{{Der alte Bahnhof}}</h1><p>{{Seit vierzig Jahren hält hier kein Zug mehr, doch die Uhr geht noch.}}</p><p>{{Ein Verein kümmert sich um das Haus und um den Garten dahinter.}}</p></div><div class='fuss footer'>Impressum</div></body>",
    "references": "<body><article><h1>{{On the tides}}</h1><p>{{Two tides a day is the rule, but not in every bay.<sup><a href='#1'>1</a></sup>}}</p><p>{{In some the second is so small that few notice it.}}</p></article></body>",
    "code": "<body><article><h1>{{Counting lines}}</h1><p>{{One command is enough for most files:}}</p><pre>{{wc -l notes.txt}}</pre><p>{{It prints a number, and the name of the file.}}</p></article><div class='sidebar'><h4>Tags</h4><a href='/t'>shell</a></div></body>",
    "figure": "<body><article><h1>{{The mill at dusk}}</h1><figure><img src='m.jpg'><figcaption>{{The wheel, seen from the bridge.}}</figcaption></figure><p>{{It stopped in 1951, when the last miller died.}}</p><p>{{The stones are still there, under a roof of ivy.}}</p></article></body>",
    "forum post": "<body><div class='navbar'><a href='/f'>Forum</a></div><div class='post'><h1>{{Which oil for an old bicycle?}}</h1><p>{{The chain is from the sixties and I do not want to ruin it.}}</p><p>{{I have tried the thin one and it drips all over the floor.}}</p></div><div class='replies'><div class='reply'><p>Use the thick one, and less of it.</p></div><div class='reply'><p>Any oil will do.</p></div></div></body>",
    "recipe": "<body><main><h1>{{Leek soup}}</h1><ul class='ingredients'><li>{{Three leeks}}</li><li>{{One large potato}}</li><li>{{Salt, pepper}}</li></ul><div class='steps'><p>{{Cut the leeks thinly and wash them twice.}}</p><p>{{Cook all for twenty minutes and press it through a sieve.}}</p></div></main><aside><h3>More soups</h3><ul><li><a href='/1'>Onion soup</a></li><li><a href='/2'>Pea soup</a></li></ul></aside></body>",
    "press release": "<body><div class='logo'><img src='l.png'></div><div class='release'><p><b>{{Bergen, 4 May.}}</b></p><p>{{The company will build forty ships in the next ten years, it said on Friday.}}</p><p>{{The first is to sail in the autumn of next year.}}</p></div><div class='legal'>This text holds statements about the future.</div></body>",
    "login box": "<body><div class='login'><form><label>Name</label><input name='u'><label>Password</label><input type='password'><button>Log in</button></form></div><article><h1>{{Letters from the lighthouse}}</h1><p>{{My grandfather wrote one each week, and posted them in spring.}}</p><p>{{By then he had forgotten most of what was in them.}}</p></article></body>",
    "sections": "<body><header><h1>Town museum</h1></header><main><section><h2>{{The first room}}</h2><p>{{It holds the tools of the coopers, all of them from one shop.}}</p></section><section><h2>{{The second room}}</h2><p>{{Here are the boats, or what the worms have left of them.}}</p></section></main><footer>Open daily</footer></body>",
    "breadcrumbs": "<body><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/h'>History</a> &gt; Canals</div><div id='main'><h1>{{The canal that was never used}}</h1><p>{{It was dug in nine years, and the railway came in the tenth.}}</p><p>{{Today it is a good place for ducks &amp; herons.}}</p></div></body>",
    "pager": "<body><div class='entry'><h1>{{Part two: the pass}}</h1><p>{{We left before light, with the dogs behind us.}}</p><p>{{Snow had fallen on the upper road, and nobody had crossed it.}}</p></div><div class='pagination'><a href='/1'>1</a> <b>2</b> <a href='/3'>3</a></div><div class='widget'><h3>Popular</h3><ol><li><a href='/p'>Part one: the valley</a></li></ol></div></body>",
    "one paragraph": "<body><nav><a href='/'>Home</a></nav><article><p>{{It rained.}}</p></article><footer>Site of the weather club, since 1999.</footer></body>",
    "long page": "<body><div class='page'><div class='menu'><a href='/1'>One</a><a href='/2'>Two</a></div><div class='text'>" + "".join(f"<p>{{{{Paragraph number {k} says a little more than the one before it, and then it stops.}}}}</p>" for k in range(12)) + "</div><div class='bottom'><a href='/t'>Terms</a></div></div></body>",
    "guest book": "<body><article><h1>{{Our summer by the lake}}</h1><p>{{The house stands on stilts, and the water comes under it.}}</p><p>{{In the evening you can hear the fish.}}</p><div class='guestbook'><p>Lovely house, we will come again!</p><p>Best holiday ever.</p></div></article></body>",
    "nested frames": "<body><div class='outer'><div class='inner'><div class='col-8'><div class='row'><h1>{{A bridge of rope}}</h1><p>{{It is made new each June, by four villages together.}}</p><p>{{The old one is cut and falls into the river.}}</p></div></div><div class='col-4'><h3>Also of interest</h3><ul><li><a href='/a'>Grass roofs</a></li><li><a href='/b'>Stone walls</a></li></ul></div></div></div></body>",
    "font tags": "<body bgcolor='white'><center><font size='5'>{{The clocks of the town hall}}</font></center><p><font face='Times'>{{There are three of them, and no two agree.}}</font><p><font face='Times'>{{The oldest has been wrong since 1840, but it strikes well.}}</font><hr><center><a href='home.htm'>Home</a> | <a href='mail.htm'>Mail</a></center></body>",
}


def page_of(source: str) -> str:
    return source.replace("{{", "").replace("}}", "")


def text_of(source: str) -> str:
    blocks = re.findall(r"\{\{(.*?)\}\}", source, re.S)
    return " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
