"""Labelled text blocks from which the tree of html_main is grown: sketches of invented pages, judged by hand.

In a sketch +60 stands for 60 words of main text and -3 for three words that aren't; all else is markup.
"""

SKETCHES = [
    # a menu, an advert, an article whose paragraphs have any length, a foot
    "<nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav><div class=ad>-8</div><article><h1>+9</h1><p>+60</p><p>+2</p><p>+35</p><p>+1</p><p>+4</p></article><footer>-11</footer>",
    "<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-14</div><article><h1>+5</h1><p>+1</p></article><footer>-24</footer>",
    "<nav><a>-2</a> <a>-1</a></nav><div class=ad>-6</div><article><h1>+1</h1><p>+240</p><p>+18</p><p>+75</p></article><footer>-3</footer>",
    "<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-11</div><article><p>+7<p>+12<p>+6<p>+3</article><footer>-16</footer>",
    # a weblog: heads, notes about the post, side column, reader comments
    "<header class=site-header><a>-2</a><p>-6</p><nav><ul><li><a>-1</a><li><a>-1</a><li><a>-3</a></ul></nav></header><main><article class=post><header class=entry-header><h1>+7</h1></header><div class=entry-content>"
    "<p>+52<a>+3</a>+20</p><h2>+4</h2><p>+33</p><ul><li>+6<li>+9<li>+4</ul><blockquote><p>+27</p></blockquote><figure><figcaption>+8</figcaption></figure><p>+70</p></div></article>"
    "<section id=comments><h2>-2</h2><article class=comment><p>-2</p><p>-44</p></article><article class=comment><p>-2</p><p>-18</p></article><form><label>-2</label><button>-2</button></form></section></main>"
    "<aside class=sidebar><h3>-2</h3><ul><li><a>-5</a><li><a>-6</a></ul><p>-30</p></aside><footer><p>-9</p></footer>",
    "<header><h1>-3</h1></header><article><h2>+6</h2><p>+41</p><p>+5</p><div class=share><a>-1</a><a>-1</a></div><div class=ad><p>-22</p></div><p>+38</p><p>+3</p></article><div class=comments><div><b>-2</b><p>-35</p></div><div><b>-1</b><p>-61</p></div></div><footer>-8 <a>-2</a></footer>",
    # link lists inside an article
    "<article><h1>+8</h1><p>+64</p><ul><li><a>-5</a><li><a>-7</a><li><a>-4</a></ul><p>+29</p></article>",
    "<main><nav class=breadcrumb><a>-1</a> <a>-2</a></nav><h1>+5</h1><p>+22<a>+4</a></p><p>+90</p><ul class=related><li><a>-6</a><li><a>-8</a></ul><ul><li><a>-3</a><li><a>-6</a><li><a>-9</a></ul></main><footer><a>-1</a> <a>-1</a></footer>",
    "<article><h1>+4</h1><p>+48</p><p><a>-12</a></p><p>+57</p><p>+10<a>+6</a></p><div><a>-2</a> <a>-3</a> <a>-2</a></div></article>",
    # columns known by names
    "<div id=header><a>-2</a> -4</div><div id=menu><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></div><div id=content><h2>+5</h2><p>+44</p><p>+16</p><p>+7</p><table><tr><td>+2</td><td>+3</td></tr><tr><td>+2</td><td>+4</td></tr></table></div><div id=sidebar><p>-26</p><ul><li><a>-4</a></ul></div><div id=footer>-12</div>",
    "<div class=cookie-banner><p>-28</p><button>-1</button></div><div class=topbar><a>-1</a> <a>-2</a></div><div class=main-content><h1>+10</h1><p>+85</p><p>+66</p><pre>+30</pre><p>+12</p></div><div class=newsletter><h3>-4</h3><p>-17</p><form><label>-2</label></form></div><div class=social><a>-1</a><a>-1</a></div>",
    "<div class=entry><h1>+3</h1><dl><dt>+2<dd>+20<dt>+1<dd>+34</dl></div><div class=footer><p>-7</p><p>-3</p></div>",
    # nothing is named: only the blocks and their neighbours tell
    "<ul><li><a>-1</a><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h1>+6</h1><p>+58</p><p>+77</p><p>+31</p><p><a>-1</a> <a>-1</a> <a>-2</a></p>",
    "<p><a>-2</a> <a>-1</a> <a>-1</a></p><h1>+9</h1><p>+24</p><p>+110</p><h2>+3</h2><p>+36</p><p>+8</p><p>+49</p><div>-5 <a>-2</a></div>",
    "<div>-3</div><div><a>-1</a> <a>-2</a> <a>-1</a></div><h2>+5</h2><div>+46</div><div>+83</div><div>+21</div><div><a>-2</a> <a>-2</a></div><div>-6</div>",
    "<h1>+7</h1><p>+39</p><p>+14</p><p>+62</p><p>+26</p>",
    "<h1>+4</h1><p>+19</p><h2>+2</h2><p>+43</p><h2>+6</h2><p>+28</p><p>+11</p><p>+55</p>",
    "<div><a>-1</a></div><div><a>-1</a></div><div>-2</div><div><a>-3</a></div><div>-4</div><div><a>-2</a></div><div>-1</div>",
    "<table><tr><td><a>-1</a><td><a>-2</a><td><a>-1</a></tr></table><table><tr><td><h1>+6</h1><p>+71</p><p>+32</p><p>+17</p><p>+45</p></td></tr></table><p>-4 <a>-1</a> <a>-1</a></p>",
    "<p>+33</p><p>+9</p><p>+27</p><p>+41<a>+2</a>+10</p><p><a>-4</a></p><p><a>-3</a></p>",
    "<ul><li><a>-2</a><li><a>-3</a></ul><h1>+5</h1><p>+130</p><ul><li>+12<li>+18<li>+9</ul><p>+47</p><ul><li><a>-5</a><li><a>-4</a><li><a>-6</a></ul>",
    "<div>-2 <a>-1</a></div><div><a>-1</a> <a>-1</a></div><h1>+11</h1><p>+38</p><p>+6</p><p>+51</p><p>+4</p><p>+88</p><div><a>-1</a> <a>-1</a> <a>-1</a></div><div>-7</div>",
    "<h3>-2</h3><ul><li><a>-4</a><li><a>-5</a><li><a>-3</a></ul><h3>-1</h3><ul><li><a>-2</a><li><a>-2</a></ul><p>-3</p>",
    "<div><a>-2</a> <a>-2</a></div><div>+210</div><div>+95</div><div><a>-1</a></div>",
    "<p>-2</p><p><a>-1</a> <a>-1</a></p><h2>+8</h2><p>+25<a>+5</a></p><p>+34<a>+8</a>+12</p><p>+20</p><p>+13</p><p>+29</p><p><a>-6</a></p><p><a>-7</a></p><p>-5</p>",
    # a single paragraph
    "<p>+40</p>",
    "<div>+26</div>",
    "<h1>+5</h1><p>+33</p>",
    "<nav><a>-1</a> <a>-2</a></nav><p>+64</p><footer>-5</footer>",
    "<p><a>-1</a> <a>-1</a></p><p>+52</p>",
    "<h1>-3</h1><p><a>-2</a></p>",
    "<p>-4</p>",
    # forms, dialogs and notices before and after; pages without an article at all
    "<form><label>-1</label><label>-1</label><button>-2</button></form><p>-4</p><footer>-8</footer>",
    "<dialog><p>-40</p><button>-1</button></dialog><main><h1>+2</h1><p>+5</p><p>+3</p></main>",
    "<nav><a>-1</a> <a>-1</a></nav><ul><li><a>-3</a><li><a>-4</a><li><a>-2</a></ul><footer><a>-2</a></footer>",
    "<div class=notice><p>-19</p></div><section><h2>+4</h2><p>+56</p><p>+23</p><p>+37</p></section><section class=reviews><p>+18</p><p>+40</p></section><aside><p>-54</p></aside>",
    "<div class=promo><p>-33</p><p>-12</p></div><article><p>+15</p><p>+28</p></article><div class=disclaimer><p>-70</p></div><div class=copyright>-6</div>",
    # linked sentences and short last paragraphs of articles; menus, notices, feet and comments with links beside them
    "<nav><a>-2</a> <a>-3</a> <a>-2</a> <a>-4</a> <a>-2</a></nav><article><h1>+6</h1><p>+40</p><p>+1<a>+2</a>+2</p><p>+55</p><p>+7</p></article><footer>-9 <a>-2</a> <a>-3</a> <a>-4</a></footer>",
    "<header><a>-3</a><nav><a>-1</a> <a>-1</a> <a>-2</a> <a>-3</a> <a>-2</a> <a>-6</a></nav></header><div class=cookie-bar>-14 <a>-2</a> -5 <a>-3</a></div><main><h1>+4</h1><p>+25</p><p>+4<a>+9</a></p><p>+3<a>+1</a></p></main><footer><a>-4</a> <a>-6</a> <a>-5</a></footer>",
    "<article><h1>+1</h1><p>+40</p><p>+7</p></article>",
    "<article><h1>+2</h1><p>+12</p></article>",
    "<article><h2>+5</h2><p>+16</p><p>+3</p></article><div class=comments><p>-20 <a>-3</a> -11</p><p>-3 <a>-2</a></p><p>-40</p></div>",
    "<article><p>+31</p><p>+6<a>+5</a></p></article><section id=comments><h3>-2</h3><p><a>-2</a> -6</p><p>-9 <a>-1</a></p><p><a>-1</a> -28</p></section><footer>-16 <a>-2</a></footer>",
    "<div class=notice>-6 <a>-3</a></div><div class=content><h1>+3</h1><p><a>+7</a></p><p>+60</p><p><a>+14</a></p><p>+2</p></div><div class=sidebar><p>-9 <a>-4</a></p><p><a>-16</a></p></div>",
    "<div class=popup><p>-18 <a>-2</a></p></div><article><p>+20<a>+20</a></p><p>+5<a>+3</a>+4</p></article><aside><p>-30 <a>-8</a></p><p><a>-22</a></p></aside>",
    "<nav>-1 <a>-2</a> -1 <a>-2</a> -1 <a>-3</a></nav><article><h1>+8</h1><p>+9</p></article><footer><p>-25 <a>-2</a></p><p>-3</p></footer>",
    # the same with nothing named
    "<div><a>-2</a> <a>-3</a> <a>-2</a> <a>-4</a> <a>-2</a></div><h1>+6</h1><p>+40</p><p>+4<a>+2</a>+8</p><p>+55</p><p>+17</p><div>-3 <a>-2</a> <a>-3</a> <a>-4</a></div>",
    "<p><a>-3</a> <a>-1</a> <a>-1</a> <a>-2</a> <a>-3</a> <a>-2</a> <a>-6</a></p><h1>+4</h1><p>+25</p><p>+24<a>+9</a></p><p>+43<a>+6</a></p><p><a>-4</a> <a>-6</a> <a>-5</a></p>",
    "<div><a>-1</a> <a>-1</a></div><h2>+7</h2><p>+38</p><p>+12<a>+3</a>+6</p><p>+29</p><p>+14</p><p>+66<a>+12</a></p><div><a>-9</a></div><div><a>-13</a></div><div><a>-8</a></div>",
    "<h1>+5</h1><p>+18<a>+2</a></p><p>+31</p><p>+14<a>+4</a>+20</p><p>+22</p>",
    "<div>-2 <a>-3</a> -2 <a>-5</a></div><div>+46</div><div>+30<a>+7</a>+11</div><div>+83</div><div>+19<a>+3</a></div><div>-2 <a>-4</a> <a>-2</a></div>",
    "<ul><li><a>-14</a><li><a>-12</a><li><a>-16</a></ul><h1>+9</h1><p>+90</p><p>+50<a>+2</a></p><p>+35</p><ul><li><a>-13</a><li><a>-18</a></ul>",
    # articles of paragraphs of all lengths in any order
    "<nav><ul><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-9</div><article><h1>+7</h1><p>+1</p><p>+48</p><p>+2</p><p>+19</p><p>+1</p><p>+161</p><p>+2</p><p>+8</p><p>+3</p></article><footer>-14</footer>",
    "<article><h1>+12</h1><p>+1</p><p>+94</p><p>+31</p><p>+1</p><p>+5</p><p>+129</p><p>+9</p><p>+2</p><p>+45</p><p>+1</p></article><footer>-18</footer>",
    "<main><h1>+4</h1><p>+20</p><p>+2</p><p>+53</p><p>+17</p><p>+1</p><p>+8</p><p>+60</p><p>+22</p><p>+2</p><p>+139</p><p>+46</p><p>+1</p><p>+173</p></main><aside>-12</aside>",
    "<article><p>+3</p><p>+253</p><p>+4</p><p>+1</p><p>+86</p><p>+45</p><p>+2</p><p>+7</p><p>+12</p><p>+2</p><p>+19</p><p>+242</p><p>+4</p></article><footer>-7</footer>",
    "<article><h1>+9</h1><p>+15</p><p>+6</p><p>+10</p><p>+2</p><p>+13</p><p>+4</p><p>+1</p><p>+27</p><p>+2</p><p>+1</p></article><footer>-21</footer>",
    "<div class=post><h2>+3</h2><p>+5</p><p>+1</p><p>+2</p><p>+6</p><p>+1</p><p>+14</p><p>+3</p></div><div class=comments><p>-2</p><p>-24</p><p>-1</p><p>-51</p><p>-3</p><p>-8</p></div>",
    # plain pages that end with text, or with a few words and links
    "<h1>+6</h1><p>+44</p><p>+25</p><p>+40</p>",
    "<div><a>-1</a> <a>-2</a></div><h1>+5</h1><p>+30</p><p>+62</p><p>+38</p>",
    "<h2>+4</h2><p>+52</p><p>+37</p><div>-1 <a>-3</a> <a>-1</a></div>",
    "<h1>+8</h1><p>+41</p><p>+33</p><p>+47</p><p>-2 <a>-2</a> <a>-4</a></p>",
    "<p><a>-2</a> <a>-1</a></p><h1>+3</h1><p>+59</p><p>+45</p><p>-1 <a>-1</a> <a>-2</a> <a>-1</a></p>",
]
