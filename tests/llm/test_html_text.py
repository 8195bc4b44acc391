import numpy as np
from lodestream.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>one<li>two</ul></nav><!-- <p>no</p> --><div class="ad">buy <div>more</div> now</div>
<div id="cookie-notice">We use cookies</div><article class="post"><header class="entry-header"><h1>Ti&eacute;tle&nbsp; x</h1></header><p><b>bold
  text<br><p>second &lt;p&gt; &amp;amp; <a href="a>b">li<i>nk</i></a>ed<ul><li>i1<li>i2</ul><form><input value="x">Name</form><aside>side</aside>
<div class="comments"><p>first!</div><p>last &quot;one&quot;</article><section id="comments"><article>reader</article></section><footer>&copy; f</footer></body></html>"""


def test_zones_of_a_marked_page():
    got = H.blocks(PAGE)
    assert [b.text for b in got if b.zone == H.ARTICLE] == ["Tiétle x", "bold text", "second <p> &amp; linked", "i1", "i2", 'last "one"']
    assert not {"reader", "first!", "Name", "© f", "side"} & {b.text for b in got if b.zone < H.CHROMED}
    assert H.main_texts([PAGE]) == ["Tiétle x\nbold text\nsecond <p> &amp; linked\ni1\ni2\nlast \"one\""]


def texts(html):
    return [b.text for b in H.blocks(html)]


def test_odd_markup():
    assert H.blocks(None) == H.blocks("") == []
    assert texts("just text < 3 &amp; more") == ["just text < 3 & more"]
    assert texts("<p>a<p>b<div>c") == list("abc") and texts("<table><tr><td>a</td><td>b</td></tr></table>") == ["a b"]
    assert texts("<article><p>x</article") == ["x"]
    assert texts('<p title="a > b">x</p><p title="open>y</p><p>z</p>') == ["x", "y", "z"]
    assert H.main_texts(["<p>x<span hidden>gone</span> y</p>"]) == ["x\ny"]


def test_class_names_and_titles_decide_nothing():
    for html in ('<div class="content no-sidebar"><p>a b c</p></div>', '<article class="post related-links"><p>a b c</p></article>',
                 '<article><section class="legal"><p title="a hidden gem">a b c</p></section></article>', "<main><header><h1>a b c</h1></header></main>"):
        assert H.main_texts([html]) == ["a b c"]
    assert H.main_texts(["<main><p>long own text of the main part which is more</p><article><p>teaser words</p></article></main>"])[0].startswith("long own text")


def test_what_two_stories_share_stays():
    idiom = ["<p>Our goalkeeper knew at the end of the day it is only football.</p>", "<p>They said at the end of the day we had lost.</p>"]
    assert H.main_texts(idiom) == [h[3:-4] for h in idiom]
    story = "<div><p>one and the same story on two pages of a host</p></div>"
    assert H.main_texts([story, story + "<!-- other -->"]) == ["one and the same story on two pages of a host"] * 2
    assert len(set(H.main_texts([f"{story}<i>{'x' * i}</i>" for i in range(1, 9)]))) == 8  # many copies: none is emptied


def test_parsing_is_linear():
    import time

    for piece in ("<a ", "<div>", "<p title=\"", "<p title='\">", "</div>", "<script>", "<!--", "<ul><li>x", "<b><i>"):
        start = time.perf_counter()
        H.main_texts([piece * 40_000])
        assert time.perf_counter() - start < 8, piece


def test_repeats_match_brute_force():
    rng = np.random.default_rng(2)
    for need in (2, 3, 5):
        for depth in (1, 2, 3, 5, 8, 12):
            tokens, pages = rng.integers(0, 3 if depth < 6 else 2, 150), np.sort(rng.integers(0, 6, 150))
            on = {}
            for i in range(151 - depth):
                if pages[i + depth - 1] == pages[i]:
                    on.setdefault(tuple(tokens[i : i + depth].tolist()), set()).add(int(pages[i]))
            want = [i + depth <= 150 and pages[i + depth - 1] == pages[i] and len(on[tuple(tokens[i : i + depth].tolist())]) >= need for i in range(150)]
            assert H.repeats(tokens, pages, depth, need).tolist() == want
            covered = H.covered_by(np.array(want), depth)
            assert covered.tolist() == [any(want[max(0, i - depth + 1) : i + 1]) for i in range(150)]
            assert H.repeats(tokens, pages, depth, need, covered).tolist() == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    menu, foot = "<p>Home about us contact our whole team</p>", "<p>All rights of this site are reserved</p>"
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>unique words of page number {i} alone{i} x{i}</p>{foot}") for i in range(6)]
    rows += [(9, "http://other.example/1", f"{menu}<p>another host</p>")]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows).repartition(4)).collect()}
    assert got[9] == "Home about us contact our whole team\nanother host"
    assert all(got[i] == f"unique words of page number {i} alone{i} x{i}" for i in range(6))
    assert {r.page_id: r.text for r in H.extract(pages(spark, rows).repartition(1)).collect()} == got


def test_a_side_position_goes_where_it_is_repeated_and_marked_pages_teach_the_rest():
    """Menus in plain containers: three of a position's texts are each on several pages, none on a share of all."""
    rows = [f"<div class='m'><a>go to part {i % 4} of the site now</a></div><div><p>{' '.join(f'w{i}x{j}' for j in range(30))}</p></div>" for i in range(24)]
    assert H.main_texts(rows) == [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(24)]
    marked = [f"<div class='a'>unique {i} advert{i} text {i}</div><article><p>{' '.join(f'w{i}x{j}' for j in range(30))}</p></article>" for i in range(9)]
    assert H.main_texts([*marked, "<div class='a'>one more advert</div><section><p>story without a mark</p></section>"])[-1] == "story without a mark"


def test_shared_article_text_stays(spark):
    rows = [(i, "http://h.example/x", "<nav>a b c d e f g</nav><article><p>the same long text on all of the pages</p></article>") for i in range(9)]
    assert {r.text for r in H.extract(pages(spark, rows)).collect()} == {"the same long text on all of the pages"}
    lead = "<p>a passage of a dozen words that each of these articles has at its head</p>"
    got = H.main_texts([f"<article>{lead}<h1>Same title on all of the pages</h1><p>{' '.join(f'w{i}x{j}' for j in range(30))}</p></article>" for i in range(9)])
    assert all(t.startswith("a passage of a dozen") and "Same title" in t for t in got)


def test_one_id_with_two_texts_and_small_shards(spark):
    rows = [(1, "http://h.example/x", "<p>zulu yankee xray whisky victor uniform tango</p>"), (1, "http://h.example/x", "<p>tango</p>"), (1, "http://h.example/x", "<p>tango</p>")]
    for shard in (10, 10_000):
        assert sorted(r.text for r in H.extract(pages(spark, rows), shard=shard).collect()) == ["tango", "tango", "zulu yankee xray whisky victor uniform tango"]


def words(tag, n=30):
    return " ".join(f"{tag}{j}" for j in range(n))


def test_reader_comments_by_name_and_by_structure():
    for part in ('<ol class="commentlist"><li>so true</li></ol>', '<div class="comment-list"><p>so true</p></div>', '<div id="disqus_thread"><p>so true</p></div>',
                 '<div class="responses"><p>so true</p></div>', "<article><p>so true</p><a>Reply</a></article>",
                 "<ul><li><b>Ann</b><p>so true</p><p>Reply</p></li><li><b>Bob</b><p>not at all</p><p>Reply</p></li></ul>"):
        assert H.main_texts([f"<article><h1>Title</h1><p>{words('w')}</p>{part}</article>"]) == [f"Title\n{words('w')}"], part
    kept = f"<article><p>{words('w')}</p><p>They sent no reply</p><p>He would not reply</p><p>comment was free</p><p class='commentary'>last</p></article>"
    assert H.main_texts([kept]) == [f"{words('w')}\nThey sent no reply\nHe would not reply\ncomment was free\nlast"]


def test_live_blogs_keep_their_entries_and_articles_lose_their_readers():
    entries = "".join(f"<article><h2>{i} pm</h2><p>{words(f'e{i}x')}</p></article>" for i in range(3))
    assert H.main_texts([f"<article><h1>Live</h1>{entries}</article>"]) == ["Live\n" + "\n".join(f"{i} pm\n{words(f'e{i}x')}" for i in range(3))]
    assert len(H.main_texts([f"<article><h1>Live</h1>{entries}<form><input></form></article>"])[0]) > 300
    assert H.main_texts([f"<article><h1>Live</h1>{entries}<form><textarea></textarea></form></article>"]) == ["Live"]
    assert H.main_texts([f"<article><h1>Story</h1><p>{words('w', 200)}</p>{entries}</article>"]) == [f"Story\n{words('w', 200)}"]


def test_a_page_with_nothing_but_the_menu_of_its_host_is_empty():
    menu = "<p>Home about us contact our whole team</p>"
    got = H.main_texts([*[f"{menu}<p>{words(f'w{i}x')}</p>" for i in range(6)], menu, f"{menu}<!-- -->"])
    assert got == [*[words(f"w{i}x") for i in range(6)], "", ""]


def test_repeated_notices_in_articles_go_and_passages_stay():
    for line, stays in (("Sign up for our newsletter and never miss one of our stories", False), ("The quick brown fox jumps over the lazy dog once more today", True)):
        got = H.main_texts([f"<article><p>{words(f'w{i}x')}</p><p>{line}</p></article>" for i in range(9)])
        assert got == [words(f"w{i}x") + (f"\n{line}" if stays else "") for i in range(9)]
    assert "newsletter" in H.main_texts([f"<article><p>{words(f'w{i}x')} newsletter</p></article>" for i in range(9)])[0]


def test_positions_are_whole_chains():
    deep = "<div><ul><li><div><div><div><div><div><div><p>x</p></div></div></div></div></div></div></li></ul></div>"
    a, b = H.blocks(deep + deep.replace("<ul>", "<ul class='other'>"))
    assert a.path != b.path and len({x.path for x in H.blocks(deep + deep)}) == 1


def test_odd_tables(spark):
    rows = [(None, None, None), (1, None, "<p>x</p>"), (1, "u", ""), (2, "http://a/b", "<p>" + "y " * 50_000), (2, "http://a/b", "<p>" + "y " * 50_000)]
    out = H.extract(pages(spark, rows).selectExpr("*", "1 as uid", "'z' as host", "'q' as text", "1 as h")).collect()
    assert len(out) == len(rows) and sorted(len(r.text) for r in out) == [0, 0, 1, 99_999, 99_999]
    assert {r.page_id for r in out} == {None, 1, 2}
    assert H.extract(pages(spark, [])).count() == 0


def test_the_size_of_the_parts_changes_no_result(spark):
    """menus, notices, side positions, blank pages and copies are told from the whole host, whatever its parts hold."""
    menu, foot = "<p>Home about us contact our whole team</p>", "<p>All rights of this site are reserved</p>"
    htmls = [f"{menu}<p>{words(f'w{i}x')}</p>{foot}" for i in range(12)]
    htmls += [f"<ul><li>go to part {i % 4} of the site now</li></ul><div><p>{words(f'v{i}x')}</p></div>" for i in range(12)]
    htmls += [f"{menu}{'<!-- -->' * i}" for i in range(3)] + [f"<article><p>{words('copy')}</p><p>Sign up for our newsletter today</p></article>"] * 9
    htmls += [f"<article><p>{words(f'u{i}x')}</p><p>Sign up for our newsletter and read more</p></article>" for i in range(14)]
    rows = [(i, "http://h.example/x", h) for i, h in enumerate(htmls)] + [(900 + i, f"http://o{i}.example/x", menu) for i in range(3)]
    want = dict(enumerate(H.main_texts(htmls))) | {900 + i: "Home about us contact our whole team" for i in range(3)}
    assert want[0] == words("w0x") and want[12] == words("v0x") and want[24] == "" and want[40] == words("u4x")
    for shard, least in ((10**9, 1), (1_500, 1), (100, 1)):
        assert {r.page_id: r.text for r in H.extract(pages(spark, rows), shard=shard, least=least).collect()} == want, shard


def test_a_page_in_eighty_speaks_for_its_position_on_large_hosts():
    assert [H._few(n) for n in (1, 240, 241, 8_000)] == [3, 3, 4, 100] and H._need(8_000, 0.3) == 2_400
    part = H.Part(list(map(H.Packer(), [f"<p>{words(f'w{i}x', 5)}</p>" for i in range(5)])), 5, 12, 0.3)
    assert len(part.candidates(False)[5]) == 10 and not part.candidates(True)[5].size  # two runs of five tokens a page
