"""Main parts against names of classes, and pages whose quotes never end."""

import time

import pytest

from quernstone.llm.html import scan


@pytest.mark.parametrize("page, text", [
    ('<div class="page sidebar"><article>Story here</article></div>', "Story here"),
    ('<main class="content search">Body</main>', "Body"),
    ('<div id="search"><main><p>Found</p></main></div><div class="footer">F</div>', "Found"),
    ('<article>Main text <div class="reader-comments">c</div><div class="post-footer advert-box">a</div><ul class="nav-list"><li>n</li></ul></article>', "Main text"),
    ('<article>Main<div class="user-comments">c1</div></article>', "Main"),
    ('<article>Main</article><section class="reader-replies"><article>c1</article></section>', "Main"),
    ('<section class="comments"><article>first</article><article>second</article></section>', "first second"),
    ('<article><p class="ad">x</p>long story text</article>', "long story text"),
    ('<article hidden>x</article><p>y</p>', "y"),
    ('<article><div class="comments-on-law"><p>All of the article is here and it is long</p></div> End</article>', "All of the article is here and it is long End"),
    ('<article><p class="share-price">Up</p><div class="related-work">Old</div></article>', "Up Old"),
])
def test_main_part(page, text):
    assert scan(page)[0] == text


@pytest.mark.parametrize("piece", ['<b "> "', "<b '> '", '<b "', "<b '> \"", "<a \"'>", "<i '\">\" "])
def test_odd_quotes_take_linear_time(piece):
    took = []
    for n in (30_000, 240_000):
        start = time.perf_counter()
        scan(piece * (n // len(piece)))
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_a_scan_that_found_no_end_hides_no_tag():
    # the first tag has an odd quote; those after it have even ones, and a `>` in them
    page = '<p x="1">a</p><b ">b</b><i title="c>d">e</i><u y=\'>\'>f</u>' + "<p>g</p>" * 3 + "'"
    assert scan(page)[0].startswith("a") and scan(page)[0].count("g") == 3
