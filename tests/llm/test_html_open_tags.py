import time

from tidemark.llm import html


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_open_drawings_and_formulas_lose_nothing_after_them():
    for tag in ("svg", "math", "template", "noscript"):
        assert texts(f"<article><p>one <{tag} class='x'> two</p><p>three</p></article>") == ["one two", "three"]
    assert texts("<p>a <math><mi>x</mi></math> b</p><noscript><p>c</p></noscript><svg><text>d</text></svg><p>e</p>") == ["a x b", "c", "e"]
    assert texts("<p>a</p><script>let x = '<p>b</p>'") == ["a"]


def test_training_reads_to_the_end_of_a_page():
    assert list(html.spread(5)) == [0, 1, 2, 3, 4]
    at = html.spread(1000)
    assert len(at) == html.TRAIN_BLOCKS and at[0] == 0 and at[-1] == 999 and len(set(at)) == len(at)


def test_quotes_count_after_an_equals_sign_only():
    assert texts("<p data-x=it's>First.</p><p>It's second.</p>") == ["First.", "It's second."]
    assert texts("<p title=\"a > b\" class='c>d' id = \"e\">x</p><p \"y>z\">w</p>") == ["x", 'z">w']
    assert texts("<p>a</p><p title=\"never closed>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><p class='x") == ["a"]


def test_deep_pages_take_room_and_time_in_proportion():
    def took(n):
        began = time.process_time()
        page = html.blocks("<div class='a b'>a</i></p>" * n)
        x = html.vectors(page)
        assert len(page) == n and x.shape[0] == n
        return time.process_time() - began

    took(1000)
    assert took(50_000) < 60 and page_depth() == 50_000


def page_depth():
    node, n = html.blocks("<div>a" * 50_000)[-1].node, 0
    while node.parent is not None:
        node, n = node.parent, n + 1
    return n


def test_pages_share_nodes_until_there_are_many():
    for k in range(60):
        page = html.blocks("".join(f"<div class='c{k}x{i}'><p>t{i}</p></div>" for i in range(1000)))
        assert [b.text for b in page] == [f"t{i}" for i in range(1000)] and page[7].path == f"div c{k}x7/p"
    assert html.Node.made <= 53_000


def test_comments_end_as_html_ends_them():
    assert texts("<p>a<!-- x --!>b</p><p>c</p>") == ["ab", "c"]
    assert texts("<!--><p>kept?</p>") == ["kept?"] and texts("<p>a<!--->b</p><p>c") == ["ab", "c"]
    assert texts("<p>a<!-- <p>x</p> --><b>b</b><!-- never ended <p>c</p>") == ["ab"]
    assert texts("<p>a<!---->b<!-- - -- > -->c<!----!>d</p>") == ["abcd"]
