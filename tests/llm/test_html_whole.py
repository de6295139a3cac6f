import time

from tallyspark.llm import html_extract


def texts(page):
    return [t for t, _, _ in html_extract.leaves(page)]


def test_long_attribute_values():
    for quote in "\"'":
        page = f"<article><div class=body data-props={quote}{'{a > b} ' * 2000}{quote}><p>one</div><p>two</article>"
        got = html_extract.leaves(page)
        assert [t for t, _, _ in got] == ["one", "two"]
        assert ("div", "body") in got[0][1] and ("div", "body") not in got[1][1]


def test_names_that_begin_like_raw_elements():
    for name in ("video-player", "svg-icon", "template-x", "title-bar"):
        assert texts(f"<article><p>one</p><{name}></{name}><p>two") == ["one", "two"]
        assert texts(f"<article><p>one</p><{name} a='b'>in</{name}><p>two") == ["one", "in", "two"]
    for name in ("svg", "math", "SVG"):
        assert texts(f'<p>one <{name} a="b>c" />two</p><p>three</p>') == ["one two", "three"]
        assert texts(f"<p>one</p><{name}/><p>two</p>") == ["one", "two"]
        if name != "math":
            assert texts(f"<p>one</p><{name} a='/'><path d='x'/>no</{name}><p>two</p>") == ["one", "two"]
    assert texts("<p>area is <math><mi>x</mi></math> units</p>") == ["area is x units"]  # formulas are text of the article
    assert texts("<p>one</p><script>a<b</script><p>two") == ["one", "two"]


def test_unclosed_quotes_take_no_square_time():
    began = time.time()
    for piece in ('<p a="', "<p a='b\">", '<svg a="', "<svg a='\">x"):
        html_extract.leaves(piece * 20001)
    assert time.time() - began < 20
