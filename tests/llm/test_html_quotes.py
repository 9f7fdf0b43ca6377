import pytest

from tabflow.llm.html import render


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p class=a\">Hello world</p><p>x</p>", "Hello world\n\nx"),
        ("<a href=\"x\"\">text</a> more <b class=\"y\">z</b>", "text more z"),
        ("<div title=it's>Hi, don't go</div>", "Hi, don't go"),
        ("<p class=\"a\"b\">one</p> 'two'", "one\n\n'two'"),
        ("<a ='x'>y</a>'z", "y'z"),
        ("<p title = 'a>b' x=\"c>d\">e", "e"),
        ("<p a\"hidden>seen</p>", "seen"),
    ],
)
def test_stray_quotes_take_no_text(page, want):
    assert render(page)[0].strip() == want
