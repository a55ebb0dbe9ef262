"""Self-closed and unclosed raw elements lose no text."""

import pytest

from lumenlake.llm import html


@pytest.mark.parametrize(
    "inner, text",
    [
        ("One <svg class='a'/>two <svg><style>no</style><text>and</text></svg> three", "One two and three"),
        ("Take <math>x</math> and <noscript>fallback words</noscript> here", "Take x and fallback words here"),
        ("One <object data='a.swf'>film</object> two <textarea>no</textarea>three", "One film two three"),
        ("One <math/>two", "One two"),
        ("Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> be", "Let x=2x = 2 be"),
        *((f"One <{t}>two", "One two") for t in ("noscript", "object", "template", "canvas")),
        ("One <canvas>no</canvas>two <canvas>three", "One two three"),
        ("One <script>no < never", "One"),
    ],
)
def test_text_after_raw_elements(inner, text):
    closed = "" if "<script" in inner else "</p><p>End.</p></article>"
    assert [b.text for b in html.blocks(f"<article><p>{inner}{closed}")] == [text] + (["End."] if closed else [])
