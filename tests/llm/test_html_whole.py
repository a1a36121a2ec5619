"""Visible text that an open head or a style attribute must not hide."""

from __future__ import annotations

import pytest
from tapeloom.llm import html_text


@pytest.mark.parametrize(("page", "text"), [
    ("<head><title>T</title>Hello", "Hello"), ("<head><title>T</title>\n <a>link</a> text", "link text"),
    ("<head><title>T</title><font size=2><p>whole<p>page", "whole\n\npage"), ("<head><meta a><x-y>b</x-y>c", "bc"),
    ("<head><template>no</template><noscript>no</noscript><link><script>no</script></head>yes", "yes"), ("<head>&nbsp;x", "\xa0x"),
    ("<b style='backface-visibility: hidden'>a</b><b style='x-display:none'>b</b>", "ab"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z", "yes\nz"),
    ("<div style='visibility:collapse'>no<p>no</p><b style='VISIBILITY:Inherit'>no</b></div>yes", "yes"),
    ("<b style=\"content:'; display:none'\">a</b><b style='background:url(x;display:none)'>b</b><b style='/*display:none*/color:red'>c</b>", "abc"),
    ("<b style='display:none;display:block'>a</b><b style='display:none !important;display:block'>no</b><b style='visibility:hidden;visibility:odd'>no</b>", "a"),
    ("<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr><td>d<td>e<td>f</table>", "a     c\nd  e  f"),
])
def test_visible_text_is_kept(page, text):
    assert html_text.extract(page) == text
