"""Links of pages against urllib."""

import html
from urllib.parse import urldefrag, urljoin

from tandem.llm import urlfilter

LINKS = ["http://h.org/p?a=1&b=2", "http://h.org/p?a=1&b=3", "/p;v=1/q;w", "page.html", "?id=3", "../x", "../../../y/./z/..", "//o.net/a", "#top", "a b/c;d?e=f#g", "./", "HTTP://H.org/Q"]


def test_links_are_whole_and_resolved(spark):
    pages = ["http://s.org/a/b/c.html?q=1", "https://s.org", "http://s.org/d/"]
    rows, expected = [], set()
    for page in pages:
        for i, link in enumerate(LINKS):
            text = html.escape(link)
            rows.append((page, [f"<meta http-equiv='refresh' content=\"0; url={text}\">", f'<META content="5;URL=\'{text}\'" HTTP-EQUIV=refresh>', f'<link rel="x canonical" href="{text}">'][i % 3]))
            target = urldefrag(urljoin(page, link))[0].replace("H.org", "h.org").replace("HTTP:", "http:")
            if target != page:
                expected.add((page, target))
    rows += [(pages[0], '<link rel="icon" href="canonical.png">'), (pages[0], '<meta name="refresh" content="0;url=/no">'), (pages[0], None)]
    found = {tuple(r) for r in urlfilter.declared_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found == expected


def test_hidden_links_and_bases(spark):
    page, to = "http://s.org/a/b", "http://s.org/x/2"
    link = '<link rel="nofollow canonical" href="2">'
    rows = [
        (page, f'<base target=_top href="/x/y">{link}', to), (page + "1", f"<!-- {link} -->", None), (page + "2", f"<script>var a = '{link}'</script >", None), (page + "3", f"<style>{link}", None),
        (page + "4", f"<!-- a --><link rel=canonical href='http://o.net/?a=1&amp;b=>'><!-- {link}", "http://o.net/?a=1&b=>"), (page + "5", "<link " + "x='>' " * 20_000 + ' rel=canonical href="/long">', "http://s.org/long"),
        (page + "6", "<title>" + link + "</title>" + "y" * 300_000 + '<link rel=canonical href="/z">', "http://s.org/z"), (page + "7", "<link rel=canonical href", None),
    ]
    found = {tuple(r) for r in urlfilter.declared_links(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()}
    assert found == {(a, b) for a, _, b in rows if b}
