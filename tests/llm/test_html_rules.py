"""HTML extraction: odd markup, and every page of the smallest tables against a plain version built on the standard parser."""

import re
import time
from html.parser import HTMLParser

import pytest

from linequarry.llm import html_extraction as hx
from linequarry.llm.common import table

LONG = "This is a paragraph of the text and it is long enough to be good, for it has a lot of the words that are in any text of this kind."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>see <a href="/blog/hidden-costs">the report</a></p></article>', "see the report"),
        ('<article><p title="a hidden gem">a</p><p data-id="comment">b</p><p data-class=ad>c</p></article>', "a\nb\nc"),
        ('<div class="content has-sidebar"><article><p>c</p></article></div><div class="with_comments"><p>d</p></div>', "c"),
        ("<!--><article><p>a</p></article>", "a"),
        ("<article><p>a<!--->b<!-- > -- --!>c</p></article>", "abc"),
        ('<div class="layout sidebar"><main><p>e</p></main></div>', "e"),
        ("<form><article><p>f</p><div class=search>no</div></article></form>", "f"),
        ("<div class=sidebar><article>teaser</article></div><article><p>g</p></article>", "g"),
        ("<div class=related><article>teaser</article></div>", ""),
        ("<head><title>t</title><body><article>h</article>", "h"),
        ("<article><div class='postComments'>no</div><div class=comment_list>no</div><div id=side-bar-2>no</div><div role=complementary>no</div>yes</article>", "yes"),
        ("<article><h1><a href=/>Title</a></h1><p>one</p><ul><li><a href=1>Menu</a><li><a href=2>Menu two</a></ul><p>two</p></article>", "Title\none\ntwo"),
        ("<article><p class=x class=ad>a</p><p CLASS='AD'>b</p><p class='re&#97;dable a&#100;'>c</p></article>", "a"),
        ("<article><p>a</ >b</p><![CDATA[x]]>c <? d > </3e> 1 < 2</article>", "ab\nc 1 < 2"),
        ("<article><i>a<div>b</i>c</div></i>d</article>", "a\nbc\nd"),
    ],
)
def test_odd_markup(page, text):
    assert hx.extract(page) == text


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "</i>" * n, lambda n: "<i>" + "<div>" * n + "</i>" * n, lambda n: "<span hidden>" * n + "<p></p>" * n, lambda n: "<div><b>" * n + "</p>" * n, lambda n: "<p a='" * n, lambda n: "<!--" * n, lambda n: "<div class=ad><article>" * n])
def test_time_is_linear(make):
    began = time.perf_counter()
    hx.extract(make(20_000))
    assert time.perf_counter() - began < 4


def test_rules_decide_where_no_element_does():
    menu = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"
    assert hx.extract(f"<div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>{menu}<p>Far</p></div>") == f"Head\n{LONG}\nShort.\n{LONG}"
    assert hx.extract(f"{menu}<p>Tail</p>") == ""
    assert hx.extract(f"<article><p>{LONG}</p><p>Short.</p>{menu}</article>") == f"{LONG}\nShort."
    assert hx.extract(f"{menu}<p>x</p><p>y</p><p>{LONG}</p>") == f"y\n{LONG}"


class Plain(HTMLParser):
    """Blocks of well-formed enough pages: nav, footer and named parts left out, a new block at each tag that isn't inline."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.text, self.raw, self.links = [], [], "", 0, 0

    def skipped(self):
        return any(x[1] for x in self.open)

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((text, self.links, any(x[0] in ("h1", "h2") for x in self.open), any(x[0] == "article" for x in self.open)))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "br":
            self.text += " "
            return
        if tag in ("meta", "input", "img"):
            self.flush()
            return
        if tag not in ("b", "a", "i"):
            self.flush()
            names = [x[0] for x in self.open]
            while names and names[-1] in ("b", "a", "i"):
                names.pop()
            if names and names[-1] == "p":
                del self.open[len(names) - 1 :]
            else:
                del self.open[len(names) :]
        self.open.append((tag, tag in ("nav", "footer", "script", "style", "head") or a.get("class") == "ad"))

    def handle_endtag(self, tag):
        places = [i for i, x in enumerate(self.open) if x[0] == tag]
        if not places or (tag in ("b", "a", "i") and any(x[0] not in ("b", "a", "i") for x in self.open[places[-1] :])):
            return
        if tag not in ("b", "a", "i"):
            self.flush()
        del self.open[places[-1] :]

    def handle_data(self, data):
        if not self.skipped():
            self.text += data
            if any(x[0] == "a" for x in self.open):
                self.links += len(" ".join(data.split()))


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.flush()
    labels = []
    for text, linked, _, inside in p.out:
        stops = sum(w.strip(".,;:!?\"'()&$#*%") in hx.STOP_WORDS for w in text.lower().split()) / len(text.split())
        if linked > (0.9 if inside else 0.4) * len(text):
            labels.append("bad")
        elif len(text) < 40:
            labels.append("short")
        elif stops >= 0.2 and len(text) >= 120:
            labels.append("good")
        else:
            labels.append("near" if stops >= 0.08 or inside or len(text) < 120 else "bad")
    kept = []
    for i, (text, _, heading, inside) in enumerate(p.out):
        if labels[i] in ("good", "bad"):
            kept.append(labels[i] == "good")
            continue
        decided = [(abs(k - i), labels[k] == "good", k > i) for k in range(len(labels)) if labels[k] in ("good", "bad") and p.out[k][3] == inside]
        near = [min((d for d in decided if d[2] is way), default=None) for way in (False, True)]
        if inside:
            kept.append(any(d is None or d[1] for d in near))
        elif heading and near[1]:
            kept.append(near[1][1])
        elif not any(near):
            kept.append(labels[i] == "near")
        else:
            some = [d for d in near if d]
            kept.append(any(d[1] for d in some if d[0] == min(d[0] for d in some)))
    some = [(t, inside) for k, (t, _, _, inside) in zip(kept, p.out, strict=True) if k]
    if any(inside for _, inside in some):
        some = [x for x in some if x[1]]
    return "\n".join(t for t, _ in some)


def test_all_pages_against_a_plain_version(spark, sf):
    """As they are, and without the article element, where the rules alone decide."""
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    changed = 0
    for page in pages:
        assert hx.extract(page) == plain(page)
        bare = re.sub(r"</?article>", "", page or "")
        assert hx.extract(bare) == plain(bare)
        found, _ = hx.blocks(page or "")
        labels = hx.first_pass(found)
        changed += any(x in ("short", "near") and k for x, k in zip(labels, hx.second_pass(found, labels), strict=True))
    assert changed > 0.9 * len(pages)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<article>a</article>", "own", 7, "t")], "page_id long, html string, text string, n_chars long, label string")
    r = hx.extracted(df).collect()
    assert [(x.text, x.n_chars, x.label) for x in r] == [("a", 1, "t")]
    assert hx.extracted(df.limit(0)).count() == 0
