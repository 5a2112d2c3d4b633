"""Which blocks of a page are its article: templates, evidence of tags and names, copies."""

from collections import defaultdict

import pytest

from answerframe.llm import extract

SCHEMA = "page_id long, url string, html string, text string, n long, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA)


def texts(found):
    return {r.page_id: r.text for r in found.collect()}


def plain_templates(rows, support=0.5):
    """Brute force: whole occurrence vectors, no hashes."""
    hosts = defaultdict(set)
    for host, html in rows:
        if html is not None:
            hosts[host].add(html)
    out = {}
    for host, pages in hosts.items():
        vectors, slots = defaultdict(dict), defaultdict(dict)
        for page in pages:
            for slot, text, _, main in extract.blocks_of(page):
                slots[slot][page] = slots[slot].get(page, 0) + 1
                if not main:
                    vectors[slot, text][page] = vectors[slot, text].get(page, 0) + 1
        frequent = {k: v for k, v in vectors.items() if len(v) >= 3 and len(v) >= support * len(pages)}
        broken = {frozenset(v.items()) for (slot, _), v in frequent.items() if len(slots[slot]) < len(v)}
        valid = {k: v for k, v in frequent.items() if frozenset(v.items()) not in broken}
        fixed = defaultdict(int)
        for (slot, _), v in valid.items():
            fixed[slot] += sum(v.values())
        kept = {extract._token(*k) for k in valid if fixed[k[0]] >= 0.9 * sum(slots[k[0]].values())}
        if kept:
            out[host] = kept
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_templates_decide_on_pages_without_an_article(spark, most):
    page = "<div class=top>Welcome</div><div class=mood>{1}</div><div class=text><p>story {0}</p><p>common</p></div><div class=last>Imprint</div>"
    rows = [(i, "http://a.org/x", page.format(i, "good" if i % 19 else "odd mood")) for i in range(20)]
    rows += [(50 + i, "http://b.org/", page.format(i, "good")) for i in range(2)] + [(60, None, None), (61, "no url", "")]
    got = texts(extract.extract(frame(spark, rows), most_broadcast=most))
    # "common" is repeated, but its slot holds the stories too; a host of two pages has no template.
    # Of the slot of moods, the template holds the frequent text only.
    assert [got[i] for i in (1, 2, 19)] == ["story 1\ncommon", "story 2\ncommon", "odd mood\nstory 19\ncommon"]
    assert got[50] == "Welcome\ngood\nstory 0\ncommon\nImprint" and got[60] == got[61] == ""


def test_templates_equal_brute_force(spark):
    frames = ["<div class=a>{0}</div>", "<div class=b>same</div>", "<p>{1}</p><p>two</p>", "<article>same</article>", "<div class=c>{2}</div>"]
    rows = []
    for i in range(300):
        body = "".join(f for k, f in enumerate(frames) if (i * 7 + k * 3) % 11 > k)
        rows.append((i, f"http://h{i % 7}.org/", body.format(f"t{i % 2}", i, "fixed" if i % 13 else "other")))
    rows += rows[:40] * 3
    pages = frame(spark, rows).selectExpr("substring_index(url, '/', 3) host", "html")
    got = {r.host: set(r.texts) for r in extract.templates(pages).collect()}
    want = plain_templates([(u.rstrip("/"), h) for _, u, h in rows])
    assert got == want and len(want) > 3


def test_copies_count_once(spark):
    copies = [(i, "http://a.org/", "<div>one story</div><p>told at length</p>") for i in range(30)]
    near = [(100 + i, "http://n.org/", f"<article><h1>one story</h1><p>told at length</p><p>{i}</p></article>") for i in range(9)]
    got = texts(extract.extract(frame(spark, [*copies, (99, "http://a.org/", "<div>another story</div>"), *near])))
    assert got[0] == "one story\ntold at length" and got[99] == "another story"
    assert got[103] == "one story\ntold at length\n3"


def test_tags_and_names_are_evidence_only():
    story = "a long story that fills the page, told in a plain element"
    assert extract.main_text(f"<article>Teaser one</article><div>{story}</div>") == f"Teaser one\n{story}"
    assert extract.main_text(f"<div>short</div><article>{story}</article>") == story
    inside = "<article><div class='form-letter'>Dear all</div><div class='related work'>Others did</div><div class=comments>me too</div><div class='ad big'>{}</div></article>"
    assert extract.main_text(inside.format("")) == "Dear all\nOthers did"
    outside = "<div class='site-header'>a</div><div id=ad-7>b</div><div class='menu main'>c</div><div class='form-letter'>Dear</div><div class='cookie-policy'>d</div>"
    assert extract.main_text(outside) == "Dear"
    # What a template would take whole stays.
    same = extract.blocks_of("<p>all</p>")[0]
    assert extract.main_text("<p>all</p>", {extract._token(same[0], same[1])}) == "all"


def test_long_and_empty_pages(spark):
    rows = [(1, "http://a/", "<p>" + "word " * 300_000), (2, "http://a/", ""), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x"), (2**53 + 1, None, "<b>y")]
    got = extract.extract(frame(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (0, 1), (1, 1_499_999), (2, 0), (2**53 + 1, 1)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and extract.extract(frame(spark, []).limit(0)).count() == 0
