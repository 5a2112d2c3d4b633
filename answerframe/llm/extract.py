"""Main text of web pages by template deduction over the pages of a host.

Each page becomes a row of blocks, each in a slot (the path of tags with their classes). Two
kinds of tokens are counted: slots, and texts within a slot. The occurrence vector of a token
(how often it occurs in each page of the host) is hashed by a sum that does not depend on
order, so tokens with equal vectors fall into one equivalence class without any page meeting
another. Rows with equal html are one page here, however many there are. A class is valid if it
is frequent (in at least ``support`` of the host's pages and in three pages) and its texts lie in
slots of a class that is at least as frequent, so that classes nest. A slot is filled if such texts
are nearly all it holds; these texts, and no others, are the template.

On every page the template's texts go first. Tags and class names are evidence on what remains:
blocks within menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments go, and text within ``article`` or ``main`` is never the template's, since pages that are
nearly copies of each other repeat it. If ``article`` and ``main`` hold at least half of a page's remaining
characters, they alone are the page's text; otherwise (a teaser, or none) all that remains is. A
page of which nothing would remain keeps its template's texts.

Only hashes and counts are shuffled, summed per task first, and a page's tokens once for all its
copies. The template of a host has at most twice as many texts as an average page. All templates
together are broadcast up to ``most_broadcast`` texts (16 bytes each); beyond, the pages are joined
to them with a salt, so that a host with a third of all pages is dealt over many tasks.

Nulls and ties: a null html gives an empty text. A null URL or one without a host belongs to
the host of empty name. Broken or cut markup is read as far as it goes; a tag cut off at the end
is dropped, as are an unclosed comment and script. Line breaks (``br``) are white space.
Repeated rows each give their row. Other columns are not kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerframe.llm.url_filter import host_of
from answerframe.session import written

_TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*+(?:>|\Z)))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

# Kinds of elements.
_RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_LEFT_OUT = frozenset("nav footer aside form button select option datalist dialog menu noscript template svg canvas object audio video map head".split())
_MAIN = frozenset(("article", "main"))
_LEFT_OUT_PARTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header masthead menu "
    "modal nav navbar navigation newsletter notice notification pagination popup promo related replies share sharing sidebar social sponsor sponsored subscribe".split()
)
# Parts of class names that say where or what, not what kind of text.
_NEUTRAL_PARTS = frozenset(
    "area bar block bottom box button buttons center col column container content global group icon icons inner item items left lg link links list main md "
    "outer page pane panel right row section site slot sm top unit widget wrap wrapper xl xs".split()
)
# Words that before another word say only of what kind it is: a form letter, a notice period.
_ALSO_ADJECTIVES = frozenset("form header notice related social".split())
_CLOSES_ITSELF = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _names_left_out(name: str) -> bool:
    """Whether one class name means something left out: ``site-header`` and ``ad-box`` do, ``form-letter`` does not."""
    parts = [p for p in _PART.findall(name) if p not in _NEUTRAL_PARTS]
    return bool(parts) and (parts[-1] in _LEFT_OUT_PARTS or parts[0] in _LEFT_OUT_PARTS - _ALSO_ADJECTIVES)


def _left_out(name: str, rest: str, inside_main: bool) -> tuple[bool, str]:
    """Whether an element's text is never article text, and its mark in the path.

    Within the main part all names of an attribute must say so, as ``class="related work"`` may be the article's own.
    """
    marks = [next(v for v in m[1:] if v is not None).lower() for m in (x.groups() for x in _ATTRIBUTE.finditer(rest))] if "=" in rest else []
    every = all if inside_main else any
    named = any(every(_names_left_out(n) for n in names) for names in map(str.split, marks) if names)
    out = name in _LEFT_OUT or (name == "header" and not inside_main) or named and name not in ("html", "body")
    parts = sorted({p for m in marks for p in _PART.findall(m)})
    return out, f"{name}.{'.'.join(parts)}" if parts else name


def blocks_of(html: str | None) -> list[tuple[str, str, bool, bool]]:
    """``slot, text, left out, in the main part`` of a page's blocks, in page order."""
    if not html:
        return []
    found: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, left out, main
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append((stack[-1][1], text, stack[-1][2], stack[-1][3]))

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            pieces.append(html[at:])
            break
        if m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _VOID:
            if name not in _INLINE:
                pieces.append(" ") if name == "br" else flush()
            continue
        if name in _INLINE:
            continue
        flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name in _CLOSES_ITSELF and stack[k][0] not in _CLOSES_ITSELF:
                    break
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(html, at)
            at = html.find(">", close.start()) + 1 if close else len(html)
            if at == 0:
                break
            continue
        if m.end() == len(html) and not m.group().endswith(">"):
            break
        # A block that opens ends the paragraph, item or cell that it cannot be part of.
        while len(stack) > 1 and stack[-1][0] in _CLOSES_ITSELF and (name in _CLOSES_ITSELF or stack[-1][0] == "p"):
            stack.pop()
        _, path, was_out, was_main = stack[-1]
        out, mark = _left_out(name, m["rest"], was_main)
        # A path is a hash of the path above and its own mark, so deep nesting costs no more than its tags.
        stack.append((name, xxhash.xxh64_hexdigest(f"{path}/{mark}".encode("utf-8", "surrogatepass")), was_out or out, was_main or name in _MAIN))
    flush()
    return found


def _token(slot: str, text: str) -> int:
    return _hash(f"{slot} {text}")


def page_tokens(html: str) -> list[tuple[int, int, int]]:
    """``slot, text, count`` of a page's tokens; the text is 0 for the slot itself, both are 0 for the page."""
    counts: Counter = Counter({(0, 0): 1})
    for slot, text, _, main in blocks_of(html):
        s = _hash(slot)
        counts[s, 0] += 1
        if not main:
            counts[s, _token(slot, text)] += 1
    return [(*token, n) for token, n in counts.items()]


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """``host, texts``: the hashed texts of each host's template. ``pages`` has ``host, html``."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(page_tokens(html), dtype=np.int64).T for html in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "page": batch["page"], **{c: [f[i] for f in found] for i, c in enumerate(("slot", "text", "n"))}})

    # Copies of a page have one mark; its tokens, not its html, are shuffled once for all of them.
    marked = pages.filter("html is not null").select("host", F.xxhash64("html").alias("page"), "html")
    listed = marked.mapInPandas(tokens, "host string, page long, slot array<long>, text array<long>, n array<long>")
    once = listed.groupBy("host", "page").agg(F.first(F.arrays_zip("slot", "text", "n")).alias("tokens"))
    found = once.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.slot", "t.text", "t.n")
    vector = lambda salt: F.sum(F.pmod(F.xxhash64("page", "n", F.lit(salt)), F.lit(1 << 31)))
    summed = found.groupBy("host", "slot", "text").agg(
        F.count("*").alias("pages"), F.sum("n").alias("times"), vector(1).alias("v1"), vector(2).alias("v2")
    )
    # A text in fewer than three pages is in no valid class; slots and the page itself are needed for their sums.
    token = written(summed.filter("text = 0 or pages >= 3"), "page-tokens")
    size = token.filter("slot = 0 and text = 0").select("host", F.col("pages").alias("host_pages"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    texts = token.filter("text <> 0").withColumn("salt", F.pmod("text", F.lit(32)).cast("int"))
    frequent = texts.join(size, ["host", "salt"]).filter(F.col("pages") >= support * F.col("host_pages")).drop("salt", "host_pages")
    slots = token.filter("text = 0 and slot <> 0").select(
        "host", "slot", F.col("pages").alias("slot_pages"), F.col("times").alias("slot_times"), F.col("v1").alias("s1"), F.col("v2").alias("s2")
    )
    # Nesting: a class lies in its slots' classes, each as frequent or more; a class with a text outside such a slot is not valid.
    nested = frequent.join(slots, ["host", "slot"])
    vectors = ["host", "pages", "v1", "v2"]
    valid = nested.groupBy(*vectors).agg(F.min(F.col("slot_pages") >= F.col("pages")).alias("nests")).filter("nests").select(*vectors)
    filled = (
        nested.join(valid, vectors).groupBy("host", "slot").agg(F.sum("times").alias("fixed"), F.first("slot_times").alias("slot_times"), F.collect_list("text").alias("texts"))
        .filter("fixed >= 0.9 * slot_times")
    )
    return filled.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts"))


def main_text(html: str | None, template: Collection[int] = frozenset()) -> str:
    found = [b for b in blocks_of(html) if not b[2]]
    left = [b for b in found if b[3] or not template or _token(b[0], b[1]) not in template] or found
    main = [b for b in left if b[3]]
    if 2 * sum(len(b[1]) for b in main) >= sum(len(b[1]) for b in left):
        left = main
    return "\n".join(b[1] for b in left)


def extract(pages: DataFrame, support: float = 0.5, salts: int = 256, most_broadcast: int = 1_000_000) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    own = own.withColumn("host", F.coalesce("host", F.lit("")))
    known = written(templates(own, support), "page-templates")
    texts = known.agg(F.sum(F.size("texts") + 1).alias("n")).first()["n"] or 0
    if texts <= most_broadcast:
        joined = own.join(F.broadcast(known), "host", "left")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [main_text(h, frozenset(t) if t is not None else frozenset()) for h, t in zip(batch["html"], batch["texts"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": made, "n_chars": [len(t) for t in made]})

    # An id passes as text: beside a null, pandas would make a float of it.
    schema = "page_id string, url string, text string, n_chars long"
    made = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "texts").mapInPandas(run, schema)
    return made.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
