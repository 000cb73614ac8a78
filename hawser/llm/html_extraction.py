"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page's tokens are its elements by role (the path of element names and classes that leads to them, as a chained
hash) and its runs of text by role. Over the pages of a host each token has an occurrence vector: how often each page
has it. Tokens with the same vector form an equivalence class; a class is valid when it is large (LEAST_TOKENS),
frequent (LEAST_PAGES and LEAST_SHARE of the host's pages) and steady in order, and it is nested into the template
where the element around it is frequent, too. Text below an article is template only where most text of its role is:
a role that mostly varies is a slot, and what pages share in it is their own.

The slots of the template are what its elements hold besides. The main slot of a host is the innermost element of a
valid class that holds over MAIN_SHARE of the text in all its pages, links and marked side parts not counted; such
elements lie within each other, and among them one named as an article or main part is preferred. The main text is
the main slot's text without the template's. Where a page lacks that element, or the host has too few pages for a
template, names of elements and classes decide alone.

Vectors are never built: their hash is an exclusive-or over pages, so counting is a partial aggregation and a host
that holds a third of all pages costs no more than others.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, cut, table

LEAST_TOKENS = 3
LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: Share of a host's text that its main slot holds at least.
MAIN_SHARE = 0.5

# Fixed values of HTML and of common page layouts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_MAIN = frozenset("article main".split())
_NO_TEXT = frozenset("audio button canvas dialog head iframe input noembed noframes noscript object option script select style svg template textarea title video xmp".split())
_ASIDE = frozenset("aside fieldset footer form header menu nav".split())
_BOILERPLATE = _NO_TEXT | _ASIDE
_BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus foot footer header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_SIDE_PARTS = _ASIDE - {"header"}  # an article's header holds its title
_COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
_PARAGRAPHS = frozenset("blockquote caption dd dt figure h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
_CLOSES_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_RAW_END = {name: re.compile(f"</{name}(?![a-z0-9-])", re.I) for name in _RAW}
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:[\s=>]|$)|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    role: int
    in_main: bool
    in_slot: bool
    boilerplate: bool  # by element or class, or no text at all
    aside: bool  # by element
    side_part: bool  # by element, or visitors' comments
    no_text: bool  # hidden, or in an element that shows no text
    parts: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def only_links(self) -> bool:
        return all(link for part, link in zip(self.parts, self.linked, strict=True) if part.strip())


@dataclass(slots=True)
class _Open:
    name: str
    role: int
    depth: int
    in_main: bool
    in_slot: bool
    boilerplate: bool
    aside: bool
    side_part: bool
    no_text: bool
    link: bool


@dataclass(slots=True)
class Element:
    role: int  # inline elements: of the block around with their name
    around: int
    depth: int
    name: str


def _chained(role: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), role)


def parse(page: str, slot: int | None = None) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and every element; blocks below an element of the role `slot` are marked."""
    stack, blocks, elements = [_Open("", 0, 0, False, False, False, False, False, False, False)], [], []
    opened: Counter[str] = Counter()  # open elements by name, so that no search of the stack is in vain
    block: Block | None = None
    at, end = 0, len(page)

    def add(raw: str) -> None:
        nonlocal block
        top = stack[-1]
        if block is None:
            if not raw.strip():
                return
            block = Block(top.role, top.in_main, top.in_slot, top.boilerplate, top.aside, top.side_part, top.no_text)
            blocks.append(block)
        block.parts.append(entities.unescape(raw))
        block.linked.append(top.link)

    def close(i: int) -> None:
        opened.subtract(o.name for o in stack[i:])
        del stack[i:]

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if name not in _INLINE and name != "br":
            block = None
        if name == "br":
            if block is not None:
                add(" ")
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[i].name == name:
                    close(i)
                    break
                if name in _INLINE and stack[i].name not in _INLINE:
                    break
            continue
        if name not in _INLINE and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in _INLINE:
                    break
        if name in _CLOSES_SAME and (opened[name] > 0 or name in ("dt", "dd") and opened["dt"] + opened["dd"] > 0):
            scopes = _CLOSES_SAME[name].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name or name in ("dt", "dd") and stack[i].name in ("dt", "dd"):
                    close(i)
                    break
                if stack[i].name in scopes:
                    break
        top, label, words = stack[-1], name, set()
        if attributes:
            for kind, value in _NAMES.findall(attributes):
                found = _WORD.findall(value.lower())
                words.update(found)
                if kind.lower() == "class" and found:
                    label = f"{name}.{found[0]}"
        hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
        inline = name in _INLINE
        role = top.role if inline else _chained(top.role, label)
        no_text = top.no_text or name in _NO_TEXT or hidden
        aside = top.aside or name in _ASIDE
        named = name not in ("html", "body", "article", "main")
        side_part = top.side_part or name in _SIDE_PARTS or named and not words.isdisjoint(_COMMENT_WORDS)
        boilerplate = top.boilerplate or aside or no_text or named and not words.isdisjoint(_BOILERPLATE_WORDS)
        if (boilerplate, side_part, no_text) != (top.boilerplate, top.side_part, top.no_text):
            block = None
        elements.append(Element(_chained(role, f"~{name}") if inline else role, top.role, top.depth + 1, name))
        if name in _VOID:
            continue
        if name in _RAW:
            closed = _RAW_END[name].search(page, at)
            at = closed.start() if closed else end
        elif not attributes.endswith("/") or inline or name in _BOILERPLATE:
            in_main = top.in_main or name in _MAIN and not (aside or no_text)
            stack.append(_Open(name, role, top.depth + (not inline), in_main, top.in_slot or role == slot and not inline, boilerplate, aside, side_part, no_text, top.link or name == "a"))
            opened[name] += 1
    if at < end:
        add(page[at:])
    return blocks, elements


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))


def _signed(unsigned: int) -> int:
    return unsigned - (1 << 63)


ELEMENT, TEXT, ARTICLE_TEXT, ROLE_MARK, PAGE_MARK = range(5)


@dataclass(slots=True)
class Token:
    """A token of a page; `weight` counts the characters at or below an element, without links and side parts."""

    token: int
    around: int
    kind: int
    weight: int = 0
    depth: int = 0
    named: int = 0  # 2 for articles and main parts, 0 for paragraphs and inline elements, else 1


def tokens(page: str) -> list[Token]:
    """A page's tokens in order. Besides elements and texts there are marks that count a role's texts, and one a page."""
    blocks, elements = parse(page)
    weight: Counter[int] = Counter()
    for b in blocks:
        if not (b.no_text or b.side_part):
            weight[b.role] += sum(len(part) for part, link in zip(b.parts, b.linked, strict=True) if not link)
    around = {e.role: e.around for e in elements}
    for role in reversed(around):  # an element's role is first met after that of the element around it
        weight[around[role]] += weight[role]
    out, weighed = [], set()
    for e in elements:
        named = 2 if e.name in _MAIN else 0 if e.name in _INLINE or e.name in _PARAGRAPHS else 1
        out.append(Token(_signed(e.role), _signed(e.around), ELEMENT, 0 if e.role in weighed else weight[e.role], e.depth, named))
        weighed.add(e.role)
    for b in blocks:
        if not b.no_text:
            out.append(Token(_hash(f"{b.role}|{b.text()}"), _signed(b.role), ARTICLE_TEXT if b.in_main else TEXT))
            out.append(Token(_hash(f"{b.role}#"), _signed(b.role), ROLE_MARK))
    out.append(Token(_hash("page"), 0, PAGE_MARK, weight[0]))
    return out


def main_text(page: str, template: frozenset[int], few_pages: bool = True, slot: int | None = None) -> str:
    """Text of the main slot without the template's; without a slot that of the article, or of all slots.

    Where a host has `few_pages`, marked elements and classes and, without an article, links alone are no slots.
    """
    blocks = [b for b in parse(page, None if slot is None else slot + (1 << 63))[0] if not b.no_text]
    if few_pages:
        slots = [b for b in blocks if not b.boilerplate]
        if any(b.in_main for b in slots):
            slots = [b for b in slots if b.in_main]
        else:
            slots = [b for b in slots if not b.only_links()]
    else:
        slots = [b for b in blocks if b.in_slot] or blocks
        slots = [b for b in slots if b.in_main] or slots
        slots = [b for b in slots if not b.side_part]
    varying = [b for b in slots if _hash(f"{b.role}|{b.text()}") not in template]
    slots = varying or slots  # all pages of a host the same: no telling template from text
    if not few_pages and not any(b.in_main for b in slots):
        slots = [b for b in slots if not b.aside] or slots
    return " ".join(t for b in slots if (t := b.text()))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(_host, template, slot) of each host of `least_pages` or more: hashes of its template's texts, at most a few for
    each page's length, and the role of its main slot (null if no element of a valid class holds most text)."""

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, key in zip(batch["_host"], batch["html"], batch["_page"], strict=True):
                found = tokens(page)
                counts = Counter(t.token for t in found)
                about = {t.token: t for t in reversed(found)}  # the first of each, which has the weight
                before = 0
                for t in reversed(about.values()):
                    rows.append((host, t.token, t.around, t.kind, t.weight, t.depth, t.named, counts[t.token], before, key))
                    if counts[t.token] == 1 and t.kind < ROLE_MARK:
                        before = t.token
            yield pd.DataFrame(rows, columns=["_host", "token", "around", "kind", "weight", "depth", "named", "n", "before", "_page"])

    source = pages.select(host_of().alias("_host"), F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url", "html").alias("_page"))
    found = source.mapInPandas(occurrences, "_host string, token long, around long, kind int, weight long, depth int, named int, n int, before long, _page long")
    vectors = found.groupBy("_host", "token").agg(
        F.bit_xor(F.xxhash64("_page", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.max("kind").alias("kind"),
        F.min("around").alias("around"), (F.min("before") == F.max("before")).cast("int").alias("steady"), F.sum("weight").alias("weight"), F.max("depth").alias("depth"), F.max("named").alias("named"),
    )
    # single pages' own text makes no class; the rest is read more than once
    vectors = cut(vectors.where(F.col("pages") >= least_pages))
    size = source.groupBy("_host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= least_pages)
    same = ["_host", "vector", "pages", "total"]
    members = vectors.where(F.col("kind") < ROLE_MARK)
    classes = members.groupBy(*same).agg(F.count("*").alias("members"), F.sum("steady").alias("in_order"))
    frequent = classes.join(size, "_host").where(F.col("pages") >= least_share * F.col("host_pages"))
    valid = members.join(frequent.where((F.col("members") >= least_tokens) & (2 * F.col("in_order") >= F.col("members"))).select(*same), same)
    # an element may repeat within its parent's slot and so be a small class of its own; it need only be frequent
    elements = members.where(F.col("kind") == ELEMENT).join(frequent.select(*same), same).select("_host", F.col("token").alias("around"))
    texts = valid.where(F.col("kind") > ELEMENT).join(elements, ["_host", "around"], "left_semi").select("_host", "around", "token", "kind", "total")
    all_of = vectors.where(F.col("kind") == ROLE_MARK).select("_host", "around", F.col("total").alias("of_role"))
    shared = texts.groupBy("_host", "around").agg(F.sum("total").alias("shared")).join(all_of, ["_host", "around"])
    mostly = shared.where("2 * shared > of_role").select("_host", "around", F.lit(True).alias("mostly"))
    template = texts.join(mostly, ["_host", "around"], "left").where((F.col("kind") == TEXT) | F.col("mostly")).groupBy("_host").agg(F.collect_set("token").alias("template"))
    whole = vectors.where(F.col("kind") == PAGE_MARK).select("_host", F.col("weight").alias("whole"))
    holding = valid.where((F.col("kind") == ELEMENT) & (F.col("named") > 0)).join(whole, "_host").where(F.col("weight") > MAIN_SHARE * F.col("whole"))
    slots = holding.groupBy("_host").agg(F.min_by("token", F.struct(-F.col("named"), "weight", -F.col("depth"))).alias("slot"))
    found = size.select("_host").join(template, "_host", "left").join(slots, "_host", "left")
    return found.select("_host", F.coalesce("template", F.array().cast("array<bigint>")).alias("template"), "slot")


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with text (the main text, empty if none) and n_chars. Null html is an empty page, null urls share a host.

    Rows stay where they are; repeated pages are extracted each. Columns of `pages` with these names are replaced.
    """
    found = cut(templates(pages))
    size = found.agg(F.sum(F.size("template") * 8 + F.octet_length("_host") + 40)).first()[0]

    @F.pandas_udf(T.StringType())
    def text(html: pd.Series, template: pd.Series, slot: pd.Series) -> pd.Series:
        held: dict[bytes, frozenset[int]] = {}

        def texts_of(t) -> frozenset[int]:
            key = t.tobytes()
            if key not in held:
                held.clear()
                held[key] = frozenset(t.tolist())
            return held[key]

        rows = zip(html, template, slot, strict=True)
        return pd.Series([main_text(h, frozenset() if t is None else texts_of(t), t is None, None if pd.isna(s) else int(s)) for h, t, s in rows], dtype=object)

    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    joined = pages.withColumn("_host", host_of()).join(checked_broadcast(found, size), "_host", "left")
    return joined.select(*own, text(F.coalesce("html", F.lit("")), F.col("template"), F.col("slot").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; see `extract` for nulls, repeated rows and empty tables."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
