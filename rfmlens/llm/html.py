"""Main-text extraction by templates deduced from equivalence classes of tokens.

Pass 1 reads every page as tokens: a tag token is an element with the path of elements above it, a text token the text of a block with its
path. Each token has an occurrence vector, its number of occurrences on every page of the host, which is kept as the
exclusive or of a hash of (page, number) and so adds up in any order. Tokens of a host with the same vector form an
equivalence class. Classes nest: a class lies in that of the element around it, and one whose tokens lie in several others is
told apart into a class for each of them. A text token is valid if its class, so told apart, holds a tag, or the element around it is of
its own vector, and it occurs on at least ``SHARE`` of the pages of its type (and on ``LEAST`` at least); these are the pages that hold the
slot, an element with all those above it, so types of pages are told apart by their roots and slots nest by their paths. Valid text tokens
are the host's template, i.e. boilerplate; what lies between its elements are slots. The slot with the most text outside of the template is the host's main slot; slots whose other text is mostly labels
(few words and no sentence: dates, counters, links) are boilerplate, too.

Pass 2 reads the pages again with their host's template and extracts the slots, without the template's texts. Slots inside an
article (or else the article body, the main element, an element named as content) rank first; on pages without such an element
it is every slot but those of labels, and the page's top heading. A page, or its marked content, that is all template is a copy of others
and is kept. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by
their elements, roles and whole class names, outside of content by whole ids, and belong to no slot; one word of a name is only a hint: inside of
marked content such an element loses what the template has of its text and nothing else (papers and manuals repeat
sections like "related-work"), on other pages it is left out if its position is in the template, it lies outside of the main slot
and it doesn't hold most of the text. An article in an element
that is left out by its name counts where the page has no other. A header inside an article keeps its headings.

What is gathered for a host is bounded: slots of labels and hinted elements count if they are on 1 / HOT_SHARE of its pages,
so there are at most HOT_SHARE times a page's mean number of them.

A block is the text between two block-level tags; a line break is white space, as are cells of a row.

Cases: a null or blank page has the empty text; pages whose URL is null or has no host form one host of their own; null ids and
repeated rows keep a row each; markup that isn't closed or nested as it should be is read as far as browsers would;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import HOT_SHARE, cut_lineage, lookup

SHARE, LEAST = 0.5, 3
HELD = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody
    tfoot thead tr ul caption td th""".split())
CELL = frozenset("td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
COUNTED = HEADING | {"head"}
INNER = HEADING | frozenset("p li dt dd pre blockquote ul ol dl td th tr tbody thead tfoot caption figcaption summary legend address".split())
#: An open element of the first kind ends where a tag of the second kind begins, unless one of the third is between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
        "thead": ({"tbody", "tr", "td", "th"}, {"table"})}
OUTSIDE = frozenset("""head nav aside footer form script style noscript template iframe object canvas svg audio video button select option
    textarea input label dialog menu search title""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies
    consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside menu nav
    navbar navigation breadcrumb breadcrumbs pagination pager footer foot copyright comment comments commentlist disqus respond share sharing
    social related recommended recommendations toolbar skip searchform""".split())
HEADERS = frozenset("header masthead topbar".split())
REMARKS = frozenset("comment comments commentlist disqus respond".split())
CONTENT = frozenset("article post entry content story maincontent articlebody".split())
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
NO_P_END = frozenset("option optgroup summary html body head".split())
ARTICLE, BODY, MAIN, NAMED = 8, 4, 2, 1

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""", re.S)
OPENING = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
CAMEL = re.compile(r"([a-z])([A-Z])")


def digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(100_000)
def path_of(parent: int, key: str) -> int:
    return digest("path", parent, key)


@dataclass(slots=True, frozen=True)
class Element:
    key: str  # in a path
    outside: bool  # of every slot, by its element or role
    header: bool
    kind: int  # of content
    cut: bool  # a whole class token is in NAMES
    cut_id: bool  # so is the whole id
    remark: bool  # a whole class token is in REMARKS
    remark_id: bool
    hint: bool  # a word of a class token is in NAMES or HEADERS
    hint_id: bool


def word_sets(names: str) -> tuple[set[str], set[str]]:
    """Whole tokens (without digits at their ends) and the words of all tokens."""
    whole, words = set(), set()
    for t in names.split():
        whole.add(t.lower().strip("0123456789-_"))
        parts = [x for x in re.split(r"[^a-z]+", CAMEL.sub(r"\1 \2", t).lower()) if x]
        if parts and parts[0] not in ("no", "has", "with", "without"):
            words |= set(parts)
    return whole, words


@functools.lru_cache(20_000)
def describe(tag: str, attributes: str) -> Element:
    a = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    (classes, words), (ids, id_words) = word_sets(a.get("class", "")), word_sets(a.get("id", ""))
    role, prop = a.get("role", "").lower(), a.get("itemprop", "").lower()
    root = tag in ("html", "body", "main", "article")
    cut, cut_id = bool(classes & NAMES) and not root, bool(ids & NAMES) and not root and tag not in HEADING
    remark = bool(classes & REMARKS)
    hint, hint_id = bool(words & (NAMES | HEADERS)) and not root, bool(id_words & (NAMES | HEADERS)) and not root and tag not in HEADING
    kind = ARTICLE * (tag == "article") | BODY * (prop == "articlebody") | MAIN * (tag == "main" or role == "main")
    if (words | id_words) & CONTENT and not hint and not hint_id:
        kind |= NAMED
    outside = tag in OUTSIDE or role in ROLES or remark and tag == "article"
    header = tag == "header" or bool(classes & HEADERS) and not root
    key = " ".join([tag, re.sub(r"\d+", "", a.get("class", "")), re.sub(r"\d+", "", a.get("id", ""))]).strip()
    return Element(key, outside, header, kind, cut, cut_id, remark, bool(ids & REMARKS) and not root and tag not in HEADING,
                   hint and not kind, hint_id and not kind)


@dataclass(slots=True)
class Block:
    text: str
    kinds: int
    slot: int  # path of the nearest element that holds blocks
    around: tuple  # that path and, in the same way, those of the elements around it
    top: bool  # first-level heading
    wrapped: bool = False  # in an article inside of an element that is cut by its name
    hints: tuple = ()  # path of the nearest element with a word of NAMES, and in the same way those around it

    def hinted(self) -> Iterator[int]:
        at = self.hints
        while at:
            yield at[0]
            at = at[1]

    def within(self, path: int | None) -> bool:
        at = self.around
        while at and at[0] != path:
            at = at[1]
        return bool(at)


#: How an open element is left out: not, by its name, by its element or role; or an article within one that is left out by its name.
KEPT, CUT, HARD, WRAPPED = range(4)


def read(page: str) -> tuple[dict[int, int], list[Block], dict[int, tuple[int, bool]]]:
    """Occurrences of each tag token, the blocks that lie in slots, and of each tag token the path around it and if a word of NAMES hints at it."""
    tags: dict[int, int] = {}
    blocks: list[Block] = []
    around: dict[int, tuple[int, bool]] = {}
    # open elements: tag, path, how it's left out, kinds, in an article's header, holders, hints
    stack: list[tuple[str, int, int, int, bool, tuple, tuple]] = [("", 0, KEPT, 0, False, (0, ()), ())]
    parts: list[str] = []
    headings = firsts = heads = 0  # open headings, first-level headings and heads

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, _, out, kinds, _, holders, hints = stack[-1]
                blocks.append(Block(text, kinds, holders[0], holders, firsts > 0, out == WRAPPED, hints))

    def add(text: str) -> None:
        top = stack[-1]
        if text and top[2] in (KEPT, WRAPPED) and (headings or not top[4]):
            parts.append(unescape(text) if "&" in text else text)

    def close(to: int) -> None:
        nonlocal headings, firsts, heads
        while len(stack) > to:
            name = stack[-1][0]
            if name in CELL:
                parts.append(" ")
            elif parts and name in BLOCK:
                end_block()
            stack.pop()
            if name in COUNTED:
                headings -= name in HEADING
                firsts -= name == "h1"
                heads -= name == "head"

    def imply(name: str) -> None:
        """End the elements that a tag of this name ends."""
        if heads and name not in IN_HEAD:
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name in ENDS:
            ended, within = ENDS[name]
            k = len(stack) - 1
            while k and stack[k][0] not in within:
                if stack[k][0] in ended:
                    close(k)
                k = min(k, len(stack)) - 1
        if name in BLOCK and name not in NO_P_END:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INNER and stack[k][0] in BLOCK:
                    break

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None
        if not m:
            m = OPENING.search(page, at)  # a tag that never ends takes the rest
            add(page[at:m.start() if m else n])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCK
        if m[1]:
            k = len(stack) - 1
            while k and stack[k][0] != name:
                if not block and stack[k][0] in BLOCK:  # an inline end tag ends no block
                    k = 0
                    break
                k -= 1
            if k:
                close(k)
            elif name == "p":
                end_block()
            continue
        e = describe(name, m[3] or "")
        top = stack[-1]
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            path = path_of(top[1], e.key)
            tags[path] = tags.get(path, 0) + 1
            around[path] = (top[1], False)
            continue
        if name in VOID:
            if name == "hr":
                imply(name)
                end_block()
            elif name == "br":
                parts.append(" ")
            continue
        in_article = top[3] & (ARTICLE | BODY)
        cut = e.cut or e.cut_id and (not top[3] or e.remark_id and not in_article)  # ids inside of content are often made from headings
        if not block and not e.outside and not cut:
            continue  # inline markup
        if block:
            imply(name)
            if name in CELL:
                parts.append(" ")
            elif parts:
                end_block()
        _, parent, out, kinds, in_header, holders, hints = stack[-1]
        path = path_of(parent, e.key)
        hint = not cut and (e.hint or e.hint_id and not kinds or e.remark_id and bool(in_article))
        tags[path] = tags.get(path, 0) + 1
        around[path] = (parent, hint)
        outside, kind = e.outside, 0 if e.outside or cut else e.kind
        if e.header and not outside and not cut:
            in_header, outside, cut = (True, False, False) if kinds & (ARTICLE | BODY | MAIN) else (in_header, name == "header", name != "header")
        if outside or out == HARD or cut and (e.remark or e.remark_id):
            out = HARD
        elif cut:
            out = CUT
        elif out == CUT and kind & (ARTICLE | BODY | MAIN):
            out = WRAPPED
        if kind:
            hints = ()
        elif hint:
            hints = (path, hints)
        if name in COUNTED:
            headings += name in HEADING
            firsts += name == "h1"
            heads += name == "head"
        stack.append((name, path, out, kinds | kind, in_header, holders if name in INNER else (path, holders), hints))
    end_block()
    close(1)
    if any(b.wrapped for b in blocks):  # teasers, unless the page has no other article and less other text
        rest = [b for b in blocks if not b.wrapped]
        if any(b.kinds for b in rest) or 2 * sum(len(b.text) for b in rest) > sum(len(b.text) for b in blocks):
            blocks = rest
    return tags, blocks, around


def prose(text: str) -> bool:
    """Not a mere label: several words, a sentence's end, or long (for languages without spaces)."""
    return len(text) >= 40 or text.rstrip("\"'”’»)]").endswith((".", "!", "?", "…", "。", "！", "？")) or text.count(" ") >= 4


def text_token(b: Block) -> int:
    return digest("text", b.slot, b.text)


def uncut(blocks: list[Block], main: int | None, cuts: frozenset[int]) -> list[Block]:
    """Without the elements ``cuts``, but for those around the main slot or in it, or most of the page's text."""
    total = sum(len(b.text) for b in blocks)
    within: dict[int, int] = {}
    keep: set[int] = set()
    for b in blocks:
        for h in b.hinted():
            if h in cuts:
                within[h] = within.get(h, 0) + len(b.text)
                if b.within(main):
                    keep.add(h)
    keep |= {h for h, n in within.items() if 2 * n > total}
    return [b for b in blocks if not any(h in cuts and h not in keep for h in b.hinted())]


def extract(blocks: list[Block], texts: frozenset[int], main: int | None, labels: frozenset[int] = frozenset(),
            cuts: frozenset[int] = frozenset()) -> str:
    """The slots' text: ``texts`` are the template's text tokens, ``main`` the host's heaviest slot, ``labels`` its slots of labels and
    ``cuts`` the elements of the template with a word of NAMES."""
    if cuts and any(b.hints for b in blocks) and not any(b.kinds for b in blocks):
        blocks = uncut(blocks, main, cuts)
    left = [b for b in blocks if text_token(b) not in texts] if texts else blocks
    left = left or blocks  # a page that is all template is one of several copies
    kinds = functools.reduce(int.__or__, (b.kinds for b in blocks), 0)
    for want in (ARTICLE, BODY, MAIN, NAMED):
        if any(b.kinds & want for b in left):
            return "\n".join(b.text for b in left if b.kinds & want)
    if kinds:  # copies again: all marked text is template
        want = 1 << kinds.bit_length() - 1
        return "\n".join(b.text for b in blocks if b.kinds & want)
    if not any(b.within(main) for b in left):
        size: dict[int, int] = {}
        for b in left:
            size[b.slot] = size.get(b.slot, 0) + len(b.text)
        main = max(size, key=size.__getitem__, default=0)
    return "\n".join(b.text for b in left if b.top or b.slot not in labels or b.within(main))


def vector(row: int, number: int) -> int:
    """Hash of (page, number of occurrences), a signed 64-bit integer."""
    x = (row * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


TOKENS = "host string, token long, is_text boolean, slot long, hinted boolean, chars long, prose long, support long, vector long"
#: A token that every page has once.
PAGE = 1


def tokens(rows: DataFrame) -> DataFrame:
    """host, token, is_text, slot (of a tag the path around it), hinted, chars and those in prose (of pages without marked content), support (pages), vector."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TOKENS.split(", ")]
        seen: dict[tuple[str, int], list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if seen:
                cols = [*zip(*seen, strict=True), *zip(*seen.values(), strict=True)]
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                seen.clear()

        for batch in batches:
            for row, host, page in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html")), strict=True):
                tags, blocks, around = read(page or "")
                marked = any(b.kinds for b in blocks)
                found: dict[int, list[int]] = {PAGE: [False, 0, False, 0, 0, 1]}  # is_text, slot, hinted, chars, chars in prose, occurrences
                for t, k in tags.items():
                    found[t] = [False, *around[t], 0, 0, k]
                for b in blocks:
                    x = found.setdefault(text_token(b), [True, b.slot, bool(b.hints), 0, 0, 0])
                    if not marked:
                        x[3] += len(b.text)
                        x[4] += len(b.text) * prose(b.text)
                    x[5] += 1
                for t, (is_text, slot, hinted, chars, told, k) in found.items():
                    x = seen.setdefault((host, t), [is_text, slot, False, 0, 0, 0, 0])
                    x[2] |= hinted
                    x[3] += chars
                    x[4] += told
                    x[5] += 1
                    x[6] ^= vector(row, k)
                if len(seen) > HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(count, TOKENS).groupBy("host", "token").agg(
        F.first("is_text").alias("is_text"), F.first("slot").alias("slot"), F.max("hinted").alias("hinted"), F.sum("chars").alias("chars"),
        F.sum("prose").alias("prose"), F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"))


def templates(seen: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, n (pages), texts (the template's text tokens), main (slot with the most other text), labels (slots whose other text is labels),
    cuts (elements with a word of NAMES, by the same support)."""
    hosts = cut_lineage(seen.where(F.col("token") == PAGE).select("host", F.col("support").alias("n")), "hosts")
    often = seen.where(F.col("support") >= least)
    tags = often.where(~F.col("is_text"))
    # pages of a type are those that hold the slot: its path names the page's root and all elements down to it
    held = tags.select("host", F.when(F.col("token") == PAGE, 0).otherwise(F.col("token")).alias("slot"), F.col("support").alias("of"), F.col("vector").alias("outer"))
    # an element is on all pages that its inner tokens are on, so every token has the class around it; elements enclose those of their own class, too
    nested = tags.join(held.drop("of"), ["host", "slot"]).select("host", "vector", "outer").union(tags.select("host", "vector", "vector")).distinct()
    valid = often.where("is_text").join(held, ["host", "slot"]).where(F.col("support") >= share * F.col("of")).join(
        nested, ["host", "vector", "outer"], "left_semi")
    # at least ``share`` of a slot's pages hold each, so a slot has at most its mean number of blocks / share of them
    texts = cut_lineage(valid.groupBy("host").agg(F.collect_list("token").alias("texts")), "template")
    known = texts.select("host", F.explode("texts").alias("token"))
    slots = seen.where(F.col("is_text") & (F.col("chars") > 0)).join(known, ["host", "token"], "left_anti").groupBy("host", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("prose").alias("prose"), F.max("hinted").alias("hinted"))
    # slots of fewer pages than make a template are told apart by nothing and stay
    held = held.drop("outer").join(hosts, "host").withColumn("common", F.col("of") * HOT_SHARE >= F.col("n")).drop("n")
    slots = slots.join(held, ["host", "slot"], "left").groupBy("host").agg(
        F.max_by("slot", F.struct(F.col("chars") * F.when(F.col("hinted"), 1).otherwise(10), "slot")).alias("main"),
        F.collect_list(F.when((F.col("prose") * 2 < F.col("chars")) & F.col("common"), F.col("slot"))).alias("labels"))
    cuts = tags.where("hinted").join(held, ["host", "slot"]).where((F.col("support") >= share * F.col("of")) & F.col("common")).groupBy("host").agg(
        F.collect_list("token").alias("cuts"))
    return hosts.join(texts, "host", "left").join(slots, "host", "left").join(cuts, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
                        host_of(F.col(url_col).cast("string")).alias("host"))
    seen = cut_lineage(tokens(rows.select(F.monotonically_increasing_id().alias("row"), "host", "html")), "html-tokens")
    table = cut_lineage(templates(seen), "templates")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = lookup(rows, table, ["host"], "n", total, F.struct("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                found = [extract(read(page or "")[1], frozenset(texts or ()), main, frozenset(labels or ()), frozenset(cuts or ())) for page, texts, main, labels, cuts in
                         zip(*(part.column(c).to_pylist() for c in ("html", "texts", "main", "labels", "cuts")), strict=True)]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(found, pa.string()),
                                                  "n_chars": pa.array(list(map(len, found)), pa.int64())})

    return rows.select("page_id", "url", "html", "texts", "main", "labels", "cuts").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
