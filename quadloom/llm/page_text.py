"""Main text of web pages: site templates found by counting element subtrees, then roles of elements.

1. A pass over each page's whole markup makes its element tree, the blocks of text
   between block elements, and a hash of every block-level subtree, from its name, its text and
   its children's hashes.
2. Spark counts, for each host, on how many pages with different main texts a subtree occurs.
   One that recurs on at least LEAST of them, and on a share of SHARE of the host's, is
   template, and its blocks go wherever it stands on that host. Copies of a text
   are one text here, so a host full of copies doesn't lose them.
3. Elements whose name, role, class or id says that they are no main text go too, which a
   host of few pages can't show by counts.
4. Where blocks of an article or main element remain, only these are the text.

Never template, however often they recur: an author's own blocks inside an article (headings,
paragraphs, quotations, lines and lists), since shared passages are part of the texts; and a subtree that
holds half of its page's main text or more. If nothing else remains of a page, its recurring
blocks stay.

White space inside a block becomes one space (no-break spaces too); br and table cells are
white space. Null or empty html has an empty text. A page without a host, and each row of a repeated
page, is treated like any other; pages without a host are not counted. An empty table gives no rows.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._arrow import slices
from quadloom.llm._shared import join_hot, work_dir

#: Pages of different main texts that a template subtree occurs on, at least, and their share of the host's.
LEAST, SHARE = 4, 0.01
#: Template subtrees of all hosts up to which they are broadcast, eight bytes each.
SMALL = 1 << 20

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that say what an element is for.
TELLING = ("class", "id", "role", "hidden", "style", "aria-hidden")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; an end tag of their own name ends them.
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.IGNORECASE) for n in "script style textarea title xmp iframe noembed noframes".split()}
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("html head body caption legend li dd dt optgroup option select tbody tfoot thead tr".split()) | {"li", "dd", "dt"}
#: What a start tag ends, if open: the names, and the elements that it does not reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "thead": ({"caption", "tbody"}, {"table"}),
}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())

#: Elements that hold no main text.
ASIDE = frozenset("head script style noscript template nav aside footer form button select option optgroup textarea input fieldset iframe noembed noframes object embed svg canvas audio video dialog search menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist".split())
#: Words of a class or id whose element holds no main text: menus, heads and feet, side matter, notices, adverts, forms, comments.
WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc toolbar topbar skip header masthead banner logo footer colophon copyright sidebar aside rail widget widgets related recommended recommendations "
    "trending popular share sharing social cookie cookies consent gdpr notice notices alert paywall popup modal overlay ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion "
    "form search login signin signup register subscribe subscription newsletter comment comments commentlist commentform reply replies respond disqus".split()
)
#: First words that speak of another element's presence.
ABOUT = frozenset("has no with without is not show hide".split())
#: Elements that no class, id or subtree count removes.
FRAME = frozenset("html body main article".split())
#: An author's own blocks.
PROSE = HEADING | frozenset("p blockquote pre li ul ol dl dt dd table tbody thead tfoot tr caption figure figcaption address details summary hr".split())

PARSED = "page_id long, url string, host string, digest long, blocks array<struct<text: string, inside: boolean, aside: boolean, path: array<long>>>, subtrees array<long>"


class Element:
    """An open element: its parts (text and hashes) for the hash, and the blocks that lie in it."""

    __slots__ = ("name", "inside", "aside", "article", "parts", "first", "held")

    def __init__(self, name: str, inside: bool, aside: bool, article: bool, first: int) -> None:
        self.name, self.inside, self.aside, self.article, self.first = name, inside, aside, article, first
        self.parts: list[bytes] = []
        self.held: list[str] | None = None  # the text around an inline element that is none of it


def telling(text: str) -> dict[str, str]:
    """The attributes of TELLING; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in TELLING and name not in out:
            out[name] = html.unescape(m[2] or m[3] or m[4] or "")
    return out


def no_text(name: str, attributes: dict[str, str], article: bool) -> bool:
    """Whether an element holds no main text; article: whether it stands inside one."""
    if name in ASIDE or name == "header" and not article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.IGNORECASE):
        return name not in FRAME
    if attributes.get("role", "").strip().lower() in ROLES:
        return name not in FRAME
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", label).lower()) if w]
        if not words or words[0] in ABOUT:
            continue
        if name in FRAME:  # a comment may be an article of its own; what else an article's classes say is about others
            if name == "article" and len(words) == 1 and words[0] in {"comment", "reply", "ad", "advert", "promo", "sponsored", "related"}:
                return True
            continue
        said = {words[0], words[-1]} & WORDS
        if said and not (article and said == {"header"}):
            return True
    return False


class Page:
    """The blocks and subtrees of a page's markup."""

    def __init__(self, markup: str) -> None:
        self.blocks: list[list] = []  # text, inside, aside, subtrees around it
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, block behind the last
        self.open: list[Element] = [Element("", False, False, False, 0)]
        self.names: Counter[str] = Counter()  # of the open elements
        self.text: list[str] = []
        self.read(markup)

    def read(self, markup: str) -> None:
        at, size = 0, len(markup)
        while at < size:
            mark = markup.find("<", at)
            token = TOKEN.match(markup, mark) if mark >= 0 else None
            while mark >= 0 and token is None:  # a lone "<" is text
                mark = markup.find("<", mark + 1)
                token = TOKEN.match(markup, mark) if mark >= 0 else None
            end = mark if mark >= 0 else size
            if end > at:
                self.characters(html.unescape(markup[at:end]))
            if token is None:
                break
            at = token.end()
            if token[2]:
                name = token[2].lower()
                if token[1]:
                    self.end(name)
                else:
                    self.start(name, token[3])
                    if name in RAW:
                        close = RAW[name].search(markup, at)
                        at = close.start() if close else size
        while len(self.open) > 1:
            self.close()
        self.flush()

    def characters(self, text: str) -> None:
        if self.open[-1].name == "head" and not text.isspace():
            self.close()
        self.text.append(text)

    def flush(self) -> None:
        """Ends the block of text before a block element's start or end."""
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text = []
            if words:
                top = self.open[-1]
                top.parts.append(words.encode("utf-8", "surrogatepass"))
                self.blocks.append([words, top.inside, top.aside, []])

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.names[name]:
            return
        if self.open[-1].name == "head" and name not in IN_HEAD:
            self.close()
        if name in ENDS_P:
            self.close_open({"p"}, {"button", "caption", "table", "td", "th", "object", "template"})
        if name in ENDS:
            self.close_open(*ENDS[name])
        if name in HEADING and self.open[-1].name in HEADING:
            self.close()
        if name in BLOCKS:
            self.flush()
        if name in ("br", "td", "th"):
            self.text.append(" ")
        if name in VOID:
            return
        top = self.open[-1]
        said = telling(attributes) if attributes and not attributes.isspace() else {}
        aside = top.aside or no_text(name, said, top.article)
        article = top.article or name in ("article", "main")
        self.names[name] += 1
        self.open.append(Element(name, top.inside or name in ("article", "main") and not aside, aside, article, len(self.blocks)))
        if aside and not top.aside and name not in BLOCKS:
            self.open[-1].held, self.text = self.text, []

    def end(self, name: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name in ("html", "body"):  # what comes after them still belongs there
            return
        inline = name not in BLOCKS and name not in ("td", "th")
        for k in range(len(self.open) - 1, 0, -1) if self.names[name] else ():
            here = self.open[k].name
            if here == name:
                while len(self.open) > k:
                    self.close()
                return
            if inline and here in BLOCKS or here in ("td", "th", "caption", "table") and name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table") or here in ("ul", "ol") and name == "li":
                break
        if not inline:
            self.flush()

    def close_open(self, names: set[str], bounds: set[str]) -> None:
        """Ends the innermost open elements of the names, and all in them, inside the bounds."""
        deepest = None
        if not any(self.names[name] for name in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in bounds:
                break
            if self.open[k].name in names:
                deepest = k
                if names == {"p"} or names == {"li"}:
                    break
        while deepest is not None and len(self.open) > deepest:
            self.close()

    def close(self) -> None:
        top = self.open[-1]
        if top.name in ("td", "th"):
            self.text.append(" ")
        if top.name not in BLOCKS:  # inline: its text is the block's
            if top.held is not None:
                self.flush()
                self.text = top.held
            self.pop().parts += top.parts
            return
        self.flush()
        self.pop()
        size = len(self.blocks)
        if size == top.first:
            return
        key = xxhash.xxh64_intdigest(b"\x00".join([top.name.encode("utf-8", "replace"), *top.parts])) - (1 << 63)
        self.open[-1].parts.append(b"\x01" + key.to_bytes(8, "little", signed=True))
        if top.name not in FRAME and not (top.inside and top.name in PROSE):
            self.subtrees.append((key, top.first, size))

    def pop(self) -> Element:
        """Drops the innermost element; the one around it."""
        self.names[self.open.pop().name] -= 1
        return self.open[-1]

    def main(self) -> list[int]:
        """The blocks that are main text as far as the page alone shows."""
        own = [k for k, b in enumerate(self.blocks) if not b[2]]
        return [k for k in own if self.blocks[k][1]] or own

    def row(self) -> tuple[int, list[dict], list[int]]:
        main = self.main()
        at = [0]
        sizes = dict.fromkeys(main, 0) | {k: len(self.blocks[k][0]) for k in main}
        for k in range(len(self.blocks)):
            at.append(at[-1] + sizes.get(k, 0))
        found = set()
        for key, first, end in self.subtrees:
            if 2 * (at[end] - at[first]) < at[-1] or not at[-1]:
                found.add(key)
                for block in self.blocks[first:end]:
                    block[3].append(key)
        digest = xxhash.xxh64_intdigest("\n".join(self.blocks[k][0] for k in main).encode("utf-8", "surrogatepass")) - (1 << 63)
        return digest, [dict(zip(("text", "inside", "aside", "path"), b, strict=True)) for b in self.blocks], sorted(found)


def parsed(pages: DataFrame, id_col: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Blocks, subtrees and a digest of the main text of each page."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.nullif(host, F.lit("")).alias("host"), F.col(markup).alias("html"))
    block = pa.struct([("text", pa.string()), ("inside", pa.bool_()), ("aside", pa.bool_()), ("path", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], 3):
                got = [Page(text or "").row() for text in batch.column(3).to_pylist()]
                columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(block)), pa.array([g[2] for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "url", "host", "digest", "blocks", "subtrees"])

    return rows.mapInArrow(run, PARSED)


def templates(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, gone): the hashes of each host's template subtrees, from parsed rows.

    Counts are aggregated before they are shuffled. A host has no more template subtrees
    than 1/share times the mean number of subtrees of its pages, so an array of them is small.
    """
    named = rows.where("host IS NOT NULL").select("host", "digest", "subtrees")
    texts = named.groupBy("host").agg(F.countDistinct("digest").alias("texts"))
    counts = named.select("host", "digest", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.countDistinct("digest").alias("n")).where(F.col("n") >= least)
    return counts.join(texts, "host").where(F.col("n") >= share * F.col("texts")).groupBy("host").agg(F.collect_list("subtree").alias("gone"))


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark, folder = pages.sparkSession, work_dir(pages.sparkSession, "page-text")
    parsed(pages).write.option("compression", "zstd").parquet(f"{folder}/pages")
    rows = spark.read.parquet(f"{folder}/pages")
    templates(rows, least, share).write.parquet(f"{folder}/templates")
    gone = spark.read.parquet(f"{folder}/templates")
    texts = rows.select("page_id", "url", "host", "blocks")
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= SMALL:
        judged = texts.join(F.broadcast(gone), "host", "left")
    else:
        hosts = texts.select("host").where("host IS NOT NULL").distinct().join(gone, "host", "left")
        judged = join_hot(texts, hosts, "host").unionByName(texts.where("host IS NULL").withColumn("gone", F.lit(None).cast("array<long>")))
    own = F.filter("blocks", lambda b: ~b["aside"])
    left = F.filter(own, lambda b: ~F.coalesce(F.arrays_overlap(b["path"], F.col("gone")), F.lit(False)))
    judged = judged.withColumn("__left", F.when(F.size(left) > 0, left).otherwise(own))
    inside = F.filter("__left", lambda b: b["inside"])
    kept = F.when(F.size(inside) > 0, inside).otherwise(F.col("__left"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def contract(pages: DataFrame) -> DataFrame:
    return extract(pages)
