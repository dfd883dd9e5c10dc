"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read into flat blocks, runs of text between block-level tags.  A block has its number of words, its link
density (share of words inside links), both for its two neighbours, and what the markup says: whether it stands in a
part made for something else than the article (a navigation, header, footer, sidebar, form, or a class, id or role of
such a name), inside an article or main element, or in a heading.  A decision tree is trained on the labelled blocks of
``html_samples``, a small table, and becomes one column expression, so the pages are read once and never shuffled.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a
line break.  Scripts, styles, comments in the markup and the head are no text.  Null and empty pages have no blocks and
an empty text, and so has a page without a main block.  Unclosed tags end where HTML ends them or with the page.
Repeated rows are read each for itself.  Other columns are kept; ``blocks`` and ``text`` are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerspark.llm.base import slices, text_or_empty
from ledgerspark.llm.html_samples import PAGES

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "aside", "in_article", "heading",
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose start and end separate blocks.
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of the page.
NO_TEXT = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
#: Elements that hold something else than the article.
ASIDES = frozenset("nav footer aside form menu dialog button select textarea fieldset label input".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in the class or id of parts that are not the article.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations sidebar widget widgets menu nav navbar navigation navi breadcrumb "
    "breadcrumbs topbar masthead header footer copyright comment comments commentlist reply replies respond disqus discussion "
    "login search searchform toolbar pagination pager taglist tagcloud skip teaser outbrain taboola paywall disclaimer".split()
)
#: The ones that also count on an article or main element, which may carry names of the page's layout.
ASIDE_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser".split())
#: Words in the class or id of the article's own part.
ARTICLE_NAMES = frozenset("article post entry story content prose main articlebody".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _names(attrs: dict[str, str | None]) -> set[str]:
    return {x.lower() for x in NAME_PARTS.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}


def _aside(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in ASIDES or (tag == "header" and not in_article):
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if "display:none" in (attrs.get("style") or "").lower().replace(" ", ""):
        return True
    if (attrs.get("role") or "").strip().lower() in ASIDE_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    return not _names(attrs).isdisjoint(ASIDE_ARTICLES if tag in ("article", "main") else ASIDE_NAMES)


class BlockReader(HTMLParser):
    """Collects ``(text, words, linked words, aside, in_article, heading, label)`` of a page's blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, aside, in_article, heading, label
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.silent: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            words = text.count(" ") + 1
            state = self.stack[-1][1:] if self.stack else (False, False, False, False)
            self.blocks.append((text, words, min(self.linked, words), *state))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            elif tag != "body" or "head" not in self.silent:
                return
            else:
                self.silent = []  # a head that was never closed
        if tag in NO_TEXT:
            self.silent.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.links += 1
            return
        attrs = dict(attrs)
        block = tag in BLOCKS
        if not block and tag not in ASIDES and not ("class" in attrs or "id" in attrs or "hidden" in attrs or "style" in attrs or "data-main" in attrs):
            return
        if tag in VOID:
            if block:
                self.flush()
            return
        if block:
            self.flush()
            self._imply(tag)
        _, aside, in_article, heading, label = self.stack[-1] if self.stack else ("", False, False, False, False)
        own = _aside(tag, attrs, in_article)
        if own != aside and own and not block:
            self.flush()
        of_article = tag in ("article", "main") or attrs.get("role") == "main"
        if block and tag != "body" and not _names(attrs).isdisjoint(ARTICLE_NAMES):
            of_article = True
        self.stack.append((tag, aside or own, in_article or of_article, heading or tag in HEADINGS, label or "data-main" in attrs))

    def _imply(self, tag: str) -> None:
        """Ends that HTML implies before a block starts."""
        ends = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
        for name, within in [("p", ("td", "th", "li", "div", "section", "article", "body", "blockquote")), ends.get(tag, (None, ()))]:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == name:
                    del self.stack[at:]
                    break
                if self.stack[at][0] in within:
                    break

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag == "head":
                self.silent = []
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag in BLOCKS:
            self.flush()
            self.links = 0 if tag in ("nav", "ul", "ol", "table", "section", "article", "body") else self.links
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                if tag not in BLOCKS and self.stack[at][1] != (at > 0 and self.stack[at - 1][1]):
                    self.flush()
                del self.stack[at:]
                break

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())


def read_blocks(html: str) -> list[dict]:
    """The blocks of a page as dictionaries of ``text``, ``FEATURES`` and ``label``."""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    found = reader.blocks
    density = [linked / words for _, words, linked, *_ in found]
    edge = (0.0, 0.0)
    out = []
    for i, (text, words, _, aside, in_article, heading, label) in enumerate(found):
        before = (float(found[i - 1][1]), density[i - 1]) if i else edge
        after = (float(found[i + 1][1]), density[i + 1]) if i + 1 < len(found) else edge
        values = (float(words), density[i], *before, *after, float(aside), float(in_article), float(heading))
        out.append({"text": text, **dict(zip(FEATURES, values)), "label": float(label)})
    return out


BLOCK_TYPE = "struct<text:string," + ",".join(f"{f}:double" for f in FEATURES) + ">"


def page_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``blocks``, an array of structs of ``text`` and ``FEATURES`` in page order."""
    others = [c for c in pages.columns if c != "blocks"]
    frame = pages.select(*[F.col(f"`{c}`") for c in others], text_or_empty(html_col).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "__html")
    kind = pa.list_(pa.struct([("text", pa.string()), *((f, pa.float64()) for f in FEATURES)]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, len(others)):
                blocks = [[{k: v for k, v in b.items() if k != "label"} for b in read_blocks(h)] for h in batch.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(blocks, kind)], [*others, "blocks"])

    return frame.mapInArrow(run, f"{schema}, blocks array<{BLOCK_TYPE}>")


def train_tree(spark: SparkSession, samples: list[str] = PAGES, depth: int = 6):
    """A decision tree over the blocks of labelled sample pages, in which ``data-main`` marks the main text."""
    rows = [([b[f] for f in FEATURES], b["label"]) for html in samples for b in read_blocks(html)]
    table = spark.createDataFrame(rows, "values array<double>, label double").coalesce(1)
    table = table.select(array_to_vector("values").alias("features"), "label")
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=1).fit(table)


def is_main(model, block: Column) -> Column:
    """The tree as an expression of a block."""

    def visit(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        value = block[FEATURES[split.featureIndex()]]
        return F.when(value <= split.threshold(), visit(node.leftChild())).otherwise(visit(node.rightChild()))

    return visit(model._call_java("rootNode"))


def main_text(pages: DataFrame, html_col: str = "html", model=None) -> DataFrame:
    """``pages`` without ``html_col``, with ``text``: the blocks that the tree takes for the article."""
    model = model or train_tree(pages.sparkSession)
    rows = page_blocks(pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "text"]), html_col)
    main = F.filter("blocks", lambda b: is_main(model, b))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n")
    return rows.withColumn("text", text).drop("blocks", html_col)
