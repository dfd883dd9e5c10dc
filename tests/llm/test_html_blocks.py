"""Main text of pages."""

import html
import re

import pytest
from conftest import SMALL

from ledgerspark.llm import html_blocks as hb
from ledgerspark.llm.queries import op1


@pytest.fixture(scope="module")
def model(spark):
    return hb.train_tree(spark)


def extract(spark, model, pages):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    return [r.text for r in sorted(hb.main_text(frame, model=model).collect())]


PROSE = "The carpenters walked to the market while the river rose behind them and nobody looked back at the bridge."


def test_parts_that_are_not_the_article(spark, model):
    article = f"<h1>A title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} <a href='/x'>A link</a> in it.</p>"
    want = f"A title\n{PROSE}\nShort.\n{PROSE} A link in it."
    around = [
        "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>{}",
        f"<header><p>{PROSE}</p></header>{{}}<footer><p>{PROSE}</p></footer>",
        f"{{}}<aside><p>{PROSE}</p></aside><div class='sidebar-left'>{PROSE}</div>",
        f"<div id='cookieNotice'><p>{PROSE}</p></div>{{}}<div class=\"ad\">{PROSE}</div><div class='ad'>Buy.</div>",
        f"{{}}<form><p>{PROSE}</p><textarea>{PROSE}</textarea><button>Send</button></form>",
        f"<script>var a='</p><p>{PROSE}';</script><style>p{{{{}}}}</style>{{}}<!-- <p>{PROSE}</p> --><noscript>{PROSE}</noscript>",
        f"{{}}<section class='comments'><article class='comment'><p>{PROSE}</p></article><p>{PROSE}</p></section>",
        f"<div role='dialog'>{PROSE}</div><div style='display: none'>{PROSE}</div><div hidden>{PROSE}</div>{{}}",
    ]
    pages = [f"<html><head><title>T {PROSE}</title></head><body>{a.format(f'<article>{article}</article>')}</body></html>" for a in around]
    assert extract(spark, model, pages) == [want] * len(pages)


def test_text_of_blocks(spark, model):
    pages = [
        "<article><p>a &amp; b &lt;i&gt; &eacute;&#233;\n\t c</p><p>x<b>y</b>z <i>w</i></p></article>",
        "<article><p><b>unclosed<br><p>next<p>last",
        "<article><ul><li>one two three<li>four five six</ul><table><tr><td>c1 c1 c1<td>c2 c2 c2</table></article>",
        "<article><p>1 < 2 and 3 > 2</p></article>",
        "", None, "<nav><a href='/'>Home</a></nav>", f"<article><p>{'w ' * 100_000}</p></article>",
        "<article>" + "<div>" * 5000 + "deep text here" + "</div>" * 5000 + "</article>",
    ]
    got = extract(spark, model, pages)
    assert got[:4] == ["a & b <i> éé c\nxyz w", "unclosed\nnext\nlast", "one two three\nfour five six\nc1 c1 c1\nc2 c2 c2", "1 < 2 and 3 > 2"]
    assert got[4:7] == ["", "", ""] and len(got[7]) == 199_999 and got[8] == "deep text here"


def test_samples_are_learned(model):
    blocks = [b for p in hb.PAGES for b in hb.read_blocks(p)]
    assert len(blocks) > 150 and 0.2 < sum(b["label"] for b in blocks) / len(blocks) < 0.8


def test_held_out_accuracy(spark):
    """Train on all sample pages but one, judge its blocks; every page in turn."""
    right = total = 0
    for i in range(0, len(hb.PAGES), 4):
        model = hb.train_tree(spark, hb.PAGES[:i] + hb.PAGES[i + 1 :])
        blocks = hb.read_blocks(hb.PAGES[i])
        frame = spark.createDataFrame([([b[f] for f in hb.FEATURES], b["label"]) for b in blocks], "v array<double>, label double")
        from pyspark.ml.functions import array_to_vector

        judged = model.transform(frame.select(array_to_vector("v").alias("features"), "label"))
        right += judged.where("prediction = label").count()
        total += len(blocks)
    assert right / total >= 0.9


def test_given_pages(spark):
    got = {r.page_id: r for r in op1(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", row.html).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[row.page_id].text == "\n".join(x for x in parts if x)
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_repeated_rows_clashing_columns_and_empty(spark, model):
    rows = [(1, "<article><p>some text</p></article>", "t", 1)] * 2
    frame = spark.createDataFrame(rows, "page_id long, html string, text string, blocks int")
    got = hb.main_text(frame, model=model)
    assert [r.text for r in got.collect()] == ["some text"] * 2 and got.columns == ["page_id", "text"]
    assert hb.main_text(frame.limit(0), model=model).collect() == []
