"""HTML extraction and chat formatting."""

import hashlib
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from sluicework.llm import chat, labelled_pages
from sluicework.llm.html import extract, main_text, parse, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return train(labelled_pages.labelled_pages())


def article(source):
    """What stands in the article of a page of the test data."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract(spark, pages).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}


def _right(model, layout: str, rng: random.Random) -> float:
    """Share of text runs of three pages of a layout that the model labels as the layout does."""
    right = total = 0
    for _ in range(3):
        page = parse(labelled_pages._fill(layout, rng))
        for i, node in enumerate(page.nodes):
            node.y = page.nodes[node.parent].y if node.y < 0 and i else max(node.y, 0)
        chance = model.marginals(page)
        right += sum((chance[n] >= 0.5) == (page.nodes[n].y == 1) for n, _ in page.runs)
        total += len(page.runs)
    return right / total


def test_other_fillings(model):
    rng = random.Random(99)
    assert all(_right(model, layout, rng) == 1 for layout in labelled_pages.LAYOUTS)


def test_layouts_not_seen():
    """A model of all layouts but one, on that one. Bare text of a body is like no other layout and is left out here."""
    shares = []
    for layout in labelled_pages.LAYOUTS:
        rng = random.Random(7)
        rest = [labelled_pages._fill(other, rng) for other in labelled_pages.LAYOUTS if other != layout for _ in range(labelled_pages.VARIANTS)]
        shares.append(_right(train(rest), layout, random.Random(99)))
    bare = labelled_pages.LAYOUTS.index('<body data-label="1">{S}</body>')
    assert sum(share >= 0.95 for share in shares) >= len(shares) - 2 and all(share >= 0.7 for i, share in enumerate(shares) if i != bare)


_S = "The fox runs over it, and far. It was seen by all. Nobody knew, though, why it ran. "


@pytest.mark.parametrize(
    "source,text",
    [
        ("<body>{}</body>", "{}"), ("<body><p>{}</p><p>{}</p></body>", "{}\n\n{}"), ("<article><p><a href='x'>{}</a></p><p>{}</p></article>", "{}\n\n{}"),
        ('<div class="site has-sidebar"><div class="content sidebar-right"><p>{}</p></div></div>', "{}"), ("<div><p>{}</p></div><div>Copyright 2020</div>", "{}"),
        ("<article><header><h1>Title</h1></header><p>{}</p></article>", "Title\n\n{}"), ("<article><p>{}</p></article><div class='user-talk'><p>{}</p></div>", "{}"),
        ("<article><p>{}</p><div class='newsletter'><p>{}</p></div><p>{}</p></article>", "{}\n\n{}"),
    ],
)
def test_pages_without_divisions(model, source, text):
    assert main_text(model, source.replace("{}", _S)) == text.replace("{}", _S.strip())


@pytest.mark.parametrize("source", ["<aaaa" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<p>" + "<b>" * 50_000 + "<h1>" * 50_000, "<div><b><h1>" * 50_000])
def test_parsing_is_linear(model, source):
    start = time.monotonic()
    assert main_text(model, source) == ""
    assert time.monotonic() - start < 20


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""), ("<", ""), ("<p", ""), ("<script>var a='<p>x</p>'", ""), ("<!-- <p>x</p>", ""),
        ("<article><p>a &#x41;&nbsp;b &lt;i&gt;</p><ul><li>one<li>two</ul></article>", "a A b <i>\n\none\n\ntwo"),
        ("<article><p>one<br>two <b>x<p>y\n\n z</article><footer>no</footer>", "one two x\n\ny z"),
        ("<main><h1>T</h1><p>Text here, and more.</p><form><p>Mail</p><input></form></main>", "T\n\nText here, and more."),
        ("<nav><a href='/'>home</a></nav><article><p>A</p><aside class='comments'><p>Reader says.</p></aside></article>", "A"),
        ("<article><style>p{}</style><p>A<script>1</script>B</p><noscript><p>no</p></noscript></article>", "AB"),
    ],
)
def test_markup(model, source, text):
    assert main_text(model, source) == text


def test_no_page_fails(model):
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<", ">", "&amp", "&#99999999;", "<!--", "-->", "<li>", "</ul>", "<table><tr><td>", "text ", "<script>", "</script>", '"', "'", "<br/>", "<x-y>", "\x00", "<svg>", "</body>"]
    for _ in range(300):
        main_text(model, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))))
    assert main_text(model, "<div>" * 3000 + "x" + "</div>" * 10) in ("", "x")
    assert len(main_text(model, "<article><p>" + "word " * 300_000)) > 1_000_000


def test_pages_table_cases(spark):
    rows = [(1, None, None, 1), (2, "u", "", 2), (None, "u", "<article><p>x y. Z</p></article>", 3), (2, "u", "", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    assert sorted((str(r.page_id), r.text) for r in extract(spark, df).collect()) == [("1", ""), ("2", ""), ("2", ""), ("None", "x y. Z")]
    assert extract(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "tag", ["<p title=it's>", "<p title=\"Tom\"s\">", "<p it's>", "<p title='never closed>", "<p title=\"a>b\" x='>' y = \"c>\">", "<p title=a=\"b>", "</3><p>", "</ it's><p>", "<p class=x/>", "<p title=it's class='y'>"]
)
@pytest.mark.parametrize("rest", ["", "<p>four \"quoted\" words</p>"])
def test_odd_quotes_end_with_their_tag(tag, rest):
    page = parse(f"<p>one</p>{tag}two</p><p>three</p>{rest}")
    assert [text for _, text in page.runs] == ["one", "two", "three", *(['four "quoted" words'] if rest else [])]


def test_tags_that_never_end():
    assert [text for _, text in parse("<p>one</p><p title=\"x>two").runs] == ["one", "two"]
    assert [text for _, text in parse("<p>one</p><p>two</p><a title='x>y' three").runs][:2] == ["one", "two"]
    assert [text for _, text in parse("<p>one</p><a href=x three").runs] == ["one"]
    assert [text for _, text in parse("<p>1 < 2 <é <</p>").runs] == ["1 < 2 <é <"]


# --- chat


def test_escape_is_reversible():
    rng = random.Random(2)
    bits = ["<", "\\", "|", "[", "INST]", "/INST]", "</s>", "s>", "/", "end", "|>", "<|end|>", "<|turn|>", "a", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(x in shown for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def wanted(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    from sluicework.llm.queries import QUERIES

    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_formatting"](spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    talks = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == {c: wanted([x[1:] for x in sorted(t)]) for c, t in talks.items()}


def test_conversation_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "<|end|>\n"), (None, 0, None, "x"), (2, None, "assistant", "b"), (2, 5, "as|>", "<|says|>"), (2, 5, "as|>", "<|says|>"), (3, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == {
        1: wanted([("user", "<|end|>\n"), ("assistant", "")]), None: wanted([(None, "x")]), 2: wanted([("assistant", "b"), ("as|>", "<|says|>"), ("as|>", "<|says|>")]), 3: wanted([("", "")]),
    }
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_parts(spark):
    """Placeholders in order, with references and expanded token counts."""
    text = ("text", "see <|image|>", None, None, None, None, None)
    parts = [text, ("image", None, "a.png", 57.0, 28.0, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2.0), (None, "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [text]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS.simpleString()}")
    row = chat.format_conversations(df).first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 2048)]
    assert [row.formatted[a.place :].startswith(f"<|{a.kind}|>") for a in row.attachments] == [True] * 3
    assert [chat.unescape(row.formatted[s.start : s.end]) for s in row.loss] == ["see <|image|>"]
    assert chat.parse(row.formatted)[0] == ("user", "see <|image|><|image|><|audio|><|document|>end")


def test_parts_side_by_side_and_odd_parts():
    """Random cuts through control strings read back; null parts, undefined sizes and unknown kinds end no job."""
    import random

    from sluicework.llm.chat import format_turns, parse

    part = dict.fromkeys(("kind", "text", "ref", "width", "height", "seconds", "pages"))
    rng = random.Random(5)
    bits = ["<", "|", "end|>", "<|end|>", "\\", "</s>", "[", "/INST]", "[INST]", "<|image|>", "x", "|turn|>", ""]
    for _ in range(2000):
        texts = [[rng.choice(bits) for _ in range(rng.randint(0, 5))] for _ in range(3)]
        turns = [{"role": rng.choice(["user", "assistant", "<|says|>"]), "parts": [{**part, "kind": rng.choice(["text", None, "new"]), "text": x} for x in t]} for t in texts]
        made, loss, attached = format_turns(turns)
        assert parse(made) == [(t["role"], "".join(x)) for t, x in zip(turns, texts, strict=True)]
        assert len(loss) == sum(t["role"] == "assistant" for t in turns) and not attached
    odd = [None, {**part, "kind": "image", "width": float("nan"), "height": 3.0}, {**part, "kind": "text", "text": "<"}, {**part, "kind": "audio", "ref": "a", "seconds": float("inf")}, {**part, "text": "|end|>"}]
    made, _, attached = format_turns([{"role": "user", "parts": odd}, {"role": "user", "parts": None}])
    assert [(a["kind"], a["tokens"], a["turn"]) for a in attached] == [("image", 1, 0), ("audio", 1, 0)]
    assert all(made[a["place"] :].startswith(f"<|{a['kind']}|>") for a in attached)
    assert len(parse(made)) == 2
