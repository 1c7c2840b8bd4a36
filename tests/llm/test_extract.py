"""Main text against a naive scorer over random trees, and on pages that are easy to get wrong."""

import random
import time
from xml.etree import ElementTree

import pytest

from sievemark.llm.extract import main_text

STORY = "".join(f"<p>Paragraph {k} of the story, with commas, and of a good length to count.</p>" for k in range(6))
PLAIN = [f"Paragraph {k} of the story, with commas, and of a good length to count." for k in range(6)]


def test_letters_that_grow_in_lower_case_shift_nothing():
    assert main_text("İ" * 20 + "<SCRIPT>var x</scRIPT ><p>visible text here, it is so</p>").endswith("visible text here, it is so")
    assert main_text("<p>long enough to be a paragraph, this</p><style>a</ſtyle>b</style><p>second one, also long enough</p>").endswith("second one, also long enough")
    assert main_text("<p>kept text, and long enough it is</p><script>never closed <p>x</p>") == "kept text, and long enough it is"


def test_scores_decide_over_article_and_main():
    teaser = "<article>One sentence of a teaser, no more than that.</article>"
    assert main_text(f"<body>{teaser}<div class='content'>{STORY}</div></body>").split("\n\n") == PLAIN
    assert main_text(f"<body><main><h1>Head</h1><div>{STORY}</div></main></body>").split("\n\n") == ["Head", *PLAIN]
    assert main_text(f"<body><h1>Head</h1><div>{STORY}</div><h2>Related</h2></body>").split("\n\n") == ["Head", *PLAIN]
    assert main_text("<body><article><p>Short. Yes, it is.</p></article><footer><p>Long footer, with commas, and it never ends, no.</p></footer></body>") == "Short. Yes, it is."


def test_class_words_discount_and_remove_no_paragraph():
    assert main_text(f"<div class='post'>{STORY}<p class='tags-explained search-results'>What tags mean, in a story.</p></div>").split("\n\n") == [*PLAIN, "What tags mean, in a story."]
    assert main_text(f"<div class='share-wrapper'>{STORY}</div>").split("\n\n") == PLAIN
    assert main_text(f"<div class='post'>{STORY}</div><div class='share-wrapper'>Share this, please, with all of your friends.</div>").split("\n\n") == PLAIN
    comments = "<p>" + "Great post, thanks, really, very nice, and so on. " * 20 + "</p>"
    for name in ("comments", "post-comments", "comment-list", "commentlist"):
        assert main_text(f"<div><div class='story'>{STORY}</div><div id='{name}'>{comments}</div></div>").split("\n\n") == PLAIN
    assert main_text(f"<div>{STORY}<div class='ad'>{comments}</div><p class='ad'>Buy, buy, and buy again, now.</p></div>").split("\n\n") == PLAIN
    assert main_text(f"<div class='post'><header><h1>Head</h1></header>{STORY}</div>").split("\n\n") == ["Head", *PLAIN]
    assert main_text(f"<body><header><h1>Site</h1></header><div class='post'>{STORY}</div></body>").split("\n\n") == PLAIN
    assert main_text(f"<div>{STORY}<p hidden>not seen, by any reader at all</p><p data-hidden=1>seen, by every reader of it</p></div>").split("\n\n") == [*PLAIN, "seen, by every reader of it"]


@pytest.mark.parametrize("html", ["<p a=b {}>text of it</p>", "<p {}=>text of it</p>", "<p a='{}'>text of it</p>", "<p {}", "<" * 3 + "{}", "{}<a <b <c", "<!--{}", "<div class='{} '>text of it</div>"])
def test_long_runs_take_linear_time(html):
    began = time.time()
    main_text(html.format("x" * 1_000_000))
    main_text(html.format("x " * 300_000))
    main_text(html.format("<a \"'" * 20_000))
    assert time.time() - began < 10


def naive(page):
    """The rules word for word over a well-formed page, quadratic and recursive."""
    root = ElementTree.fromstring(page)
    parent = {c: p for p in root.iter() for c in p}
    containers, headings, inline = {"article", "main", "section", "div", "body", "html"}, {"h1", "h2"}, {"a", "b"}

    def gone(e):
        return e.tag in ("nav", "footer") or e.get("class") in ("ad", "comments")

    def up(e):
        return [e, *up(parent[e])] if e in parent else [e]

    runs = []  # block, text, linked characters

    def walk(e, block, linked):
        def add(text):
            if text:
                if runs and runs[-1][3] and runs[-1][0] is block:
                    runs[-1][1] += text
                    runs[-1][2] += len(text) * linked
                else:
                    runs.append([block, text, len(text) * linked, True])

        def cut():
            if runs:
                runs[-1][3] = False

        add(e.text)
        for c in e:
            if gone(c):
                if c.tag not in inline:
                    cut()
            elif c.tag in inline:
                walk(c, block, linked or c.tag == "a")
            else:
                cut()
                walk(c, c, linked)
                cut()
            add(c.tail)

    walk(root, root, False)
    found = [(b, " ".join(t.split()), k) for b, t, k, _ in runs if t.split()]
    doubtful = [e for e in root.iter() if e.tag in ("div", "section") and e.get("class") == "share-box"]
    worth = lambda t: 1 + min(len(t) / 100, 3) + t.count(",") if len(t) >= 25 else 0
    net = lambda rows: sum(worth(t) * (1 - min(1, k / len(t))) for _, t, k in rows)
    inside = lambda e: [r for r in found if e in up(r[0])]
    out = {id(r) for e in doubtful for r in inside(e) if 2 * net(inside(e)) <= net(found)}
    found = [r for r in found if id(r) not in out]
    if not found:
        return ""

    def density(e):
        return sum(min(k, len(t)) for _, t, k in inside(e)) / max(1, sum(len(t) for _, t, _ in inside(e)))

    def score(e):
        total = 0.0
        for b, t, _ in found:
            line = [x for x in up(b if b.tag in containers or b not in parent else parent[b]) if x.tag in containers]
            if e in line:
                level = line.index(e)
                total += worth(t) / (1 if level == 0 else 2 if level == 1 else 3 * level)
        return total * (1 - density(e)) * (2 if e.tag in ("article", "main") else 1)

    order = []
    for b, _, _ in found:
        order += [x for x in up(b) if x not in order]
    best = max(order, key=lambda e: (round(score(e), 9), sum(len(t) for _, t, _ in inside(e))))
    told = [e for e in order if e.tag in ("article", "main") and density(e) < 0.6]
    if score(best) <= 0 and told:
        told = max(told, key=lambda e: sum(len(t) for _, t, _ in inside(e)))
        return "\n\n".join(t for b, t, _ in found if told in up(b))
    if score(best) <= 0:
        return "\n\n".join(t for _, t, k in found if k < 0.5 * len(t))
    while best in parent and parent[best].tag in containers and score(parent[best]) >= score(best):
        best = parent[best]
    keep = [best]
    if best in parent:
        line = [x for x in parent[best] if inside(x)]
        at = line.index(best)
        k = at
        while k and line[k - 1].tag in headings:
            keep.append(line[k := k - 1])
        for x in line:
            n = sum(len(t) for _, t, _ in inside(x))
            own = [t for b, t, _ in found if b is x]
            prose = x.tag == "p" and (n > 80 and density(x) < 0.25 or density(x) == 0 and bool(own) and own[-1][-1] in ".!?")
            if x is not best and (x.tag in containers and score(x) >= max(10, 0.2 * score(best)) or prose):
                keep.append(x)
    return "\n\n".join(t for b, t, _ in found if any(x in keep for x in up(b)))


def random_page(rng):
    def words():
        return " ".join(rng.choice(["word", "longer", "comma,", "end.", "of", "sentence"]) for _ in range(rng.randint(1, 40)))

    def inside(depth):
        parts = [words()] if rng.random() < 0.2 else []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "p", "h1", "h2", "a"] + ["div", "div", "section", "article", "main", "nav", "footer"] * (depth < 4))
            if kind in ("p", "h1", "h2"):
                parts.append(f"<{kind}>{words()}{'<b>' + words() + '</b> ' if rng.random() < 0.2 else ''}{'<a>' + words() + '</a>' if rng.random() < 0.2 else ''}</{kind}>")
            elif kind == "a":
                parts.append(f"<a>{words()}</a> ")
            else:
                name = rng.choice(["", "", "", " class='ad'", " class='comments'", " class='share-box'", " class='wrap'"]) if kind in ("div", "section") else ""
                parts.append(f"<{kind}{name}>{inside(depth + 1)}</{kind}>")
        return "".join(parts)

    return f"<html><body>{inside(0)}</body></html>"


def test_main_text_equals_the_naive_scorer():
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(400)] + ["<html><body><p>a</p><article><p>b, c</p></article><main><a>d</a></main><h1>e</h1></body></html>"]
    texts = [main_text(p) for p in pages]
    assert [p for p, t in zip(pages, texts, strict=True) if t != naive(p)] == []
    assert sum("\n\n" in t for t in texts) > 100


def test_clashing_names(spark):
    from sievemark.llm.extract import extracted

    pages = spark.createDataFrame([(1, "<p>some text</p>", "u", "x")], "page_id long, html string, url string, _html string")
    assert extracted(pages, keep=("url", "_html", "html")).first().asDict() == {"page_id": 1, "url": "u", "_html": "x", "html": "<p>some text</p>", "text": "some text"}
    with pytest.raises(ValueError, match="result columns"):
        extracted(pages.withColumnRenamed("url", "text"), keep=("text",))
