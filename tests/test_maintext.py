"""Main text against planted navigation, comments, side bars and broken pages."""

from __future__ import annotations

import random

import pytest

from tidewatch.operators.maintext import best_run, main_text

WORDS = "river council opened gates after heavy rain while engineers checked the old dam and farmers moved their herds".split()


def _sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(rng, paragraphs):
    links = lambda n: "".join(f'<li><a href="/{i}">{_sentence(rng, 3)}</a></li>' for i in range(n))
    body = "".join(f"<p>{p}</p>" if rng.random() < 0.8 else f"<div>{p}</div>" for p in paragraphs)
    return f"""<html><head><title>A  title</title><style>p{{}}</style></head><body><header class="site-header"><ul>{links(6)}</ul></header>
      <div class="breadcrumb"><a href="/">Home</a> / News</div><div id="main"><h1>Rain and the river</h1>{body}<script>var x = "NOPE";</script></div>
      <div class="related-posts"><h3>Read more</h3><ul>{links(5)}</ul></div><div class="sidebar"><p>SIDEBAR {_sentence(rng, 30)}</p></div>
      <section id="comments"><p>COMMENT {_sentence(rng, 40)}</p><p>COMMENT {_sentence(rng, 25)}</p></section><footer>FOOTER {_sentence(rng, 20)}</footer></body></html>"""


@pytest.mark.parametrize("seed", range(12))
def test_what_stands_beside_a_text_is_left_out(seed):
    rng = random.Random(seed)
    paragraphs = [_sentence(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 9))]
    title, text, method, status = main_text(_page(rng, paragraphs))
    assert (title, method, status) == ("A title", "density", "full")
    assert text.split("\n")[-len(paragraphs) :] == paragraphs and text.startswith("Rain and the river")
    assert not any(x in text for x in ("SIDEBAR", "COMMENT", "FOOTER", "NOPE", "Home", "Read more"))


def test_the_ways_follow_each_other():
    assert main_text("<html><head><title>T</title></head><body><p>Short words.</p></body></html>") == ("T", "Short words.", "blocks", "full")
    assert main_text('<head><title>Only a title</title><meta name="description" content="and what it says"></head><body><nav>' + "x" * 90 + "</nav></body>") == ("Only a title", "Only a title\nand what it says", "title", "partial")
    assert main_text("<title>T</title>") == ("T", "", "none", "failed")
    for nothing in (None, "", "<<<>>", "</div></p>", "<p>"):
        assert main_text(nothing)[1:] == ("", "none", "failed") or len(main_text(nothing)[1]) < 10
    broken = "<body><div><p>" + "An unclosed paragraph of some length goes on here " * 3 + "<p>and another " + "one follows it " * 6
    assert main_text(broken)[2:] == ("density", "full") and main_text(broken)[1].count("\n") == 1


def test_runs():
    assert best_run([]) == (0, 0) and best_run([-1.0, -2.0]) == (0, 0)
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.uniform(-5, 5) for _ in range(rng.randint(1, 12))]
        a, b = best_run(scores)
        most = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == pytest.approx(most)
