"""Main text of generated pages whose article is known, and of broken markup."""

import random
import time

import pytest

from kiloqueue.llm import html_text


def sentence(r, n=24):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n)).capitalize() + ", so it goes."


def page(seed, comments, frame, body, wrapper):
    """A page and its article: a frame element, an article element (or plain div), and comments inside or beside them."""
    r = random.Random(seed)
    title, paragraphs = sentence(r, 5), [sentence(r) for _ in range(r.randrange(3, 7))]
    article = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    open_body = {"article": "<article>", "div": '<div class="article">', "plain": "<div>"}[body]
    close_body = "</article>" if body == "article" else "</div>"
    said = "".join(f"<li><article><b>name{k}</b><p>{sentence(r, 12)}</p></article></li>" for k in range(comments))
    said = {"section": f'<section id="comments"><ol>{said}</ol></section>', "div": f'<div class="post-comments"><ul>{said}</ul></div>',
            "list": f'<ul class="commentlist">{said}</ul>'}[wrapper]
    open_frame = {"main": "<main>", "none": "", "named": '<div class="site sidebar-left" id="page-menu">'}[frame]
    close_frame = {"main": "</main>", "none": "", "named": "</div>"}[frame]
    links = "".join(f'<li><a href="/{k}">{sentence(r, 2)}</a></li>' for k in range(6))
    html = (f"<html><body><header><p>{sentence(r, 8)}</p></header><nav><ul>{links}</ul></nav>{open_frame}"
            f'<div class="sidebar"><p>{sentence(r, 10)}</p></div>{open_body}{article}{close_body}{said}'
            f'<div class="related"><ul>{links}</ul></div><div class="cookie-banner">{sentence(r, 20)}</div>{close_frame}'
            f"<footer>{sentence(r, 10)}</footer></body></html>")
    return html, "\n".join([title, *paragraphs])


@pytest.mark.parametrize("frame", ["main", "none", "named"])
@pytest.mark.parametrize("body", ["article", "div", "plain"])
@pytest.mark.parametrize("wrapper", ["section", "div", "list"])
def test_comments_never_win(frame, body, wrapper):
    for seed, comments in enumerate((0, 1, 2, 5, 20, 80, 200)):
        html, want = page(seed, comments, frame, body, wrapper)
        assert html_text.extract(html) == want, comments


def test_the_article_wins_over_articles_in_comments():
    text = "The council met on Monday, and the bridge, it said, will be closed for repairs until the spring of next year. "
    html = (f'<div class="article"><p>{text * 3}</p></div><section class="comments"><article><p>{"I never liked this bridge, or any other bridge at all. " * 9}'
            "</p></article></section>")
    assert html_text.extract(html) == " ".join((text * 3).split())


def test_cut_and_broken_tags_cost_one_pass():
    start = time.time()
    quotes = "".join(random.Random(1).choices("\"'", k=10_000))
    assert html_text.extract(f"<p>before</p><div class={quotes}") == "before"
    assert html_text.extract('<p>before</p><div class="' + 'a="' * 10_000) == "before"
    html_text.extract("<p>" + "<a " * 50_000 + ">")
    html_text.extract("<p>" + "<a x='" * 50_000)
    html_text.extract("<" * 100_000)
    assert time.time() - start < 5
    assert html_text.extract("<div><p title=\"it's 5\" tall\" class=x>text, that is</p></div>") == "text, that is"
    assert html_text.extract("<div><p class='a>b'>one, two</p><p data-x=\"<p>\">three, four</p></div>") == "one, two\nthree, four"
