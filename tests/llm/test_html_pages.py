import time

import pytest

from tidewater.llm import html_text

PARAGRAPHS = [f"This is the {n} paragraph of the article, and it is as long as the paragraphs of an article are when they have something to say to those who read them, which is what we want to keep here." for n in ("first", "second", "third")]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
AROUND = '<nav><a href="/">Start</a> <a href="/n">News</a></nav>{}<div class="sidebar"><p>Other things of the day that you may want to read on this site.</p></div><footer>The end of the page</footer>'


def text_of(middle):
    return html_text.main_text(f"<html><body>{AROUND.format(middle)}</body></html>")


@pytest.mark.parametrize("name", ["has-sidebar", "layout no-sidebar", "with-comments", "page ad-free", "post-form", "cookie-page", "searchResults"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_wrappers_are_not_boilerplate(name, tag):
    assert text_of(f'<{tag} class="{name}">{BODY}</{tag}>') == " ".join(PARAGRAPHS)
    assert text_of(f'<{tag} id="{name}"><article>{BODY}</article></{tag}>') == " ".join(PARAGRAPHS)


@pytest.mark.parametrize("name", ["share-content", "comments-open", "tags", "post form"])
def test_hints_inside_an_article(name):
    assert text_of(f'<article><h1>Head</h1><div class="{name}">{BODY}</div></article>') == "Head " + " ".join(PARAGRAPHS)


def test_a_form_around_the_page():
    page = f'<body><form id="page"><div class="menu"><a href="/">Start</a></div>{BODY}</form></body>'
    assert html_text.main_text(page) == " ".join(PARAGRAPHS)


def test_named_boilerplate_still_goes():
    ad, share = '<div class="ad">Buy this now, it is the best of all the things that you can have.</div>', '<div class="share-bar">Share it with those you know</div>'
    said = "".join(f"<p>I think that {n} of the things in this article are right and that the others are not.</p>" for n in range(6))
    assert text_of(f"<article>{ad}{BODY}{share}</article>") == " ".join(PARAGRAPHS)
    assert text_of(f'<div>{ad}{BODY}{share}</div><div id="comments">{said}</div>') == " ".join(PARAGRAPHS)
    assert text_of(f'<article>{BODY}<section class="post-comments">{said}</section></article>') == " ".join(PARAGRAPHS)


def test_pictures_end_where_they_end():
    for picture in ('<svg class="i"/>', '<svg viewBox="0 0 1 1"><path d="M0"/><text>no</text></svg>', "<math/>", '<svg title="a > b"/>'):
        first, rest = BODY.split("</p>", 1)
        assert text_of(f"<article>{first} {picture}</p>{rest}</article>") == " ".join(PARAGRAPHS)


def test_text_after_an_inline_hint_stays():
    assert text_of(f'<article><p>One word <span class="ad">buy</span> and the rest of it.</p>{BODY}</article>') == "One word and the rest of it. " + " ".join(PARAGRAPHS)


def test_a_language_without_known_stop_words():
    polish = ["Wczoraj wieczorem mieszkańcy miasteczka zebrali się przed ratuszem, żeby wysłuchać burmistrza, który przez niemal godzinę opowiadał o planach przebudowy rynku oraz pobliskich ulic, mostów i parków."] * 3
    page = f"<body><div><a href=x>Strona</a> <a href=y>Wiadomości</a></div>{''.join(f'<p>{p}</p>' for p in polish)}<div class='cookie-notice'>Używamy ciasteczek.</div></body>"
    assert html_text.main_text(page) == " ".join(polish)


def test_long_pages_take_linear_time():
    took = []
    for n in (300, 3000):
        page = AROUND.format(f'<div class="ad">{BODY}' * n)
        t = time.process_time()
        text = html_text.main_text(page)
        took.append(time.process_time() - t)
        assert 0 < text.count("first paragraph") <= n
    assert took[1] < 25 * max(took[0], 0.05)


def test_given_pages_keep_their_articles(spark, sf):
    """Every paragraph of every article of the given pages, and nothing from its surroundings."""
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if article and "<form" not in article[1] and "class=" not in article[1]:
            want = " ".join(html.unescape(re.sub(r"<(?:p|/p|h1|/h1|br|h2|/h2|li|/li|ul|/ul)\b[^>]*>", " ", article[1])).split())
            assert html_text.main_text(r.html) == re.sub(r"</?b>", "", want)
