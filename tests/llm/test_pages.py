"""Readers' comments, whole-page forms, split references and broken markup in page extraction."""

import time

import pytest

from evenhand.llm.html_text import main_text

PART = "Some long running text of the article with enough words to count in it. "
SAYS = "Readers say many things in this place about it all the time here. "
P, C = f"<p>{PART * 6}</p>", f"<p>{SAYS * 9}</p>"
ARTICLE_TEXT = (PART * 6).strip()


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        (f"<article><h1>T</h1>{P}<section id='comments'><h2>Comments</h2>{C}{C}</section></article>", 1),
        (f"<article>{P}<div class='comments'>{C * 3}</div></article>", 1),
        (f"<article>{P}<ol class='comments-list'><li>{C}</li><li>{C}</li></ol></article>", 1),
        (f"<div class='post'>{P}{P}</div><div id='comments'>{C * 5}</div>", 2),
        (f"<article>{P}</article><section class='comments'>{f'<article class=comment>{C}</article>' * 4}</section>", 1),
        (f"<article>{P}</article>{f'<article class=comment>{C}</article>' * 4}", 1),
        (f"<main>{P}<div id='disqus'>{C * 4}</div></main>", 1),
    ],
)
def test_comments_go_whatever_their_share(body, blocks):
    found = main_text(f"<html><body>{body}</body></html>")
    assert "Readers say" not in found and "Comments" not in found
    assert found.count(ARTICLE_TEXT) == blocks


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{P}<section id='discussion'>{P}</section></article>",
        f"<article><h2 id='comments'>Comments on the law</h2>{P}{P}</article>",
        f"<article class='comments'><h1>T</h1>{P}{P}</article>",
        f"<article><div class='comments'>{P}</div>{P}</article>",
    ],
)
def test_text_of_the_article_stays(body):
    assert main_text(f"<html><body>{body}</body></html>").count(ARTICLE_TEXT) == 2


def test_a_form_around_the_page_is_no_form():
    page = f"<body><form id='aspnetForm'><input name=x><nav>menu</nav><div><article><h1>T</h1>{P}{P}</article></div><button>Go</button></form></body>"
    assert main_text(page) == f"T\n{ARTICLE_TEXT}\n{ARTICLE_TEXT}"


@pytest.mark.parametrize("form", [f"<form><label>{'name ' * 300}</label><input></form>", "<form><p>Write to us</p><select><option>a</select></form>"])
def test_forms_on_a_page_go(form):
    assert main_text(f"<body><article>{P}</article>{form}</body>") == ARTICLE_TEXT


def test_references_end_where_their_text_does():
    assert main_text("<body><article><p>R&<i>copy</i> AT&<b>amp;</b> &amp;copy; &eacute;<i>&lt;</i></p></article></body>") == "R&copy AT&amp; &copy; é<"


@pytest.mark.parametrize("part", ['<a "', "<a ", "<div>", "<p>", "</ul>", "<li>", "<td>", "<!--", "<b>", "<div><p>", "<a '>\""])
def test_a_megabyte_of_broken_markup_is_read(part):
    for page in (part * (1_000_000 // len(part)), "<div>" * 20_000 + part * (500_000 // len(part)) + ">"):
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 12  # seconds; before, such pages took the square of their length
