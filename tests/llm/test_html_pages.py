"""Pages labelled by hand: what a reader would call the article's text."""

import time

import pytest

from sheetlake.llm.html_text import Page, main_text

A = "The cat is on the mat and it was not a dog for that, so they all went to the house by the sea. " * 3
B = "She had been there with her brother, and it was the first time that he saw what they had made of it. " * 3
A, B = A.strip(), B.strip()
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
LINKS = "<div><a href=1>First of the other stories here</a> <a href=2>Second of the other stories here</a></div>"

GOLD = {
    # elements that are never closed, or closed by what follows
    "li in a dropped class": (f"<body><ul><li class=promo>Buy<li>{A}<li>{B}</ul>", f"{A}\n{B}"),
    "li before paragraphs": (f"<body><li class=promo>Buy<p>{A}<p>{B}", f"{A}\n{B}"),
    "dt and dd": (f"<article><dl><dt class=ad>Buy<dd>{A}<dt>Next<dd>{B}</dl></article>", f"{A}\nNext\n{B}"),
    "cells": (f"<table><tr><td class=sidebar>Left<td><p>{A}<p>{B}</table>", f"{A}\n{B}"),
    "rows": (f"<table><tr class=banner><td>Top<tr><td>{A}<tr><td>{B}</table>", f"{A}\n{B}"),
    "option": (f"<p>{A}</p><select><option>One<option>Two</select><p>{B}", f"{A}\n{B}"),
    "open advert in an article": (f"<article><div class=ad>Buy<p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    "open advert in a div": (f"<div id=wrap><div class=ad>Buy<p>{A}</p><p>{B}</p></div></body>", f"Buy\n{A}\n{B}"),
    "open advert as a span": (f"<article><p><span class=ad>Buy<p>{A}<p>{B}</article>", f"{A}\n{B}"),
    "paragraph of an advert": (f"<article><p class=ad>Buy now<p>{A}<div>{B}</div></article>", f"{A}\n{B}"),
    "open link": (f"<article><p><a href=x>See<p>{A}<p>{B}</article>", f"See\n{A}\n{B}"),
    "open bold": (f"<article><p><b>{A}<p>{B}</article>", f"{A}\n{B}"),
    "open head": (f"<html><head><title>T</title><meta charset=utf-8><body><p>{A}", A),
    "stray ends": (f"</div></p></article><p>{A}</section></li></p></div><p>{B}", f"{A}\n{B}"),
    "cut off": (f"<article><p>{A}</p><p>{B}</p><a hr", f"{A}\n{B}"),
    # wrappers
    "form around the page": (f"<body><form action=/x>{NAV}<article><h1>Title</h1><p>{A}</p><p>{B}</p></article><footer>&copy; me</footer></form>", f"Title\n{A}\n{B}"),
    "short form page": ("<form><article><h1>Hello</h1><p>Short text.</p></article></form>", "Hello\nShort text."),
    "form without an article": (f"<body><form><div>{A}</div><div>{B}</div><input name=q></form>", f"{A}\n{B}"),
    "login section": (f"<section class='login'><article><p>{A}</p></article></section>", A),
    "login form beside": (f"<form class=login><p>Name <input></p><p>Word <input></p></form><article><p>{A}</p></article>", A),
    "aside of cards": (f"<div><p>{A}</p><p>{B}</p></div><aside><article><p>The next story is of a man and his dog.</p></article></aside>", f"{A}\n{B}"),
    # several articles, and text outside of them
    "teaser first": (f"<article>Short teaser.</article><div>{A}</div><div>{B}</div>", f"{A}\n{B}"),
    "two articles": (f"<article><p>{A}</p></article><article><p>{B}</p></article>", f"{A}\n{B}"),
    "no article": (f"{NAV}<div><h1>Title</h1><p>{A}</p><p>{B}</p></div>{LINKS}<footer>Imprint</footer>", f"Title\n{A}\n{B}"),
    "main": (f"{NAV}<main><h2>Title</h2><p>{A}</p></main><aside>More of it</aside>", f"Title\n{A}"),
    # comments, sidebars, footers, whatever else their names say
    "post-comments": (f"<article><p>{A}</p><div class='post-comments'><p>{B}</p></div></article>", A),
    "comments section": (f"<article><p>{A}</p></article><section id=comments><h2>Comments</h2><article class='comment'><p>{B}{B}{B}{B}{B}</p></article></section>", A),
    "comment articles alone": (f"<article class=post><p>{A}</p></article><article class='comment depth-1'><p>{B}</p></article>", A),
    "entry-footer": (f"<article><p>{A}</p><div class='entry-footer'><p>{B}</p></div></article>", A),
    "content-sidebar": (f"<article><p>{A}</p></article><div class='content-sidebar'><p>{B}</p></div>", A),
    "comment-body": (f"<article><p>{A}</p></article><div class='comment-body'>{B}</div>", A),
    "article-header": (f"<article><div class='article-header'><h1>Title</h1></div><p>{A}</p></article>", f"Title\n{A}"),
    "no-sidebar": (f"<div class='content no-sidebar'><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}"),
    "sponsored post": (f"<div class='post sponsored'><p>{A}</p></div>", A),
    "footer in article": (f"<article><header><h1>Title</h1></header><p>{A}</p><footer>By me</footer></article>", f"Title\n{A}"),
    "hidden": (f"<article><p>{A}</p><p hidden>{B}</p><p style='display: none'>{B}</p></article>", A),
    # what is in a page but no markup or text
    "raw elements": (f"<p>{A}</p><script>var x='<p>no</p>';</script ><style>p{{}}</style><textarea>t</textarea><svg><svg><text>n</text></svg>no</svg><p>{B}</p>", f"{A}\n{B}"),
    "open textarea and title": (f"<title>T<p>{A}</p><textarea>x<p>{B}</p>", f"{A}\nx\n{B}"),
    "comments of the markup": (f"<!-- <p>a</p> --><!--><p>{A}</p><!---><p>{B}</p><!-- open", f"{A}\n{B}"),
    "references": ("<article><p>a &amp; b &#65; &lt;p&gt; &nbsp; c</p><p>d\n\t e</p></article>", "a & b A <p> c\nd e"),
    "list of links in an article": (f"<article><p>{A}</p><ul><li><a href=1>One long link to another page</a><li><a href=2>Two long link to another page</a></ul><p>{B}</p></article>", f"{A}\n{B}"),
    "article in a table": (f"<table><tr><td>{NAV}</td><td><p>{A}</div></p><p>{B}</p></td></tr></table>", f"{A}\n{B}"),
}


@pytest.mark.parametrize("name", GOLD)
def test_gold(name):
    page, want = GOLD[name]
    assert main_text(page) == want


def test_long_and_broken_pages_take_linear_time():
    pieces = ["<head>", "<title>", "<div class=ad>", "<li class=promo>x", "<p class=ad>y<b>", "<a href=x>z", "<td><table>", "<a><p>q</a>", "<textarea>", "<span><div>k</span>", "<", "<!--", "&amp;", "<form><p>"]
    for piece in pieces:
        began = time.time()
        main_text(piece * 20_000)
        assert time.time() - began < 5, piece
    long = "".join(f"<p>{A} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{long}</article>").count("\n") == 19_999


def test_every_character_lands_in_a_block():
    page = "<div>one<p>two<li>three<td>four<a>five</div>six</a><b>seven<div>eight</b>nine"
    assert "".join(x[1] for x in Page(page).pieces) == "onetwothreefourfivesixseveneightnine"
