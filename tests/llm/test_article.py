import random

from arcweave.llm.article import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>Menu, title</title><style>p{}</style></head><body>
<header><h1>Site, name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many, of them, for everything, on this site.</p></div>
<div id="wrap"><div class="post"><h2>Title</h2><p>First, of all &amp; &eacute;&#33;
  two   lines<br>three</p><p>Second <b>bold</b>, <a href=x>link</a>.</p><ul><li>one<li>two</ul>
<script>var x = "<p>no, no, no</p>";</script><div class="ad">Buy, buy, buy</div>
<form><p>Name, mail, send</p></form></div>
<aside><p>Related, things, to, read</p></aside>
<section class="comments"><p>I, also, think, that, this, is, great, really, a, lot.</p></section></div>
<footer>&copy; someone, somewhere</footer></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == ("Title\n\nFirst, of all & é! two lines three\n\nSecond bold, link.\n\none\n\ntwo")


def test_scores_choose_the_container_and_siblings():
    long = "Words, words, and more words that go on, " * 5
    page = (f"<div><div id=a><p><a href=x>{long}</a></p><p><a href=y>{long}</a></p></div>"
            f"<div id=b><p>{long}</p><p>{long}</p></div><p>Last words.</p><div id=c><a href=z>More, links</a></div></div>")
    assert main_text(page) == "\n\n".join([long.strip(), long.strip(), "Last words."])


def test_hard_markup():
    cases = {
        None: "", "": "", "plain text": "plain text", "<p>open": "open", "<!-- open": "", "<a href='x": "",
        "<p>a < b & c &unknown; &amp</p>": "a < b & c &unknown; &",
        "<div>loose <p>para</p> tail</div>": "loose\n\npara\n\ntail",
        "<article><p>x</article><p>y": "x", "<p>a<p>b<p hidden>c": "a\n\nb",
        "<table><tr><td>a<td>b</table>": "a\n\nb", "<p title='a > b'>ok</p>": "ok",
        "<textarea><p>no</p></textarea><p>yes</p>": "yes", "<P CLASS=x>Big</P>": "Big",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_stray_quotes_do_not_swallow_text():
    cases = {
        "<p title=don't>Some text</p><p>more</p>": "Some text\n\nmore",
        '<a href="x"">Text</a><p>rest "quoted" end</p>': 'Text\n\nrest "quoted" end',
        "<p title='open>Some text</p><p>more</p>": "Some text\n\nmore",
        "<p it's>one</p><p a=b\"c d = 'x > y'>it's two</p>": "one\n\nit's two",
        "<p>a</p ><p =\"x>b</p><p class = \"ok\"id='y'>c": "a\n\nb\n\nc",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_marks_on_a_wrapper_keep_the_article():
    long = "Words, words, and more words that go on, " * 8
    body = f"<h2>Title</h2><p>{long}</p><p>{long}</p>"
    want = "\n\n".join(["Title", long.strip(), long.strip()])
    aside = "<div class=sidebar><p>Other, things, to, read, here</p></div>"
    talk = f"<div class=comments>{'<p>I, also, think, so, too, yes.</p>' * 40}</div>"
    intro = f"<p>{'Some teaser text without much. ' * 8}</p>"
    for name in ("content has-sidebar", "no-sidebar", "page-header-wrap"):
        assert main_text(f'<div class="{name}">{body}{aside}</div>') == want, name
        assert main_text(f'<div class="{name}"><div id=page-header>{body}</div>{aside}</div>{talk}'.replace("h2", "h1")) == want
        assert main_text(f'{intro}<div id="{name}"><main>{body}</main></div>') == want
    # larger than the article, but not around it
    assert main_text(f"<div><div>{body}</div>{talk}</div>") == want
    menu = "<div class=menu>" + "<li><a href=x>Some, linked, words</a></li>" * 50 + "</div>"
    assert main_text(f"{menu}<div><p>Short, text.</p></div>") == "Short, text."
    assert main_text("<div><p>One <span class=ad>buy</span> two</p></div>") == "One two"


def test_comments_never_win_over_the_article():
    def p(n, word="Words"):
        return f"<p>{(word + ', words, and more words that go on. ') * 4}</p>" * n

    own = "\n\n".join([("Words, words, and more words that go on. " * 4).strip()] * 2)
    talk = [f"<section id=comments><article>{p(4, 'Reply')}</article></section>",
            f"<section class=comments><article>{p(2, 'Reply')}</article><article>{p(4, 'Reply')}</article></section>",
            f"<div id=comments><h1>Comments</h1>{p(9, 'Reply')}</div>", f"<div class=userComments>{p(5, 'Reply')}</div>",
            f'<ul class="commentList"><li>{p(3, "Reply")}</ul>']
    for t in talk:
        for page in (f"<article>{p(2)}</article>{t}", f"<main><article>{p(2)}</article>{t}</main>",
                     f"<article>{p(2)}{t}</article>", f"<div><div>{p(2)}</div>{t}</div>",
                     f"<div class=has-sidebar><main>{p(2)}</main>{t}</div>",
                     f'<div class="single comments-open no-ads">{p(2)}{t}</div>'):
            assert main_text(page) == own, page
    # the last content left
    assert main_text(f"<div class=comments>{p(2)}</div>") == own


def test_marked_paragraphs_and_headings():
    long = ("Words, words, and more words that go on. " * 4).strip()
    for bad in ("<p class=advertisement>Buy, now, here</p>", "<h3 class=comments-title>12 comments</h3>",
                "<p class='text relatedLinks'>See, also</p>", "<p id=cookieNotice>We use cookies</p>"):
        assert main_text(f"<article><p>{long}</p>{bad}<p>{long}</p></article>") == f"{long}\n\n{long}", bad
    assert main_text(f"<article><h1 class=page-header>Title</h1><p>{long}</p></article>") == f"Title\n\n{long}"
    assert main_text(f"<article><header><h1>Title</h1></header><p>{long}</p></article>") == long


def test_random_pages_give_their_article():
    """Pages put together from an article, whose blocks are known, and boilerplate of all kinds around and in it."""
    rng = random.Random(11)

    def prose(k):
        return " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) + rng.choice(["", "", ",", "."]) for _ in range(k))

    def junk():
        text, links = prose(rng.randrange(3, 60)), "".join(f"<li><a href=x>{prose(3)}</a></li>" for _ in range(9))
        return rng.choice([
            f"<nav><ul>{links}</ul></nav>", f"<aside><p>{text}</p></aside>", f"<div class=sidebar><p>{text}</p></div>",
            f"<footer><p>{text}</p></footer>", f"<header><h1>{prose(3)}</h1></header>", f"<form><p>{text}</p></form>",
            f"<section id=comments><article><p>{text}</p></article><article><p>{text}</p></article></section>",
            f"<div class=adBox><p>{text}</p></div>", f"<div role=banner>{text}</div>", f"<script>{text}</script>",
            f"<div class='cookie-notice'><h2>{text}</h2></div>", f"<p hidden>{text}</p>", f"<!-- {text} -->",
            f"<ul class=menu>{links}</ul>", f"<div id=newsletterSignup><p>{text}</p></div>"])

    for _ in range(400):
        want, body = [], []
        for _ in range(rng.randrange(2, 8)):
            text = prose(rng.randrange(15, 120))
            want.append(" ".join(text.split()))
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "pre"])
            body.append(f"<{tag}>{text}</{tag}>" + (junk() if rng.random() < 0.3 else ""))
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"),
                                   ("<main><article class=post>", "</article></main>"),
                                   ("<div class='post has-sidebar'>", "</div>"), ("<div id=content>", "</div>")])
        page = "".join([*(junk() for _ in range(rng.randrange(4))), open_, *body, close,
                        *(junk() for _ in range(rng.randrange(4)))])
        assert main_text(f"<html><body><div>{page}</div></body></html>") == "\n\n".join(want), page


def test_deep_and_long_pages():
    assert main_text("<div>" * 50000 + "<p>x, y") == "x, y"
    assert main_text("<p>" + "<b>" * 20000 + "x") == "x"
    assert len(main_text("<p>" + "word, " * 200000)) == 6 * 200000 - 1


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, extract(df).collect()), key=repr)
    t = main_text(PAGE)
    assert out == sorted([(1, "u", t, len(t)), (1, "u", t, len(t)), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract(df.limit(0)).count() == 0
