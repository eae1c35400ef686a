"""Main text of pages whose article is known, over several layouts."""

import random

import pytest

from clipwarden.llm import extraction as X

SCHEMA = "page_id long, url string, html string"
WORDS = "river stone walked over quiet morning ünder café letters nobody counted the old harbour again 42 when".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def menu(rng, n=6):
    return "<ul>" + "".join(f'<li><a href="/{k}">{say(rng, 2)}</a></li>' for k in range(n)) + "</ul>"


def plain_article(rng, body, paras):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p><p>no';</script></head><body><nav>{menu(rng)}</nav>"
        f"<!-- <p>hidden</p> --><div class=\"ad\">{say(rng, 30)}</div><article>{body}</article><footer>&copy; {say(rng, 9)}</footer></body></html>"
    )


def divs(rng, body, paras):
    return (
        f"<html><body class='has-sidebar'><div id=header><h2>{say(rng, 3)}</h2>{menu(rng)}</div><div class='cookie-notice'><p>{say(rng, 25)}</p></div>"
        f"<div class='wrap'><div class='content-{rng.randrange(99)}'>{body}</div><div class='sidebar'><p>{say(rng, 30)}</p>{menu(rng, 3)}</div></div>"
        f"<div id='comments'><h3>3 comments</h3><div class='comment'><p>{say(rng, 60)}</p></div></div>"
        f"<form action='/s'><label>{say(rng, 4)}</label><input name=q><button>{say(rng, 2)}</button></form><div class=footer>{say(rng, 8)}</div></body></html>"
    )


def table_page(rng, body, paras):
    return (
        f"<table><tr><td>{menu(rng, 9)}<td>{body}<td class=advert>{say(rng, 40)}</table><p class=copyright>{say(rng, 6)}"
    )


def shell(rng, body, paras):
    """Form around the page, discussion without class names."""
    return (
        f"<body><form id=aspnet><header><a href=/>{say(rng, 2)}</a></header><main><section>{body}</section><section><h2>Comments (2)</h2>"
        f"<p>{say(rng, 50)}<p>{say(rng, 20)}</section></main><aside>{say(rng, 30)}</aside></form>"
    )


LAYOUTS = [plain_article, divs, table_page, shell]


def made(rng, layout, n):
    paras = [say(rng, rng.randrange(4, 60)) for _ in range(n)]
    title = say(rng, 4)
    shown = [p.replace("café", "caf&eacute;").replace("quiet morning", "quiet <b>mor</b>ning").replace("stone", "sto<i>ne</i>") for p in paras]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p.replace(' over ', '  over' + chr(10) + ' ')}</p>" for p in shown)
    return layout(rng, body, paras), " ".join([title, *paras])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for k in range(120):
        # one host holds a third of the pages
        layout = LAYOUTS[0] if k % 3 == 0 else LAYOUTS[k % 4]
        host = "big.example" if k % 3 == 0 else f"h{k % 4}.example"
        html, text = made(rng, layout, rng.randrange(1, 9))
        out.append((k, f"https://{host}/{k}", html, text))
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
def test_articles_without_the_rest(layout):
    rng = random.Random(1)
    for n in (3, 6, 12):
        html, text = made(rng, layout, n)
        assert X.main_text(html) == text


@pytest.mark.parametrize("hot", [1000, 2])
def test_hosts_agree(spark, rows, hot):
    pages = spark.createDataFrame([r[:3] for r in rows], SCHEMA).repartition(4)
    got = {r["page_id"]: r for r in X.extract(pages, hot_hosts=hot).collect()}
    assert len(got) == len(rows)
    assert [k for k, _, _, text in rows if got[k]["text"] != text] == []
    assert all(got[k]["n_chars"] == len(text) for k, _, _, text in rows)


def test_paths_of_a_host_correct_a_page(spark):
    """A page whose neutral box is longer than its article is read by the path of its host."""
    rng = random.Random(2)
    page = lambda body, box: f"<div class=a1>{body}</div><div class=b>{box}</div>"
    rows = [(k, "http://x.example/", page(f"<p>{say(rng, 80)}</p>", f"<p>{say(rng, 5)}</p>")) for k in range(9)]
    rows.append((9, "http://x.example/z", page("<p>Short one.</p>", f"<p>{say(rng, 60)}</p>")))
    got = {r["page_id"]: r["text"] for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9] == "Short one."
    assert X.main_text(rows[9][2]) != "Short one."


def test_odd_pages(spark):
    texts = {
        None: "", "": "", "   ": "", "just text &amp; more &am": "just text & more &am", "<p>a<p>b<br>c": "a b c", "<p>cut <b>off</b> <a hre": "cut off",
        "<div>one<script>two": "one", "<p title='>'>x": "x", "<!-- open <p>y": "", "<p>&#x41;&nbsp;&lt;b&gt;</p>": "A <b>",
        "<div>" * 3000 + "deep" + "</div>" * 3000: "deep", "</p></div>z": "z", "a<wbr>b": "ab", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    }
    for html, want in texts.items():
        assert X.main_text(html) == want, html[:40]
    rows = [(k, None if k % 2 else "ftp//no", html) for k, html in enumerate(texts)]
    rows += [rows[3], (None, None, "<p>n</p>")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS host", "1 AS agreed", "2 AS _html")
    got = X.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["text"] for r in got.collect()) == sorted([*texts.values(), rows[3][2].replace("&amp;", "&"), "n"])
    assert X.extract(pages.limit(0)).count() == 0
