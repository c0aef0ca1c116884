"""Operators 7, 9 and 10."""

import hashlib
import io

import pytest

from zonelens.llm import html_extract, url_filter, warc
from zonelens.llm.common import fresh_folder

PAGES = "page_id long, url string, html string, record_type string, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], PAGES).repartition(3)


ARTICLE = "<p>First paragraph of the story, with commas, and some length to it.</p><p>Second one, also long enough to count here.</p>"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("only text, no tags at all", "only text, no tags at all"),
    (f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1>{ARTICLE}</article><footer>&copy; x</footer></body>",
     "Title First paragraph of the story, with commas, and some length to it. Second one, also long enough to count here."),
    ("<article><p>fish &amp; chips &lt;b&gt; &eacute;&#233; &am", "fish & chips <b> éé &am"),
    ("<article><p>a\n b\t<b>c<br><p>d</article>", "a b c d"),
    ("<article><p>in<b>line</b> tags <i>do</i> not part w<i>or</i>ds</p><scr", "inline tags do not part words"),
    ("<body><div class='ad'>Buy this now, today, here, cheap.</div><div id=content><p>Real text, with a comma, is kept here.</p></div>"
     "<section class='comments'><p>First! A comment, by a reader, goes.</p></section><aside><p>side, bar, text</p></aside></body>",
     "Real text, with a comma, is kept here."),
    ("<body><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no, no</p> --><main><p>Only this, and nothing more.</p></main>"
     "<form><p>search, here</p></form></body>", "Only this, and nothing more."),
])
def test_extract(page, text):
    assert html_extract.extract(page) == text


def test_deep_and_broken_markup():
    deep = "<div>" * 5000 + "<p>deep text, found here.</p>" + "</div>" * 10
    assert html_extract.extract(deep) == "deep text, found here."
    assert html_extract.extract("<p title='<a \"> unclosed" + "<" * 2000 + "x" * 50) is not None


BODY = "<p>" + "Long body text, with commas, and more of it. " * 4 + "</p>"
BODY_TEXT = ("Long body text, with commas, and more of it. " * 4).strip()


@pytest.mark.parametrize("page,text", [
    (f"<article><h1>The Title</h1><div class=body>{BODY}</div></article>", f"The Title {BODY_TEXT}"),
    (f"<article><ul><li>one</li><li>two</li></ul><div class=body>{BODY}</div><table><tr><td>a</td><td>b</td></tr></table>"
     f"<blockquote>Quoted</blockquote></article>", f"one two {BODY_TEXT} a b Quoted"),
    (f"<article>Before it <div>{BODY}</div> and after</article>", f"Before it {BODY_TEXT} and after"),
    (f"<body><div class=wrap>Before it <div>{BODY}</div><div>plain block</div><div><a href=x>only a link</a></div> and after</div></body>",
     f"Before it {BODY_TEXT} plain block and after"),
    (f"<body><h2>Head line</h2><div id=content>{BODY}</div><ul><li><a href=x>Menu</a></li></ul></body>", f"Head line {BODY_TEXT}"),
    (f"<article><div class='related-work'>{BODY}</div><p id='share-price'>The share price rose.</p></article>", f"{BODY_TEXT} The share price rose."),
    (f"<article>{BODY}<div class='share-buttons'>Tell all</div><section class='comment-list'><p>First, a comment.</p></section>"
     f"<div class='postComments x'>Me, too, of course.</div></article>", BODY_TEXT),
    (f"<body><div class='cookie-banner'>We use cookies, all of them.</div><main><header><h1>In main</h1></header>{BODY}</main>"
     "<header><h1>Site</h1></header></body>", f"In main {BODY_TEXT}"),
])
def test_nothing_of_an_article_is_lost(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize("page", ["<div>{}", "<div>t<span>{}", "<span></i>{}", "<p>a{}", "<ul><li>a{}", "<table><tr><td>a{}", "<b><p>{}",
                                  "<header>{}", "<i><div>{}", "</div><td>{}"])
def test_time_grows_with_the_page_alone(page):
    import time

    took = []
    for n in (10_000, 100_000):
        t = time.process_time()
        html_extract.extract(page.replace("{}", "") * n + "text, here.")
        took.append(time.process_time() - t)
    assert took[1] < 25 and took[1] < 40 * max(took[0], 0.05)  # a hundred times, were it quadratic


def test_scores_by_definition(rng):
    """Every container's score as a plain sum over all paragraphs below it."""
    def below(node):
        for k in node.kids:
            if not isinstance(k, str):
                yield k
                yield from below(k)

    for _ in range(150):
        parts, words = [], "lorem, ipsum dolor sit, amet".split()
        for _ in range(rng.randint(3, 25)):
            tag = rng.choice(["div", "p", "section", "ul", "li", "a href=x", "h2", "b", "td", "blockquote", "div class=content", "/div", "/p", "/section"])
            parts.append(f"<{tag}>" + " ".join(rng.choices(words, k=rng.randint(0, 30))))
        order = html_extract._prune_and_order(html_extract.parse("".join(parts)))
        html_extract._measure(order)
        best, scores = html_extract.best_container(order), {}
        for node in order:
            total, some = html_extract.START.get(node.tag, 0) + (25 if node.names & html_extract.GOOD else 0), False
            for p in [node] * (node.parent is None) + list(below(node)):
                points = html_extract.paragraph_points(p)
                depth, up = 1, p.parent or p
                while up is not None and up is not node:
                    depth, up = depth + 1, up.parent
                if points is not None and up is node and depth <= 5:
                    some, total = True, total + points * [1, 1 / 2, 1 / 6, 1 / 12, 1 / 18][depth - 1]
            if some:
                scores[id(node)] = total * (1 - (node.linked / node.chars if node.chars else 0))
                assert node.score == pytest.approx(scores[id(node)])
        if scores and max(scores.values()) > 0:
            assert scores[id(best)] == pytest.approx(max(scores.values()))


def test_extract_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (None, None, None)]
    got = html_extract.extract_main_text(pages_of(spark, rows)).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["n_chars"] for r in got)[0] == 0
    assert html_extract.extract_main_text(pages_of(spark, [])).count() == 0


def test_warc_round_trip_over_small_ranges(spark, rng):
    rows = [(i, f"http://h/{i}\r\nX: é", "".join(rng.choice("ab<>é\x1f") for _ in range(rng.choice([0, 50, 99, 100, 101, 5000]))))
            for i in range(40)]
    rows += [(100, None, rows[5][2]), (101, "u", None), (3, rows[3][1], rows[3][2]), (7, "u", "z" * 300), (200, "u", "z" * 300),
             (201, "u", "z" * 300), (None, "u", "z" * 300), (300, "u", "short"), (301, "u", "short")]
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == raw]
        first = min(same) if len(raw) >= 100 and i is not None else i
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    for size in (1 << 20, 700):
        got = [tuple(r) for r in warc.round_trip(pages_of(spark, rows), spark, size).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_warc_payloads_and_empty_table(spark):
    rows = [(1, "http://x/?q=a b", "<p>é</p>" * 30), (2, "http://y", "<p>é</p>" * 30)]
    files = warc.write_warc(pages_of(spark, rows), fresh_folder(spark, "warc"))
    got = {r["record_id"]: r for r in warc.read_warc(files).collect()}
    assert bytes(got["<urn:page:1>"]["payload"]).decode() == rows[0][2] and got["<urn:page:2>"]["payload"] is None
    assert got["<urn:page:1>"]["target_uri"] == "http://x/?q=a%20b" and got["<urn:page:2>"]["refers_to"] == "<urn:page:1>"
    assert warc.round_trip(pages_of(spark, []), spark).count() == 0


def test_reader_owns_each_record_once_and_skips_false_magic():
    members = [warc._member(warc.record(i, "u", bytes([i]) * 400 + warc.MAGIC, "d", None)) for i in range(20)]
    data = b"junk" + warc.MAGIC + b"\0" * 9 + b"".join(members[:10]) + warc.MAGIC + b"??" + b"".join(members[10:]) + members[0][:30]
    for size in (1, 7, 64, 1000, len(data)):
        got = [h["warc-record-id"] for s in range(0, len(data), size) for h, _ in warc.records_in(io.BytesIO(data), s, min(len(data), s + size))]
        assert got == [f"<urn:page:{i}>" for i in range(20)]


def judged_by_hand(rules, url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    fits = [(len(h.split(".")), len(p), v == "allow", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules(spark, rng):
    rules = [("block", "com", "/"), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y/"), ("allow", "b.a.com", "/x/y/"),
             ("block", "b.a.com", ""), ("allow", "b.a.com", ""), ("block", "net", "/xy"), ("block", "xa.com", "/x/")]
    urls = [None, "", "a.com/x", "http://", "http://COM", "http://com/?a", "HTTP://a.com:80/x", "x://b.A.com/x/y/z#q", "http://net/xyz/a"]
    urls += ["http://" + ".".join(rng.choice(["a", "b", "xa", "com", "net"]) for _ in range(rng.randint(1, 4))) + "".join(
        rng.choice(["/", "/x", "/xy", "/x/y", "y/", "?", "#", "//"]) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://com/", None)]
    for chosen in (rules, list(url_filter.RULES), []):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(pages_of(spark, rows), chosen).collect()}
        assert got == {i: judged_by_hand(chosen, u) for i, u, _ in rows}
    assert url_filter.filter_urls(pages_of(spark, [])).count() == 0


def test_many_rules_under_one_host(rng):
    """A hundred thousand rules that share host and folders: by plain search, and in time."""
    import time

    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(100_000)]
    rules = [(rng.choice(["allow", "block"]), "example.com", f"/x/{n}") for n in names]
    t = time.process_time()
    trie = url_filter.build_trie(rules)
    paths = ["/x/" + "".join(rng.choice("abcd/") for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    got = [url_filter.judge(trie, "www.example.com", p) for p in paths]
    assert time.process_time() - t < 10
    best = {}
    for verdict, _, path in rules:
        if best.get(path) != "allow":
            best[path] = verdict
    for p, found in list(zip(paths, got))[:2000]:
        fits = [p[:k] for k in range(len(p), 0, -1) if p[:k] in best]
        assert found == (("example.com" + fits[0], best[fits[0]]) if fits else None)
