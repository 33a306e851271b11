"""Quality rules, BPE, HTML and URL operators against plain Python."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import awkward, empty, texts  # noqa: F401
from visitcast.llm import bpe, html_text, quality_rules, url_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_rules_match_plain_python(awkward):
    got = quality_rules.judge(awkward).collect()
    want = collections.Counter((r["doc_id"], *plain_rules(r["text"])) for r in awkward.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                                r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        assert r["base_failed"] or r["kept"] == (r["broken_rules"] == [])


def test_rules_plan_has_no_python_and_no_shuffle(awkward, empty):
    plan = quality_rules.judge(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality_rules.judge(empty).count() == 0


def test_rules_are_a_parameter(awkward):
    none = quality_rules.judge(awkward, rules=()).where("not base_failed and not kept")
    assert none.count() == 0


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.Codec(bpe.load_ranks(path), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text(alphabet="ab \n'sé", max_size=200), max_size=6))
def test_bpe_matches_the_library(codec, library, texts):
    got = codec.encode_corpus(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


def test_bpe_forgets_without_a_change(codec, library):
    for _ in range(2):
        assert np.frombuffer(codec.encode_corpus(["some words to forget"], memo_words=0)[0], "<u4").tolist() \
            == library.encode_ordinary("some words to forget")


def test_bpe_query_rows(spark, awkward, texts, empty, library):
    vocabulary = bpe.public_vocabulary(spark)
    got = collections.Counter(tuple(r) for r in bpe.round_trip(awkward, vocabulary, corpus_bytes=1000).collect())
    want = collections.Counter()
    for r in awkward.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty, vocabulary).count() == 0
    coded = bpe.encode(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(coded, vocabulary).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


@pytest.mark.parametrize("page, text", [
    (None, None), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b", "a < b"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a<script>no</script>b<style>x</style><!-- c -->", "ab"), ("<b>un<i>closed", "unclosed"),
    ("<div hidden>no</div><span style='display: none'>no</span><p aria-hidden=true>said</p>yes", "said\n\nyes"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>A<th>Bbb<tr><td>long<td>2</table>", "A     Bbb\nlong  2"),
    ("<table><caption>T</caption><tr><td>1</table>after", "T\n1\n\nafter"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("x<br>y<br><br>z", "x\ny\n\nz"), ("<p>a  \n b</p>", "a b"),
    ("<title>no</title><h1>Head</h1>text", "Head\n\ntext"), ("<img alt='pic'> <q>q</q>", 'pic "q"'),
    ("<td>loose</td><tr>x", "loose\nx"), ("</p></div>a</b>", "a"), ("<a href='x>y'>k</a>", "k"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
])
def test_html_cases(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<button>Question?</button><p>Answer", "Question?\n\nAnswer"),
    ("<dialog>no</dialog>a<dialog open>yes</dialog>b", "a\nyes\nb"),
    ("<select><option>a<option selected>b</select>", "a\nb"), ("x<textarea>l1\n  l2</textarea>y", "x\nl1\n  l2\ny"),
    ("<svg><title>no</title><defs><text>no</text></defs><circle r=1 /><text>one</text><text>t<tspan>wo</tspan></text></svg> z", "one two z"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<table><tr><td><p>one<p>two<ul><li>a<li>b</ul></table>", "one\n\ntwo\n\n- a\n- b"),
    ("<table><tr><td>k<br>long<td>v<tr><td>m<td><pre>p\n  q</pre></table>", "k     v\nlong\nm     p\n        q"),
    ("<table><tr><td><table><tr><td>1<td>2<tr><td>3<td>4</table></table>", "1  2\n3  4"),
])
def test_html_shows_what_browsers_show(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td colspan=2>wide head<td>c<tr><td>a1<td>b<td>c2</table>", "wide head  c\na1  b      c2"),
    ("<table><tr><td rowspan=2>ab<td>x<tr><td>y<tr><td>z<td>w</table>", "ab  x\n    y\nz   w"),
    ("<table><tr><td rowspan=0>s<td colspan=999>x<td>q<tr><td>y</table>", "s  x  q\n   y"),
    ("<table><tr><td rowspan=x colspan=>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<svg><clipPath/><mask id=a/><symbol/><text>in</text></svg>after", "in after"),
    ("<div/>a<svg><foreignObject><p/>b</foreignObject></svg>", "a\n\nb"),
])
def test_html_spans_and_closed_elements(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("css, body, text", [
    (".gone, p#x {display: none}", "<p class=gone>no</p><p id=x>no</p><p>yes", "yes"),
    (".a.b{display:none} .a{display:block}", "<i class='a b'>no</i><i class=a>yes</i>", "yes"),
    ("i{visibility:hidden}.back{visibility:visible}", "<i>no</i><i class=back>yes</i>", "yes"),
    (".a{display:none}", "<p class=a style='display:block'>own</p>", "own"),
    (".a{display:none !important}", "<p class=a style='display:block'>no</p>yes", "yes"),
    ("@media print{p{display:none}} @media screen{.a{display:none}} @font-face{x:y}", "<p>yes</p><p class=a>no</p>", "yes"),
    ("/* p{display:none} */ div > p{display:none} a:hover{display:none}", "<div><p>yes</p></div>", "yes"),
    ("p{display:none", "<p>no</p>yes", "yes"), ("p{color:none;displays:none}}}{", "<p>yes</p>", "yes"),
])
def test_html_style_sheets(css, body, text):
    assert html_text.page_text(f"<head><style>{css}</style></head><body>{body}</body>") == text


def test_html_wide_and_high_cells_stay_small():
    page = "<table><tr><td>" + "w" * 20_000 + "<td>" + "<br>".join("abc" for _ in range(5000)) + "</table>"
    out = html_text.page_text(page)
    assert len(out) < 10 * len(page) and out.count("abc") == 5000 and "w" * 20_000 in out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "text ", "<",
                                 "<div hidden>", "</div>", "<pre>", "\n", "<script>", "&lt;", "<br>", "<!--", "-->"]),
                max_size=40).map("".join))
def test_html_never_fails(page):
    out = html_text.page_text(page)
    assert out == out.strip("\n") and "script" not in out


def test_html_deep_nesting_and_rows(spark):
    deep = "<div>" * 20_000 + "in" + "</div>" * 20_000
    pages = spark.createDataFrame([(1, deep, "x"), (2, None, "x"), (None, "<p>a", "x"), (2, None, "x")],
                                  "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "in"), (2, None), (None, "a"), (2, None)], key=str)
    assert html_text.extract(pages.where("page_id = 9")).count() == 0


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for r in url_templates.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) \
                and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


URLS = ["http://a.example.net/en/1", "http://a.example.net/de/1", "http://EXAMPLE.com/de/x", "https://example.com/de",
        "https://b.org/fr/9", "http://org/fr/", "http://net", "http://net/", "no scheme", "", None, "://", "http://x.com/a/b?c#d",
        "http://xnet/en/", "ftp://h.example.com#f/de/", "http://a/b://c/d", "http://q.com/1/2/3/4/5/6/7"]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)] + [(None, "http://n.net/", "x", "x")],
                                  "page_id long, url string, host string, template string")
    got = url_templates.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r["page_id"]] if r["page_id"] is not None else "http://n.net/"
        host, path = plain_host_path(url)
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        if rule:
            assert r["verdict"] == rule.action
    assert url_templates.judge(pages.where("page_id = 99")).count() == 0


def test_url_templates_generalise_merge_and_reject(spark):
    rows = [f"http://s.example.com/de/{i}" for i in range(40)]            # blocked by rule
    rows += [f"http://t.org/fr/{i}" for i in range(40)]                   # allowed by rule
    rows += [f"http://u.example.com/de2x/{i}" for i in range(5)]
    rows += [f"http://v.org/de/{i}" for i in range(20)]                   # like the blocked template
    rows += [f"http://w.com/fr/{i}" for i in range(20)]                   # like the allowed template
    rows += [f"http://z.net/{s}/{i}" for s in ("aa", "bb") for i in range(30)]  # two branches alike
    rows += [f"http://z.net/rare{chr(97 + i)}/x" for i in range(20)]      # each too rare to stay
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in url_templates.judge(pages).collect()}
    assert got["http://v.org/de/3"]["verdict"] == "block" and got["http://w.com/fr/3"]["verdict"] == "allow"
    assert got["http://z.net/aa/1"]["template"] == got["http://z.net/bb/1"]["template"] == "/{aa,bb}/*"
    assert got["http://z.net/rarea/x"]["template"].startswith("/*/")
    assert got["http://u.example.com/de2x/1"]["template"] == "/*/*"


def test_url_branches_of_a_small_share_keep_their_own_verdict(spark):
    own = (url_templates.UrlRule("block", "s.com", "/de/"), url_templates.UrlRule("allow", "s.com", "/en/"))
    rows = [f"http://s.com/en/{i}" for i in range(940)] + [f"http://s.com/de/{i}" for i in range(30)]
    rows += [f"http://s.com/{s}/{i}" for s, n in (("fr", 20), ("es", 10)) for i in range(n)]
    rows += [f"http://t.com/{chr(97 + k)}sec/{i}" for k in range(25) for i in range(4)]      # 4 % each
    rows += [f"http://u.net/{chr(97 + k)}sec/{i}" for k in range(25) for i in range(4)]      # alike, blocked by rule
    own += (url_templates.UrlRule("block", "u.net"),)
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in url_templates.judge(pages, rules=own).collect()}
    assert len(got) == len(set(rows))
    for s, verdict in (("en", "allow"), ("de", "block"), ("fr", "allow"), ("es", "allow")):
        assert got[f"http://s.com/{s}/1"]["template"] == f"/{s}/*" and got[f"http://s.com/{s}/1"]["verdict"] == verdict
    assert len({got[f"http://t.com/{chr(97 + k)}sec/1"]["template"] for k in range(25)}) == 25
    assert {got[f"http://u.net/{chr(97 + k)}sec/1"]["template"] for k in range(25)} == {"/{asec,?,ysec}/*"}


def test_url_opposites_do_not_join_through_small_mixed_branches(spark):
    own = (url_templates.UrlRule("block", "s.com", "/spam/"), url_templates.UrlRule("allow", "s.com", "/news/"))
    rows = [f"http://s.com/{s}/{i}" for s in ("spam", "news") for i in range(1000)]
    for k, (bad, good) in enumerate(((1, 5), (1, 3), (2, 3), (1, 1), (3, 2), (3, 1), (5, 1))):
        own += (url_templates.UrlRule("block", "s.com", f"/m{chr(97 + k)}/bad"), url_templates.UrlRule("allow", "s.com", f"/m{chr(97 + k)}/good"))
        rows += [f"http://s.com/m{chr(97 + k)}/bad{i}" for i in range(bad)] + [f"http://s.com/m{chr(97 + k)}/good{i}" for i in range(good)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r["template"] for r in url_templates.judge(pages, rules=own).collect()}
    assert got["http://s.com/spam/1"].split("/")[1] != got["http://s.com/news/1"].split("/")[1]


def test_url_new_pages_of_a_blocked_branch(spark):
    own = (url_templates.UrlRule("block", "s.com", "/spam/a"), url_templates.UrlRule("allow", "s.com", "/news/"),
           url_templates.UrlRule("block", "e.com", "/de/"))
    rows = [f"http://s.com/spam/a{i}/y" for i in range(200)] + [f"http://s.com/news/{i}" for i in range(200)] + ["http://s.com/spam/q/x"]
    rows += [f"http://e.com/de/{i}" for i in range(100)] + [f"http://e.com/{s}/{i}" for s in ("en", "fr") for i in range(100)] + ["http://e.com/x/y"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r["verdict"] for r in url_templates.judge(pages, rules=own).collect()}
    assert got["http://s.com/spam/q/x"] == "block"            # nothing else under it was ever allowed
    assert got["http://e.com/en/1"] == got["http://e.com/fr/1"] == got["http://e.com/x/y"] == "allow"


def test_url_deep_branches_are_told_apart(spark):
    own = (url_templates.UrlRule("block", "s.com", "/a/b/c/d/spam/"), url_templates.UrlRule("allow", "s.com", "/a/b/c/d/news/old"))
    rows = [f"http://s.com/a/b/c/d/spam/x/{i}" for i in range(500)] + [f"http://s.com/a/b/c/d/news/old/{i}" for i in range(50)]
    rows += ["http://s.com/a/b/c/d/news/new/x", "http://s.com/a/b/c/d/news/new/y/z", "http://lone.com/a/b/c/d/e/f/g"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in url_templates.judge(pages, rules=own).collect()}
    assert got["http://s.com/a/b/c/d/news/new/x"]["verdict"] == got["http://s.com/a/b/c/d/news/new/y/z"]["verdict"] == "allow"
    assert got["http://s.com/a/b/c/d/spam/x/3"]["template"] == "/a/b/c/d/spam/x/*"
    assert got["http://lone.com/a/b/c/d/e/f/g"]["template"] == "/**"


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    plan = url_templates.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
