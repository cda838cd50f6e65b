"""Known answers, independent models and edge cases of the core operators."""

import math
import random
import re
from collections import deque
from datetime import datetime
from hashlib import md5
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from attestry.functions import fixed, html, markers, match, text, urls
from attestry.functions.embed import hashed_vector
from attestry.operators import catalog, crawl, index, search, verify
from attestry.plans import api
from attestry.plans.rendering import rendered
from attestry.sources import pages


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


# --- identity ----------------------------------------------------------------


def test_fingerprints(spark):
    assert column(spark, ["hello world", "", None], "string", text.fingerprint) == ["b94d27b9934d", None, None]
    assert [len(x) for x in column(spark, ["hello world"], "string", text.full_fingerprint)] == [64]
    assert column(spark, ["hello world", "other"], "string", lambda v: text.fingerprint_matches(v, F.lit("b94d27b9934d"))) == [True, False]
    assert column(spark, ["https://example.com"], "string", lambda v: text.chunk_selector(v, F.lit(0)))[0].startswith(fixed.SELECTOR_PREFIX)


# --- sentences and chunks ----------------------------------------------------


def model_split(t):
    out = []
    for p in (p.strip() for p in re.split("\n\n+", t)):
        if not p:
            continue
        if p.count("|") > 1 or re.match(r"[-*•·]\s", p) or re.match(r"\d+[.)]\s", p):
            out.append(p)
            continue
        for a in fixed.ABBREVIATIONS:
            p = a.replace(".", fixed.DOT).join(p.split(a))
        cut = re.compile("[.!?]\\s+(?=[A-Z\"'(])")
        start = 0
        pieces = []
        for m in cut.finditer(p):
            pieces.append(p[start : m.start() + 1])
            start = m.end()
        out += [x for x in (y.replace(fixed.DOT, ".").strip() for y in [*pieces, p[start:]]) if x]
    return out


def test_split_sentences(spark):
    rng = random.Random(1)
    texts = ["Hello world. This is a test. Another sentence!", "", None, "a | b | c\n\n- x. Y\n\n1. One. Two", "etc. The end. @@@ Dr. Who", "  X.  Y　"]
    texts += ["".join(rng.choice(["A", "b", ". ", "! ", "\n\n", "|", "- ", "Dr. ", '"', "(", " ", " ", "1. "]) for _ in range(40)) for _ in range(300)]
    got = column(spark, texts, "string", text.split_sentences)
    assert len(got[0]) == 3 and got[1] == [] and got[2] is None
    assert all(g == model_split(t) for g, t in zip(got, texts) if t is not None)


def model_group(sentences, size):
    """Closes a chunk by these rules, written over indexes of a list of lists."""
    out, wait = [[]], []

    def settle():
        if wait:
            if not (out[-1] and len(out[-1]) + len(wait) <= size):
                if out[-1]:
                    out.append([])
            out[-1].extend(wait)
            wait.clear()

    bullet = lambda s: bool(re.match(r"\s*[-*•·]\s", s))
    for s in sentences:
        if s.count("|") > 1:
            wait.append(s)
            continue
        settle()
        if not (bullet(s) and out[-1] and bullet(out[-1][-1])) and len(out[-1]) >= size:
            out.append([])
        out[-1].append(s)
    settle()
    return [c for c in out if c]


def test_group_chunks(spark):
    rng = random.Random(2)
    lists = [[rng.choice(["x", "- item", "1. n", "a | b | c", "- a | b | c"]) for _ in range(rng.randrange(40))] for _ in range(300)] + [[], None, ["s"] * 10]
    got = column(spark, lists, "array<string>", lambda v: text.group_chunks(v, 5))
    assert got[-1] == [["s"] * 5, ["s"] * 5] and got[-2] is None
    assert all(g == model_group(x, 5) for g, x in zip(got, lists) if x is not None)


# --- markers -----------------------------------------------------------------


def test_markers(spark):
    t = "One. [C1:abc123def456:css=#para1] Two. [C02:abc123def457:css=#para2] (R1:SUMMARY:C1,C2) (R2:OTHER:C1) (R3:CAUSAL:C1, C3)"
    got = column(spark, [t, "none", None, ""], "string", markers.parse_claim_markers)
    assert [(m.claim_id, m.css_selector) for m in got[0]] == [(1, "#para1"), (2, "#para2")] and got[1:] == [[], [], []]
    rel = column(spark, [t, None], "string", markers.parse_relation_markers)
    assert [(m.rel_id, m.rel_type, m.claim_ids) for m in rel[0]] == [(1, "SUMMARY", ["C1", "C2"])] and rel[1] == []
    made = column(spark, ["abc123def456"], "string", lambda v: markers.claim_marker(F.lit(1), v, F.lit("#test")))
    assert made == ["[C1:abc123def456:css=#test]"]
    ok = lambda v: markers.relation_marker(F.lit(1), v, F.array(F.lit("C1"), F.lit("C2")))
    assert column(spark, list(fixed.RELATION_TYPES), "string", ok)[0] == "(R1:SUMMARY:C1,C2)"
    with pytest.raises(Exception, match="INVALID"):
        column(spark, ["INVALID"], "string", ok)
    df = spark.createDataFrame([("Claim.", None, "", "NOPE", None, None), ("Claim.", "abc123def456", "#x", "CAUSAL", ["C1"], None)],
                               "claim string, shi_prefix string, css_selector string, rel_type string, claim_ids array<string>, synthesis_text string")
    grounded = [r.grounded for r in api.generate_grounded_text(df).collect()]
    assert grounded[0].endswith(f":css={fixed.AUTO_SELECTOR}]") and grounded[1].endswith("\nRelationship: CAUSAL (R1:CAUSAL:C1)")


# --- matching ----------------------------------------------------------------


def model_method(c, s):
    tok = lambda x: set(re.findall("[a-z0-9$]+", x.lower()))
    if not c:
        return "none"
    if c.lower() in s.lower():
        return "exact"
    own = tok(c)
    if own and (own <= tok(s) or any(tok(n) and len(own & tok(n)) / len(own | tok(n)) >= 0.6 for n in re.split("\n+", s))
                or any(v in s for v in re.findall(r"\$?[0-9]+\.?[0-9]*", c))):
        return "fuzzy"
    return "none"


def test_match(spark):
    rng = random.Random(3)
    piece = lambda n: " ".join(rng.choice(["cost", "$0.14", "per", "token", "Été", "12", "x", "\n", "."]) for _ in range(n))
    data = [(piece(rng.randrange(5)), piece(rng.randrange(14))) for _ in range(500)] + [("", ""), ("é", "e"), ("X", "")]
    df = spark.createDataFrame(data, "c string, s string")
    got = [r.m for r in df.select(match.match_method(F.col("c"), F.col("s")).alias("m")).collect()]
    assert got == [model_method(c, s) for c, s in data]
    assert [r[0] for r in spark.createDataFrame([(None, "a"), ("a", None)], "c string, s string").select(match.match_method(F.col("c"), F.col("s"))).collect()] == ["none", "none"]


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]), ([1.0], [-1.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(match.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, 0, 5 / math.sqrt(14 * 5), -1])


# --- HTML and addresses ------------------------------------------------------


def test_page_text(spark):
    page = ("<html><head><title>t</title></head><body><nav>menu</nav><h1>Top</h1><p>Hello <b>world</b>! &amp;lt; <a href=\"/x\">link</a></p>"
            "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2> 1 </td><td>2<br>3</td></tr></table><pre>x = 1</pre><ul><li>one<li>two</ul><footer>f</footer></body></html>")
    got = column(spark, [page, "", None, "<p></p>"], "string", html.page_text)
    assert got[0].startswith("a | b\n1 | 2 3\n\n[CODE]: x = 1") and "# Top" in got[0] and "**world**" in got[0] and "[link](</x>)" in got[0]
    assert "< " in got[0] and "menu" not in got[0] and "* one" in got[0] and got[1:] == ["", None, ""]
    shell = "<html><body>" + "<script>x</script>" * 400 + "</body></html>"
    assert column(spark, ['<div id="root">', "<p>plain</p>", None, shell], "string", html.needs_scripts) == [True, False, None, False]
    assert column(spark, ["<html><body>" + "<i></i>" * 1000 + "short</body></html>"], "string", html.needs_scripts) == [True]


def test_handwritten_pages(spark):
    known = [
        ("<nav><nav>x</nav>MENU</nav><p>body</p>", "body"),
        ("<div>a<script>if (a < 1) { '<nav>' }</script>b</div>", "ab"),
        ("<footer>one<footer>two</footer>three</footer>left<nav/>", "left"),
        ("<p>caf&eacute; &#8212; &#x41;&hellip; &amp;eacute; &unknown;</p>", "café — A… &eacute; &unknown;"),
        ("<svg><svg><path/></svg></svg><p>after</p><nav>never closed", "after\n\nnever closed"),
        ("<p><a href='/one'>1</a> <A HREF=/two>2</A> <a title='a > b' href = \"/three\">3</a></p>", "[1](</one>) [2](</two>) [3](</three>)"),
    ]
    got = column(spark, [p for p, _ in known], "string", html.page_text)
    assert [re.sub("\n+", "\n", g) for g in got] == [re.sub("\n+", "\n", w) for _, w in known]
    page = ("<a href='/one'>1</a><a href=/two>2</a><a data-href=\"/no\" href=\"/three?a=1&amp;b=2\">3</a><!-- <a href='/hidden'>x</a> --><script>'<a href=\"/s\">'</script>"
            "<a name=x>no</a><a\n href=\"sub/../f&ouml;\n\">4</a><a href=\"//h.example/x.pdf\">5</a><a href=\"ftp://a.example/\">6</a><a href='../up/'>7</a><a href=''>8</a><a " + "x " * 5000 + "href=/far>9</a>")
    df = spark.createDataFrame([("https://a.example/b/c", page), ("https://a.example/none", "<p>no links</p>")], "url string, html string")
    got = [r.link for r in crawl.page_links(df, external=True).orderBy("pos").collect()]
    assert got == [f"https://a.example/{x}" for x in ("one", "two", "three?a=1&b=2", "b/fö", "up", "far")]


def test_latest_never_mixes_rows_of_one_version(spark):
    at = datetime(2030, 1, 1)
    df = spark.createDataFrame([("k", "a", "z", at), ("k", "b", "y", at), ("k", "c", None, datetime(2029, 1, 1)), ("n", None, "p", at), ("n", "q", None, at)], "k string, x string, y string, at timestamp")
    got = {r.k: (r.x, r.y) for r in catalog.latest(df, ["k"], "at").collect()}
    assert got["k"] in {("a", "z"), ("b", "y")} and got["n"] == ("q", "p")


def test_sources_that_share_a_fingerprint(spark):
    at = datetime(2030, 1, 1)
    rows = [("u1", "h1", "f", at), ("u2", "h2", "f", at), ("u3", "h3", "g", at), ("u4", "h4", "g", datetime(2029, 1, 1)), ("u4", "h4", "x", at), ("u5", "h5", None, at)]
    got = catalog.conflicts(spark.createDataFrame(rows, "url string, url_hash string, shi_prefix string, indexed_at timestamp")).collect()
    assert [tuple(r) for r in got] == [("f", 2, "u1")]


def test_listings_in_order(spark):
    df = spark.createDataFrame([("t", "C2"), ("t", "C10"), ("t", "C1"), ("u", "C3")], "text_id string, claim_id string")
    assert [r.claim_id for r in catalog.listed(df, "text_id", "t", "claim_id").collect()] == ["C1", "C10", "C2"]


def test_pages_verify_by_their_fingerprint(spark):
    now = "The mill opened in 1950.\nIt has 12 wheels."
    own = column(spark, [now], "string", text.fingerprint)[0]
    texts = spark.createDataFrame([
        ("a", f"The mill opened in 1950. [C1:{own}:css=#x]"), ("b", f"Wheels it has, 12 of them. [C1:{own}:css=#x]"), ("c", f"No such thing. [C1:{own}:css=#x]"),
        ("d", "The mill opened in 1950. [C1:0123456789ab:css=#x]"), ("e", "It has. [C1:aaaaaaaaaaaa:css=#x]"), ("f", "Gone. [C1:bbbbbbbbbbbb:css=#x]"), ("g", None),
    ], "text_id string, text string")
    sources = spark.createDataFrame([("u", own), ("u", "0123456789ab"), ("gone", "bbbbbbbbbbbb"), (None, None)], "url string, shi_prefix string")
    snapshot = spark.createDataFrame([("u", now), ("u", now), ("other", "x"), ("empty", ""), (None, "x")], "url string, text string").withColumn("page", F.lit(1))
    got = {r.text_id: (r.shi_valid, r.match_method, r.verified, r.reason) for r in verify.verify_pages(texts, sources, snapshot).collect()}
    assert got == {
        "a": (True, "exact", True, None), "b": (True, "fuzzy", True, None), "c": (True, "none", False, None), "d": (False, "exact", False, None),
        "e": (False, None, False, "source not found"), "f": (False, None, False, "page not fetched"),
    }
    assert verify.verify_pages(texts.limit(0), sources, snapshot).count() == 0


def test_hashed_vectors_and_vector_search(spark):
    got = column(spark, ["a b a", "", None, "..."], "string", lambda v: hashed_vector(v, 8))
    assert sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-6) and got[1:] == [[], None, []]
    rows = [("s", i, t, [t], None) for i, t in enumerate(["the old mill", "a harbour crane", "the new mill", None, ""])]
    df = spark.createDataFrame(rows + rows[:1], "source_id string, chunk_index int, text string, sentences array<string>, url string").withColumn("embedding", hashed_vector(F.col("text")))
    hits = search.search(df, "old mill the", embed=hashed_vector).collect()
    assert [(r.chunk_index, r.score) for r in hits] == [(0, 1.0)]
    assert [r.chunk_index for r in search.search(df, "MILL", embed=hashed_vector, min_score=0.99, limit=0).collect()] == [0]
    assert search.search(df, "...", embed=hashed_vector).count() == 0 and search.search(df.limit(0), "mill", embed=hashed_vector).count() == 0


def test_a_crawl_task_and_its_states(spark, tmp_path):
    html_of = lambda *links: "".join(f"<p>The {x} mill opened.</p><a href='{x}'>x</a>" for x in links)
    pages_df = spark.createDataFrame([("https://a.example/1", html_of("2", "3")), ("https://a.example/2", html_of("1"))], "url string, html string")
    empty = spark.createDataFrame([], "url string, url_hash string, shi_prefix string, total_chunks int, full_text_length int, indexed_at timestamp")
    store = api.Store(empty, spark.createDataFrame([], "source_id string, chunk_index int, text string, sentences array<string>, css_selector string, shi_prefix string, url string"))
    path = str(tmp_path / "tasks")
    after = api.crawl_task(store, pages_df, path, "t1", "https://a.example/1")
    assert after.sources.count() == 2
    checked = api.verify_pages(after, spark.createDataFrame([("x", "The 2 mill opened. [C1:" + after.sources.where("url like '%1'").first().shi_prefix + ":css=#a]")], "text_id string, text string"), pages_df)
    assert [r.verified for r in checked[1].collect()] == [True]
    with pytest.raises(Exception):
        api.crawl_task(store, pages_df.drop("html"), path, "t2", "https://a.example/1")
    states = spark.read.parquet(path)
    one = api.crawl_status(states, "t1").first()
    assert (one.status, one.progress.urls_discovered, one.progress.urls_indexed) == ("completed", 3, 2) and one.completed_at >= one.started_at
    assert [(r.task_id, r.status) for r in api.crawl_tasks(states).collect()] == [("t1", "completed"), ("t2", "failed")]


def test_the_shared_folder_is_needed_off_one_machine(spark):
    from attestry.sources import scratch

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        def __init__(self, **kv):
            self.conf = Conf({k.replace("__", "."): v for k, v in kv.items()})

    with pytest.raises(ValueError):
        scratch.shared_dir(Session(spark__master="spark://h:7077", spark__app__id="a"))
    assert scratch.shared_dir(Session(spark__master="yarn", spark__app__id="a", spark__checkpoint__dir="hdfs:///x/")) == "hdfs:///x/attestry-a"


def test_resolve_like_the_standard_library(spark):
    bases = ["https://a.example/b/c/d?q=1", "http://a.example", "https://a.example/", "https://a.example/x/"]
    refs = ["g", "./g", "g/", "/g", "//h.example/g", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../../g", "http://o.example/z", "mailto:x", "g/../h", "/a/./b/../c"]
    data = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(data, "b string, r string")
    got = [x[0] for x in df.select(urls.resolve(F.col("b"), F.col("r"))).collect()]
    wrong = [(b, r, g, urljoin(b, r)) for (b, r), g in zip(data, got) if g.rstrip("/") != urljoin(b, r).rstrip("/")]
    assert not wrong


def test_links(spark):
    assert column(spark, ["https://www.A.example:80/x", "nothing", None], "string", urls.host) == ["a.example", "", None]
    assert column(spark, ["", "#a", "javascript:x", "MAILTO:x", "/p", None], "string", urls.is_skipped_link) == [True, True, True, True, False, True]
    files = ["https://a.example/x.pdf", "https://a.example/a.docs/x.html", "https://a.example/a.docs/x", "https://a.example/x?f=.pdf"]
    assert column(spark, files, "string", urls.is_skipped_file) == [True, True, False, False]
    data = [("https://a.example/", '<a href="/p1/">1</a><a class=x href="/p1">again</a><a href="javascript:x">j</a><a href="https://b.example/">b</a>'), ("https://a.example/e", ""), (None, "<a href='x'>"), ("https://a.example/n", None)]
    df = spark.createDataFrame(data, "url string, html string")
    assert [(r.pos, r.link) for r in crawl.page_links(df).collect()] == [(0, "https://a.example/p1")]
    assert crawl.page_links(df, external=True, exclude="p1").first().link == "https://b.example"


def test_crawl_equals_a_queue(spark):
    rng = random.Random(4)
    for depth, most in ((1, 9), (2, 5), (3, 100), (4, 7)):
        edges = [(f"u{rng.randrange(12)}", p, f"u{rng.randrange(12)}") for p in range(30)]
        want, seen, queue = [], {"u0"}, deque([("u0", 0)])
        while queue:
            u, d = queue.popleft()
            want.append(u)
            if d + 1 < depth:
                for _, _, v in sorted((e for e in edges if e[0] == u), key=lambda e: e[1]):
                    if v not in seen:
                        seen.add(v)
                        queue.append((v, d + 1))
        df = spark.createDataFrame(edges, "url string, pos int, link string")
        got = [r.url for r in crawl.crawl(df, "u0", depth, most).orderBy("rank").collect()]
        assert got == want[:most]


# --- stored collections ------------------------------------------------------


def test_latest_merges_fields(spark):
    rng = random.Random(5)
    changes = []
    for _ in range(300):
        changes.append((f"k{rng.randrange(9)}", rng.choice([None, rng.randrange(50)]), rng.choice([None, "a", "b"]), datetime(2030, 1, 1 + rng.randrange(28)) if rng.random() < 0.9 else None))
    changes += [(None, 1, "x", datetime(2031, 1, 1))] + changes[:10]
    df = spark.createDataFrame(changes, "k string, n int, s string, at timestamp")
    got = {r.k: (r.n, r.s) for r in catalog.latest(df, ["k"], "at").collect()}
    old = datetime(1, 1, 1)
    for key in {c[0] for c in changes} - {None}:
        for place, field in ((1, 0), (2, 1)):
            known = [(c[3] or old, md5("\x1f".join("" if x is None else str(x) for x in c[1:3]).encode()).hexdigest(), c[place]) for c in changes if c[0] == key and c[place] is not None]
            assert got[key][field] == (max(known)[2] if known else None)
    assert None not in got and catalog.latest(df.limit(0), ["k"], "at").count() == 0


def test_delete_count_clear(spark):
    sources = spark.createDataFrame([("a", "ua"), ("b", "ub")], "url_hash string, url string")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 0)], "source_id string, chunk_index int")
    left = catalog.delete_sources(sources, chunks, spark.createDataFrame([("a",), ("zz",)], "url_hash string"))
    assert left[0].count() == 1 and left[1].count() == 2
    store = api.Store(sources, chunks)
    empty, lost = api.clear(store)
    assert {r.collection: r.n_rows for r in lost.collect()} == {"sources": 2, "chunks": 4} and empty.chunks.count() == 0
    with pytest.raises(ValueError):
        api.reset(spark)
    assert api.reset(spark, confirm=True) == []


# --- search ------------------------------------------------------------------


CHUNKS = "source_id string, chunk_index int, url string, text string, sentences array<string>, embedding array<float>"


def test_keyword_search_and_confidence(spark):
    data = [("a", 0, "u", "The Harbour is deep. HARBOUR!", ["The Harbour is deep.", "HARBOUR!"], [1.0, 0.0]), ("a", 1, None, "nothing", ["nothing"], None),
            ("b", 0, "v", "harbour", None, [0.0, 1.0]), ("a", 0, "u", "The Harbour is deep. HARBOUR!", ["The Harbour is deep.", "HARBOUR!"], [1.0, 0.0]), ("c", 0, None, None, None, [])]
    chunks = spark.createDataFrame(data, CHUNKS)
    assert [(r.source_id, r.score) for r in search.keyword_search(chunks, "harbour").collect()] == [("a", 2), ("b", 0)]
    sources = spark.createDataFrame([("a",), ("b",)], "url_hash string")
    hit = search.check_indexed(chunks, sources, "harbour").first()
    assert (hit.tier, hit.confidence, hit.n_results, hit.sources_matched) == ("HIGH", 1.0, 2, 2)
    miss = search.check_indexed(chunks, sources, "absent").first()
    assert (miss.tier, miss.confidence, miss.answerable) == ("LOW", 0.0, False)
    near = api.search_sources(api.Store(sources, chunks), "harbour", [1.0, 0.1])
    assert [(r.source_id, r.score) for r in near.collect()] == [("a", 0.995)]
    assert [r.source_id for r in api.search_sources(api.Store(sources, chunks), "harbour", [-1.0, -1.0]).collect()] == ["a", "b"]


def test_neighbours_across_stretches(spark):
    keep = [i for i in range(60) if i % 7]
    data = [("s", i, f"t{i}") for i in keep] + [("s", 3, "t3"), ("t", 0, None), (None, 1, "x"), ("s", None, "y")]
    df = spark.createDataFrame(data, "source_id string, chunk_index int, text string").withColumn("stretch", F.lit(1))
    got = {(r.source_id, r.chunk_index): (r.context, r.n_chunks) for r in search.neighbours(df, 2, stretch=8).collect()}
    assert got == {("s", i): ("\n\n".join(f"t{j}" for j in range(i - 2, i + 3) if j in keep), sum(j in keep for j in range(i - 2, i + 3))) for i in keep} | {("t", 0): ("", 1)}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    vecs = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 4), (5, None)]
    df = spark.createDataFrame(vecs, "id long, embedding array<double>")
    got = {}
    for r in search.nearest(df, df.where("id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    good = {i: v for i, v in vecs if v}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or math.inf)
    for q in (0, 50, 250):
        want = sorted(((-round(cos(good[q], v), 4), i) for i, v in good.items() if i != q))[:5]
        assert [(i, pytest.approx(-s)) for s, i in want] == [(i, s) for _, i, s in sorted(got[q])]


# --- pipelines ---------------------------------------------------------------


def test_verify(spark):
    texts = spark.createDataFrame([
        ("t1", "The kiln holds 12 tonnes. [C1:aaaaaaaaaaaa:css=#x-0] Nothing like it. [C2:aaaaaaaaaaaa:css=#x-0] Lost. [C3:bbbbbbbbbbbb:css=#x-0] Gone. [C4:aaaaaaaaaaaa:css=#x-9]"),
        ("t2", "No marker."), ("t3", None), ("t4", "Odd. [C01:aaaaaaaaaaaa:css=#x-0]"),
    ], "text_id string, text string")
    sources = spark.createDataFrame([("u", "aaaaaaaaaaaa"), ("u", "aaaaaaaaaaaa"), ("w", None)], "url string, shi_prefix string")
    chunks = spark.createDataFrame([("#x-0", "aaaaaaaaaaaa", "Look: the kiln holds 12 tonnes."), ("#x-0", "aaaaaaaaaaaa", "Look: the kiln holds 12 tonnes."), (None, None, None)],
                                   "css_selector string, shi_prefix string, text string")
    rows = {(r.text_id, r.claim_id): r for r in verify.verify_claims(texts, sources, chunks).collect()}
    assert rows["t1", "C1"].verified and rows["t1", "C1"].match_method == "exact"
    assert rows["t1", "C2"].claim_text == "[C1:aaaaaaaaaaaa:css=#x-0] Nothing like it." and rows["t1", "C3"].reason == "source not found" and rows["t1", "C4"].reason == "passage not found"
    assert rows["t4", "C1"].claim_text is None and len(rows) == 5
    summary = {r.text_id: r for r in verify.verdicts(verify.verify_claims(texts, sources, chunks)).collect()}
    assert (summary["t1"].total, summary["t1"].passed, summary["t1"].failed, summary["t1"].verified) == (4, 2, 2, False)
    record = api.build_registry(texts).where("text_id = 't1'").first()
    assert record.same and record.protocol == fixed.PROTOCOL and len(record.ssr_entries) == 4 and record.rar_entries == []


def test_index_is_idempotent_and_keeps_sentences(spark):
    data = [("https://a.example/1", "<p>One. Two. Three.</p>" * 9), ("https://a.example/2", ""), (None, "<p>x</p>"), ("https://a.example/3", None)]
    df = spark.createDataFrame(data, "url string, html string")
    empty = api.Store(*(spark.createDataFrame([], s) for s in ("url string, url_hash string, shi_prefix string, total_chunks int, full_text_length int, indexed_at timestamp", CHUNKS)))
    once = api.index_pages(empty, df)
    twice = api.index_pages(once, df)
    assert sorted(map(str, once.chunks.collect())) == sorted(map(str, twice.chunks.collect())) and twice.sources.count() == 1
    rows = index.indexed(index.extracted(df))
    sentences = rows.select(text.split_sentences(F.col("text"))).first()[0]
    assert sum((r.sentences for r in index.chunk_rows(rows).orderBy("chunk_index").collect()), []) == sentences
    assert {r.reason for r in index.quarantine(df).collect()} == {"no text", "no address"}
    after, summed = api.crawl_and_index(empty, df, "https://a.example/1")
    assert tuple(summed.first()) == (1, 1, 0) and after.sources.count() == 1


def test_long_code_lines_are_rendered_whole(spark):
    docs = spark.createDataFrame([(1, "https://a.example/1")], "doc_id long, url string").select(
        "doc_id", "url", F.concat(F.lit("[CODE]: "), F.repeat(F.lit("x"), 1_000_100), F.lit(" end")).alias("text"), F.lit("en").alias("lang"))
    html = rendered(docs).select(F.regexp_extract("html", "<pre>([^<]*)</pre>", 1).alias("code"))
    assert html.select(F.length("code"), F.endswith("code", F.lit(" end"))).first() == (1_000_104, True)


def test_fetch_errors_become_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no answer")
        return f"<p>{url}</p>"

    df = spark.createDataFrame([("good",), ("bad",), ("good",), (None,)], "url string")
    got = {r.url: (r.html, r.error) for r in pages.fetched(df, fetch).collect()}
    assert got == {"good": ("<p>good</p>", None), "bad": (None, "no answer")}


def test_streaming_index(spark, tmp_path):
    from attestry.streaming import incremental

    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for hour, body in ((1, "One. Two."), (2, "Changed.")):
        rows = [("https://a.example/1", f"<p>{body}</p>", datetime(2030, 1, 1, hour)), (f"https://a.example/{hour + 1}", "<p>Other.</p>", datetime(2030, 1, 1, hour))]
        spark.createDataFrame(rows, incremental.PAGE_SCHEMA).write.mode("append").parquet(folder)
        incremental.start_index(spark, folder, out, check).awaitTermination()
    sources, chunks = incremental.current(spark, out)
    assert sources.count() == 3 and {r.text for r in chunks.collect()} == {"Changed.", "Other."}
    claims = spark.createDataFrame([(datetime(2030, 1, 1, 0, m), m % 2 == 0) for m in range(9)], "created_at timestamp, verified boolean")
    assert [(r.passed, r.failed) for r in incremental.claim_rate(claims).orderBy("start").collect()] == [(3, 2), (2, 2)]


def test_claims_are_compared_with_the_whole_source(spark):
    url = "https://a.example/1"
    key = spark.range(1).select(text.url_hash(F.lit(url))).first()[0]
    long = " ".join(f"Filler {w} sentence." for w in "abcdefghij" * 200)
    said = ["The dam opened late.", "窯は古い。と", "Kiln gauge dam rows reach.", "Nothing of this zebra.", "Weir at 4711 it is.", "Mill sluice pond near gate quite old here.", "川は深い"]
    texts = spark.createDataFrame([(f"t{i}", f"{c} [C1:aaaaaaaaaaaa:css=#x-0]") for i, c in enumerate(said)], "text_id string, text string")
    sources = spark.createDataFrame([(url, key, "aaaaaaaaaaaa")], "url string, url_hash string, shi_prefix string")
    parts = ["Start.", long, "So the dam opened late.", "古い窯。窯は古い。", "と言った。", "Kiln rows.", "Gauge: reach!", "Item 994711.", "x y\nmill sluice pond near gate old\nz", long, "川は", "深い"]
    rows = [(key, 2 * i, f"#x-{i}", "aaaaaaaaaaaa" if i else None, p) for i, p in enumerate(parts)]
    chunks = spark.createDataFrame([*rows, *rows[:3], (key, 99, "#x-99", "aaaaaaaaaaaa", None)], "source_id string, chunk_index int, css_selector string, shi_prefix string, text string")
    got = {r.text_id: (r.match_method, r.verified) for r in verify.verify_claims(texts, sources, chunks).collect()}
    want = ["exact", "none", "fuzzy", "none", "fuzzy", "fuzzy", "none"]
    assert got == {f"t{i}": (m, m != "none") for i, m in enumerate(want)}
    spread = spark.createDataFrame([(f"t{i}", f"{c} [C1:aaaaaaaaaaaa:css=#x-0]") for i, c in enumerate(["川は 深い", "古い。 と言"])], "text_id string, text string")
    assert [r.match_method for r in verify.verify_claims(spread, sources, chunks).collect()] == ["exact", "exact"]
    stale = chunks.unionByName(chunks.limit(1).withColumn("shi_prefix", F.lit("bbbbbbbbbbbb")))
    assert not any(r.verified or r.shi_valid for r in verify.verify_claims(texts, sources, stale).collect())
