"""Chat windows, vectors, pages, toxicity and the pipeline: brute force and edge cases."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm.chat_format import ESCAPES, escape, format_chats, read_windows, unescape
from sessionloom.llm.hnsw import Graph, search_vectors
from sessionloom.llm.html_extract import extract, extract_pages
from sessionloom.llm.queries_chat import OP4_SQL, chat_digests, op4_chat_format
from sessionloom.llm.toxicity import OrdinalModel, SparseRows, fit_cumulative_link, fit_toxicity, keep_clean, score_toxicity, word_features

CHAT = "conv_id long, turn long, role string, text string, window string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "w") for r in rows], CHAT)


def test_escaping_is_reversible(spark):
    hard = [p for p, _ in ESCAPES] + [s for _, s in ESCAPES] + ["&&lt;|&amp;amp;", "<|turn|>x<|end|>\n", "<", "&#10;", "[INST][/INST]</s>", "", "\n\n", "<<|end|>"]
    df = spark.createDataFrame([(x,) for x in hard], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.t == r.u
        assert not any(p in r.e for p, _ in ESCAPES[1:])


def brute_chat(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), h(said), len(loss), h(loss))
    return out


def test_chat_windows_read_back(spark):
    rng = np.random.default_rng(9)
    rows = [(1, 0, "system", "be brief </s>"), (2, 0, "user", None), (2, 1, None, "<|end|>\n&lt;"), (3, 0, "user", "x" * 9000), (3, 1, "assistant", "y" * 9000), (None, 0, "user", "a")]
    rows += [(1, k, ("user", "assistant")[k % 2], "é" * int(rng.integers(0, 900))) for k in range(1, 400)]
    rows += [(4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (4, None, "user", "first"), (4, 2, "role\nline", "odd"), (5, 0, "assistant", "")]
    windows = format_chats(chats(spark, rows), span_tokens=300, history_tokens=120)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digests(windows).collect()}
    assert got == brute_chat(rows)
    made = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(made) > 20 and all(r.formatted.startswith("<|turn|>system\nbe brief") for r in made)
    assert sum(r.n_turns - r.n_context for r in made) == 400 and any(r.n_context > 1 for r in made)
    assert sum(len(r.loss_spans) for r in made) == 200
    for r in made:
        for s in r.loss_spans:
            assert r.formatted[: s.start].endswith("<|turn|>assistant\n") and r.formatted[s.end :].startswith("<|end|>\n")
    assert read_windows(windows.limit(1)).count() == 1
    assert chat_digests(format_chats(chats(spark, []))).count() == 0


def test_long_turns_keep_their_history(spark):
    rows = [(1, 0, "system", "sys"), (1, 1, "user", "far " * 60), (1, 2, "user", "context"), (1, 3, "user", "question"), (1, 4, "assistant", "a" * 4 * 2500)]
    rows += [(1, 5, "user", "next"), (1, 6, "assistant", "b" * 4 * 1900), (1, 7, "user", "too long " * 40), (1, 8, "assistant", "c" * 4 * 900)]
    rows += [(None, 0, "user", "of null"), (None, 1, "assistant", "d" * 4 * 5000), (2, 0, "assistant", "e" * 4 * 3000), (3, 0, "system", "s"), (3, 1, "assistant", "f" * 4 * 3000)]
    windows = format_chats(chats(spark, rows), span_tokens=300, history_tokens=60).collect()
    by = {}
    for r in windows:
        parts = [p.split("\n", 1)[1] for p in r.formatted.split("<|end|>\n")[:-1]]
        by[r.conv_id, parts[r.n_context][:4]] = parts[: r.n_context]
        assert r.n_turns == len(parts) and len(r.loss_spans) == sum(p[:3] in {x * 3 for x in "abcdef"} for p in parts[r.n_context :])
    assert by[1, "aaaa"] == ["sys", "context", "question"] and by[1, "bbbb"] == ["sys", "next"] and by[1, "cccc"] == ["sys"]
    assert by[None, "dddd"] == ["of null"] and by[2, "eeee"] == [] and by[3, "ffff"] == ["s"]
    assert {r.conv_id: r.n_turns for r in chat_digests(spark.createDataFrame(windows)).collect()} == {1: 9, None: 2, 2: 1, 3: 2}


def test_chat_sql_follows_long_turns(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        head = [(c, 0, "system", "rules & <|end|>")] if c % 2 else []
        sizes = [int(rng.choice([3, 200, 900, 4000, 4100, 6000, 20_000])) for _ in range(12)]
        rows += head + [(c, k + 1, ("user", "assistant")[k % 2], "é<s> word "[: n % 11] + "x" * n) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = duck.execute(f"select {', '.join(names)} from ({OP4_SQL})").fetchall()
    assert sorted(found) == sorted(map(tuple, op4_chat_format(spark, str(tmp_path)).select(names).collect()))
    without = duck.execute(f"select sum(formatted_chars) from ({OP4_SQL.replace('x.tokens > 1024', 'false')})").fetchone()[0]
    assert sum(r[-1] for r in found) > without


VEC = "vec_id long, embedding array<float>, score string"


def brute_nearest(ids, vectors, every, k):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % every == 0:
            s = (vectors * v).sum(axis=1)
            own = [(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q]
            out[q] = [i for _, i in sorted(own)[:k]]
    return out


def test_vectors_recall_and_ties(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    v[200:320] = v[200]  # copies
    ids = list(range(1500))
    bad = [(5000, None, "s"), (5020, [0.0] * 24, "s"), (5040, [float("nan")] * 24, "s"), (5060, [None] * 24, "s"), (5080, [float("inf")] * 24, "s"), (None, [1.0] * 24, "s"), (5100, [], "s")]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "s") for i in ids] + [(7, [float(x) for x in v[7]], "s")] + bad, VEC)
    got = collections.defaultdict(list)
    for r in search_vectors(df, least_shards=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(ids, v.astype(float), 20, 20)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & set(want[q])) / 20 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
        assert all(abs(s - float(v[q].astype(float) @ v[i].astype(float))) < 1e-9 for i, s in found)
    assert [i for i, _ in got[200]] == want[200]


def test_recall_of_the_query(spark):
    import os

    from sessionloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got = collections.defaultdict(set)
    for r in QUERIES["op5_nearest"](spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest(ids, v, 20, 20)
    assert set(got) == set(want) and np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_few_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], "x")], VEC)
    assert search_vectors(one).count() == 0 and search_vectors(one.limit(0)).count() == 0
    few = spark.createDataFrame([(i, [1.0, float(i)], "x") for i in range(5)], VEC)
    assert [(r.rank, r.vec_id) for r in search_vectors(few).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_graph_is_flat_and_survives_a_round_trip():
    v = np.random.default_rng(11).normal(size=(700, 8))
    g = Graph(v)
    h = Graph.load(g.dump())
    a, b = g.nearest(v[:50], 60)[0], h.nearest(v[:50], 60)[0]
    assert (a == b).all() and h.links[0].shape == (700, 32)
    want = np.argsort(-(v[:50] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[i][:10]) & set(want[i])) / 10 for i in range(50)]) > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home of the brave and long menu entry</a></li></ul></nav>
<div id="cookie-notice">We use cookies and would like you to know about that at some length here.</div>
<div class="layout"><div class="story"><h1>The &amp; title</h1><p><b>First paragraph with <i>marks</i> &eacute; &#8364; and enough words to count.<br><p>Second   one,
 broken over lines, has more than enough text.<div class="ad">Buy now, buy here, buy a lot of it, really</div><p>Short.<table><tr><td>Cell</td><td>Other</td></tr></table></div>
<aside>Related: something else entirely</aside></div><form>Your name <input> please sign up</form>
<section class="comments"><article class="comment"><p>I liked this very much, thank you all for writing it down.</p></article></section>
<footer>&copy; someone</footer><!-- <p>hidden</p> --></body></html>"""


def test_main_text_of_a_page():
    want = "The & title\nFirst paragraph with marks é € and enough words to count.\nSecond one, broken over lines, has more than enough text.\nShort.\nCell\nOther"
    assert extract(PAGE) == want
    assert extract(PAGE.replace("</td>", "")) == want
    article = "<body><div class=menu><p>Long enough menu text that isn't linked at all, to mislead.</p></div><article><h1>A</h1><p>B</p></article><p>Outside text, also long enough to be taken.</p>"
    assert extract(article) == "A\nB"


STORY = "<h1>Title</h1><p>A paragraph of the story that is long enough to be taken for main text.</p><p>And a second one of the same kind, to make most of the page.</p>"
SIDE = "<div class='left-sidebar'><p>Words beside the story, forty of them at least.</p></div><div id='cookie-notice'>We use cookies.</div>"


@pytest.mark.parametrize(
    "wrap", ["div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "div id='page' class='with-comments'", "form action='/x'", "div class='sidebar'", "div role='search' class='page'"]
)
def test_wrappers_of_the_story_are_not_left_out(wrap):
    name, want = wrap.split()[0], extract(STORY)
    assert want.count("\n") == 2
    assert extract(f"<body><{wrap}><div>{STORY}</div>{SIDE}</{name}><footer>Foot</footer></body>") == want
    assert extract(f"<body><{wrap}>{SIDE}<article>{STORY}</article></{name}></body>") == want
    assert extract(f"<body><{wrap}>{SIDE}<main>{STORY}</main></{name}></body>") == want
    assert extract(f"<body><{wrap}><form>{STORY}</form>{SIDE}</{name}></body>") == want


def test_foreign_text_stays_out_however_long():
    talk = "<p>I have a long opinion on this matter and shall write it down here in full.</p>" * 20
    for wrap in ("section class='comments'", "section id='post-comments'", "div class='related-posts'", "aside", "div style='display:none'"):
        assert extract(f"<body><div>{STORY}</div><{wrap}><article>{talk}</article></{wrap.split()[0]}></body>") == extract(STORY)
    assert extract(f"<div hidden><main>{talk}</main></div><div>{STORY}</div>") == extract(STORY)


def test_linked_and_short_lines_of_the_story():
    links = "".join(f"<li><a href='/{k}'>Source number {k}</a></li>" for k in range(5))
    story = f"<h1><a href='/'>Linked headline</a></h1><p>{'w' * 200}</p><ul>{links}</ul><p>Short closing paragraph.</p><p><a href='/z'>Read on</a></p>"
    want = "\n".join(["Linked headline", "w" * 200, *[f"Source number {k}" for k in range(5)], "Short closing paragraph.", "Read on"])
    menu = "<div class='x'><ul>" + "".join(f"<li><a href='/m{k}'>Menu entry {k}</a></li>" for k in range(9)) + "</ul></div>"
    for name in ("article", "main", "div", "section"):
        assert extract(f"<body>{menu}<{name}>{story}</{name}>{menu}<footer>Foot</footer></body>") == want
    cells = "".join(f"<td><a href='/c{k}'>Cell {k}</a></td>" for k in range(4))
    assert extract(f"<div><p>{'w' * 200}</p><table><tr>{cells}</table><p>End.</p></div>") == "\n".join(["w" * 200, *[f"Cell {k}" for k in range(4)], "End."])
    layout = f"<table><tr><td><a href='/'>Home</a></td><td><a href='/n'>News</a></td></tr><tr><td>{'w' * 200}</td></tr></table>"
    assert extract(layout) == "w" * 200


def test_odd_pages(spark):
    odd = [None, "", "plain", "a < b &amp; c", "<p>x", "<!-- open", "<script>open", "<div><div><div>deep", "<p>" * 5000 + "end", "<a href='x", "&nbsp;", "<b>bold</b>" * 2000]
    rows = [(i, f"u{i}", h, "clash") for i, h in enumerate(odd)] + [(1, "u1", "plain", "clash"), (None, None, "<p>n</p>", None)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {r.page_id: r.text for r in got.where("page_id <> 1").collect()}
    assert [texts[k] for k in (0, 2, 3, 4, 5, 6, 7, 8, 10)] == ["", "plain", "a < b & c", "x", "", "", "deep", "end", ""]
    assert all(r.n_chars == len(r.text) for r in got.collect()) and got.count() == len(rows)
    assert extract_pages(got.limit(0).withColumn("html", F.lit(""))).count() == 0


def labelled(spark, n=400):
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(n):
        own = [f"w{int(k)}" for k in rng.integers(0, 300, int(rng.integers(20, 80)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + i // 4 % 6):
                own[int(rng.integers(len(own)))] = ("idiot", "vileness", "vileful")[int(rng.integers(3))]
        rows.append((i, " ".join(own), "x"))
        labels.append((i, int(bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {i for i in range(n) if i % 4 == 0}


def test_severity_on_held_out_rows(spark):
    docs, labels, bad = labelled(spark)
    model = fit_toxicity(docs, labels.where("doc_id < 280"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) >= 2
    scored = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = range(280, 400)
    wrong = sum(scored[i].toxic != (i in bad) for i in held)
    assert wrong <= 3
    mild, severe = [i for i in bad if i // 4 % 6 == 0], [i for i in bad if i // 4 % 6 == 5]
    assert np.mean([scored[i].expected_severity for i in severe]) > np.mean([scored[i].expected_severity for i in mild])
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.grade for r in kept.collect()} == {"x"}


def test_toxicity_edges(spark):
    docs, labels, _ = labelled(spark, 40)
    nothing = fit_toxicity(docs, labels.where("toxic = 0"))
    assert nothing == OrdinalModel((), (), (5.0,)) and score_toxicity(docs, nothing).where("toxic").count() == 0
    assert fit_toxicity(docs.limit(0), labels).features == () and fit_toxicity(docs, labels.limit(0)).features == ()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot " * 5000)], "doc_id long, text string")
    model = fit_toxicity(docs.unionByName(odd.withColumn("grade", F.lit(None).cast("string"))), labels.unionByName(labels.limit(3)))
    assert score_toxicity(odd, model).count() == 4 and score_toxicity(odd.limit(0), model).count() == 0


def test_scores_against_brute_force(spark):
    docs, labels, _ = labelled(spark, 120)
    model = fit_toxicity(docs, labels)
    weight = dict(zip(model.features, model.weights, strict=True))
    odd = spark.createDataFrame([(9000, None, "mine"), (9001, "", "mine"), (9002, "idiot " * 3000 + "Ünknown wörds 42", "mine")], "doc_id long, text string, toxic string")
    table = docs.select("doc_id", "text").withColumn("toxic", F.lit("mine")).unionByName(odd)
    scored = score_toxicity(table, model).collect()
    assert sorted(r.doc_id for r in scored) == sorted(r.doc_id for r in table.collect())
    for r in scored:
        counts = collections.Counter(f for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) for f in word_features(w))
        z = sum(weight[f] * math.log1p(n) for f, n in counts.items() if f in weight)
        above = [1 / (1 + math.exp(b - z)) for b in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(above), abs=2e-6)
        assert r.grade == sum(p >= 0.5 for p in above) and r.toxic == (above[0] >= 0.35)
    kept = keep_clean(table, labels)
    assert kept.columns == table.columns and {r.toxic for r in kept.collect()} == {"mine"}


def test_cumulative_link_recovers_the_order():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2000, 3))
    z = x @ np.array([2.0, -1.0, 0.0])
    y = (z[:, None] + rng.logistic(size=(2000, 1)) > np.array([-1.0, 1.0, 3.0])).sum(axis=1)
    rows, columns = np.divmod(np.arange(x.size), 3)
    w, b = fit_cumulative_link(SparseRows(rows, columns, x.ravel(), x.shape), y, 3, steps=600)
    assert np.allclose(w, [2, -1, 0], atol=0.35) and np.allclose(b, [-1, 1, 3], atol=0.4)


def test_pipeline_stages_and_columns(spark, tmp_path):
    docs, labels, bad = labelled(spark, 200)
    base = " ".join(f"u{k}" for k in range(60))
    leak = " ".join(f"leak{k}" for k in range(30))
    extra = [(1000, base, "x"), (1001, base + " tail", "x"), (1002, f"{leak} and more", "x"), (1003, "repeated line of enough length\nown a", "x"), (1004, "repeated line of enough length\nown b", "x"),
             (1005, "repeated line of enough length\nown c", "x"), (1006, None, "x"), (1007, "", "x")]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == current.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r for r in current.collect()}
    assert not bad & set(left) or len(bad & set(left)) <= 2
    assert {1000, 1003, 1004, 1005, 1006, 1007} <= set(left) and 1001 not in left and 1002 not in left
    assert left[1006].n_tokens == 0 and len(left[1003].ids) == left[1003].n_tokens < left[1005].n_tokens
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


def test_pipeline_without_rows_and_with_odd_ones(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    odd = [(None, None, None, None, None, "a"), (None, "no id here at all", "x", None, 3, None), (1, "twice the same", "x", "s", 14, "b"), (1, "twice the same", "x", "s", 14, "b"), (2, "", "x", "s", 0, "c")]
    long_text = " ".join(f"w{k % 9973}" for k in range(40_000))
    for name, rows, n in (("none", [], 0), ("odd", [*odd, (3, long_text, "x", "s", 1, "d")], 6)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert len(out) == n
        assert not [r for r in out if r.n_tokens != len(r.ids)] and (n == 0 or max(r.n_tokens for r in out) > 40_000)


def test_vectors_of_another_length_take_no_part(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)], "x") for i in range(5)] + [(20, [9.0], "x"), (21, [9.0, 9.0, 9.0], "x")], VEC)
    assert {r.query_id for r in search_vectors(few).collect()} == {0} and 21 not in {r.vec_id for r in search_vectors(few, block=1).collect()}


def test_queries_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(400)], VEC)
    rows = lambda **more: sorted(map(tuple, search_vectors(df, query_every=2, k=5, **more).collect()))
    assert rows() == rows(block=40, least_shards=6)


def line_blocks(page):
    """The windowed line weights, by definition, over paragraphs without markup inside."""
    lines = [" ".join(x.split()) for x in re.findall(r"<p>(.*?)</p>", page, re.S)]
    lines = [x for x in lines if x]
    return [len(x) for x in lines], lines


@pytest.mark.parametrize("seed", range(12))
def test_regions_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    page = "".join(f"<div><p>{'x' * int(n)}</p></div>" if n else "<div><p><a href=q>linked words here</a></p></div>" for n in rng.choice([0, 0, 0, 4, 12, 30, 90], 40))
    lines = re.findall(r"<p>(.*?)</p>", page)
    weights = [0 if x.startswith("<a") else len(x) for x in lines]
    sums = [sum(weights[i : i + 3]) for i in range(len(lines))]
    threshold = min(60, max(sums))
    kept = set()
    for i, w in enumerate(weights):
        if w and sums[i] >= threshold > 0:
            stop = next((k for k in range(i, len(lines)) if not sums[k]), len(lines))
            begin = i
            while begin and weights[begin - 1]:
                begin -= 1
            kept |= set(range(begin, stop))
    want = [re.sub("<[^>]*>", "", x) for i, x in enumerate(lines) if i in kept]
    assert extract(page).split("\n") == want


def test_markup_that_never_closes_is_read_in_linear_time():
    import time

    for piece, n in (("<svg>", 40_000), ("<a title='", 16_000), ("<head>", 20_000), ("<div class='", 16_000)):
        began = time.perf_counter()
        extract(f"<p>{'words of a story ' * 9}</p>" + piece * n)
        assert time.perf_counter() - began < 2, piece
    story = "words of a story " * 9
    assert extract(f"<head><meta x><body><header>Top</header><article><p>{story}</p></article></body>") == story.strip()
    assert extract(f"<body><p><a href=x>{' ' * 500}{story}</a></p><p>{story}</p>").count("\n") == 1


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.catalog.clearCache()
