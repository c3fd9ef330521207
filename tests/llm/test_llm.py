"""Each operator on nulls, empty and long texts, repeats, empty tables and extra columns, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from repset.llm import decontaminate, interpolation, jaccard, language, mixing, quality, tokenfile, vectors, warc, wrapper

A = " ".join(f"w{i}" for i in range(60))
B = A.replace("w30", "zz")
DOCS = [(1, A, "en", "s/a"), (2, A, "en", "s/a"), (2, A, "en", "s/a"), (3, B, "en", "s/b"), (4, "", None, None), (5, None, "de", None), (6, "  \n", "de", "t"), (7, "Ähm das ist ein Text", "de", "t"), (8, "x" * 5000 + " y", "en", "t"), (None, A, "en", "s")]
DDL = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, DDL).selectExpr("*", "1 AS n", "2 AS key", "3 AS ident", "4 AS w", "5 AS size")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_jaccard(docs, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    assert got == Counter({(1, 57, 1): 1, (2, 57, 1): 2, (3, 57, 1): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 0, 6): 1, (7, 2, 7): 1, (8, 1, 8): 1, (None, 57, None): 1})
    assert jaccard.jaccard_components(none).count() == 0


def test_pipeline_keeps_one_of_texts_with_one_id(spark):
    import corpus_pipeline

    rows = [(5, A), (5, B), (5, B), (6, A), (5, prose(9)), (9, prose(20)), (9, prose(30)), (None, A)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    got = Counter((r["doc_id"], "A" if r["text"] in (A, B) and r["doc_id"] else r["text"]) for r in kept)
    assert got == Counter([(5, "A"), (5, prose(9)), (9, prose(20)), (9, prose(30)), (None, A)])


@pytest.mark.parametrize("percent", [85, 80])
def test_signatures_lose_no_pair(percent):
    rng = np.random.default_rng(3)
    tried = 0
    for often, common in ((0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (0.5, 0.5), (1.0, 0.5), (1.0, 1.0)):
        for _ in range(150):
            n = int(rng.integers(2, 300))
            s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            t = np.unique(np.concatenate([s[rng.random(len(s)) > 0.07], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64)]))
            both = np.intersect1d(s, t)
            if len(t) < 2 or 100 * len(both) < percent * (len(s) + len(t) - len(both)):
                continue
            every = np.union1d(s, t)
            count = np.where(rng.random(len(every)) < often, np.where(rng.random(len(every)) < common, 1_000_000, 300), np.where(np.isin(every, both), 2, 1))
            code = jaccard._code(count)
            x, y = (set(jaccard.signatures(z, code[np.searchsorted(every, z)], percent)[0].tolist()) for z in (s, t))
            assert x & y
            tried += 1
    assert tried > 300


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(DOCS)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for some in by.values():
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 0.5
    assert math.isclose(sum(s[0]["target"] for s in by.values()), sum(r["size"] for r in rows))
    assert mixing.mix_sources(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(10, 30)), 0), (2, None, 0), (3, "", 0), (4, "ein text", 0), (4, "ein text", 0)], "item_id long, text string, w int")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got[1, 60, 20, 1, True] == 1 and got[2, 60, 20, 1, True] == 2 and got[3, 60, 20, 1, True] == 1
    assert got[7, 5, 2, 1, True] == 1 and got[5, 0, 0, 0, False] == 1 and got[8, 2, 0, 0, False] == 1
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_large_benchmark_path(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 30)))], "item_id long, text string")
    want = sorted(map(str, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.decontaminate(docs, items).collect())) == want


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_items_without_id_count(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    rows = [(None, " ".join(f"w{i}" for i in range(10, 30))), (None, "ein text"), (1, " ".join(f"w{i}" for i in range(20, 40)))]
    got = {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got >= {(1, 30, 2, True), (3, 20, 1, True), (7, 2, 1, True), (8, 0, 0, False)}


def test_interpolation(docs, none):
    got = interpolation.score_documents(docs).collect()
    train = Counter()
    for d, text, *_ in DOCS:
        if not interpolation.held_out(d):
            train.update([*words(text), None])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, text, *_ in DOCS:
        t = [*words(text), None]
        want[d, len(t), sum(train[x] > 0 for x in t), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert interpolation.score_documents(none).count() == 0


def test_language(spark, none):
    rows = [(i, t, lang, "s") for i in range(40) for t, lang in ((f"the cat and the dog {i}", "en"), (f"der hund und die katze {i}", "de"))]
    out = language.identify(spark.createDataFrame([*rows, (99, "12 !", "en", "s"), (98, None, None, None), (97, "the dog", None, None)], DDL)).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (98, 99)} == {"und"}
    assert next(r["lang_pred"] for r in out if r["doc_id"] == 97) == "en"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert language.identify(none).count() == 0


def test_warc(spark):
    big, url = "<p>" + "é" * 100, "http://h/\r\nX: y"
    rows = [(3, url, big), (1, None, big), (2, "http://h/2", big), (None, "http://h/n", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first", "2 AS digest")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    assert got == {1: (203, "response", None), 2: (203, "revisit", 1), 3: (203, "revisit", 1), None: (203, "revisit", 1), 4: (5, "response", None), 5: (5, "response", None), 6: (0, "response", None), 7: (240, "response", None)}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_packed_documents_unpack_by_themselves():
    some = np.random.default_rng(6)
    length = tokenfile.code_lengths(np.arange(1, 301) ** 3)
    n = np.array([1, 127, 128, 129, 1, 256, 1000])
    ids = some.integers(0, 300, int(n.sum())).astype("<u2")
    table, at = tokenfile.decode_table(length), 0
    for k, (bits, marks) in zip(n.tolist(), tokenfile.pack(ids, n, tokenfile.codes(length), length), strict=True):
        ends = np.cumsum(marks.astype(np.int64))
        held = np.minimum(tokenfile.EVERY, k - tokenfile.EVERY * np.arange(len(marks)))
        assert len(bits) == ends[-1] + 7 >> 3
        assert (tokenfile.unpack(np.frombuffer(bits, np.uint8), ends - marks, held, table) == ids[at : at + k]).all()
        at += k


def test_token_files(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, start, want = Tokenizer.from_file(path), 0, []
    for d, text, *_ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfile.token_files(docs, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokenfile.token_files(none, path).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 1000):
        length = tokenfile.code_lengths((rng.pareto(0.4, n) * 10 + 1).astype(np.int64), 12)
        assert length.max() <= 12 and (n == 1 or abs(sum(0.5 ** length.astype(float)) - 1) < 1e-9)


def test_long_texts_in_bounded_memory():
    """Texts of 2 MB go through the encoder one by one and in stretches; other processes' memory aside, a
    worker takes no more than some 250 MB for them, 32 MB of which are kept."""
    import subprocess
    import sys

    code = """if True:
        import resource, sys
        import numpy as np, pyarrow as pa, public_tokenizers
        from repset.llm import tokenfile
        path, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(0)
        words = np.array([f"w{i}" for i in range(5000)])
        texts = [" ".join(rng.choice(words, 400_000)) for _ in range(4)] + ["\u00fc\u4e2d " * 300_000]
        b = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "tie": [0] * 5, "text": texts})
        list(tokenfile._encoded(iter([b.slice(0, 1).slice(0, 0)]), path, np.zeros((0, 2), np.int64)))
        tokenfile.encoder(path)(["warm up"])
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        n = [r for part in tokenfile._encoded(iter([b]), path, np.zeros((0, 2), np.int64)) for r in part.column("n").to_pylist()]
        after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        enc = tokenfile.encoder(path)
        assert n[:5] == [len(enc.tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
        print((after - before) // 1024)
    """
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert grown < 280


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0, None] * 4), (None, [1.0] * 8), (380, [1.0])]
    got = vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["query_id"] for r in got} == set(range(0, 300, 20))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 300, 20):
        s = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:20]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in mine] == list(range(1, 21))
        hits += len({v for _, v in mine} & {int(i) for i in order})
    assert hits >= 0.9 * 20 * 15
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_small_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TARGET", 0.0)  # one list is probed
    x = np.random.default_rng(1).normal(size=(2000, 4))
    x[:40] += np.array([400.0, 0, 0, 0]) * (1 + np.arange(40)[:, None])  # outliers in lists of their own
    got = vectors.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    assert got.groupBy("query_id").count().where("count = 20").count() == 100


def test_wrapper(spark):
    page = lambda i: f"<html><head><title>t</title><script>x='</p>'</script></head><body><div class='site-header'>Menu</div><nav>n{i}</nav><div><p>Back to all</p><p>Body {i} &amp; more<br>text {i * 7}<p>Second   part {i * i}</div><div id=comments>c{i}</div><form>f</form><footer>x{i}</footer>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(90, None, None), (91, "bad", ""), (92, "http://o/1", "<article><header><h1>H</h1>by me</header><p>One<!-- c --> two<aside>no</aside></article><p>out"), (92, "http://o/1", "<p>alone")]
    got = {(r["page_id"], r["text"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(i, f"Body {i} & more text {i * 7}\nSecond part {i * i}") for i in range(6)} | {(90, ""), (91, ""), (92, "H\nOne two"), (92, "alone")}


def test_wrapper_keeps_all_content():
    page = lambda x: wrapper.text(wrapper.segments(wrapper.strip(wrapper.tree_of(f"<html><body><nav>n</nav>{x}<footer>f</footer></body></html>"))))
    body = "a body of the page in many words " * 3
    assert page(f"<div><p>{body}</p><article>A small card</article></div>") == f"{body.strip()}\nA small card"
    assert page("<article><h2>One</h2>first part</article><article>second part</article>") == "One\nfirst part\nsecond part"
    assert page(f"<main><h1>Head</h1><p>Lead</p><article>{body}</article></main>") == f"Head\nLead\n{body.strip()}"
    assert page(f"<h1>Head</h1><article>{body}</article><p>and five words more here</p>") == f"Head\n{body.strip()}\nand five words more here"


def test_wrapper_hints_are_weak():
    page = lambda x: wrapper.text(wrapper.segments(wrapper.strip(wrapper.tree_of(f"<html><body>{x}</body></html>"))))
    body = "a body of the page in many words " * 3
    assert page(f"<article><h1>Head</h1></article><div><p>{body}</p></div>") == f"Head\n{body.strip()}"
    assert page(f"<div class='content no-sidebar'><p>{body}</p></div>") == body.strip()
    assert page(f"<div class='sidebar'><p>{body}</p></div><p>x</p>") == f"{body.strip()}\nx"
    assert page(f"<article><p>{body}</p><p class='notice'>mind the gap</p><div class='related-work'>others did so</div></article>") == f"{body.strip()}\nmind the gap\nothers did so"
    assert page("<p>Press <button>Start</button> to get <math><mi>x</mi></math> at once</p><button>Buy</button>") == "Press Start to get x at once"
    assert page(f"<form><p>{body}</p><input name=q></form>") == body.strip()
    assert page(f"<article><p>{body}</p></article><div class='cookie-banner'>we use some of your cookies here</div><div class='ad-slot-17'>buy this thing and that now</div>") == body.strip()


def matched(a, b):
    """Simple tree matching by brute force: the most nodes in equal subtrees of any mapping that keeps tags, order and ancestors."""
    if a.sig == b.sig:
        return a.weight
    xs, ys = wrapper._elements(a), wrapper._elements(b)

    def best(i, j):
        if i == len(xs) or j == len(ys):
            return 0
        pair = 0
        if xs[i].sig == ys[j].sig:
            pair = xs[i].weight
        elif xs[i].tag == ys[j].tag and (m := matched(xs[i], ys[j])):
            pair = m + 1
        return max(best(i + 1, j), best(i, j + 1), pair + best(i + 1, j + 1) if pair else 0)

    return best(0, 0)


def test_tree_matching_is_optimal():
    rng = np.random.default_rng(5)

    def html(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<b>t{rng.integers(3)}</b>"
        tag = rng.choice(["div", "section"])
        return f"<{tag}>{''.join(html(depth - 1) for _ in range(rng.integers(1, 4)))}</{tag}>"

    for _ in range(300):
        a, b = (wrapper.tree_of("".join(html(2) for _ in range(3))) for _ in range(2))
        pairs = wrapper.align(a, b)
        assert all(x.tag == y.tag for x, y in pairs)
        got = sum(x.weight for x, y in pairs if x.sig == y.sig) + sum(x.sig != y.sig for x, y in pairs[1:])
        assert got == matched(a, b)


def test_wide_lists_are_matched_as_narrow_ones(monkeypatch):
    """Of all pairs of children the best, with no regard to how far they are from the diagonal."""
    rng = np.random.default_rng(8)
    row = lambda i: rng.choice([f"<b>t{rng.integers(9)}</b>", f"<li><b>own {i}</b><i>reply</i></li>", f"<li><p>own {i}</p><b>t{rng.integers(3)}</b></li>", f"<li><ul><li><b>t{rng.integers(4)}</b></li><li>x{i}</li></ul></li>"])
    weight = lambda pairs: sum(x.weight for x, y in pairs if x.sig == y.sig) + sum(x.sig != y.sig for x, y in pairs[1:])
    for n in range(40):
        a, b = (wrapper.tree_of("<ul>" + "".join(row(f"{side}{i}") for i in range(rng.integers(1, 14))) + "</ul>") for side in "ab")
        monkeypatch.setattr(wrapper, "PAIRS", 200_000)
        whole = wrapper.align(a, b)
        monkeypatch.setattr(wrapper, "PAIRS", 0)
        pairs = wrapper.align(a, b)
        assert all(x.tag == y.tag for x, y in pairs) and weight(pairs) == weight(whole)
        if n < 8:
            assert weight(pairs) == matched(a, b)


def test_wide_lists_far_from_the_diagonal():
    """900 rows of which the other list has the last 450 first, with another word in each."""
    item = lambda i, word: f"<li><b>row {i}</b><i>{word} {i}</i></li>"
    a = wrapper.tree_of("<ul>" + "".join(item(i, "one") for i in range(900)) + "</ul>")
    b = wrapper.tree_of("<ul>" + "".join(item(i, "two") for i in [*range(450, 900), *range(1000, 1450)]) + "</ul>")
    equal = sum(x.sig == y.sig for x, y in wrapper.align(a, b))
    assert equal == 450


def test_wrapper_without_article_elements(spark):
    """Alignment alone: plain containers, nothing that names itself."""
    page = lambda i: f"<div><div>Our house since long ago</div><div><a href=/a>Start here</a><a href=/b>And there</a></div></div><div><div><p>{prose(i)}</p><p>{prose(i + 50)}</p></div><div>You may like these pages of ours too</div></div><div>All rights are ours</div>"
    assert extracted(spark, [page(i) for i in range(6)]) == {i: f"{prose(i)}\n{prose(i + 50)}" for i in range(6)}


def test_wrapper_none(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, host int, layout int, wrapper int")
    assert wrapper.extract(pages).count() == 0
    some = spark.createDataFrame([(1, "http://h/1", "<p>one", 1, 2, 3)], pages.schema)
    assert [tuple(r) for r in wrapper.extract(some).collect()] == [(1, "http://h/1", "one", 3)]


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", f"<body>{x}</body>") for i, x in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def prose(i, n=12):
    return " ".join(f"w{i * n + k}" for k in range(n))


def test_wrapper_template_of_any_length(spark):
    blurb = "share this article with all of your friends and subscribe to our weekly letter " * 5
    shared = "a passage of many words that a few articles of the host have in common"
    pages = [f"<article><p>{prose(i)}</p>{f'<p>{shared}</p>' if i < 3 else ''}<div><p>{blurb}</p></div></article>" for i in range(12)]
    assert extracted(spark, pages) == {i: f"{prose(i)}\n{shared}" if i < 3 else prose(i) for i in range(12)}


def test_wrapper_small_hosts_and_copies(spark):
    page = lambda i: f"<div>{prose(i)}</div><div>read more about it here</div>"
    assert extracted(spark, [page(0), page(1)]) == {0: prose(0), 1: prose(1)}
    assert extracted(spark, [page(0)] * 5 + [page(1), page(2)]) == {i: prose(max(0, i - 4)) for i in range(7)}
    near = [f"<p>{prose(1)}</p><p>{prose(2)}</p><p>edit {i}</p>" for i in range(2)]
    assert extracted(spark, near) == {i: f"{prose(1)}\n{prose(2)}\nedit {i}" for i in range(2)}


def test_wrapper_template_of_a_layout(spark):
    pages = [f"<div class=post><p>{prose(i)}</p></div><div class=end>all rights are with the authors</div>" if i < 10 else f"<section><p>{prose(i)}</p></section>" for i in range(50)]
    assert extracted(spark, pages) == {i: prose(i) for i in range(50)}


def test_wrapper_wide_and_deep_pages(spark):
    end = "all rights are with us"
    wide = ["".join(f"<div><p>{prose(300 * i + k, 5)}</p><p>{end}</p></div>" for k in range(250)) for i in range(5)]
    assert extracted(spark, wide) == {i: "\n".join(prose(300 * i + k, 5) for k in range(250)) for i in range(5)}
    deep = ["<div>" * 70 + f"<p>{prose(i)}</p><p>{end}</p>" + "</div>" * 70 for i in range(5)]
    assert extracted(spark, deep) == {i: prose(i) for i in range(5)}


def test_quality(spark, docs, none):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(400)]
    text = [" ".join(rng.choice(vocab, 30)) + (" idiot" if i % 5 == 0 else "") + (" spam!! junk!!" * 8 if i % 7 == 0 else "") for i in range(600)]
    d = spark.createDataFrame([(i, t, "en", f"h{i % 3}/p{i % 6}/x") for i, t in enumerate(text)], DDL)
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(500)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(d, labels).collect()}
    assert sum(got[i] == (i % 5 != 0 and i % 7 != 0) for i in range(500, 600)) >= 97
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == len(DOCS)
    assert quality.classify(none, labels).count() == 0


def test_site_posteriors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        h = f"h{rng.integers(6)}"
        path = f"{h}/{rng.integers(3)}" if h not in ("h0", "h1") else h
        e = rng.normal(size=2) * 2
        v = [float(rng.random() < 0.3) if rng.random() < 0.5 else 1 / (1 + math.exp(-k)) for k in e]
        rows.append((i, h, path, float(e[0]), float(v[0]), float(e[1]), float(v[1])))
    rows.append((200, "alone", "alone", 0.5, 0.2, -1.0, 0.1))
    got = {r["doc_id"]: (r["p_low"], r["p_toxic"]) for r in quality.site_posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, e_low double, v_low double, e_toxic double, v_toxic double")).collect()}
    for k in range(2):
        e, v = {r[0]: r[3 + 2 * k] for r in rows}, {r[0]: r[4 + 2 * k] for r in rows}
        mean = sum(v.values()) / len(v)
        hosts = sorted({r[1] for r in rows})
        by_host = {h: [r[0] for r in rows if r[1] == h] for h in hosts}
        rate = np.array([np.mean([v[i] for i in by_host[h]]) for h in hosts])
        between = (rate**2).mean() - rate.mean() ** 2 - mean * (1 - mean) * np.mean([1 / len(by_host[h]) for h in hosts])
        m = float(np.clip(mean * (1 - mean) / between - 1, 10, 1e5)) if between > 0 else 1e5
        logit = lambda p: math.log(p / (1 - p))
        for i, h, path, *_ in rows:
            others = [v[j] for j in by_host[h] if j != i]
            site = (sum(others) + m * mean) / (len(others) + m)
            on_path = [r[0] for r in rows if r[1:3] == (h, path)]
            if len(on_path) < len(by_host[h]):
                others = [v[j] for j in on_path if j != i]
                site = (sum(others) + m * site) / (len(others) + m)
            assert math.isclose(got[i][k], 1 / (1 + math.exp(-(e[i] + logit(site) - logit(mean)))), rel_tol=1e-9)


def test_language_by_brute_force(spark):
    rows = [(i, t, lang, "s") for i in range(30) for t, lang in ((f"the cat {i} and the dog", "en"), (f"der hund {i} und die Katze", "de"), (f"le chat {i * 7} et le chien", "fr"))]
    rows += [(100, "chat und dog", None, "s"), (101, "Katze", "en", "s"), (102, None, "de", "s")]
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in language.identify(spark.createDataFrame(rows, DDL)).collect())
    grams = lambda t: Counter(f for _, fs in language.features([t]) for f in fs.tolist())
    langs = ["de", "en", "fr"]
    seen, docs = {x: Counter() for x in langs}, Counter()
    for d, t, lang, _ in rows:
        if lang and zlib.crc32(str(d).encode()) % 5:
            seen[lang].update(grams(t or ""))
            docs[lang] += 1
    want = Counter()
    for d, t, *_ in rows:
        if t is None:
            want[d, "und", 0.0] += 1
            continue
        s = []
        for x in langs:
            whole = sum(seen[x].values()) + language.ALPHA * (1 << language.BITS)
            s.append(math.log(docs[x] / sum(docs.values())) + sum(n * math.log((seen[x][f] + language.ALPHA) / whole) for f, n in grams(t).items()))
        k = int(np.argmax(s))
        want[d, langs[k], round(1 / sum(math.exp(x - s[k]) for x in s), 5)] += 1
    assert got == want


def test_interpolation_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vocab = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 40)), p=np.arange(60, 0, -1) / 1830)), "en", "s") for i in range(150)]
    learned, learn = [], interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda cells, counts: learned.append(learn(cells, counts)) or learned[-1])
    got = {r["doc_id"]: r["score"] for r in interpolation.score_documents(spark.createDataFrame(rows, DDL)).collect()}
    one, two, before = Counter(), Counter(), Counter()
    for d, t, *_ in rows:
        if not interpolation.held_out(d):
            seq = [*words(t), None]
            one.update(seq)
            two.update(zip(["<", *seq[:-1]], seq))
            before.update(["<", *seq[:-1]])
    n, v = sum(one.values()), len(one)
    (w,) = learned
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    for d, t, *_ in rows:
        seq, total = [*words(t), None], 0.0
        for a, b in zip(["<", *seq[:-1]], seq):
            # a context's frequency is that of the word, wherever it stands; before a text, the number of texts
            c = before["<"] if a == "<" else one[a]
            x = w[min(int(math.log2(c + 1)), interpolation.BUCKETS - 1)]
            total += math.log10(x[0] * two[a, b] / max(c, 1) + x[1] * one[b] / n + x[2] / (v + 1))
        assert math.isclose(got[d], total, rel_tol=1e-9, abs_tol=1e-9)


def test_pieces_one_by_one_as_whole_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from repset.llm import tokenfile

    path = public_tokenizers.path("byte_bpe_50k.json")
    some, whole, enc = random.Random(11), Tokenizer.from_file(path), tokenfile.Encoder(path, keep=200_000)
    word = lambda: "".join(some.choice("aeioustrnéñ’'") for _ in range(some.randrange(1, 12)))
    often, asked, model, resets = [word() for _ in range(300)], [], enc.model, 0

    class Counted:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    enc.model = Counted()
    for turn in range(12):
        texts = ["".join(some.choice([*often, word(), "7", " 42", "\n", "  ", "\t", " (", ")…", " ", "中", "I'll "]) + some.choice(["", " "]) for _ in range(400)) for _ in range(8)] + ["", " ", "don't"]
        before = len(enc.keys)
        got = enc(texts)
        resets += len(enc.keys) < before
        for t, x in zip(texts, got, strict=True):
            assert x.tolist() == whole.encode(t, add_special_tokens=False).ids
    assert resets and (enc.slot_n > 0).sum() > 100
    known = len(asked)
    enc(["the same again"])
    first = len(asked) - known
    enc(["the same again", "the same again"])
    assert len(asked) - known == first <= 3


def test_places_are_given_up_with_the_pieces():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from repset.llm import tokenfile

    path = public_tokenizers.path("byte_bpe_50k.json")
    some, whole, enc, resets = random.Random(12), Tokenizer.from_file(path), tokenfile.Encoder(path, keep=4000), 0
    often = ["".join(some.choice("aeioustrné’") for _ in range(some.randrange(1, 9))) for _ in range(200)]
    for _ in range(8):
        texts = [" ".join(some.choices(often, k=300)) for _ in range(4)]
        before = enc.ids
        got = enc(texts)
        resets += enc.ids is not before
        assert (enc.slot_n > 0).sum() > 50
        for t, x in zip(texts, got, strict=True):
            assert x.tolist() == whole.encode(t, add_special_tokens=False).ids
    assert resets > 1
