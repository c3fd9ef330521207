"""Every stage of the pipeline on nulls, repeats, long texts, empty tables and clashing columns, against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline

rng = np.random.default_rng(11)
VOCAB = [f"w{i}" for i in range(3000)]
ITEM = " ".join(VOCAB[:30])


def prose(n=80):
    return " ".join(rng.choice(VOCAB[100:], n))


def edited(text, n):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = "changed"
    return " ".join(words)


def table():
    base = [prose() for _ in range(12)]
    rows = [(i, t, "en", f"host{i % 3}/a", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "host1/a", 5) for i, t in enumerate(base[:4])]  # exact copies
    rows += [(200 + 10 * i + k, edited(base[i], k), "de", "host2/b", 5) for i in range(6) for k in (1, 2, 4, 9)]
    rows += [(300, f"{prose(20)} {ITEM.upper()} {prose(5)}", "en", "host1/a", 1), (301, f"{prose(900)} {ITEM}", "en", "host1/a", 1)]
    rows += [(400, None, None, None, None), (401, "", "en", "host1/a", 0), (402, " \t\n", "en", None, 3), (None, prose(), "en", "host1/a", 1), (None, None, None, None, None)]
    rows += [(403, prose(60_000), "en", "host1/a", 1), (404, "x" * 300_000, "en", "host1/a", 1)]
    rows += [rows[3], rows[3], (5, prose(), "fr", "host9", 2)]  # repeated rows, and another text with a known id
    return rows


ROWS = table()
DDL = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "size ident component_id text_hash n_shingles taken tie part group y_id keep copies".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, DDL).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, DDL).selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(EXTRA)))


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns_and_stands_an_empty_table(spark, sf_dir, k):
    stage, docs = corpus_pipeline.STAGES[k][1], docs_of(spark)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert set(rows_of(out)) <= set(rows_of(docs))
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(spark):
    kept = rows_of(corpus_pipeline.keep_one_of_each_group(spark, docs_of(spark), None))
    known = sorted({(d, t) for d, t, *_ in ROWS if d is not None and shingles(t)}, key=str)
    sets, low = [shingles(t) for _, t in known], list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = low[i], low[j]
                low = [b if x == a else x for x in low]
    want = {min(known[i][0] for i in range(len(known)) if low[i] == g) for g in set(low)}
    got = [r for r in kept if r[0] is not None and shingles(r[1])]
    assert sorted(r[0] for r in got if r[0] != 5) == sorted(want - {5})
    assert len(got) == len(set(low))
    assert [r for r in kept if r[0] is None or not shingles(r[1])] == sorted((r for r in ROWS if r[0] is None or not shingles(r[1])), key=str)


def test_contaminated_go(spark, sf_dir):
    kept = rows_of(corpus_pipeline.keep_uncontaminated(spark, docs_of(spark), sf_dir))
    assert kept == sorted((r for r in ROWS if r[0] != 300), key=str)  # of 301, a thirtieth is hit


def test_mix_takes_whole_documents(spark):
    out = corpus_pipeline.mix(spark, docs_of(spark), None)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r[1]) for r in ROWS)
    taken = {}
    for r in rows_of(out):
        taken[r[3]] = taken.get(r[3], 0) + size(r[1])
    names = sorted({r[3] for r in ROWS if r[3] is not None}) + [None]
    own = {s: sum(size(r[1]) for r in ROWS if r[3] == s) for s in names}
    target, open_, rest = {}, {s: k % 3 + 1 for k, s in enumerate(names)}, float(total)
    while open_:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            rest -= target[s]
            del open_[s]
    longest = {s: max(size(r[1]) for r in ROWS if r[3] == s) for s in names}
    for s in names:
        assert abs(taken.get(s, 0) - target[s]) <= longest[s] / 2 + 1, s
    assert rows_of(out) == rows_of(corpus_pipeline.mix(spark, docs_of(spark), None))


def test_whole_pipeline(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    text = {}
    for d, t, *_ in ROWS:
        text.setdefault(d, set()).add(t)
    start = 0
    for d, at, n, crc in got:
        ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in text[d]]
        assert at == start and (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in ids}
        start += n
    assert [r[0] for r in got if r[0] is not None] == sorted(r[0] for r in got if r[0] is not None)
    assert 300 not in {r[0] for r in got} and {0, 1, 2} & {r[0] for r in got}


def test_last_stage_of_nothing(spark, sf_dir):
    assert corpus_pipeline.write_tokens(spark, docs_of(spark, []), sf_dir).count() == 0
