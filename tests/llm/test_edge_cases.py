"""Every operator on nulls, empty and long texts, repeated rows, empty tables and columns
whose names clash with those that operators use."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontam, exact_dedup, html_text, langid, minhash, packing, secrets, sentence_spans, simple8b, warc
from framewright.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, n bigint, id bigint, key string, page bigint, _norm string, label string, kept string, score string"
LONG = " ".join(f"word{k}" for k in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "k", 3, "x", "y", "z", "s") for i, t, lang in rows], SCHEMA)


ROWS = [(1, "a b c d e f. g h", "en"), (1, "a b c d e f. g h", "en"), (2, None, None), (3, "", "en"), (4, " \t\n", "fr"), (None, "a b c", None), (5, LONG, "en"), (6, "ABCDEF.GH a", "fr"), (7, "a\tb c d e f. g h", "en")]


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [(1, "a", "en")]).limit(0)


def test_exact(some, none):
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(some).collect())
    assert got == [(0, None, 1, True), (1, 1, 3, True), (1, 1, 3, True), (2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 1, True), (6, 6, 1, True), (7, 1, 3, False)]
    kept = exact_dedup.drop_copies(some)
    assert kept.columns == some.columns and kept.count() == 5  # one of the repeated row
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_language(some, none):
    model = langid.train(some)
    got = {r["doc_id"]: r for r in langid.predict(some, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert got[5]["lang_pred"] == "en" and 0 <= got[5]["score"] <= 1
    empty = langid.train(none)
    assert empty.languages == () and langid.predict(some, empty).filter("lang_pred = 'und'").count() == len(ROWS)
    assert langid.predict(none, model).count() == 0


def test_near(some, none):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(some, words=2).collect()}
    assert (got[2]["n_shingles"], got[2]["component_id"], got[2]["kept"]) == (0, 2, True)
    assert (got[7]["component_id"], got[7]["kept"]) == (1, False)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, True)
    assert got[5]["n_shingles"] == 29_999
    left = minhash.drop_near_duplicates(some, words=2)
    assert left.columns == some.columns and left.count() == len(ROWS) - 2  # 7 and one of the repeated row
    assert minhash.near_duplicates(none).count() == 0


def test_packing(some, none):
    out = packing.pack(some, tokenizer("byte_bpe_50k.json"), capacity=64, block=256).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert [r["length"] for r in out if r["doc_id"] == 2] == [1]
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_with_few_pieces_kept(spark):
    """Texts of many different words, over parts of a batch, with a small table of pieces; the
    table that a worker keeps is bounded by a parameter."""
    from framewright.llm import bpe

    path = tokenizer("byte_bpe_50k.json")
    texts = [" ".join(f"w{k}x{j}, and" for j in range(40)) for k in range(300)]
    enc = bpe.encoder(path, "bytes", 1000)
    assert list(enc.encode(texts)) == list(bpe.PieceEncoder(path, "bytes").encode(texts)) and len(enc) < 1300
    df = docs(spark, [(k, t, "en") for k, t in enumerate(texts * 5)]).coalesce(1)
    rows = [sorted(map(tuple, packing.pack(df, path, pieces=n).drop("ids").collect())) for n in (1000, 250_000)]
    assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == 1500


def test_spans(spark, some, none):
    assert sentence_spans.repeats(none).count() == 0
    clean = sentence_spans.cleaned(some)
    assert clean.columns == some.columns and clean.count() == len(ROWS)
    three = "One two three four five six. Seven eight nine ten eleven. Twelve thirteen fourteen fifteen sixteen!"
    df = docs(spark, [(9, f"{three}\nown words here.", "en"), (4, f"Before it. {three} After it.", "en"), (None, three, "en")])
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sentence_spans.repeats(df).collect()}
    assert got == {9: (3, "own words here."), None: (3, "")}


def test_secrets(spark, some, none):
    assert secrets.candidates(none.select("doc_id", "text")).count() == 0
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    df = docs(spark, [(1, f'api_token = "{key}" end', "en"), (2, f"commit {key} fixed", "en"), (3, None, None), (1, f'api_token = "{key}" end', "en")])
    got = sorted((r["doc_id"], r["place"], r["candidate"], r["is_secret"]) for r in secrets.findings(df).collect())
    assert got == [(1, 2, key, True), (1, 2, key, True), (2, 1, key, False)]


def test_leaks(spark, some, none):
    item = "the quick brown fox jumps over the lazy dog and then sleeps all day"
    items = spark.createDataFrame([(1, item, 5), (2, None, 5), (3, "too short", 5), (1, item, 5)], "item_id bigint, text string, doc_id bigint")
    near = item.replace("jumps", "leaps").replace("sleeps", "rests").upper()
    df = docs(spark, [(1, f"well, {near}!", "en"), (2, item[:30], "en"), (None, item, "en"), (3, None, None), (4, "too short", "en")])
    got = sorted((r["doc_id"] or 0, r["item_id"], r["doc_start"], r["n_words"], r["n_equal"]) for r in decontam.overlaps(df, items).collect())
    assert got == [(0, 1, 0, 14, 14), (1, 1, 1, 14, 12), (4, 3, 0, 2, 2)]  # short items are found whole
    assert sorted(r["doc_id"] for r in decontam.without_benchmark(df, items).collect()) == [2, 3, 4]
    assert decontam.overlaps(none, items).count() == 0 and decontam.overlaps(df, items.limit(0)).count() == 0
    by_join = decontam.overlaps(df, items, broadcast_rows=0)
    assert sorted((r["doc_id"] or 0) for r in by_join.collect()) == [0, 1, 4]


def test_leaks_of_short_equal_and_repeated(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "Alpha, beta gamma delta epsilon!"), (3, "go " * 30), (4, "one two three four five six seven")], "item_id bigint, text string")
    df = docs(spark, [
        (1, "x alpha beta gamma delta epsilon y", "en"),
        (2, "x alpha beta gamma delta zeta y", "en"),
        (3, "go " * 20_000, "en"),
        (None, "one two three four five six seven", "en"),
        (None, "a clean text", "en"),
        (4, "one two three four five six", "en"),
    ])
    got = sorted((r["doc_id"] or 0, r["item_id"], r["n_words"], r["n_equal"]) for r in decontam.overlaps(df, items).collect())
    assert got == [(0, 4, 7, 7), (1, 1, 5, 5), (1, 2, 5, 5), (3, 3, 30, 30)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in decontam.without_benchmark(df, items).select("doc_id", "text").collect())
    assert [i for i, _ in left] == [0, 2, 4] and left[0][1] == "a clean text"


def test_tokens(some, none):
    got = simple8b.round_trip(some, tokenizer("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    assert [r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert simple8b.round_trip(none, tokenizer("word_bpe_49k.json")).count() == 0


ODD = ["", " ", "a", " a  b.", "a,b dogs' dogs', don't (x) --", "na\xefve\xa0\xc4\xd6 x", "\ufb01 e\u0301 x\x85y", "\u03a9 \u6f22 abc", "a\x0bb\x0cc\td\re\nf", "\x1c a\x1fb", "<|ENDOFTEXT|> <|endoftext|>", "x" * 5000, "\u0130 \u0131 \u017f", "\u2026\u2018 \u20ac, Stra\xdfe!? 12,5"]


def test_arrays_of_words():
    """As whole texts, whatever is beside them; a batch asks the table once for a word."""
    from framewright.llm import bpe

    class Asked(bpe.PieceEncoder):
        n = 0

        def __getitem__(self, piece):
            self.n += 1
            return super().__getitem__(piece)

    enc = Asked(tokenizer("word_bpe_49k.json"), "words", 50)
    for kind in (pa.string(), pa.large_string()):
        for texts in ([], ODD, ODD[::-1], *([t] for t in ODD)):
            ids, lengths = enc.encode_words(pa.array(["z", *texts, "z"], kind).slice(1, len(texts)))
            assert len(lengths) == len(texts) and lengths.sum() == len(ids)
            assert [p.tobytes() for p in np.split(ids, np.cumsum(lengths))[:-1]] == [enc._whole(t) for t in texts]
    enc.n = 0
    assert len(enc.encode_words(pa.array(["Alpha beta, beta. ALPHA "] * 1000))[0]) == 6000 and enc.n < 10


def test_parts_of_batches(monkeypatch):
    texts = ["", "x" * 50, "y" * 9, "", "z" * 5, "x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(simple8b, "_TEXT", 20)
    got = list(simple8b._parts(batch))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts and len(got) > 2
    assert not list(simple8b._parts(batch.slice(0, 0)))


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_words_of_blocks(n):
    """Each word takes the most ids that fit, as a plain walk through a block does."""
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) >> rng.choice(np.array([4, 33, 47, 50, 60, 63], np.uint64), n)
    ids[rng.random(n) < 0.3] = 0
    ids[n // 2 : n // 2 + 600] = 0
    ids[-1:] = 2**60
    for k, (words, places, values) in enumerate(simple8b.encode_blocks(ids)):
        block = ids[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK].tolist()
        assert [(p, block[p]) for p in places.tolist()] == [(p, v) for p, v in enumerate(block) if v >= 2**60]
        assert values.tolist() == [v for v in block if v >= 2**60]
        small, at, wanted = [v if v < 2**60 else 0 for v in block], 0, []
        while at < len(block):
            s = next(s for s in range(16) if max(small[at : at + simple8b.COUNTS[s]]) < 1 << int(simple8b.BITS[s]))
            own = small[at : at + simple8b.COUNTS[s]] if simple8b.BITS[s] else []
            wanted.append(s << 60 | sum(v << i * int(simple8b.BITS[s]) for i, v in enumerate(own)))
            at += int(simple8b.COUNTS[s])
        assert words.tolist() == wanted


def test_work_of_blocks():
    """Encoding takes little more time, at most, than a running sum over the ids for each selector."""
    import time

    ids = np.random.default_rng(0).integers(0, 49_408, 512 * simple8b.BLOCK).astype(np.uint64)

    def spent(run) -> float:
        found = []
        for _ in range(5):
            begun = time.process_time()
            run()
            found.append(time.process_time() - begun)
        return min(found)

    sums = lambda: [np.cumsum(ids > 1 << int(b), dtype=np.int32) for b in simple8b.BITS]
    assert spent(lambda: simple8b.encode_blocks(ids)) < 1.5 * spent(sums)


PAGES = [(1, "http://a.org/x", "<p>one</p>"), (2, "http://a.org/x", "<p>one</p>"), (3, None, None), (4, "https://B.org:80/y?z#f", ""), (None, "http://a.org/x", "<p>one</p>"), (5, "no url", "<p>" + "x " * 50_000 + "</p>"), (1, "http://a.org/x", "<p>one</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "page_id bigint, url string, html string, key string, page bigint, host bigint")


def test_warc(spark):
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or None) for r in warc.round_trip(pages(spark, PAGES)).collect())
    assert got == [(0, 10, "revisit", 1), (1, 10, "response", None), (1, 10, "revisit", 1), (2, 10, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 100_007, "response", None)]
    least = [r["record_type"] for r in warc.round_trip(pages(spark, PAGES), min_bytes=11).collect()]
    assert least == ["response"] * 7
    assert warc.round_trip(pages(spark, PAGES).limit(0)).count() == 0


def test_warc_index_in_blocks(spark):
    """More index files than a task holds, and one key that is in all of them."""
    folder = warc.fresh_dir(spark, "test")
    rows = [(k, "http://a.org/hot" if k % 2 else f"http://b.org/{k}", f"<p>{k}</p>") for k in range(400)]
    captures = warc.write_archives(pages(spark, rows), folder)
    shards = warc.build_index(captures, f"{folder}-index")
    keys = captures.select("key").filter("page_id % 4 <> 0")
    found = {r["page_id"] for r in warc.lookup(shards, keys, most_shards=1).collect()}
    assert shards.count() > 1 and found == {k for k in range(400) if k % 4}


def test_repeated_rows_leave_one(spark):
    """Rows that repeat id and text, with and without an id, and with other columns that differ."""
    rows = [(1, "some words of a text here", "en"), (1, "some words of a text here", "fr"), (1, "some words of a text here", "en")]
    rows += [(None, "other words that nobody else has", "en")] * 2 + [(3, "some words of  a text here", None), (4, None, None), (4, None, None)]
    df = docs(spark, rows)
    for left in (exact_dedup.drop_copies(df), minhash.drop_near_duplicates(exact_dedup.drop_copies(df)), minhash.drop_near_duplicates(df)):
        assert left.columns == df.columns
    got = lambda left: sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert got(exact_dedup.drop_copies(df)) == [(0, "other words that nobody else has"), (3, "some words of  a text here"), (4, "")]
    assert got(minhash.drop_near_duplicates(df)) == [(0, "other words that nobody else has"), (1, "some words of a text here"), (4, "")]


def test_html(spark):
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(pages(spark, PAGES)).collect())
    assert [t for _, t in got[:6]] == ["one", "one", "one", "one", "", ""] and len(got[6][1]) == 99_999
    assert html_text.extract(pages(spark, PAGES).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Nulls, repeated rows, ties, long and empty texts, clashing columns and an empty table
    through every stage."""
    import corpus_pipeline as P

    sf = str(tmp_path)
    items = [(1, "the quick brown fox jumps over the lazy dog and then sleeps all day")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(*r, "s", 1, "clash", 7) for r in ROWS] + [(20, items[0][1], "en", "s", 1, "clash", 7), (None, items[0][1] + " x", "en", "s", 1, "clash", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, _i bigint")
    kept = {}
    for name, stage in P.STAGES:
        out = P.written(stage(spark, df, sf), name)
        if name != "packing":
            assert out.columns == P.COLUMNS
            assert stage(spark, df.limit(0), sf).count() == 0
            kept[name] = sorted((r["doc_id"] or 0) for r in out.collect())
            df = out
    assert kept["language"] == [0, 0, 1, 1, 5, 6, 7, 20]
    assert kept["exact"] == [0, 0, 1, 5, 6, 20]
    assert kept["near"] == [0, 0, 1, 5, 6, 20]
    assert kept["leaks"] == [0, 1, 5, 6]
    assert sorted({(r["doc_id"] or 0) for r in out.collect()}) == [0, 1, 5, 6]
