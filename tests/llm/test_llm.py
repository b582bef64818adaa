"""The operators against plain forms, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carteframe.llm import bpe, decontaminate, html, kernels, langid, minhash, pii, quality, queries, sharding, substring, warc

from . import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def near(spark, small, name="documents", key="doc_id", value="text"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{small}/{name}.parquet").select(key, value).collect()]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- kernels


def test_words_and_windows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té漢.9") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "x"]
    data, offsets = kernels.buffers(pa.array(texts))
    for kind, pattern in ((kernels.SPACED, brute.SPACED), (kernels.ALNUM, brute.ALNUM)):
        starts, ends, first = kernels.words(data, offsets, kind)
        got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
        assert got == [pattern.findall(t if kind is kernels.SPACED else t) if kind is kernels.SPACED else [re.sub("", "", w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)] for t in texts]


def test_equal_words_have_equal_hashes():
    data, offsets = kernels.buffers(pa.array(["the The x", "THE x the"]))
    starts, ends, _ = kernels.words(data, offsets, kernels.SPACED)
    assert len(set(kernels.word_hashes(data, starts, ends, lower=True).tolist())) == 2
    assert len(set(kernels.word_hashes(data, starts, ends, lower=False).tolist())) == 4


# ---- near-duplicates


def copies(rng, n):
    out = []
    for i in range(n):
        base = words(rng, rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("similarity", [85, 80])
def test_components(docs, similarity):
    texts = copies(random.Random(similarity), 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components_of(docs(texts).repartition(7), similarity).collect()}
    assert got == brute.components(list(enumerate(texts)), similarity)


def test_components_of_one_large_group(docs):
    """A cloud of near copies, most pairs close to the threshold, and a third of all rows equal."""
    rng = random.Random(5)
    base = words(rng, 100)
    texts = []
    for _ in range(220):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(100)] = f"n{rng.randrange(50)}"
        texts.append(" ".join(text))
    texts += [" ".join(base)] * 110
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components_of(docs(texts), 85).collect()}
    assert got == brute.components(list(enumerate(texts)), 85)


def test_components_odd(docs, odd):
    got = minhash.components_of(docs(odd), 85).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[0].component_id == 0
    assert by[4].component_id == by[5].component_id == 4
    assert by[None].component_id is None and by[-5].component_id == -5
    assert {r.doc_id for r in minhash.deduplicate(docs(odd)).collect()} == {r.doc_id for r in got} - {5}
    assert minhash.components_of(docs([""]).where("false")).count() == 0


def test_blocks_compare_all(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts = copies(random.Random(9), 25)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components_of(docs(texts), 80).collect()}
    assert got == brute.components(list(enumerate(texts)), 80)


def test_posterior_bound():
    for similarity in (80, 85):
        least = minhash.least_matches(similarity, 60, 1e-4)
        assert least[0] == 0 and all(b - a in (0, 1) for a, b in zip(least, least[1:])) and least[60] < 60 * similarity / 100
    rows, bands = minhash.plan(85)
    assert rows * bands <= minhash.HASHES and (1 - 0.85**rows) ** bands <= minhash.MISS


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)], "a long, b long").repartition(5)
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


# ---- tokens


def test_bpe_equals_the_library(spark, small, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    texts = [t if not isinstance(t, tuple) else t[1] for t in odd] + ["".join(rng.choice("ab c'sdre t\n\t12é漢🎉\x1c\x85\xad!?<|>²ß") for _ in range(rng.randrange(80))) for _ in range(500)] + [t for _, t in near(spark, small)]
    rows = bpe.decode(bpe.encode(docs(texts), VOCABULARY), VOCABULARY).select("doc_id", "ids", "decoded", "source").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.source == "s"


def test_fragments_are_certain_cuts():
    v = bpe.vocabulary(VOCABULARY)
    for text in ("hello", "zqxjkv", "naïve", "1234", "aébcdé"):
        raw = text.encode()
        assert b"".join(v.fragments(raw)) == raw
        assert sum((v.merged(f) for f in v.fragments(raw)), []) == v.merged(raw)
    long_ = b"abcab" * 400
    assert v._merged_long([v.byte_ids[b] for b in long_]) == sum((v.merged(long_[:0]) for _ in ()), []) + np.frombuffer(v.ids_of(long_.decode()), np.int32).tolist()


def test_broken_ids_decode_to_replacements(spark):
    v = bpe.vocabulary(VOCABULARY)
    half = v.id_of["é".encode()[:1]]
    rows = spark.createDataFrame([([half],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, VOCABULARY).collect()] == ["�", "", ""]


# ---- language


def test_language_held_out(spark, small):
    rows = queries.op3_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(docs, odd):
    filters = langid.fit(docs(["the cat sat on the mat and the dog"] * 3))
    got = langid.predict(docs(odd), filters, ["doc_id", "score"], score_col="_s").collect()
    assert len(got) == len(odd)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {0: "und", 1: "und", 2: "und"}
    nothing = langid.fit(docs(["x"]).where("false"))
    assert {r.lang_pred for r in langid.predict(docs(["hello"]), nothing, ["doc_id"]).collect()} == {"und"}


def test_language_stage_rejects_what_was_never_learned(spark, docs):
    import corpus_pipeline

    texts = ["the cat sat on the mat and the dog"] * 20 + ["漢字仮名交じり文の例です", "Ωμέγα και άλφα", "Re.", "123", None]
    rows = docs(texts).withColumn("lang", F.when(F.col("doc_id") < 20, "en"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, rows, "").collect()} == {*range(20), 22}


def test_filters_beyond_64_languages():
    languages = [f"l{i:02}" for i in range(70)]
    codes = {k: np.frombuffer(f"{k}xx".encode()[:4], np.uint32) for k in languages}
    filters = langid.Filters(languages, codes)
    data, offsets = kernels.buffers(pa.array(["abcd"]))
    assert filters.slices.shape[0] == 2 and filters.counts(data, offsets).shape == (1, 70)


# ---- repeats


@pytest.mark.parametrize("seed", range(3))
def test_repeats(docs, seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(40, 160), 2000) for _ in range(12)] + [["run"] * 130, ["a", "b"] * 70]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 45))
            parts += p[a : a + rng.randrange(30, 140)] + words(rng, rng.randrange(0, 30), 5000)
        texts.append(" ".join(parts))
    texts += texts[:15]
    out = substring.remove_repeats(docs(texts).repartition(6)).select("doc_id", "n_words", "n_removed", "kept_text", "source").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == brute.repeats(list(enumerate(texts)))


def test_repeats_odd(docs, odd):
    got = {r.doc_id: r for r in substring.remove_repeats(docs(odd)).collect() if r.doc_id != 3}
    assert got[0].n_words == 0 and got[0].kept_text == "" and got[8].n_removed == 0 and got[None].n_removed == 0
    assert substring.remove_repeats(docs([""]).where("false")).count() == 0


def test_equal_windows_have_equal_dependable_symbols():
    rng = random.Random(3)
    middle = words(rng, 50, 1000)
    seen = []
    for _ in range(6):
        text = " ".join([*words(rng, rng.randrange(0, 90), 1000), *middle, *words(rng, rng.randrange(0, 90), 1000)])
        t = substring.Texts(pa.array([text]), 50)
        names, _, left, right = t.dependable()
        at = next(k for k in range(len(t.starts)) if text.split()[k : k + 50] == middle)
        seen.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(names, left, right) if a >= at and b <= at + 50})
    assert seen[0] and all(s == seen[0] for s in seen)


# ---- personal data


def pii_texts(rng):
    parts = ["a.b@c.de", "x@y", "me@a.b.c-d@e.f", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (132) 555-1352", "+49 30", "12345678901234567890123", "é", "漢🎉", "word", "a" * 30, "..", "@@", "+", "1 2 3"]
    return [rng.choice(["", " ", ",", "é"]).join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(300)]


def test_base_spans(docs, odd):
    texts = pii_texts(random.Random(4)) + [t[1] if isinstance(t, tuple) else t for t in odd] + ["7" * 30_000, "a@" + "b." * 20_000 + "c", "a" * 60_000, "+1" + " " * 30_000]
    rows = pii.spans(docs(texts), models={}).select("doc_id", pii.ordered(F.col("pii.base")).alias("b"), "spans").collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.b] == brute.personal(texts[r.doc_id]), texts[r.doc_id][:80]


def test_redaction(docs):
    texts = ["call +1 (132) 555-1352 or me@x.org now 🎉 1.2.3.4", None, "clean"]
    assert [r.text for r in pii.redact(docs(texts), models={}).orderBy("doc_id").collect()] == ["call [PHONE] or [EMAIL] now 🎉 [IP]", None, "clean"]


def test_boosting_finds_other_spellings(docs):
    rng = random.Random(6)
    number = lambda: f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    texts = [f"call +1 {number()} now" for _ in range(300)] + [f"order {rng.randrange(10**6, 10**9)} done" for _ in range(300)]
    models = pii.fit(docs(texts))
    assert "phone" in models and 0.5 <= models["phone"].threshold <= 1
    got = pii.spans(docs(["ring (132) 555-1352 please", "order 123456789 done"]), models).select("doc_id", "pii").orderBy("doc_id").collect()
    assert [s.kind for s in got[0].pii.added] == ["phone"] and not got[1].pii.added


# ---- pages


def test_page_blocks():
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>A</a><li>B</ul></nav><!-- c --><div class=ad>Buy</div><article><h1>Hi &amp; ho</h1><p><b>One<br>two<p>Three\n  four</article>"
    assert [t for t, _, _ in html.blocks(page)] == ["T", "A", "B", "Buy", "Hi & ho", "One two", "Three four"]
    assert html.blocks(page)[4][1] == html.path("html body article h1".split()) and html.blocks("") == [] and html.blocks("a < b <") == [("a < b <", frozenset(), 0)]


def test_extraction(spark, small):
    out = html.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    for r in out:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        import html as std

        want = [re.sub(r"\s+", " ", std.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(p for p in want if p)


def test_extraction_odd(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<div class=comments><p>first!</p></div>", "x"), (4, "<article><p>Main text of the page here, long enough.</p><div class=comment><p>Nice one</p></div></article>", "x")], "page_id long, html string, text string")
    assert [r.text for r in html.extract(pages).orderBy("page_id").collect()] == ["", "", "", "Main text of the page here, long enough."]
    grammar = html.PageGrammar(77)
    drawn = [p for p in (grammar.page() for _ in range(150)) if p[0]]
    truth = np.concatenate([y for _, y in drawn])
    assert ((html.trained().scores([b for b, _ in drawn]) >= 0.5) == truth).mean() >= 0.99


def test_text_under_unusual_elements_is_read():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>a fallback</object><select><option>no</option></select>.</p><p title='a>b'>One</p><p class=x\">Two</p></article>"
    assert [t for t, _, _ in html.blocks(page)] == ["Let x=1 be a fallback .".replace(" .", "."), "One", "Two"] or [t for t, _, _ in html.blocks(page)] == ["Let x=1 be a fallback", ".", "One", "Two"]


@pytest.mark.parametrize("page", ["<div class=deep>x" * 60_000, "<b>" * 100_000 + "<hr>y" * 100_000, "<td><table>" + "<div>" * 50_000 + "<td>z</td>" * 50_000, "<a \"" * 150_001, "<a x=\"" * 100_001, "<div>" * 100_000 + "</span>" * 100_000], ids=range(6))
def test_a_page_costs_in_proportion(page):
    began = time.time()
    found = html.blocks(page)
    html.Labeller().scores([found, html.blocks("<p>short</p>")])
    assert time.time() - began < 60


def test_network_gradient():
    labeller = html.Labeller()
    page = html.PageGrammar(1).page()

    def loss():
        scores = labeller.scores([page[0]])
        return -np.mean(np.log(np.where(page[1], scores, 1 - scores) + 1e-9))

    before = loss()
    labeller.train([page], epochs=30)
    assert loss() < 0.3 * before


# ---- quality


def test_statistics(docs, odd):
    rng = random.Random(8)
    texts = [t[1] if isinstance(t, tuple) else t for t in odd] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "É ", "  ", "|"]) for _ in range(rng.randrange(120))) for _ in range(200)]
    for r in quality.statistics(docs(texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.rules(texts[r.doc_id])


def test_forest_isolates(spark, docs):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    scores = quality.Forest(rows[:500]).scores(rows)
    assert scores.argmax() == 500 and scores[:500].mean() < 0.55
    stats = quality.statistics(docs(["a b"]))
    assert quality.fit(stats.where("false"), spark.createDataFrame([], "doc_id long, quality int")) is None
    assert [(r.base_failed, r.kept) for r in quality.judge(stats, None).collect()] == [(True, False)]


def test_good_documents_are_kept(spark, small):
    rows = queries.op7_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("not base_failed and quality = 1").collect()
    assert sum(not r.kept for r in rows) <= 0.02 * len(rows) + 1


def test_fit_uses_all_rows(spark):
    """More rows and labels than any sample held: each row is in a tree, thresholds are the exact ranks among all good rows."""
    n = 30_000
    some = lambda k, most: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(most))
    counts = {"n_words": 100 + some(1, 400), "n_symbols": some(2, 9), "n_dup_lines": some(3, 5), "n_repeat_words": some(4, 25), "n_lines": 10 + some(5, 20), "n_upper": some(6, 60), "n_marks": some(7, 8)}
    stats = spark.range(n).withColumnRenamed("id", "doc_id").withColumns(counts).withColumn("word_chars", F.col("n_words") * 5 + some(8, 300)).select("doc_id", *quality.COUNTS)
    judge = quality.fit(stats, spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    assert [forest.size * quality.TREES for _, forest in judge.forests] == [n] * len(quality.GROUPS)
    rows = stats.toPandas()
    steps, lost = judge.steps(quality.features({c: rows[c].to_numpy() for c in quality.COUNTS})), int(quality.GOOD_LOST * n)
    for found, (_, forest) in zip(steps, judge.forests):
        assert (found > forest.threshold).sum() <= lost < (found >= forest.threshold).sum()


# ---- archives


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>same</p>"), (3, "u", "<p>same</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "tiny"), (8, "u", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least, revisits in ((0, {3: 2, 5: 4, 8: 7}), (10, {3: 2})):
        path = str(tmp_path / f"w{least}")
        warc.write_archives(pages, path, least)
        got = {r.metadata.page_id: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
        assert len(got) == 8
        for i, _, page in rows:
            r, raw = got[i], (page or "").encode()
            assert r.response.digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.metadata.payload_bytes == len(raw)
            assert (r.response.type, r.metadata.refers_to) == (("revisit", revisits[i]) if i in revisits else ("response", None))
            assert i in revisits or (r.response.payload == (page or "") and r.response.verified)
            assert r.request.type == "request"
    assert warc.assemble(warc.read_archives(spark, path).where("false")).count() == 0
    text = "".join(r.value for r in spark.read.text(path).select("value").collect())
    assert "WARC-Refers-To-Date" in text
    empty = str(tmp_path / "none")
    warc.write_archives(pages.where("false"), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0
    with pytest.raises(TypeError):
        warc.write_archives(pages.withColumn("page_id", F.col("page_id").cast("string")), empty)


def test_a_damaged_archive_stops_the_query(spark, tmp_path):
    good = b"<p>hello</p>"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(good).digest()) + b"\r\nContent-Length: 31\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>hellO</p>\r\n\r\n"
    row = next(warc.parse_records(memoryview(record), False))
    assert row["verified"] is False and row["digest"] == base64.b32encode(hashlib.sha1(b"<p>hellO</p>").digest()).decode()


def test_archive_streams():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody!!\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [r["payload"] for r in warc.parse_records(memoryview(data), True)] == ["body!!"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_records(memoryview(record[:-8]), True))


# ---- shards


def test_shards(spark, docs, odd):
    frame = docs([*odd, *(f"text {i}" for i in range(3000))])
    got = sharding.assign(frame).collect()
    assert len(got) == frame.count()
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and 250 < len(own) < 500
        assert {r.grown_shard for r in own} <= {shard, 8}
    assert 0.05 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.18
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 0} == {(1, 0)}
    by = {r.doc_id: r for r in got}
    assert by[100].text_crc32 == brute.crc(f"text {100 - len(odd)}")


def test_weights(spark):
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), [1, 3]).alias("s")).groupBy("s").count().collect()
    assert abs(dict((r.s, r["count"]) for r in rows)[1] / 20_000 - 0.75) < 0.02


def test_shard_files(spark, docs, tmp_path):
    sharding.write_shards(docs([f"t{i}" for i in range(50)]), str(tmp_path / "s"), file_rows=5)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


# ---- leaks


@pytest.mark.parametrize("blocks", [1, 3])
def test_leaks(spark, docs, monkeypatch, blocks):
    rng = random.Random(blocks)
    items = [(i, " ".join(words(rng, rng.choice([1, 4, 9, 10, 11, 40]), 30 if i % 2 else 3000))) for i in range(30)] + [(30, ""), (31, None), (32, "?!"), (33, "W5 w7")]
    texts = []
    for _ in range(60):
        parts = words(rng, rng.randrange(40), 30)
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(len(w)) if w else 0
            parts += w[a:] + words(rng, 3, 3000)
        texts.append(", ".join(parts))
    texts += [None, "", "..."]
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", sum(len(t or "") for _, t in items) // blocks)
    got = decontaminate.find_matches(docs(texts).repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.leaks(list(enumerate(texts)), items)
    assert {r.doc_id: (r.n_words, r.n_hit, set(r.items)) for r in got} == want
    for r in got:
        w = brute.ALNUM.findall(brute.lower(texts[r.doc_id] or ""))
        told = {i: brute.ALNUM.findall(brute.lower(t or "")) for i, t in items}
        for m in r.matches:
            part, own = w[m.word : m.word + m.length], told[int(m.item_id)]
            assert len(part) == m.length and any(own[k : k + m.length] == part for k in range(len(own)))
        assert bool(r.matches) == (r.n_hit > 0)
    kept = decontaminate.decontaminate(docs(texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, hit, _) in want.items() if not hit} and kept.columns == docs(["x"]).columns


@pytest.mark.parametrize("block", [16_000_000, 20])
def test_items_without_id_are_searched(spark, docs, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "six seven")], "item_id long, text string")
    texts = docs(["a one two three b", "four five six seven", "clean words", "six seven"])
    assert [r.doc_id for r in decontaminate.decontaminate(texts, items).collect()] == [2]
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op10_decontaminate(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracles()['op10_decontaminate']})").fetchall())


def test_equal_words_cost_no_product():
    """An item and a text of 100,000 equal words, and a phrase that many items share."""
    tests = decontaminate.TestItems([("a", "run " * 100_000), *((str(i), f"choose the one best answer to this question from the list q{i}") for i in range(300))], 10)
    texts = ["Run " * 100_000, *(["so choose the one best answer to this question from the list now"] * 300)]
    data, offsets = kernels.buffers(pa.array(texts))
    starts, ends, first = kernels.words(data, offsets, kernels.ALNUM)
    began = time.time()
    got = decontaminate.search(tests, data, starts, ends, first)
    assert time.time() - began < 60
    assert got.hit[:100_000].all() and (got.at[0], got.item[0], got.length[0]) == (0, 0, 100_000)
    listed = decontaminate._listed(tests, got.doc, got.set_, len(texts)).to_pylist()
    assert listed[0] == ["a"] and all(len(x) == 300 for x in listed[1:])


def test_longest_match(spark, docs):
    item = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(40)))], "item_id long, text string")
    text = "x " + " ".join(f"i{k}" for k in range(5, 30)) + " y " + " ".join(f"i{k}" for k in range(12))
    m = decontaminate.find_matches(docs([text]), item).first().matches
    assert [(x.item_id, x.word, x.length) for x in m] == [("1", 1, 25), ("1", 27, 12)]


# ---- the queries over a small table


def test_queries_equal_brute_force(spark, small):
    rows = near(spark, small)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_minhash(spark, small).collect()}
    assert got == brute.components(rows, 85)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring(spark, small).collect()}
    assert got == {k: (a, b, brute.sha(c)) for k, (a, b, c) in brute.repeats(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op10_decontaminate(spark, small).collect()}
    items = near(spark, small, "benchmark", "item_id")
    assert got == {k: (a, b, len(c), brute.sha(",".join(sorted(c)))) for k, (a, b, c) in brute.leaks(rows, items).items()}
    got = {r.doc_id: (r.n_email + r.n_ip + r.n_card + r.n_phone, r.base_sha256) for r in queries.op5_pii(spark, small).collect()}
    assert got == {k: (len(p := brute.personal(t)), brute.sha(",".join(f"{a}:{b}:{c}" for a, b, c in p))) for k, t in rows}
    assert {r.doc_id for r in queries.op9_sharding(spark, small).collect()} == {k for k, _ in rows}
    assert queries.op8_warc(spark, small).count() == len(near(spark, small, "pages", "page_id", "html"))


def test_pipeline(spark, small):
    import corpus_pipeline

    rows = near(spark, small)
    kept = {i: t for i, t in rows if re.search(r"[^\W\d_]", t or "")}
    groups = brute.components(list(kept.items()), minhash.SIMILARITY)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    hits = brute.leaks(list(kept.items()), near(spark, small, "benchmark", "item_id"))
    kept = {i: t for i, t in kept.items() if not hits[i][1]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(out) == set(kept) and all(r.exact for r in out.values())
    v = bpe.vocabulary(VOCABULARY)
    for i, t in kept.items():
        if not brute.personal(t):
            assert out[i].ids == np.frombuffer(v.encode(t or ""), np.int32).tolist()
        else:
            assert "[" in v.decode(np.array(out[i].ids), np.array([0, len(out[i].ids)]))[0].as_py()


# ---- very many spans


def test_many_spans_and_redaction_equal_brute_force(docs):
    """Any number of spans in one text; overlapping kinds; marks in order."""
    texts = pii_texts(random.Random(14)) + ["me@x.org 🎉 1.2.3.4, " * 5000, "é" * 2500 + "a@b.cd" + "漢" * 1700 + " 4111 1111 1111 1111"]
    got = {r.doc_id: r.text for r in pii.redact(docs(texts), models={}).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for start, end, kind in sorted((s, e, [k for k, _ in brute.PII].index(kind)) for kind, s, e in brute.personal(t)):
            if start >= at:
                out += [t[at:start], f"[{brute.PII[kind][0].upper()}]"]
            at = max(at, end)
        assert got[i] == "".join(out) + t[at:], t[:80]


def test_a_hundred_thousand_spans(docs):
    text = "mail me at someone@example.org or else, " * 100_000
    began = time.time()
    row = pii.spans(docs([text]), models={}).select(F.size("pii.base").alias("n"), F.element_at("pii.base", -1).alias("last")).first()
    assert row.n == 100_000 and row.last.end == len(text) - len(" or else, ") and time.time() - began < 60


def test_added_spans_overlap_nothing(docs):
    always = {k: pii.Trees(5.0, [], 0.5) for k in pii.KINDS}
    texts = ["call 555 123 4567 or x (at) y.org, 4111.1111.1111.1111 1 . 2 . 3 . 4", "+1 (132) 555-1352", "4111 1111 1111 1111 and 4111 1111 1111 1112"]
    for r in pii.spans(docs(texts), always).select("doc_id", "pii").collect():
        spans = sorted([(s.start, s.end) for s in r.pii.added] + [(s.start, s.end) for s in r.pii.base])
        added = {(s.start, s.end) for s in r.pii.added}
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]) if a in added or b in added)
        assert {(s.kind, s.start, s.end) for s in r.pii.base} == set(brute.personal(texts[r.doc_id]))
        assert added or r.doc_id == 1


# ---- words that a polynomial hash would confuse


def thue_morse(n=1024):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_one_polynomial_value_differ(spark, docs):
    one, two = thue_morse()
    tail = " ".join(f"t{k}" for k in range(60))
    texts = [f"{one} " * 12, f"{two} " * 12, f"{one} {tail}", f"{two} {tail}", f"{one} {two} " * 6]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components_of(docs(texts), 85).collect()}
    assert got == brute.components(list(enumerate(texts)), 85)
    out = substring.remove_repeats(docs([f"{one} " * 60, f"{two} " * 60])).collect()
    assert [r.n_removed for r in out] == [0, 0]
    for r in quality.statistics(docs(texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.rules(texts[r.doc_id])
    items = [(1, f"{one} " * 10), (2, two)]
    want = brute.leaks(list(enumerate(texts)), items)
    got = decontaminate.find_matches(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, set(r.items)) for r in got} == want


def test_colliding_names_are_found_and_replaced(monkeypatch):
    """With a hash of two bits nearly all words collide; sets are still exact."""
    texts = [" ".join(words(random.Random(k), 30)) for k in range(4)]
    monkeypatch.setattr(kernels, "mix", lambda x: x & kernels.U(3))
    values, first = minhash.shingle_sets(pa.array(texts))
    monkeypatch.undo()
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first, first[1:])]
    exact = [brute.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    assert all(len(sets[i] & sets[j]) == len(exact[i] & exact[j]) for i in range(4) for j in range(4))


def test_a_very_long_text_stays_in_bounds():
    import resource

    text = pa.array(["x" * 8_000_000 + " " + "word and " * 1_000_000])
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    minhash.shingle_sets(text, checked=False)
    substring.Texts(text, 50).wholes()
    quality.count_texts(*kernels.buffers(text))
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000


# ---- more of the queries against plain forms


def test_more_queries_equal_brute_force(spark, small):
    import math
    import struct

    import xxhash
    from tokenizers import Tokenizer

    rows = dict(near(spark, small))

    def shard(key, n):
        def score(k):
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", k), h)
            return -1 / math.log(((h >> 11) + 0.5) / (1 << 53))

        return max(range(n), key=lambda k: (score(k), k))

    got = queries.op9_sharding(spark, small).collect()
    for r in got:
        assert (r.shard, r.grown_shard, r.size, r.text_crc32, r.law) == (shard(r.doc_id, 8), shard(r.doc_id, 9), len((rows[r.doc_id] or "").encode()) + 1, brute.crc(rows[r.doc_id]), "key")
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    library = Tokenizer.from_file(VOCABULARY)
    for r in queries.op2_bpe(spark, small).collect():
        ids = library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))
    for r in queries.op7_quality(spark, small).collect():
        want = brute.rules(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    assert all(r.n_chars == len(r.text) for r in queries.op6_html(spark, small).collect())
    for r in queries.op5_pii(spark, small).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = {(k, str(a), str(b)) for k, a, b in brute.personal(rows[r.doc_id])}
        assert base <= {tuple(x) for x in spans} and [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)


def test_filters_are_near_exact_sets():
    """Corrected counts differ from those of exact sets by the filters' false positives only."""
    rng = np.random.default_rng(3)
    codes = {k: np.unique(rng.integers(0, 1 << 32, 3000, dtype=np.uint32)) for k in ("a", "b")}
    filters = langid.Filters(["a", "b"], codes)
    assert (filters.false < 0.1).all()
    text = np.concatenate([codes["a"][:500], rng.integers(0, 1 << 32, 500, dtype=np.uint32)])
    for i, k in enumerate(("a", "b")):
        hits = np.all([filters.slices[0][p] >> kernels.U(i) & kernels.U(1) for p in langid.probes(text, filters.positions)], axis=0)
        exact = np.isin(text, codes[k])
        assert hits[exact].all() and hits[~exact].mean() < 0.1


def test_empty_tables_and_clashing_names(spark, docs):
    none = docs([""]).where("false")
    assert bpe.round_trip(none, VOCABULARY).count() == 0 and pii.redact(none, {}).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_matches(none, items).count() == 0 and decontaminate.decontaminate(docs(["a b c", "x"]), items.where("false")).count() == 2
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0
    clash = docs(["a b c d e f", "a b c d e f", None]).withColumn("_lost", F.lit(1)).withColumn("_lost_id", F.lit(2)).withColumn("_hashes", F.lit(3)).withColumn("_wholes", F.lit(4)).withColumn("_pii", F.lit(5))
    assert {r.doc_id for r in minhash.deduplicate(clash).collect()} == {0, 2}
    assert {(r._lost_id, r._hashes, r._wholes) for r in substring.remove_repeats(clash).collect()} == {(2, 3, 4)}
    assert {r._pii for r in pii.redact(clash, {}).collect()} == {5}
    for f in (minhash.components_of, substring.remove_repeats):
        with pytest.raises(TypeError):
            f(docs(["a"]).withColumn("doc_id", F.lit("x")))


def test_odd_rows_in_decontamination(spark, docs, odd):
    items = [(None, "one"), ("x", "a b c d e"), ("y", None), ("z", "word " * 12), ("w", "ß")]
    want = brute.leaks([(k, t) for k, t in enumerate(x[1] if isinstance(x, tuple) else x for x in odd)], items)
    frame = docs([(k, x[1] if isinstance(x, tuple) else x) for k, x in enumerate(odd)])
    got = decontaminate.find_matches(frame, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, {str(i) for i in r.items}) for r in got} == want
