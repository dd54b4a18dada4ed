"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from astraloom.llm import ann, html_text, language, mixing, pieces, quality_model, quality_rules, secrets, simhash, warc
from astraloom.llm.registry import tokenizer_path

WORDS = [w + v for w in "lor ips dol sit ame con sec adi eli sed".split() for v in "aeiou"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, kept string, budget long, spans string, rank int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 200_000)
    texts = [
        (1, None, "en", "src0"), (2, "", "en", None), (3, " \t\n", None, "src0"), (4, long, "de", "src0"), (5, prose(2, 80), "en", "src1"), (5, prose(2, 80), "en", "src1"),
        (6, prose(2, 80), "de", "src2"), (7, "x" * 300_000, "en", "src0"), (8, "one two", None, None), (None, prose(3, 70), None, None), (9, "\U0001f600 \x00 é́ ſ K", "fr", "src0"), (10, prose(4, 60) + '\ntoken = "abcdef123456"', "en", "src1"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "a", "b", 1, "c", 2) for i, t, lang, s in texts], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "http://a", None, "x"), (2, None, "", "x"), (3, "u v", "<p>" + "a b " * 100_000, "x"), (3, "u v", "<p>" + "a b " * 100_000, "x"), (None, "n", "<p>z", "x"), (4, "é\n", "<html><body><article><p>Hi&nbsp;there &amp; you</article>", "x")],
        "page_id long, url string, html string, digest string",
    )


def test_rows_stay(spark, odd, none):
    docs = odd.count()
    for fn in (
        quality_rules.quality_rules, secrets.secret_spans, lambda d: pieces.round_trip(d, tokenizer_path()), lambda d: quality_model.score_quality(d, None), lambda d: language.identify(d, None),
        simhash.near_duplicate_query, lambda d: pieces.encoded(d, tokenizer_path()), secrets.redact,
    ):
        assert fn(odd).count() == docs
        assert fn(none).count() == 0


def test_rules_of_empty_texts(odd):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    for i in (1, 2, 3):
        assert rows[i]["base_failed"] and not rows[i]["kept"] and rows[i]["n_words"] == 0
    assert rows[5]["kept"] and not rows[7]["kept"]
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_models_learn_from_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (4, 1, 0), (5, None, 0), (6, 0, 0), (7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(odd, labels)
    scores = [r["score"] for r in quality_model.score_quality(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert quality_model.fit(none, labels) is None and quality_model.fit(odd, labels.limit(0)) is None
    found = {r["doc_id"]: r for r in language.identify(odd, language.fit(odd)).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und"
    assert found[4]["lang_pred"] in ("en", "de", "fr")
    assert language.fit(none) is None


def test_duplicates_of_odd_rows(odd):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_query(odd).collect()]
    by_id = {i: (f, c) for i, f, c in rows}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert by_id[5] == by_id[6] and by_id[6][1] == 5
    kept = simhash.keep_one(odd)
    assert kept.columns[0] == "doc_id" and sorted(kept.columns) == sorted(odd.columns)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 5, 7, 8, 9, 10]


def test_archives_of_odd_pages(pages):
    rows = warc.warc_round_trip(pages).collect()
    assert len(rows) == 6
    empty = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] == 0)
    assert empty == [(1, "revisit", 2), (2, "response", None)]
    twice = sorted((r["record_type"], r["refers_to"]) for r in rows if r["page_id"] == 3)
    assert twice == [("response", None), ("revisit", 3)]
    assert all(r["record_type"] == "response" for r in warc.warc_round_trip(pages, least=1).filter("payload_bytes = 0").collect())
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_record_ids_and_urls(spark, pages, tmp_path):
    """Records of one page id have ids of their own, and every url comes back as it was."""
    spark.createDataFrame([(1, u, "<p>x", "x") for u in ("http://a/ü%20 b​", "http://a/%20", "", "a\nb", None)], pages.schema).write.parquet(f"{tmp_path}/urls")
    table = spark.read.parquet(f"{tmp_path}/urls")
    assert warc.scanned(table) and not warc.scanned(table.union(table))
    index = warc.write_archives(table)
    assert sorted(r["url"] for r in warc.read_records(index).collect()) == sorted(["http://a/ü%20 b​", "http://a/%20", "", "a\nb", ""])
    assert warc.record(1, (0, 0), "u", b"", "D", None) != warc.record(1, (0, 1), "u", b"", "D", None)
    raw = warc.record(2, (0, 0), "x​", b"", warc.digest_of(b""), None)
    assert b"Target-URI: x%E2%80%8B\r\n" in raw and warc.parse(raw)["url"] == "x​"


def test_samples_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"words of row {k} here", "en", "s", 1) for k in range(300)] + [(3, "x" * 40_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality_model.train
    quality_model.train = lambda texts, of, settings: seen.append(len(texts)) or real(texts, of, settings)
    try:
        quality_model.fit(docs, labels, settings=quality_model.Settings(rows=50))
        quality_model.fit(docs, labels)
    finally:
        quality_model.train = real
    assert seen == [50, 600]
    real = language.train
    language.train = lambda texts, langs, settings: seen.append(len(texts)) or real(texts, langs, settings)
    try:
        language.fit(docs, language.Settings(rows=40))
    finally:
        language.train = real
    assert seen[-1] == 40


def test_text_of_odd_pages(pages):
    rows = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert rows[1]["text"] == "" and rows[2]["n_chars"] == 0 and rows[4]["text"] == "Hi there & you" and rows[3]["n_chars"] == 4 * 100_000 - 1
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.mix_documents(odd, mixing.Mix(share=100, epochs=2)).collect()
    assert rows and all(r["n_tokens"] >= 0 for r in rows)
    assert mixing.mix_documents(none).count() == 0
    assert mixing.keep_mixed(odd, mixing.Mix(share=100, epochs=1)).columns == odd.columns


def test_mixing_takes_repeated_and_null_ids_one_by_one(spark):
    rows = [(7 if k % 2 else None, prose(k // 2, 15), "en", "src0", 1) for k in range(20)] + [(7, prose(99, 15), "en", "src0", 1)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for share in (10, 50, 90):
        mix = mixing.Mix(share=share, epochs=1)
        taken = mixing.mix_documents(docs, mix).count()
        assert taken == -(-(30 * 15 * share // 100) // 15)  # the last one starts within the budget
        assert mixing.keep_mixed(docs, mix).count() == taken


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (100, [0.9, 0.1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = [tuple(r) for r in ann.neighbours(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in found] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert found[0][3] == 0.0
    # a length of its own is a space of its own
    more = vectors.union(spark.createDataFrame([(200, [3.0], 1), (9, [2.0], 1), (10, [5.0], 1)], vectors.schema))
    assert [tuple(r) for r in ann.neighbours(more, F.col("vec_id") % 100 == 0).filter("query_id = 200").orderBy("rank").collect()] == [(200, 1, 9, 1.0), (200, 2, 8, 2.0), (200, 3, 10, 2.0)]
    assert ann.neighbours(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_of_odd_rows(spark, odd, none):
    for docs, want in ((odd, [{None, 5, 6, 9, 10}, {None, 5, 9, 10}]), (none, [set(), set()])):
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, "unused")
            ids = [r["doc_id"] for r in now.collect()]
            if k < 4:
                assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if k < 2:
                assert set(ids) - {9} == want[k] - {9}
            if k in (2, 4):
                assert len(ids) == before.count()
            if k == 2 and ids:
                assert "<assign>" in now.filter("doc_id = 10").first()["text"]
            if k == 3 and ids:
                words = lambda d: sum(len((r["text"] or "").split()) for r in d.collect())
                longest = max(len(r["text"].split()) for r in before.collect())
                assert words(now) <= 0.7 * words(before) + 8 * longest and set(ids) <= {r["doc_id"] for r in before.collect()}
