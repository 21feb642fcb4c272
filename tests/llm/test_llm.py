"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force or SQL beside each."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gistmill.llm import exact_dedup, jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, token_files, url_filters, warc
from gistmill.llm.common import work_dir
from tests.llm import brute
from tests.parity import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, locator string, n long, keep_id long, word_chars long"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["ta", "ro", "mi", "xe", "lu"]) + str(r.randrange(300)) for _ in range(n))


BASE = _words(1, 120)
TEXTS = [
    None, "", " ", "a", "\n\n", BASE, BASE, BASE + " tail", "head " + BASE, BASE.upper(), _words(2, 60) + "\n" + BASE[:300], "é" * 60 + BASE[100:400], "x" * 400, "x" * 130,
    "same line\nsame line\nsame line", _words(3, 4000), _words(3, 4000) + " more", "a b c", "A b C", "\x0b a\tb \x0c", "▁ ▁▁  x\0y 😀", _words(4, 70) + " ### $$$ " * 20,
]


def _docs(spark, texts=TEXTS):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], 1, "l", 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def _view(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con


def test_suffix_dedup(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(_docs(spark)).collect()}
    assert got == brute.repeated_bytes(list(enumerate(TEXTS)))
    assert suffix_dedup.repeated_bytes(_docs(spark, [])).count() == 0


def test_suffix_dedup_edits(spark):
    r = random.Random(9)
    texts = []
    for k in range(40):
        t = list(BASE)
        for _ in range(k % 7):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t[r.randrange(60) :]))
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.repeated_bytes(_docs(spark, texts)).collect()}
    assert got == brute.repeated_bytes(list(enumerate(texts)))


def test_sentencepiece_round_trip_and_best_path():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model()))
    for text in [t for t in TEXTS if t is not None]:
        assert codec.decode(codec.encode(text)) == text
    piece = {t: i for i, (t, ok) in enumerate(zip(codec.pieces.texts, codec.pieces.usable)) if ok}
    scores = codec.pieces.scores

    def best(unit):
        top = [(0.0, [])] + [None] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(j):
                if top[i] and unit[i:j] in piece and (top[j] is None or top[i][0] + scores[piece[unit[i:j]]] > top[j][0]):
                    top[j] = (top[i][0] + scores[piece[unit[i:j]]], top[i][1] + [piece[unit[i:j]]])
        return top[-1][0]

    for word in ["▁international", "▁the", "▁tokenizers", "▁aaaaab"]:
        assert abs(sum(scores[i] for i in codec.viterbi(word)) - best(word)) < 1e-9


def test_sentencepiece_query(spark):
    rows = sentencepiece_codec.encode_documents(_docs(spark), sentencepiece_codec.default_model()).collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(TEXTS)
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() for r in rows)


def test_quality_rules(spark):
    docs = _docs(spark, TEXTS + [_words(100 + i, 80) for i in range(250)])
    ours = sorted(map(tuple, quality_rules.quality_rules(docs).collect()), key=str)
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    theirs = sorted(_view(docs.select("doc_id", "text", "lang", "source")).sql(f"SELECT {names} FROM ({quality_rules.ORACLE_SQL})").fetchall(), key=str)
    assert ours == theirs
    assert quality_rules.quality_rules(_docs(spark, [])).count() == 0


def test_mixing(spark):
    docs = _docs(spark, TEXTS * 5)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(TEXTS) * 5
    assert all(r["size"] == len(brute.WORD.findall(TEXTS[r["doc_id"] % len(TEXTS)] or "")) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        sizes[r["source_key"]], targets[r["source_key"]] = r["source_size"], r["target"]
        taken[r["source_key"]] = taken.get(r["source_key"], 0) + r["taken"]
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    weights = dict(zip(sorted(sizes), [3, 1, 2, 3]))  # null last
    free = [s for s in sizes if targets[s] < 2 * sizes[s] - 1e-6]
    assert len({round(targets[s] / weights[s], 6) for s in free}) <= 1
    assert all(abs(taken[s] - targets[s]) <= 2100 for s in sizes)
    assert mixing.mixing_stage(docs).count() == sum(r["copies"] for r in rows) and mixing.mixing_stage(docs).columns == docs.columns
    assert mixing.mix(_docs(spark, [])).count() == 0


def test_pivotal_keeps_mass_and_means():
    r = random.Random(1)
    rows = [(10, 0.3), (20, 0.5), (10, 0.9), (40, 0.25), (0, 0.5), (5, 0.0)]
    total = [0] * len(rows)
    for _ in range(4000):
        out, held, p = mixing.pivotal(rows, r.random)
        if held is not None:
            out[held] = int(r.random() < p)
        total = [a + b for a, b in zip(total, out)]
    assert all(abs(t / 4000 - p) < 0.04 for t, (m, p) in zip(total, rows) if m)


def test_warc(spark):
    html = [None, "", "<p>short</p>", "x" * 150, "x" * 150, "é" * 60, "é" * 60, "y" * 99, "y" * 99]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://www.A{i % 3}.org/p?q={i}#f", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, locator string")
    got = sorted(map(tuple, warc.warc_round_trip(pages).collect()))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == sorted(con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall())
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_capture_index_is_globally_ordered(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(3)
    index = warc.merge_index(warc.write_archives(pages, work_dir(spark, "warc"), archive_bytes=20_000), range_entries=9).collect()
    keys = [(r["url_key"], r["ts"]) for r in index]
    assert keys == sorted(keys) and len({r["archive"] for r in index}) > 3


def test_loser_tree():
    r = random.Random(2)
    for k in range(9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_classifier(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "", " ", "\n\n")}) == 1
    assert quality_classifier.fit(docs, labels.where("quality = 1")).weight.sum() == 0
    assert quality_classifier.classify_stage(docs, labels).columns == docs.columns
    held = {r[0]: r[1] for r in docs.select("doc_id", quality_classifier.held_out(F.col("doc_id"))).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in held)


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality_classifier.op6_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) / len(scored) > 0.9


@pytest.mark.parametrize("url,rule,verdict", [
    ("http://a.example.org/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"),
    ("http://x.com/de/", "com/de/", "block"), ("HTTP://X.COM/fr/a", "com/fr/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://example.org", None, "allow"), ("nothing", None, "allow"),
])
def test_url_filter(spark, url, rule, verdict):
    row = url_filters.url_filter(spark.createDataFrame([(1, url)], "page_id long, url string"), url_filters.RULES).first()
    assert (row["rule"], row["verdict"]) == (rule, verdict)


def _token_rows(spark, rows, **setting):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, base long")
    parts = token_files.write_tokens(docs, work_dir(spark, "tokens"), definition, end_id=2, vocab_size=50_257, **setting)
    return parts, [tuple(r) for r in token_files.read_tokens(parts).collect()]


def test_token_files(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    alphabet = ["a", "B", "7", " ", " ", "\n", "\n", "\t", "\r", ".", ",", "'s", "'", "!?", "é", "漢", "あ", "\u00a0", "\u3000", "\u2028", "\u1680", "\x1c", "\x85", "…", "😀", "<|endoftext|>", "-", "\x0b"]
    texts = TEXTS + ["a <|endoftext|> b", "  two  spaces ", "x\n\n y", "it's we'll\tgo"] + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    parts, rows = _token_rows(spark, list(enumerate(texts)), part_bytes=3000)
    got, start = {r[0]: r[1:] for r in rows}, 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert parts.count() > 1
    bases = [(r["part"], r["base"]) for r in parts.orderBy("part").collect()]
    again = token_files.with_bases(parts.drop("base"), group=2)
    assert bases == [(r["part"], r["base"]) for r in again.orderBy("part").collect()]


def test_token_files_of_odd_tables(spark):
    assert _token_rows(spark, [])[1] == []
    rows = [(5, "b"), (None, "x"), (5, "a"), (5, None), (5, "a"), (None, None)]
    parts, got = _token_rows(spark, rows)
    assert sorted(str(r[0]) for r in got) == ["5", "5", "5", "5", "None", "None"] and sorted(r[1] for r in got if r[0] is None) == [0, 1]
    assert sorted(r[1] for r in got) == [0, 1, 3, 4, 6, 8] and sum(r[2] for r in got) == 10
    assert len({r[3] for r in got if r[2] == 1}) == 1


def test_encoder_starts_afresh(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read(), 2, "<u2")
    for k in range(5):
        texts = [_words(k, 40), None, "", _words(k + 1, 40)]
        ids, bounds = encoder(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_exact_dedup_with_colliding_digests(spark):
    docs = _docs(spark, TEXTS + TEXTS)
    want = {}
    for i, t in enumerate(TEXTS + TEXTS):
        want.setdefault(t or "", []).append(i)
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)):
        for limit in (0, 1000):
            rows = exact_dedup.exact_dedup(docs, digest=digest, broadcast_rows=limit).collect()
            assert len(rows) == 2 * len(TEXTS)
            for r in rows:
                group = want[(TEXTS + TEXTS)[r["doc_id"]] or ""]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
    assert exact_dedup.dedup_stage(docs).columns == docs.columns


def test_exact_dedup_remembers_earlier_arrivals(spark):
    deduper = exact_dedup.StreamingDeduper(spark, files_per_batch=1)
    exact_dedup.exact_dedup(_docs(spark, ["a", "b", "a"]).repartition(3), deduper=deduper)
    rows = exact_dedup.exact_dedup(_docs(spark, ["c", "a"]), deduper=deduper).collect()
    assert max(r["group_size"] for r in rows) == 3 and sum(r["kept"] for r in rows) == 3


def test_late_collision_is_split_by_earlier_bytes(spark):
    one = lambda c: F.lit("same")
    deduper = exact_dedup.StreamingDeduper(spark)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.exact_dedup(docs([(1, "first")]), digest=one, deduper=deduper)
    exact_dedup.exact_dedup(docs([(2, "second"), (3, "first")]), digest=one, deduper=deduper)
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs([(4, None), (5, "second")]), digest=one, deduper=deduper).collect()}
    assert rows == {1: (3, 2, False), 3: (3, 2, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True)}


def test_dedup_stage_keeps_rows(spark, tmp_path):
    rows = [(1, "a", "x", "x1"), (2, "a", "y", "x2"), (3, None, "z", "x3"), (None, "", "w", "x4"), (4, "b", "v", "x5"), (None, "c", "u", "x6")]
    schema = "doc_id long, text string, locator string, _gone string"
    memory = spark.createDataFrame(rows, schema)
    for i in (0, 1):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], schema).write.parquet(f"file://{tmp_path}/{i}")
    union = spark.read.parquet(f"file://{tmp_path}/0").union(spark.read.parquet(f"file://{tmp_path}/1"))
    want = sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
    for docs in (memory, union, spark.read.parquet(f"file://{tmp_path}/0", f"file://{tmp_path}/1")):
        kept = exact_dedup.dedup_stage(docs)
        assert kept.columns == docs.columns and sorted(str(tuple(r)) for r in kept.collect()) == want
    assert exact_dedup.dedup_stage(memory.limit(0)).count() == 0 and exact_dedup.exact_dedup(memory.limit(0)).count() == 0
    ties = spark.createDataFrame([(7, "t"), (7, "t"), (7, "u"), (None, "t")], "doc_id long, text string")
    assert sorted((r["text_sha256"][:4], r["kept"]) for r in exact_dedup.exact_dedup(ties).collect()).count((hashlib.sha256(b"t").hexdigest()[:4], True)) == 1


def test_jaccard_join(spark):
    r = random.Random(5)
    texts = list(TEXTS)
    for k in range(60):
        w = BASE.split()
        for _ in range(k % 6):
            w[r.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    got = {x["doc_id"]: tuple(x)[1:] for x in jaccard_join.jaccard_components(_docs(spark, texts)).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)))
    assert jaccard_join.near_dedup_stage(_docs(spark, texts)).count() == len({c if n else d for d, (n, c) in got.items()})


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_warc", "op7_url_filters", "op9_exact_dedup"])
def test_same_as_sql(spark, name):
    from gistmill.llm import queries

    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["round_trip"] for r in rows)


def test_encoding_is_returned(spark):
    import corpus_pipeline

    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model()))
    for found in (corpus_pipeline.encode(spark, _docs(spark), SF), sentencepiece_codec.op2_sentencepiece(spark, SF).limit(20)):
        for r in found.collect():
            assert codec.decode(r["ids"]) == r["decoded"] and len(r["ids"]) == r["n_tokens"] and r["round_trip"]
    assert [r["decoded"] for r in corpus_pipeline.encode(spark, _docs(spark), SF).orderBy("doc_id").collect()] == [t or "" for t in TEXTS]


def test_classifier_learns_from_all_features(spark):
    import numpy as np
    import pyarrow as pa

    text = _words(6, 9000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "label", "text"])
    row = next(quality_classifier._count_features(iter([batch]))).to_pylist()[0]
    ids, share = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["share"], "<f4")
    _, index, words = quality_classifier.split_words(pa.array([text]))
    own, _, hashes = quality_classifier.word_features(words)
    assert len(ids) > 4000 and set(ids.tolist()) == {*own.tolist(), *quality_classifier._pairs(hashes[index]).tolist()}
    assert abs(share.sum() - 1) < 1e-3
    rows = quality_classifier.FeatureFile([(2, 0, row["ids"][:8], row["share"][:8]), (1, 1, row["ids"], row["share"])])
    assert (len(rows), rows.longest, rows.labels) == (2, len(ids), [1, 0])
    assert rows[0][0] == 1 and (rows[0][1] == ids).all() and (rows[0][2] == share).all() and (rows[1][1] == ids[:2]).all()
    rows.close()
