"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, each with its stated result."""

import hashlib
import math
import random
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import common, mixing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, url_filters, warc
from tests.llm import brute

CLASH = "key string, row string, size string, source_key string, copies int, _key string, _size int, _ string, locator string, id int, words int, part int, node int, n int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def _docs(spark, rows):
    rest = ("k", "r", "s", "0s", 9, "_k", 7, "_", "l", 1, 2, 3, 4, 5)
    return spark.createDataFrame([(*r, *rest) for r in rows], DOCS)


def _text(seed, n):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(5000)}" for _ in range(n))


LONG = _text(1, 60_000)


def test_suffix_dedup_nulls_repeats_and_long_texts(spark):
    rows = [(None, LONG[:400]), (3, LONG), (3, LONG), (4, LONG[100:300] + "#" + LONG[1000:1400]), (None, None), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeated_bytes(docs).collect())
    size = len(LONG)
    assert got == sorted([("None", 400, 0, 0), ("None", 0, 0, 0), ("3", size, 0, 0), ("3", size, 0, 0), ("4", 601, 600, 2), ("5", 5, 0, 0)])


def test_suffix_dedup_of_a_passage_in_a_third_of_all_texts(spark):
    passage = _text(5, 30)
    rows = [(i, (_text(10 + i, 12) + " " + passage * (i % 3 == 0) + _text(900 + i, 9 + i % 4))) for i in range(300)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.repeated_bytes(rows)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model()))


def test_codec_spells_markers_whatever_else_a_text_holds(codec):
    for text in ["▁" + "".join(map(chr, range(0xE000, 0xF900))), "▁", " ▁ ", "a▁b c▁▁ d", "▁ x", "x▁", LONG[:50_000] + "▁" + "é" * 3000]:
        assert codec.decode(codec.encode(text)) == text


def test_codec_finds_the_best_path_of_whole_texts(codec):
    usable = {t: s for t, s, ok in zip(codec.pieces.texts, codec.pieces.scores, codec.pieces.usable) if ok}
    longest = max(map(len, usable))

    def best(text):
        marked = "▁" + text.replace(" ", "▁")
        top = [0.0] + [-math.inf] * len(marked)
        for j in range(1, len(marked) + 1):
            for i in range(max(0, j - longest), j):
                top[j] = max(top[j], top[i] + usable.get(marked[i:j], -math.inf))
            if marked[j - 1] not in usable:
                top[j] = max(top[j], top[j - 1] + codec.unknown)
        return top[-1]

    spelled = set(codec.pieces.byte_ids)

    def score(text):
        ids, total, i = codec.encode(text), 0.0, 0
        while i < len(ids):
            if ids[i] in spelled:  # the bytes of one character
                lead = codec.pieces.byte_ids.index(ids[i])
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += codec.unknown
            else:
                total += codec.pieces.scores[ids[i]]
                i += 1
        return total

    draw = random.Random(3)
    chars = ["e", "t", "a", "n", "th", "ing", " ", "  ", "é", "漢", "😀", "\n", "#", "zz", "0"]
    for text in ["", "a", " ", "the tokenizers", *("".join(draw.choice(chars) for _ in range(draw.randint(1, 30))) for _ in range(150))]:
        assert score(text) == pytest.approx(best(text) if text else 0.0)


def test_units_side_by_side_are_solved_like_single_ones(codec, monkeypatch):
    draw = random.Random(8)
    units = [" " * draw.randint(0, 3) + "".join(draw.choice(["e", "th", "ing", "é", "漢", "😀", "#", "zq", "\n", "0", "\0"]) for _ in range(draw.randint(1, 20))) for _ in range(400)]
    for wide, rows in ((64, 20_000), (12, 7)):
        monkeypatch.setattr(sentencepiece_codec, "WIDE", wide)
        monkeypatch.setattr(sentencepiece_codec, "ROWS", rows)
        ids, count = codec._solve(units)
        assert ids.tolist() == [x for u in units for x in codec.viterbi(u)] and count.tolist() == [len(codec.viterbi(u)) for u in units]


def test_batches_are_encoded_like_single_texts(codec):
    import pyarrow as pa

    texts = ["a b", None, "", "▁", "x ▁ y", " ", "  two  ", LONG[:900], "▁▁", "end"]
    ids, bounds = codec.encode_all(pa.array(["skipped", *texts]).slice(1))
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])] == [codec.encode(t or "") for t in texts]
    assert codec.decode_all(ids, bounds).to_pylist() == [t or "" for t in texts]


def test_codec_query_of_odd_tables(spark, codec):
    docs = _docs(spark, [(None, "a b", None, None, 1), (2, None, "x", "y", 1), (2, None, "x", "y", 1), (3, LONG, "x", "y", 1)])
    rows = sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), with_text=True).collect()
    assert sorted((str(r["doc_id"]), len(r["decoded"])) for r in rows) == [("2", 0), ("2", 0), ("3", len(LONG)), ("None", 3)] and all(r["round_trip"] for r in rows)
    assert sentencepiece_codec.encode_documents(docs.limit(0), sentencepiece_codec.default_model()).count() == 0


def test_quality_rules_of_long_and_odd_rows(spark):
    twice = _text(2, 300) + " " + LONG + " " + _text(2, 300)
    docs = _docs(spark, [(None, "x y", None, None, 1), (7, twice, "en", "a", 1), (7, twice, "en", "a", 1), (8, "a b c " * 70_000, None, "a", 1), (9, None, None, None, 1)])
    rows = {str(r["doc_id"]): r for r in quality_rules.quality_rules(docs).collect()}
    assert rows["7"]["n_words"] == 60_600 and rows["7"]["n_repeat_words"] >= 600 and rows["8"]["n_repeat_words"] == 210_000
    assert rows["8"]["base_failed"] and rows["None"]["n_words"] == 2 and not rows["9"]["kept"] and quality_rules.quality_rules(docs).count() == 5


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water-filling, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= cap * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets_against_rounds_and_taken_near_them(spark, seed):
    draw = random.Random(seed)
    names = [None, "b", "a", "é", "C", "hot"][: 3 + seed]
    rows = [(i, _text(i, draw.randint(0, 30)), "en", "hot" if "hot" in names and i % 2 else draw.choice(names), 1) for i in range(400)]
    sizes, longest = {}, 0
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
        longest = max(longest, len(text.split()))
    want = _targets(sizes)
    found = mixing.mix(_docs(spark, rows)).collect()
    taken = {}
    for r in found:
        source = rows[r["doc_id"]][3]
        assert r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source] and r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= longest for s in want)


def test_mixing_stage_with_clashing_columns(spark):
    docs = _docs(spark, [(i, _text(i, 9), "en", [None, "s"][i % 2], 1) for i in range(60)] + [(None, None, None, None, 1)])
    kept = mixing.mixing_stage(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and all((r["_key"], r["size"], r["copies"], r["_"]) == ("_k", "s", 9, "_") for r in rows)
    assert len(rows) == sum(r["copies"] for r in mixing.mix(docs).collect()) and mixing.mixing_stage(docs.limit(0)).count() == 0


def test_warc_of_odd_rows(spark):
    long = "<p>" + LONG + "</p>"
    rows = [(None, "http://a.org/", long), (None, None, None), (4, "http://a.org/", long), (4, "http://a.org/", long), (2, "x\r\ny", "z" * 100), (9, "http://b.org", "z" * 100)]
    pages = spark.createDataFrame([(*r, "l", 1) for r in rows], "page_id long, url string, html string, locator string, offset int")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.warc_round_trip(pages).collect())
    n = len(long)
    assert got == sorted([("None", n, "response", "None"), ("None", 0, "response", "None"), ("4", n, "revisit", "None"), ("4", n, "revisit", "None"), ("2", 100, "response", "None"), ("9", 100, "revisit", "2")])
    twice = warc.warc_round_trip(spark.createDataFrame([(4, "u", long), (4, "u", long)], "page_id long, url string, html string")).collect()
    assert sorted((r["record_type"], str(r["refers_to"])) for r in twice) == [("response", "None"), ("revisit", "4")]


def test_captures_are_read_at_their_places(spark):
    from gistmill.llm.common import work_dir

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(3)
    index = warc.merge_index(warc.write_archives(pages, work_dir(spark, "warc"), archive_bytes=20_000), range_entries=9)
    some = index.where("page_id % 7 = 0")
    got = {r["page_id"] for r in warc.read_captures(some, block_bytes=1000).collect()}
    assert got == {r["page_id"] for r in some.collect()} and len(got) > 3


def test_classifier_of_odd_tables(spark):
    docs = _docs(spark, [(i, LONG if i == 5 else _text(i, 20) + (" good" if i % 2 else " bad"), "en", "a", 1) for i in range(40)] + [(5, LONG, "de", "b", 1), (None, "x", None, None, 1)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (6, None), (5, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    scores = [(r["doc_id"], r["score"]) for r in quality_classifier.score(docs.select("doc_id", "text"), model).collect()]
    assert len(scores) == 42 and len({s for d, s in scores if d == 5}) == 1 and all(0 <= s <= 1 for _, s in scores)
    assert quality_classifier.classify_stage(docs, labels).columns == docs.columns
    assert quality_classifier.score(docs.limit(0).select("doc_id", "text"), model).count() == 0
    for empty in (quality_classifier.fit(docs.limit(0), labels), quality_classifier.fit(docs, labels.limit(0))):
        assert all(r["score"] == pytest.approx(0.5) for r in quality_classifier.score(docs.select("doc_id", "text"), empty).collect())


def test_url_filter_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "h", "r"), (1, None, "h", "r"), (None, "http://x.org/a", "h", "r"), (2, "http://x.org/a", "h", "r")], "page_id long, url string, host string, rule string")
    rows = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in url_filters.url_filter(pages, [("allow", "x.org", "/a"), ("block", "x.org", "/a")]).collect())
    assert rows == [("1", "", "", "None", "allow")] * 2 + [("2", "x.org", "/a", "x.org/a", "block"), ("None", "x.org", "/a", "x.org/a", "block")]
    assert url_filters.url_filter(pages.limit(0), []).count() == 0


def _tables(spark, folder, rows, labels):
    _docs(spark, rows).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version of its decision; nulls, blank and long texts, copies, clashing columns."""
    texts = [_text(i, 60) for i in range(30)]
    texts += [texts[0]] * 5 + [texts[1] + " tail", "", None, " \n", LONG] + [texts[2].replace("a", "A")]
    rows = [(i, t, [None, "en"][i % 2], [None, "a", "b"][i % 3], 1) for i, t in enumerate(texts)]
    sf = _tables(spark, tmp_path, rows, [(i, 1) for i in range(30)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        after = spark.createDataFrame(after.collect(), after.schema)  # what the next stage gets
        if name != "sentencepiece":
            assert after.columns == docs.columns and all((r["_key"], r["size"]) == ("_k", "s") for r in after.collect())
        seen[name], before = after, after
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].collect())
    assert ids("quality_classifier") == list(range(len(rows)))  # only good labels: nothing is rejected
    last = {}
    for i, t in enumerate(texts):
        last[t or ""] = i
    assert ids("exact_dedup") == sorted(last.values())
    parts = brute.jaccard_components([(i, texts[i]) for i in ids("exact_dedup")], percent=80, shingle=5)
    assert ids("jaccard_join") == sorted({c for n, c in parts.values() if n} | {i for i, (n, _) in parts.items() if not n})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["jaccard_join"]).collect()}
    assert ids("mixing") == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted((r["doc_id"], r["decoded"]) for r in seen["sentencepiece"].collect()) == sorted((i, texts[i] or "") for i in ids("mixing"))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_digest_column_is_of_the_whole_text(spark):
    row = sentencepiece_codec.encode_documents(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), sentencepiece_codec.default_model()).first()
    assert row["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_suffix_ranks_against_sorted_suffixes():
    r = np.random.default_rng(1)
    for _ in range(400):
        s = r.integers(1, int(r.integers(2, 5)), int(r.integers(0, 40)))
        want = np.empty(len(s), int)
        want[sorted(range(len(s)), key=lambda i: tuple(s[i:]))] = range(len(s))
        assert suffix_dedup.suffix_ranks(s).tolist() == want.tolist()


def test_shared_windows_against_a_table_of_windows():
    r = np.random.default_rng(2)
    base = bytes(r.integers(97, 100, 300).astype("u1"))
    for _ in range(40):
        rows = []
        for _ in range(12):
            count, at = int(r.integers(1, 36)), int(r.integers(0, 200))
            x = bytearray(base[at : at + count + suffix_dedup.LENGTH - 1])
            if r.random() < 0.5:
                x[int(r.integers(0, len(x)))] = 65
            rows.append((int(r.integers(0, 6)), count, bytes(x)))
        least: dict[bytes, int] = {}
        for doc, count, x in rows:
            for i in range(count):
                w = x[i : i + suffix_dedup.LENGTH]
                least[w] = min(least.get(w, doc), doc)
        want = {(f, i) for f, (doc, count, x) in enumerate(rows) for i in range(count) if least[x[i : i + suffix_dedup.LENGTH]] < doc}
        data = np.frombuffer(b"".join(x for *_, x in rows), "u1")
        got = suffix_dedup.shared_windows(data, np.array([d for d, *_ in rows]), np.array([c for _, c, _ in rows]))
        assert set(zip(*(v.tolist() for v in got), strict=True)) == want


def test_blocks_of_suffix_dedup_leave_no_shuffle_files(spark):
    docs = spark.createDataFrame([(k, f"{k} " + "a passage that all of these documents share, " * 3) for k in range(40)], "doc_id long, text string")
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # what other tests have left may go first
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = str(held.keySet())
    ranges = suffix_dedup.block_ranges(docs, 4)
    until = time.time() + 5
    while str(held.keySet()) != before and time.time() < until:
        time.sleep(0.1)
    assert str(held.keySet()) == before
    assert ranges.where(f"kind = {suffix_dedup.REPEATED}").select("doc_id").distinct().count() == 39
    assert spark.conf.get(common.CLEANUP) == "false"


def test_stages_give_back_what_ended_jobs_hold(spark):
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    common.release_memory(spark)
    time.sleep(1)
    before = held.size()
    spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().collect()
    assert held.size() > before
    docs = spark.createDataFrame([(k, f"text {k}", "en", "web", 6) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    out = corpus_pipeline.lean(lambda spark, docs, sf_dir: seen.append(sf_dir) or docs)(spark, docs, "here")
    until = time.time() + 5
    while held.size() > before and time.time() < until:
        common.release_memory(spark)  # a busy thread can hold the plan for longer
    assert held.size() <= before
    assert out is docs and seen == ["here"]
    assert all(stage.__name__ == "run_lean" for _, stage in corpus_pipeline.STAGES)


def test_freed_native_memory_is_returned(spark):
    said = common.trim_native(spark)
    assert said.startswith("Trim native heap") or not shutil.which("jcmd")  # other JVMs have no such command
