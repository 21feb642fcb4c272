"""Word and shingle hashing, and the sketches, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import jaccard_join as J
from tests.llm import brute


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_token_sets(monkeypatch, block):
    monkeypatch.setattr(J, "HASH_BYTES", block)
    draw, seen = random.Random(7), {}
    for _ in range(200):
        texts = [None if draw.random() < 0.1 else "".join(draw.choice("aAbBzÉé \t\n\x0b\xa0漢") for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(0, 9))]
        for text, tokens in zip(texts, J.token_sets(pa.array(["x y", *texts], pa.string()).slice(1)), strict=True):
            assert len(tokens) == len(_shingles(text)) and (np.diff(tokens.astype(object)) > 0).all()
            assert seen.setdefault(_shingles(text), tokens.tobytes()) == tokens.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 2**63, 9000).astype("u8")
    for n, m in [(0, 0), (5, 6), (1000, 1100), (1024, 1025), (4000, 4500), (8000, 4100)]:
        x, y = np.sort(pool[:n]), np.sort(pool[n // 10 : n // 10 + m])
        assert np.bitwise_count((J.sketch(x) ^ J.sketch(y)).view("u8")).sum() <= len(np.setxor1d(x, y))


def test_stage_takes_five_words_at_80_percent(spark):
    draw, n = random.Random(5), 1200
    base = [f"w{draw.randrange(10**6)}" for _ in range(n)]
    longer, unlike = base + [f"y{i}" for i in range(240)], base[: n // 2] + [f"z{i}" for i in range(n // 2)]
    near = list(base)
    for i in range(20, n, 46):  # 26 single words: 4-word similarity under 0.85, 5-word at 0.80 or more
        near[i] = f"v{i}"
    rows = [(i, " ".join(t)) for i, t in enumerate([base, longer, near, unlike])]

    def similarity(a, b, k):
        x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    assert 0.80 <= similarity(base, longer, 5) < 0.85 and 0.80 <= similarity(base, near, 5) and similarity(base, near, 4) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]
    assert {r["component_id"] for r in J.jaccard_components(docs).where("doc_id IN (1, 2)").collect()} == {1, 2}  # op10's own values


@pytest.mark.parametrize("percent", [80, 85, 50, 99])
def test_combinations_lose_no_link(percent):
    """Linked sets that share no rare token meet under a budget that admits the pair."""
    draw = np.random.default_rng(percent)
    met = 0
    for n in (1, 2, 7, 12, 63, 64, 300, 900):
        for _ in range(60):
            pool = np.unique(draw.integers(0, 2**63, 4 * n + 4).astype("u8"))
            draw.shuffle(pool)
            common, spare = pool[:n], pool[n:]
            room = J.differ(2 * n, percent)
            a, b, c, d = (int(draw.integers(0, max(1, room // 2) + 1)) for _ in range(4))
            cut, frequent_x, frequent_y = min(a, n - 1), spare[:b], spare[b : b + c]
            x, y = np.concatenate([common, frequent_x]), np.concatenate([common[cut:], frequent_y])
            rare_x, rare_y = int(draw.integers(0, d + 1)), int(draw.integers(0, d + 1))  # rare tokens of each, none shared
            m, k = len(x) + rare_x, len(y) + rare_y
            both = n - cut
            if 100 * both < percent * (m + k - both):
                continue
            met += 1
            budget = J.differ(m + k, percent) - rare_x - rare_y
            shared = set(J.combinations(np.sort(x), m, percent)) & set(J.combinations(np.sort(y), k, percent))
            assert any(s // 2 < budget <= s or s == budget == 0 for _, s in shared)
    assert met > 50


def _edited(draw, base, k, tag):
    words = list(base)
    for i in draw.sample(range(len(words)), k):
        words[i] = f"{tag}{i}"
    return " ".join(words)


def _groups(seed):
    """Copies of a few texts with few and many edits, texts made of shared passages, unlike texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**6)}"
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts = [" ".join(draw.sample(passages, draw.randint(1, 5))) for _ in range(40)]
    for _ in range(3):
        base = [word() for _ in range(draw.randint(20, 160))]
        texts += [_edited(draw, base, draw.randint(0, max(1, len(base) // 12)), f"e{j % 7}x") for j in range(45)]
    texts += [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(30)] + [passages[0] + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_copies_against_brute_force(spark, seed):
    rows = list(enumerate(_groups(seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in J.jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(rows)
    index = J.index(docs, spark.sparkContext.broadcast(J.bitmaps(docs, 10**5)))
    short = index.where("tokens IS NOT NULL").select("key", F.col("doc_id").alias("node"), "tokens")
    assert J.combination_postings(J.shared_tokens(short, 10**4)).where("budget >= 0").count()  # frequent tokens are indexed in combinations


@pytest.mark.parametrize(
    "texts",
    [["a b c d e"], ["a b c d e"] * 2, ["a b c d e", "f g h i j", "k l m n o"], [None], [None, "", " \n"], ["x"], ["x", "x y", "X"], []],
)
@pytest.mark.parametrize("parts", [1, 4])
def test_small_tables(spark, texts, parts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    assert got == brute.jaccard_components(rows)


def test_one_row_a_partition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(30)
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in J.jaccard_components(docs.repartition(30)).collect()}
    assert got == brute.jaccard_components(rows)


def test_repeated_and_null_doc_ids(spark):
    a, b = _edited(random.Random(1), "a b c d e f g h i j".split(), 0, ""), " ".join(f"q{i}" for i in range(40))
    rows = [(5, a), (3, a), (5, b), (9, b), (9, b), (None, b), (None, None), (None, "alone here"), (7, "z")]
    got = sorted((str(tuple(r)) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == sorted(map(str, [(5, 3), (3, 3), (5, 3), (9, 3), (9, 3), (None, 3), (None, None), (None, None), (7, 7)]))
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, n int, node int")
    kept = J.near_dedup_stage(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "None", "None", "None"]


def test_texts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_BROADCAST_IDS", 0)
    rows = list(enumerate(_groups(7)))
    got = {r["doc_id"]: tuple(r)[1:] for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize("held", [1, 10**6])
def test_components_of_chains_and_stars(spark, monkeypatch, held):
    monkeypatch.setattr(J, "CONTRACTED", held)
    draw = random.Random(held)
    order = list(range(300))
    draw.shuffle(order)
    edges = [*zip(order[:100], order[1:101]), *((order[150], x) for x in order[151:200]), (7, 7)]
    got = dict(tuple(r) for r in J.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    want = {x: min(order[:101]) for x in order[:101]} | {x: min(order[150:200]) for x in order[150:200]}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) - set(want) <= {7}
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0
