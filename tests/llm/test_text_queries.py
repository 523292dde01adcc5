"""Text queries against their SQL, against brute force and on odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import TABLES, compare, connect
from slowlens.llm import catalog, contamination, language, lines, mixing, ngram_join, pages, paragraphs, quality, shards
from slowlens.llm.common import same_components
from slowlens.llm.hashing import CHUNK, shingle_set, word_hashes

catalog.load()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def odd_rows() -> list[dict]:
    base = prose(1, 120)
    texts = [
        None,
        "",
        " \n\t \x0b",
        prose(2, 30_000),
        base,
        base,
        base.replace(" ", "  ", 1).replace("a", "A", 3),
        prose(3, 60) + " " + ITEM + " " + prose(4, 60),
        "one two three",
        "One two, three!",
        "home | about | news | shop | help | terms\n" * 9,
        "!!! ### $$$ word " * 30,
        "É à ü ß 漢字 テスト " * 20 + "GNU General Public License, mit license Apache LICENSE cc-by",
        "x" * 200_000,
        "the " * 400,
        prose(5, 80) + "\nSubscribe to our newsletter.\n" + prose(6, 10),
        "alpha beta",
        "12 34 56 !!",
    ]
    return [
        {
            "doc_id": None if i is None else i,
            "text": t,
            "lang": [None, "en", "fr"][i % 3],
            "source": [None, "a", "b", "é"][i % 4],
            "n_chars": None if t is None else len(t),
            "words": "clash",
            "k1": 5,
            "size": -1,
            "path": None,
            "quality": 0.5,
            "start": i,
        }
        for i, t in enumerate(texts)
    ]


def write_tables(path, documents, benchmark, page_rows, embeddings):
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    types |= {"words": pa.string(), "k1": pa.int64(), "size": pa.int64(), "path": pa.string(), "quality": pa.float64(), "start": pa.int64()}
    pq.write_table(pa.Table.from_pylist(documents, pa.schema(types.items())), path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(benchmark, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), path / "benchmark.parquet")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())])
    pq.write_table(pa.Table.from_pylist(page_rows, schema), path / "pages.parquet")
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("node", pa.string())])
    pq.write_table(pa.Table.from_pylist(embeddings, schema), path / "embeddings.parquet")
    for name in set(TABLES) - {"documents", "benchmark", "pages", "embeddings"}:
        pq.write_table(pa.table({"none": pa.array([], pa.int64())}), path / f"{name}.parquet")
    return str(path)


BENCHMARK = [
    {"item_id": 1, "text": ITEM},
    {"item_id": 10, "text": "one two three"},
    {"item_id": 2, "text": "ALPHA, beta"},
    {"item_id": 3, "text": None},
    {"item_id": 4, "text": "--- !!"},
    {"item_id": 1, "text": ITEM},
]
PAGES = [
    {"page_id": 1, "url": "http://a.example/x", "html": None, "host": "clash"},
    {"page_id": None, "url": None, "html": "<p>a &amp; b<p>c", "host": None},
    {"page_id": 2, "url": "", "html": "", "host": ""},
]
VECTORS = [
    {"vec_id": i, "embedding": v, "label": None, "node": "clash"}
    for i, v in [
        (1, [1.0, 0.0, 0.5]),
        (2, [1.0, 0.1, 0.5]),
        (3, [-1.0, 2.0, 0.0]),
        (3, [-1.0, 2.0, 0.0]),
        (None, [2.0, 0.0, 1.0]),
        (5, None),
        (6, []),
        (7, [0.0, 0.0, 0.0]),
        (8, [float("nan"), 1.0, 0.0]),
        (9, [None, 1.0, 0.0]),
        (10, [1.0, 0.0]),
    ]
]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("odd"), odd_rows(), BENCHMARK, PAGES, VECTORS)


@pytest.fixture(scope="module")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("none"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf_dir, odd_dir, name):
    for tables in (sf_dir, odd_dir):
        left, _, differences = compare(spark, connect(tables), catalog.QUERIES[name], catalog.ORACLES[name], tables)
        assert not differences
        assert left


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert catalog.QUERIES[name](spark, empty_dir).count() == 0


def test_null_and_repeated_ids_keep_all_rows(spark, odd_dir, tmp_path):
    rows = odd_rows()
    rows += [dict(r) for r in rows[3:9]] + [dict(r, doc_id=None) for r in rows[:8]]
    tables = write_tables(tmp_path, rows, BENCHMARK, PAGES * 2, VECTORS * 2)
    by = {"op8_site_templates": len(PAGES) * 2, "op11_nn_descent": len(VECTORS) * 2, "op13_polarised_whitening": 16 * 3}
    for name in sorted(set(catalog.QUERIES) - {"pipeline", "op1_paragraph_minhash", "op12_stratified_search"}):
        assert catalog.QUERIES[name](spark, tables).count() == by.get(name, len(rows)), name
    for name in ("op11_nn_descent", "op12_stratified_search"):
        left, _, differences = compare(spark, connect(tables), catalog.QUERIES[name], catalog.ORACLES[name], tables)
        assert left and not differences
    assert catalog.QUERIES["op1_paragraph_minhash"](spark, tables).count() > 0
    assert catalog.QUERIES["pipeline"](spark, tables).count() > 0


def test_word_hashes_follow_the_words():
    text = prose(9, 40_000) + " É" + "y" * (2 * CHUNK) + " Tail tail"
    words, hashes = WORD.findall(text.lower()), word_hashes(text.encode())
    assert len(hashes) >= len(words)
    assert hashes[-1] == hashes[-2] == word_hashes(b"TAIL")[0]
    short = WORD.findall("A b-c, a 9Z\té")
    assert len(set(word_hashes("A b-c, a 9Z\té".encode()).tolist())) == len({w.lower() for w in short})


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 100), (300, 301)]
    got = {r["node"]: r["root"] for r in same_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert set(got.values()) == {0, 300}
    assert len(got) == 66


def test_shuffled_winnowing_equals_broadcast(spark, odd_dir):
    docs, items = spark.read.parquet(f"{odd_dir}/documents.parquet"), spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    rows = [
        sorted(map(str, contamination.contamination(docs, items, limit).select("doc_id", "contamination").collect())) for limit in (0, 10**6)
    ]
    assert rows[0] == rows[1]


def near_texts():
    r = random.Random(5)
    texts = [prose(100 + i, r.randint(4, 260)) for i in range(150)]
    base = prose(7, 150).split()
    for _ in range(120):  # a group of near copies
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts + texts[:20] + ["", "a b", "a b", "A  b"]


def brute_links(texts):
    sets = {t: shingle_set(t.encode()) for t in set(texts)}
    links = defaultdict(set)
    for t, a in sets.items():
        for u, b in sets.items():
            if t != u and len(a) and len(b):
                both = len(np.intersect1d(a, b))
                if both >= 0.8 * (len(a) + len(b) - both):
                    links[t].add(u)
    return links


@pytest.mark.parametrize("options", [{}, {"limit": 4, "block": 16}])
def test_chosen_paths_find_the_links(spark, options):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(docs, **options).collect()}
    links, copies = brute_links(texts), Counter(texts)
    wanted = sum(len(links[t]) for t in texts)
    found = sum(got[i]["n_links"] for i in range(len(texts)))
    assert wanted * 0.99 <= found <= wanted
    assert all(got[i]["n_copies"] == copies[t] for i, t in enumerate(texts))
    least = {}
    for i, t in enumerate(texts):  # classes by brute force
        group, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()] - group:
                group.add(u)
                todo.append(u)
        least[i] = min(j for j, u in enumerate(texts) if u in group)
    same = sum(got[i]["class_id"] == least[i] for i in least)
    assert same >= 0.99 * len(texts)


def test_embedding_lets_pairs_of_a_low_threshold_pass():
    tokens = [np.arange(ngram_join.TOKENS, dtype="<u4"), np.arange(ngram_join.TOKENS, dtype="<u4")]
    tokens[1][:34] += 1000  # 30 of 64 shared
    leaf = pd.DataFrame({"path": 7, "block": 0, "other": 0, "side": 0, "k1": [1, 2], "k2": [1, 2], "n": [90, 100]})
    leaf = leaf.assign(tokens=[t.tobytes() for t in tokens], paths=[np.array([7])] * 2)
    assert [len(list(ngram_join._candidates(t)(iter([leaf])))) for t in (0.5, 0.8)] == [1, 0]
    assert ngram_join.least_shared(0.8) == 36


def test_near_duplicate_stage_keeps_one_of_each_class(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en")], "doc_id long, text string, lang string")
    kept = ngram_join.near_duplicate_stage(spark, docs, "").collect()
    classes = {r["class_id"] for r in ngram_join.jaccard_join(docs).collect()}
    assert sorted(r["doc_id"] for r in kept) == sorted(classes)


def test_repeated_passages_are_found(spark):
    passage = prose(50, 51).replace("\n", " ")
    rows = [(i, prose(200 + i, 40).replace("\n", " ") + " " + passage + " " + prose(300 + i, 30 + i)) for i in range(6)]
    line = prose(60, 90).replace("\n", " ").split()
    rows += [(10, " ".join(line)), (11, " ".join([*line[:50], "changed", *line[51:]]))]
    clean = [(20 + i, prose(400 + i, 300)) for i in range(10)]
    got = paragraphs.repeated_spans(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    assert {r["doc_id"] for r in got if not r["removed"]} == {0, 10}
    for r in got:
        words = WORD.findall(dict(rows)[r["doc_id"]].lower())
        if r["doc_id"] < 10:
            assert r["n_words"] >= paragraphs.WORDS
            assert " ".join(words[r["start_word"] : r["end_word"]]) in " ".join(WORD.findall(passage.lower()))


def test_short_and_wrapped_paragraphs_are_found(spark):
    def wrapped(words, width):
        return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))

    long = prose(62, 60).replace("\n", " ").split()
    changed = [*long[:30], "changed", *long[31:]]
    short, exact = prose(63, 14).replace("\n", " ").split(), prose(64, 7).replace("\n", " ")
    rows = [
        (1, prose(500, 30) + "\n\n" + wrapped(long, 12) + "\n\n" + prose(501, 20), 60),
        (2, prose(502, 40) + "\n\n" + wrapped(changed, 15), 60),
        (3, prose(503, 30) + "\n" + " ".join(short) + "\n" + prose(504, 30), 14),
        (4, prose(505, 50) + "\n" + " ".join([*short[:-1], "changed"]), 14),
        (5, prose(506, 30) + "\n" + exact + "\n" + prose(507, 30), 7),
        (6, prose(508, 50) + "\n" + exact, 7),
    ]
    got = paragraphs.repeated_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["removed"]) for r in got) == [(i, n, i % 2 == 0) for i, _, n in rows]


@pytest.mark.parametrize("options", [{}, {"block": 16}])
def test_all_lines_of_a_bucket_are_compared(spark, options):
    r = random.Random(11)
    base, lines_of = prose(61, 75).replace("\n", " ").split(), []
    for _ in range(60):  # families of two, less than 0.8 alike to most others
        variant = list(base)
        for _ in range(2):
            variant[r.randrange(5, 70)] = f"w{r.randrange(10**6)}"
        lines_of += [" ".join(variant), " ".join([*variant[:-1], f"end{len(lines_of)}"])]
    texts = spark.createDataFrame([(i, i, -i, x.encode()) for i, x in enumerate(lines_of)], "doc_id long, k1 long, k2 long, raw binary")
    found = paragraphs.located(texts).cache()
    node = {row["doc_id"]: row["paragraph"] for row in found.where("bands is not null").collect()}
    root = {row["node"]: row["root"] for row in paragraphs.line_classes(found, texts, 0.8, **options).collect()}
    links = brute_links(lines_of)
    pairs = [(i, lines_of.index(u)) for i, t in enumerate(lines_of) for u in links[t]]
    assert len(pairs) >= 120
    together = sum(node[i] in root and root[node[i]] == root.get(node[j]) for i, j in pairs)
    assert together >= 0.99 * len(pairs)


def test_spans_equal_a_plain_comparison(spark):
    r = random.Random(5)
    pool = [prose(900 + i, r.choice([6, 9, 14, 23, 60, 75])).replace("\n", " ").split() for i in range(60)]

    def variant(words):  # the same, near, or so different that no 24 words are left
        words, kind = list(words), r.randrange(3)
        for at in [[], [r.randrange(len(words))], range(r.randrange(6), len(words), 10)][kind]:
            words[at] = f"w{r.randrange(10**6)}"
        return " ".join(words)

    docs = [[" ".join(words)] for words in pool]
    docs += [[variant(r.choice(pool)) for _ in range(r.randint(1, 3))] + [prose(2000 + i, 11).replace("\n", " ")] for i in range(120)]
    every = sorted({line for lines_ in docs for line in lines_})
    links, first = brute_links(every), {}
    for line in every:  # components, by walking
        group, todo = {line}, [line]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        first[line] = (group, min(i for i, lines_ in enumerate(docs) if group & set(lines_)))
    want = {}
    for i, lines_ in enumerate(docs):
        at = 0
        for line in lines_:
            n, (group, keeper) = len(line.split()), first[line]
            if sum(bool(group & set(other)) for other in docs) > 1:
                want.setdefault(i, {}).update({w: w in want.get(i, {}) and want[i][w] or i != keeper for w in range(at, at + n)})
            at += n
    got = {}
    rows = spark.createDataFrame([(i, "\n\n".join(lines_)) for i, lines_ in enumerate(docs)], "doc_id long, text string")
    for row in paragraphs.repeated_spans(rows).collect():
        for w in range(row["start_word"], row["end_word"]):
            mine = got.setdefault(row["doc_id"], {})
            mine[w] = mine.get(w, False) or row["removed"]
    wanted = {(i, w, removed) for i, words in want.items() for w, removed in words.items()}
    found = {(i, w, removed) for i, words in got.items() for w, removed in words.items()}
    assert len(wanted) > 3000
    assert len(wanted & found) >= 0.99 * len(wanted) and len(found - wanted) <= 0.01 * len(found)


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    texts = [prose(3000 + i, 30).replace("\n", " ") + "\n\n" + prose(3100 + i // 3, 60).replace("\n", " ") for i in range(30)]

    def spans(ids):  # whole passages; pieces with another first document may lie inside
        rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        return Counter((r["start_word"], r["end_word"], r["removed"]) for r in paragraphs.repeated_spans(rows).collect() if r["n_words"] >= 60)

    for ids in (range(30), [None] * 30, [7] * 30, [None if i % 2 else i % 5 for i in range(30)]):
        assert spans(ids) == {(30, 90, True): 20, (30, 90, False): 10}


def test_kind_and_least_length_of_spans(spark):
    line = prose(71, 80).replace("\n", " ").split()
    short = prose(72, 8).replace("\n", " ")
    texts = [" ".join(line), " ".join([*line[:20], "changed", *line[21:]]), prose(73, 30) + "\n\n" + short, prose(74, 50) + "\n\n" + short]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["kind"]) for r in paragraphs.repeated_spans(rows).collect()) == [(0, "near"), (1, "near"), (2, "exact"), (3, "exact")]
    assert {r["doc_id"] for r in paragraphs.repeated_spans(rows, least=20).collect()} == {0, 1}


def test_shards_are_even_and_keep_copies_together(spark):
    texts = [f"text {i}" for i in range(700)] + [f"pair {i % 90}" for i in range(300)] + ["hot"] * 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shards.shard_documents(docs).collect()
    counts, slots, spread = Counter(), defaultdict(set), defaultdict(set)
    for r in got:
        counts[r["shard"]] += 1
        slots[r["shard"]].add(r["slot"])
        spread[texts[r["doc_id"]]].add(r["shard"])
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(s == set(range(counts[k])) for k, s in slots.items())
    assert len(spread["hot"]) <= math.ceil(500 / min(counts.values())) + 1
    assert sum(len(spread[f"pair {i}"]) > 1 for i in range(90)) <= 4


def test_every_text_copied_still_moves(spark):
    docs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(400)], "doc_id long, text string")
    got = shards.shard_documents(docs, shards=4).toPandas()
    assert got.groupby("shard").size().tolist() == [100] * 4
    together = got.assign(t=got.doc_id // 2).groupby("t").shard.nunique()
    assert (together == 1).mean() > 0.6


@pytest.mark.parametrize("copies", [2, 3])
def test_copied_texts_settle_together(spark, copies):
    docs = spark.createDataFrame([(i, f"t{i // copies}") for i in range(600)], "doc_id long, text string")
    got = shards.shard_documents(docs, shards=4).toPandas()
    assert got.groupby("shard").size().tolist() == [150] * 4
    together = got.assign(t=got.doc_id // copies).groupby("t").shard.nunique()
    print("together", copies, (together == 1).mean())
    assert (together == 1).mean() > 0.95


def test_requests_go_round_in_cycles():
    wanted = {(0, 1): 5, (1, 2): 3, (2, 0): 4, (3, 0): 2, (1, 3): 1}
    admitted, grows = shards.plan_round(wanted, {}, 4)
    assert admitted == {(0, 1): 4, (1, 2): 3, (2, 0): 3, (3, 0): 1, (1, 3): 1}
    assert grows == [0] * 4


def test_mix_meets_targets(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    assert (rows.taken <= mixing.MOST * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by.target - by.taken).abs() <= 8 * (rows["size"].sum() / mixing.SLOTS + 1)).all()
    again = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).toPandas()
    assert sorted(zip(rows.doc_id, rows.taken)) == sorted(zip(again.doc_id, again.taken))


@pytest.mark.parametrize("slots", [200, 5_000])
def test_sources_come_within_a_few_blocks(spark, slots):
    r = random.Random(9)
    sizes = {"a": 400, "b": 90, "c": 300, "d": 12, "e": 3, "f": 150}
    rows = [(i, s, " ".join(["w"] * r.randint(0, 60))) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), slots=slots).toPandas()
    total = got["size"].sum()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    block = np.minimum(-(-total // slots), np.maximum(1, by["size"] // mixing.LEAST_BLOCKS) + 1)
    assert ((by.target - by.taken).abs() <= 6 * block).all()
    assert (got.taken <= mixing.MOST * got["size"]).all()
    whole = got[got["size"] > 0]
    assert set((whole.taken / whole["size"]).between(0, 3)) == {True} and abs(by.taken.sum() - total) <= 12 * (total // slots + 1)


def test_points_decide_what_is_taken(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, slots=4_000).toPandas().sort_values("doc_id")
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)
    same = mixing.mix(docs, slots=4_000).toPandas().sort_values("doc_id")
    assert same[same.taken > 0].source.nunique() <= 2 < rows[rows.taken > 0].source.nunique()


def test_mix_equals_plain_schedule(spark):
    r = random.Random(10)
    rows = [(i, r.choice("xyz"), " ".join(["w"] * r.randint(0, 30))) for i in range(120)]
    got = {x["doc_id"]: x for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), slots=300).collect()}
    total = sum(len(t.split()) for _, _, t in rows)
    wanted, order = {}, {}
    for s in "xyz":
        docs = sorted((i for i, src, t in rows if src == s and t), key=lambda i: got[i]["digest"])
        order[s] = [i for i in docs for _ in rows[i][2].split()]
        size = len(order[s])
        blocks = max(-(-size // max(1, -(-total // 300))), min(mixing.LEAST_BLOCKS, size))
        wanted[s] = (blocks, math.floor(got[docs[0]]["target"] * blocks / size + 0.5))
    n = sum(w for _, w in wanted.values())
    taken, ranks = Counter(), Counter()
    for slot in range(1, n + 1):
        point, low = slot * mixing.GOLDEN - math.floor(slot * mixing.GOLDEN), 0
        for s in "xyz":
            blocks, w = wanted[s]
            if low / n <= point < (low + w) / n and ranks[s] < mixing.MOST * blocks:
                block, size = ranks[s] % blocks, len(order[s])
                taken.update(order[s][block * size // blocks : (block + 1) * size // blocks])
                ranks[s] += 1
            low += w
    assert {i: x["taken"] for i, x in got.items()} == {i: taken[i] for i, _, _ in rows}


def test_quality_finds_junk_and_keeps_clean(spark, sf_dir):
    got = quality.op2_weak_label_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 0].kept.mean() < 0.1
    assert rows[rows.quality == 1].kept.mean() > 0.97


def test_a_looped_passage_is_not_fresh():
    loop, fresh = ((prose(1, 300) + "\n") * 300).encode(), prose(2, 90_000).encode()
    assert quality.shape(loop)[1] == 16 and quality.shape(fresh)[1] >= 30


def test_estimate_finds_planted_accuracies():
    r = np.random.default_rng(3)
    good = r.random(60_000) < 0.7
    bad_votes, good_votes = np.linspace(0.4, 0.8, 6), np.linspace(0.5, 0.8, 6)
    draw = r.random((len(good), 6))
    cast = np.where(good[:, None], np.where(draw < 0.05, 0, np.where(draw < 0.05 + good_votes, 1, -1)), np.where(draw < bad_votes, 0, np.where(draw < bad_votes + 0.1, 1, -1)))
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    prior, weights = quality.estimate(patterns, counts.astype(float), false_alarm=1.0, detected=0.0, good_odds=np.inf)
    assert abs(prior - 0.7) < 0.02
    assert np.abs(weights[:, 0] - np.log(0.05 / bad_votes)).max() < 0.15
    assert np.abs(weights[:, 2] - np.log(good_votes / 0.1)).max() < 0.15


def test_held_out_language(spark):
    tables = "/root/testdata/sf0.01"
    rows = language.op9_byte_network(spark, tables).join(spark.read.parquet(f"{tables}/documents.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_line_rules_clean_the_text(spark):
    good, bad = prose(70, 100), "home | about | news | shop | help\nAll rights reserved.\n"
    docs = spark.createDataFrame([(1, bad + good, 9), (2, bad * 40 + good[:200], 9)], "doc_id long, text string, n_chars long")
    kept = lines.quality_stage(spark, docs, "").collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept] == [(1, good, len(good))]


PAGE = (
    "<html><head><title>t</title><script>var a='</p><article>';</script></head><body class='ad-free'>"
    "<nav><ul><li><a>Menu</a></ul></nav><div class='cookie-notice'>We use cookies</div>{box}"
    "<article class='post'><header><h1>A &lt;title&gt;</h1></header><p>First <b>bold</b>\n  text<br>next<p>Second &amp; last"
    "<div class=\"share\">Share</div><section class='comments'><p>Nice!</p></section></article>"
    "<aside>Side</aside><form>Form</form><footer>Foot</footer></body></html>"
)


def test_article_text():
    assert pages.main_text(PAGE.format(box="")) == "A <title>\n\nFirst bold text next\n\nSecond & last"
    assert pages.main_text("<p>a<!-- x --> b<p>c &#233;") == "a b\n\nc é"
    assert pages.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert pages.main_text("plain < text <3 and <a href='x") == "plain < text <3 and <a href='x"
    assert pages.main_text(None) == pages.main_text(" \n") == ""


def test_site_templates_are_removed(spark):
    box = "<div class='x1'><p>Our shop sells things.</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{box}<p>Own text {i}.</p></body>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<body>{box}<p>Own.</p></body>")]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3."
    assert got[100] == "Our shop sells things.\n\nOwn."


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    last = corpus_pipeline.STAGES[-1][0]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir).cache()
        assert 0 < docs.count()
        if name != last:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "quality rules":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
            long_enough = before.join(labels, "doc_id").where(F.size(F.split("text", r"\s+")) >= 60)
            assert long_enough.join(docs, "doc_id", "left_anti").count() == 0
        if name == "benchmark decontamination":
            found = contamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert found.where("contamination.contaminated").count() == 0


def test_columns_of_the_same_name_come_back_unchanged(spark):
    names = ("quality", "contamination", "licenses", "_k1", "_k2", "_n_words", "_found", "_rid", "shard", "slot")
    texts = [prose(600 + i, 90) for i in range(30)] + [prose(3, 60) + " " + ITEM]
    rows = [(i, t, len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(r["item_id"], r["text"]) for r in BENCHMARK[:1]], "item_id long, text string")

    def own(df):
        return sorted(tuple(r[n] for n in ("doc_id", *names)) for r in df.select("doc_id", *names).collect())

    expected = sorted((r[0], *r[3:]) for r in rows)
    assert own(lines.clean_lines(docs)) == own(contamination.contamination(docs, items)) == own(shards.sharded_corpus(docs, 4)) == expected
    assert own(lines.quality_stage(spark, docs, "")) == [r for r in expected if r[0] < 30 or r[0] == 30]
    assert own(contamination.without_benchmark(docs, items)) == expected[:30]


def test_both_ways_of_leaving_out_benchmarks(spark, odd_dir):
    docs, items = spark.read.parquet(f"{odd_dir}/documents.parquet"), spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    found = contamination.contamination(docs, items)
    clean = sorted(r["doc_id"] for r in found.where("not contamination.contaminated").collect())
    for limit in (0, 1000):
        assert sorted(r["doc_id"] for r in contamination.without_benchmark(docs, items, broadcast_texts=limit).collect()) == clean
    assert 0 < len(clean) < docs.count()


def test_the_pipeline_ends_in_a_corpus(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.run(spark, sf_dir).write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus")).toPandas()
    assert list(corpus.columns) == [*docs.columns, "shard", "slot"]
    sizes = corpus.groupby("shard").size()
    assert set(sizes.index) == set(range(40)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in corpus.groupby("shard"))
    source = docs.toPandas().set_index("doc_id").source
    assert (corpus.source.fillna("") == corpus.doc_id.map(source).fillna("")).all() and corpus.text.notna().all()
