"""The pipeline against a plain Python version of its five stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from weft.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def groups(rows):
    """The smallest id reachable by links, per id."""
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 5 * len(a & b) >= 4 * len(a | b) and root[i] < root[j]:
                    root[j], changed = root[i], True
    return root


def contaminated(text, items, size=10):
    w = words(text)
    for item in items:
        v = words(item)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1)):
            return True
    return False


def draws(rows, seed=17, power=0.7):
    """How often every row is repeated."""
    size = Counter()
    for _, t, _, source, _ in rows:
        size[source] += len((t or "").encode()) + 1
    want = {s: round(b**power * 1000) for s, b in size.items()}
    out = Counter()
    for r in rows:
        mean = want[r[3]] / sum(want.values()) * sum(size.values()) / size[r[3]]
        u = int(hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, cdf, p = 0, math.exp(-mean), math.exp(-mean)
        while cdf <= u:
            n += 1
            p *= mean / n
            cdf += p
        out[r[0]] += n
    return +out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randrange(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(180):
        t, toxic = text(rnd.choice([20, 60, 150])), i % 6 == 0
        if toxic:
            t = f"{text(8)} {rnd.choice(vocabulary)} scumbag {rnd.choice(vocabulary)} nitwit {text(5)}"
        docs.append((i, t, "en", "hot" if i % 3 else "b", len(t)))
        labels.append((i, 1, int(toxic)))
    items = [(1, text(25)), (2, "only three words"), (3, None), (4, "")]
    special = [
        "you scumb4g and n1tw1t", docs[1][1], docs[1][1] + " tail", docs[2][1].upper(), f"{text(30)} {' '.join(items[0][1].split()[3:16])} {text(30)}",
        f"Some ONLY three, words {text(9)}", None, "", " \t ", "short one", "short one", text(20_000), f"{text(40)} {' '.join(items[0][1].split()[:9])}",
    ]
    docs += [(1000 + k, t, None if k % 2 else "en", None if k % 4 == 0 else "hot", None) for k, t in enumerate(special)]
    labels += [(5000, 0, 1), (1001, None, None)]
    return docs, labels, items


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_rows(spark, tmp_path, tables):
    docs, labels, items = tables
    learn = {i: y for i, _, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2}
    model = toxicity.fit((t, learn[i]) for i, t, *_ in docs if i in learn)
    kept = [r for r in docs if model.score(r[1]) < 0.3]
    gone = {r[0] for r in docs} - {r[0] for r in kept}
    assert 1000 in gone
    assert gone <= {1000, *range(0, 180, 6)}
    assert len(gone) > 25
    root = groups(kept)
    kept = [r for r in kept if root[r[0]] == r[0]]
    assert {1001, 1002, 1003, 1010}.isdisjoint(r[0] for r in kept)
    kept = [r for r in kept if not contaminated(r[1], [t for _, t in items])]
    assert {1004, 1005}.isdisjoint(r[0] for r in kept)
    assert {1006, 1007, 1008, 1011, 1012} <= {r[0] for r in kept}
    want = draws(kept)

    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs, labels, items)).collect()
    assert Counter(r.doc_id for r in got) == want
    text = {r[0]: r[1] for r in docs}
    shards = {}
    for r in got:
        assert r.text == text[r.doc_id]
        shards.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 8
    assert max(sizes) - min(sizes) <= 1
    hot = [sum(r.source == "hot" for r in v) for v in shards.values()]
    assert max(hot) - min(hot) <= 3
    for v in shards.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path, tables):
    _, labels, items = tables
    odd = [(None, None, None, None, None), (None, "a text without an id", None, "x", 1), (7, "same id", "en", "x", 1), (7, "same id", "en", "x", 1), (7, "same id, other text", "en", "x", 1), (8, "", None, None, 0)]
    folder = write(spark, tmp_path, odd, labels, items)
    docs = spark.createDataFrame([(*r, "clash") for r in odd], f"{DOCS}, score string").withColumnRenamed("score", "component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS, name
        if name == "ngram_jaccard_join":
            assert sorted(r.text or "" for r in out.collect()) == ["", "", "a text without an id", "same id", "same id, other text"]
        elif name != "source_mixing":
            assert out.count() == len(odd), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(odd)


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_toxicity_learns_from_long_texts_and_repeated_ids(spark, tmp_path, tables):
    docs, labels, items = tables
    rows = [r[:1] + (f"{r[1]} blockhead",) + r[2:] if i % 3 == 0 else r for i, r in enumerate(docs[:180])]
    rows = [r[:1] + (r[1].replace("scumbag", "dolt") + " quiet" * 12_000,) + r[2:] if r[0] % 6 == 0 else r for r in rows]
    again = [(6 * k, f"{docs[k][1].split()[0]} ninny {docs[k][1]}", "en", "b", 1) for k in range(30)]
    asked = [(2000, "what a dolt", "en", "b", 11), (2001, "what a n1nny", "en", "b", 12), (2002, "what a blockhead", "en", "b", 16)]
    folder = write(spark, tmp_path, rows + again + asked, labels[:180], items)
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert {2000, 2001}.isdisjoint(left)
    assert 2002 in left
