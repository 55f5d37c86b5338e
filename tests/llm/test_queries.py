"""Every registered corpus query over tables of nulls, empty and long texts, repeats and clashing columns, and over empty ones."""

from collections import Counter

import pytest

from weft.llm import queries, token_rollup

LONG = "word " * 30_000
DOCS = [
    (1, "Der Hund und die Katze", "de", "a", 1, "x"), (1, "Der Hund und die Katze", "de", "a", 1, "x"), (2, None, "en", "a", 0, None), (3, "", None, None, None, "x"),
    (4, LONG, "en", "hot", 9, "x"), (None, "no id", "en", "hot", 9, "x"), (6, " \t\n", "en", "hot", 9, "x"), (7, "\x00 ퟿ ٣", None, "", 1, "x"), (None, None, None, None, None, None),
]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score string",
    "embeddings": "vec_id long, embedding array<float>, rank string",
    "pages": "page_id long, url string, html string, text string",
    "benchmark": "item_id long, text string, doc_id string",
    "labels": "doc_id long, quality int, toxic int, text string",
}
ROWS = {
    "documents": DOCS,
    "embeddings": [(100, [1.0, 2.0], "x"), (100, [1.0, 2.0], "x"), (1, [0.5, -1.0], "x"), (2, None, None), (3, [None, 1.0], "x"), (200, [float("nan"), 1.0], "x"), (None, [1.0, 1.0], "x")],
    "pages": [(1, "http://h/1", "<p>a&amp;b</p>", "x"), (1, "http://h/1", "<p>a&amp;b</p>", "x"), (2, None, None, None), (3, "not a url", "", "x"), (None, "http://h/2", f"<p>{LONG}</p>", "x"), (4, "http://h/3", "<div><p>open", "x")],
    "benchmark": [(1, "der hund und die", "x"), (2, None, None), (3, "", "x"), (None, "no id", "x"), (1, "der hund und die", "x")],
    "labels": [(1, 1, 0, "x"), (1, None, 1, "x"), (None, 1, 1, "x"), (4, 1, None, "x"), (99, 1, 1, "x")],
}


def folder(spark, path, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), {k: [] for k in ROWS})


PER_ROW = {"op2_decontamination", "op3_toxicity", "op4_ngram_jaccard_join", "op5_license_scan", "op8_sharding", "op9_language_id"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    if name in PER_ROW:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in DOCS)
    if name == "op6_html_extraction":
        text = sorted((r.text, r.n_chars) for r in got)
        assert len(got) == len(ROWS["pages"])
        assert all(n == len(t) for t, n in text)
        assert ("a&b", 3) in text
        assert (LONG.strip(), len(LONG) - 1) in text


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_token_counts_by_hand(spark, odd):
    encode = token_rollup.tokenizer(f"{queries.TOKENIZER_DIR}/{queries.TOKENIZER_FILE}", queries.TOKENIZER_PATTERN).encode_ordinary
    docs, tokens = Counter(), Counter()
    for _, text, lang, source, *_ in DOCS:
        if text:  # what has no text is deleted again
            docs[source, lang] += 1
            tokens[source, lang] += len(encode(text))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op10_token_counts(spark, odd).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}
