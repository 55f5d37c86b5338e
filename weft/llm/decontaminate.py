"""Benchmark decontamination over a distributed positional inverted index. DataFrame operations only.

The index holds postings (document, position) of training tokens for the test terms
that matter. Terms of the test items are counted over the whole corpus first; a
window with a term that the corpus lacks can't occur. Every other window is looked
up from its rarest terms: the postings of its two rarest are read, shifted by the
terms' offsets in the item, and intersected to places where the window may begin.
The remaining terms are then compared at these places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, ascii_lower, join_checked, small

#: Word characters: everything but ASCII characters that are neither digits nor lower-case letters. The
#: excluded characters are listed one by one, as Java tests a list of them by one table lookup, but ranges in turn.
WORDS = "[^" + "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))) + "]+"
#: Bound of a table of terms or windows (a few short columns) that is broadcast; larger ones are joined by shuffle.
TERM_ROWS = 500_000
#: Bound of the bytes of the windows' words and items that are broadcast.
WINDOW_BYTES = 32_000_000
#: A term with more than this part of all tokens is dealt over several tasks where terms are joined by shuffle. There
#: are never more such terms than this, so their table is always broadcast.
HEAVY = 100_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased first; null has none."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))


def frequencies(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, freq)`` over the whole corpus; terms are counted where they are read, before any shuffle."""
    found, few = tokens(docs, id_col, text_col).select("term"), small(terms, TERM_ROWS)
    if few:
        found = found.join(F.broadcast(terms), "term")
    counts = found.groupBy("term").agg(F.count("*").alias("freq"))
    return counts if few else counts.join(terms, "term")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional index: ``(term, id, pos)`` for every occurrence of a term of ``terms(term)``; pos from 0.

    Where terms are too many to be broadcast, tokens meet them by shuffle: frequent words that aren't asked for are
    left out before it, frequent ones that are asked for are dealt over several tasks.
    """
    found = tokens(docs, id_col, text_col)
    if small(terms, TERM_ROWS):
        return found.join(F.broadcast(terms), "term")
    counts = Stash(docs.sparkSession, "frequencies").put("all", found.groupBy("term").agg(F.count("*").alias("freq")))
    share = max(1, (counts.agg(F.sum("freq")).first()[0] or 0) // HEAVY)
    wanted = terms.select("term", F.lit(True).alias("wanted"))
    heavy = counts.where(F.col("freq") > share).join(wanted, "term", "left").select("term", "wanted", F.ceil(F.col("freq") / share).alias("salts"))
    lists = terms.join(F.broadcast(heavy.select("term", "salts")), "term", "left")
    lists = lists.select("term", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    found = found.join(F.broadcast(heavy), "term", "left").where("salts is null or wanted")
    found = found.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.coalesce("salts", F.lit(1))))
    return found.join(lists, ["term", "salt"]).select("term", "id", "pos")


def proximity_matches(index: DataFrame, first: str, second: str, slop: int) -> DataFrame:
    """``(id, pos_first, pos_second)``: places where two terms stand at most ``slop`` words apart, in either order.

    Positions are met over buckets of ``slop + 1`` words, so a frequent pair in a long document is no product.
    """
    width = slop + 1
    a = index.where(F.col("term") == first).select("id", F.col("pos").alias("pos_first"), F.floor(F.col("pos") / width).alias("b"))
    b = index.where(F.col("term") == second).select(
        "id", F.col("pos").alias("pos_second"), F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("b")
    )
    return a.join(b, ["id", "b"]).where(F.abs(F.col("pos_first") - F.col("pos_second")).between(1, slop)).select("id", "pos_first", "pos_second").distinct()


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, start, terms)``: runs of ``size`` words; a shorter item, but not an empty one, is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, F.lit(size)).alias("terms")))
    return w.select("item_id", F.explode(cut).alias("x")).select("item_id", "x.start", "x.terms")


def phrase_matches(
    docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``(<doc_id>, w, hits)`` per row of docs: its words and the exact occurrences of item windows.

    hits is an array of ``struct<start, n, items>``: first word of the occurrence in the
    document, its length, and the items that have this window. A text without words
    has no hit. Postings name a row by its id, or without one by a hash of its text; rows
    that share a name (repeated ids) share candidate places, which each compares with its
    own words.
    """
    stash = Stash(docs.sparkSession, "decontaminate")
    id_type = docs.schema[doc_id].dataType
    by_text = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2**31 - 1)).cast(id_type)
    docs = docs.select(F.col(doc_id).alias("own_id"), F.coalesce(F.col(doc_id), by_text).alias("id"), F.col(text_col).alias("text"))
    wins = windows_of(items, size, item_id, text_col).groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    wins = stash.put("items", wins.withColumn("win", F.monotonically_increasing_id()))
    freq = frequencies(docs, wins.select(F.explode("terms").alias("term")).distinct(), "id", "text")
    flat = wins.select("win", F.posexplode("terms").alias("offset", "term")).join(freq, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("offset"), F.col("term"))))
    # a window's rarest terms; one that the corpus lacks rules the window out
    rare = flat.groupBy("win").agg(order.alias("o")).where(F.col("o")[0]["freq"] > 0)
    second = F.get("o", F.lit(1))
    rare = rare.select("win", F.col("o")[0]["term"].alias("term"), F.col("o")[0]["offset"].alias("o1"), second["term"].alias("t2"), second["offset"].alias("o2"))
    rare = stash.put("windows", rare)
    wanted = rare.select("term").unionAll(rare.where("t2 is not null").select(F.col("t2").alias("term"))).distinct()
    index = stash.put("postings", postings(docs, wanted, "id", "text"))

    places = join_checked(index, rare, "term", rows=TERM_ROWS).withColumn("begin", F.col("pos") - F.col("o1")).where("begin >= 0")
    # intersect with the second rarest term's list, shifted by its offset
    shifted = index.select("id", F.col("pos").alias("at"), F.col("term").alias("t2"))
    both = places.where("t2 is not null").withColumn("at", F.col("begin") + F.col("o2")).join(shifted, ["id", "at", "t2"], "left_semi")
    columns = ["id", "begin", "win"]
    left = stash.put("places", both.select(columns).unionByName(places.where("t2 is null").select(columns)).distinct())
    held = wins.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 8 * F.size("items"))).first()[0] or 0
    left = left.join(F.broadcast(wins) if held <= WINDOW_BYTES else wins, "win")
    by_doc = left.groupBy("id").agg(F.collect_list(F.struct("begin", "terms", "items")).alias("places"))
    own = docs.join(by_doc, "id", "left")
    fits = lambda p: F.slice("w", p["begin"] + 1, F.size(p["terms"])) == p["terms"]
    hits = F.transform(
        F.filter("places", fits), lambda p: F.struct(p["begin"].alias("start"), F.size(p["terms"]).alias("n"), p["items"].alias("items"))
    )
    empty = F.array().cast("array<struct<start:int,n:int,items:array<bigint>>>")
    return own.withColumn("w", words(F.col("text"))).select(
        F.col("own_id").alias(doc_id), "w", F.coalesce(hits, empty).cast("array<struct<start:int,n:int,items:array<bigint>>>").alias("hits")
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per row of docs its words, hit words and the items found, by ``phrase_matches``.

    ``items_sha256`` hashes the item ids sorted as strings and joined by commas; without
    any it hashes the empty string. Null texts and null item texts have no words;
    empty tables give no hits and no rows. Columns other than doc_id, item_id and
    text are not read.
    """
    m = phrase_matches(docs, items, size)
    span = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))), lambda i: i.cast("string")))
    return m.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct(span)).cast("long").alias("n_hit"), ids.alias("items")
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
