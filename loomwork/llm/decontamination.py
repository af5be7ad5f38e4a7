"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item. Of each window of a text the smallest hash of its five-word grams
is kept, the leftmost among equals, with the place where it stands; neighbouring windows mostly keep the same gram, so
that about two grams in seven remain. Which gram a window keeps follows from its words alone, so two texts that share a
window share its fingerprint: every shared span of ten words is found. Fingerprints of documents meet those of the benchmark in a join,
and each hit is extended to the windows that kept it, which are compared word by word. Items of fewer words
are one window each and are sought by grams of their own length.

A bit array of fixed size, made from the benchmark's fingerprints, spares the join most of the documents' fingerprints. It
only lets too many through as the benchmark grows, and the join decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import WordNumbers, filter_bits, gram_hashes, map_texts, may_hold
from loomwork.session import written

WINDOW = 10
GRAM = 5
# what is no word of the contract becomes a blank
_WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_WORD_BYTES).split()


def winnow(numbers: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest gram hash of each window of words, how far into its window that gram stands); the leftmost of equals."""
    hashes = gram_hashes(numbers, gram)
    n = max(0, len(numbers) - window + 1)
    least, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - gram + 1):
        other = hashes[k : k + n]
        less = other < least
        least[less] = other[less]
        at[less] = k
    return least, at


def fingerprints(numbers: np.ndarray, short: tuple[int, ...], window: int, gram: int, keep: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(hash, width, first and last start of the windows that kept it) for what `keep` lets through."""
    least, at = winnow(numbers, window, gram)
    place = np.arange(len(least)) + at
    first = np.flatnonzero(np.diff(place, prepend=-1))  # windows that keep one gram stand side by side
    last = np.append(first[1:], len(place)) - 1
    kept = keep(least[first]) if len(first) else np.zeros(0, bool)
    found = [(int(h), window, int(a), int(b)) for h, a, b in zip(least[first[kept]].view(np.int64), first[kept], last[kept])]
    for width in short:
        hashes = gram_hashes(numbers, width)
        if len(hashes):
            places = np.flatnonzero(keep(hashes))
            found += [(int(h), width, int(p), int(p)) for h, p in zip(hashes[places].view(np.int64), places)]
    return found


def item_windows(items: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(item, hash, width, words): each window of each item, its words joined by spaces. Items without words have none."""

    def start():
        numbers = WordNumbers()

        def work(text: str) -> list[tuple]:
            words = words_of(text)
            each = numbers.of(words)
            if len(words) >= window:
                kept, width = winnow(each, window, gram)[0], window
            else:
                kept, width = gram_hashes(each, len(words)) if words else each, len(words)
            return [(int(h), width, b" ".join(words[i : i + width]).decode("utf-8", "replace")) for i, h in enumerate(kept.view(np.int64))]

        return work

    found = map_texts(items, id_col, text_col, "hash long, width int, words string", start)
    return found.withColumnRenamed(id_col, "item")


def document_fingerprints(docs: DataFrame, bits, short: tuple[int, ...], window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(row, n_words, hits): a row for each document, with the fingerprints that the benchmark may have too.

    A hit holds the words of the windows that kept it, from the first one's start.
    """

    def start():
        numbers, held = WordNumbers(), bits.value

        def work(text: str) -> list[tuple]:
            words = words_of(text)
            hits = [
                {"hash": h, "width": w, "first": a, "last": b, "words": b" ".join(words[a : b + w]).decode("utf-8", "replace")}
                for h, w, a, b in fingerprints(numbers.of(words), short, window, gram, lambda hashes: may_hold(held, hashes))
            ]
            return [(len(words), hits)]

        return work

    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("number")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(rows, "row", "text", "n_words long, hits array<struct<hash: long, width: int, first: int, last: int, words: string>>", start)


def hit_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(number, start, width, window): the windows of documents that are windows of the benchmark, word by word."""
    hits = found.select(F.col("row.number").alias("number"), F.explode("hits").alias("hit")).select("number", "hit.*")
    shared = hits.join(windows.select("hash", "width").distinct(), ["hash", "width"], "left_semi")
    each = shared.withColumn("start", F.explode(F.sequence("first", "last")))
    text = F.array_join(F.slice(F.split("words", " "), F.col("start") - F.col("first") + 1, F.col("width")), " ")
    return each.select("number", "start", "width", text.alias("words")).join(windows.select("words", "window"), "words").select("number", "start", "width", "window")


def hit_words(hits: DataFrame) -> DataFrame:
    """(number, n_hit): the words of each document that lie in a window that is hit, each counted once."""
    end = F.col("start") + F.col("width")
    before = F.expr("max(start + width) over (partition by number order by start, width rows between unbounded preceding and 1 preceding)")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    return hits.select("number", new.alias("new")).groupBy("number").agg(F.sum("new").alias("n_hit"))


def hit_items(hits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((number, windows), (windows, n_items, items_sha256)): documents with equal sets of windows share one list of items."""
    sets = hits.groupBy("number").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    each = sets.select("windows").distinct().select("windows", F.explode("windows").alias("window")).join(items, "window")
    ids: Column = F.sort_array(F.collect_set(F.col("item").cast("string")))
    return sets, each.groupBy("windows").agg(F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document, repeated rows and null ids included.

    A null or empty text has no words and is clean; a null or wordless item has no window. Items that share an id count once; an item
    with a null id hits like any other, but is neither counted nor listed. Without items, or without documents,
    nothing is hit. Further columns are not read.
    """
    each = written(item_windows(items, window, gram, item_id_col, item_text_col), "item-windows")
    windows = written(each.groupBy("words").agg(F.min("hash").alias("hash"), F.min("width").alias("width")).withColumn("window", F.monotonically_increasing_id()), "windows")
    short = tuple(sorted(r[0] for r in windows.where(F.col("width") < window).select("width").distinct().collect()))
    found = written(document_fingerprints(docs, filter_bits(windows, "hash"), short, window, gram, id_col, text_col), "fingerprints")
    hits = written(hit_windows(found, windows), "hits")
    sets, lists = hit_items(hits, each.select("words", "item").distinct().join(windows.select("words", "window"), "words").select("window", "item"))
    told = hit_words(hits).join(sets, "number").join(lists, "windows", "left").select("number", "n_hit", "n_items", "items_sha256")
    number, n_hit = F.col("row.number").alias("number"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        found.select(F.col("row.id").alias(id_col), number, "n_words").join(told, "number", "left")
        .select(id_col, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of docs whose ids have no contaminated row; rows with a null id stay if none with a null id is contaminated."""
    bad = contamination(docs, items, id_col=id_col, **names).where("contaminated").select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")
