"""Phrase collocations: phrases of two to four words, counted by a multikey three-way quicksort of suffix pointers.

A suffix is a place in a piece of text with up to four words from there on. Suffixes are routed by their leading words, so
that all occurrences of a phrase of two words or more meet in one task; there a quicksort splits pointers to them in three by one word at a
time: smaller, equal, larger. The equal part goes on to the next word, down to the fourth, and its size is the count of the phrase it stands for.
Parts with fewer pointers than a candidate needs are abandoned, whatever they hold.

Two things keep the routing small and even. A suffix ends before a word that is too rare itself; words are counted first, and
a bit array of fixed size says which may be frequent. And where one pair or triple of words leads
more than a 4,096th of all suffixes, its suffixes are routed by one word more and the counts of its tasks are added. There can be at
most 4,096 of each, and each shows in the counts of at least one chunk of text.

Words are 64-bit hashes of language and word until the end. No two words may share one: all words are compared, and
another seed is taken if any do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WordNumbers, filter_bits, gram_hashes, may_hold, mixed
from loomwork.session import written

LONGEST = 4
#: Words of a chunk, whose suffixes are counted together before they move.
CHUNK_WORDS = 1 << 19
#: A pair or triple is hot if it leads more than one in so many suffixes.
HOT_SHARE = 4096
#: Suffixes of a task, at most about so many.
TASK_SUFFIXES = 2_000_000
RANK_BUCKETS = 64
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
# a dot for what ends a piece: no word has one
_BYTES = bytes(46 if b in _PIECE_ENDS else 32 if b == 9 else b for b in range(256))


def tokens_of(text: str) -> list[bytes]:
    """The words, and b"." where a piece ends."""
    return text.encode("utf-8", "replace").lower().translate(_BYTES).replace(b".", b" . ").split()


class Chunks:
    """Texts to chunks of about CHUNK_WORDS word numbers, with 0 between pieces. A chunk holds whole texts of one language.

    All languages together hold no more words at once, so that neither their number nor their order costs memory.
    """

    def __init__(self, seed: int) -> None:
        self.seed, self.numbers = seed, {}

    def words(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """(language, words, their numbers)"""
        for lang, texts in self._held(batches, CHUNK_WORDS, lambda lang, words: words):
            words = [w for words in texts for w in words]
            yield lang, words, self.of(lang, words)

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, texts in self._held(batches, CHUNK_WORDS, self.of):
            yield np.concatenate(texts)

    @staticmethod
    def _held(batches: Iterator[pa.RecordBatch], most: int, of) -> Iterator[tuple[str, list]]:
        held, sizes, total = {}, Counter(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column(0)[i].as_py(), tokens_of(batch.column(1)[i].as_py() or "")
                words.append(b".")
                held.setdefault(lang, []).append(of(lang, words))
                sizes[lang] += len(words)
                total += len(words)
                if total >= most:
                    largest = sizes.most_common(1)[0][0]
                    total -= sizes.pop(largest)
                    yield largest, held.pop(largest)
        yield from held.items()

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.numbers:
            if len(self.numbers) > 16:
                self.numbers.clear()
            seed = int(WordNumbers(self.seed)[lang.encode("utf-8", "replace")])
            self.numbers[lang] = WordNumbers(seed, 1 << 16, {b".": 0})
        return self.numbers[lang].of(words)


def _runs(numbers: np.ndarray, size: int) -> np.ndarray:
    """Where `size` words without a break begin."""
    ok = numbers != 0
    n = max(0, len(ok) - size + 1)
    out = np.ones(n, bool)
    for k in range(size):
        out &= ok[k : k + n]
    return np.flatnonzero(out)


def word_counts(texts: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """((lang, id, word, n), (size, id, n)): the words of each language with their counts, and what pairs and triples are hot in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in Chunks(seed).words(batches):
            order = np.argsort(numbers)
            each, first, n = np.unique(numbers[order], return_index=True, return_counts=True)
            real = each != 0
            names = [words[i].decode("utf-8", "replace") for i in order[first[real]]]
            yield _counts(0, lang, each[real], n[real], names)
            for size in (2, 3):
                at = _runs(numbers, size)
                each, n = np.unique(gram_hashes(numbers, size)[at], return_counts=True)
                hot = n * HOT_SHARE > len(at)
                yield _counts(size, lang, each[hot], n[hot], [None] * int(hot.sum()))

    found = written(texts.mapInArrow(run, "size int, lang string, id long, n long, word string"), "chunk-counts")
    return found.where("size = 0").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), found.where("size > 0").select("size", "id", "n")


def _counts(size: int, lang: str, ids: np.ndarray, n: np.ndarray, words: list) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(ids), size, np.int32)), pa.array([lang] * len(ids), pa.string()), pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(words, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["size", "lang", "id", "n", "word"])


def hot_leads(chunks: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of pairs and of triples that lead at least a 4,096th of all words by what chunks tell: at most 4,096 each, since the parts sum up to the whole."""
    rows = chunks.groupBy("size", "id").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE >= total).collect()
    pairs, triples = (np.sort(np.array([r["id"] for r in rows if r["size"] == size], np.int64).view(np.uint64)) for size in (2, 3))
    return pairs, triples


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def suffixes(numbers: np.ndarray, bits: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of words, 0 behind the end; how often; how many leading words route; their hash) of the different suffixes of a chunk."""
    numbers = np.where(may_hold(bits, numbers), numbers, np.uint64(0))
    at = _runs(numbers, 2)
    padded = np.append(numbers, np.zeros(LONGEST, np.uint64))
    columns = [padded[at], padded[at + 1]]
    for k in range(2, LONGEST):
        columns.append(np.where(columns[-1] == 0, np.uint64(0), padded[at + k]))
    whole = gram_of(columns)
    order = np.argsort(whole)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    columns = [c[first] for c in columns]
    two, three = gram_of(columns[:2]), gram_of(columns[:3])
    lead = np.where(_among(pairs, two), np.where(_among(triples, three) & (columns[2] != 0), 4, 3), 2)
    return columns, n, lead, np.choose(lead - 2, [two, three, gram_of(columns)])


def gram_of(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each row of word numbers: what gram_hashes gives for them in a row."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + c
    return mixed(out)


_ROUTED = "part int, lead int, " + ", ".join(f"w{k} array<long>" for k in range(LONGEST)) + ", n array<long>"


def routed(texts: DataFrame, seed: int, bits: Broadcast, hot: Broadcast, parts: int) -> DataFrame:
    """Blocks of suffixes, counted within their chunk, for each part and number of leading words that route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in Chunks(seed).read(batches):
            columns, n, lead, route = suffixes(numbers, bits.value, *hot.value)
            part = (route % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((columns[1], columns[0], lead, part))  # sorted words lie close together, which packs well
            columns, n, key = [c[order] for c in columns], n[order], (part * 8 + lead)[order]
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c.view(np.int64))) for c in [*columns, n]]
            keys = key[ends - 1] if len(ends) else key
            block = pa.RecordBatch.from_arrays([pa.array((keys // 8).astype(np.int32)), pa.array((keys % 8).astype(np.int32)), *lists], ["part", "lead", *[f"w{k}" for k in range(LONGEST)], "n"])
            for i in range(0, block.num_rows, 256):
                yield block.slice(i, 256)

    return texts.mapInArrow(run, _ROUTED)


def frequent_phrases(keys: list[np.ndarray], n: np.ndarray, least: int, lead: int) -> Iterator[tuple[int, int, int]]:
    """(a pointer, how many words of its suffix, their count) for phrases of two words and more, by multikey three-way quicksort.

    All suffixes that share `lead` leading words are here, so a part below `least` that is split by the lead's last word or a later one
    is abandoned. Phrases shorter than the lead have other suffixes elsewhere: their counts are told however small.
    """
    stack = [(np.arange(len(n)), 0)] if len(n) else []
    while stack:
        at, depth = stack.pop()
        word = keys[depth][at]
        pivot = np.sort(word[[0, len(word) // 4, len(word) // 2, 3 * len(word) // 4, -1]])[2]
        equal, less = word == pivot, word < pivot
        same = at[equal]
        if len(same) < len(at):
            for part in (at[less], at[~(equal | less)]):
                if len(part) and (depth + 1 < lead or n[part].sum() >= least):
                    stack.append((part, depth))
        if pivot == 0:
            continue
        count = int(n[same].sum())
        if depth and (count >= least or depth + 1 < lead):
            yield int(same[0]), depth + 1, count
        if depth + 1 < LONGEST and (count >= least or depth + 2 < lead):
            stack.append((same, depth + 1))


def phrase_counts(blocks: DataFrame, least: int, parts: int) -> DataFrame:
    """(words array<long>, n): the counts of frequent phrases, by the parts of the routing; parts of hot phrases may be told in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            leads = batch.column(1).to_numpy()
            for lead in np.unique(leads):
                rows = batch.filter(pa.array(leads == lead))
                held.setdefault(int(lead), []).append([rows.column(2 + k).flatten().to_numpy() for k in range(LONGEST + 1)])
        for lead, blocks in held.items():
            *keys, n = (np.concatenate(x) for x in zip(*blocks))
            found = list(frequent_phrases([k.view(np.uint64) for k in keys], n, least, lead))
            for i in range(0, len(found), 10_000):
                some = found[i : i + 10_000]
                words = [[int(keys[k][at]) for k in range(size)] for at, size, _ in some]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array([x[2] for x in some], pa.int64())], ["words", "n"])

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(run, "words array<long>, n long").groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _first_of_each(df: DataFrame, group: str, order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first k rows of each group: first within buckets of it, then among those, so that no group is ranked whole in one task."""
    in_bucket = F.row_number().over(Window.partitionBy(group, F.pmod(spread, F.lit(RANK_BUCKETS))).orderBy(*order))
    best = df.withColumn("__place", in_bucket).where(F.col("__place") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("__place")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    a, l and r count the phrase and the two parts of its weakest cut, n the language's words. Null texts are empty, a null language is `und`, like a
    language of that name. Repeated rows count as often as they stand there. Empty texts, and tables without rows or candidates, give no row.
    Further columns are not read.
    """
    lang, text = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")
    texts = docs.select(lang, text)
    while True:
        words, chunks = word_counts(texts, seed)
        words = written(words, "words")
        shared = words.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 or id = 0").limit(1)
        if not shared.count():
            break
        seed += 1  # two words share a number: others don't with another seed
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = words.where(F.col("n") >= least)
    context = docs.sparkSession.sparkContext
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_SUFFIXES + 1)
    blocks = routed(texts, seed, filter_bits(frequent, "id"), context.broadcast(hot_leads(chunks, total)), parts)
    phrases = written(phrase_counts(blocks, least, parts), "phrases")

    counts = phrases.unionByName(frequent.select(F.array("id").alias("words"), "n"))
    cut = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    parts_of = cut.withColumn("first", F.expr("slice(words, 1, k)")).withColumn("rest", F.expr("slice(words, k + 1, size(words) - k)"))
    scored = (
        parts_of.join(counts.select(F.col("words").alias("first"), F.col("n").alias("l")), "first").join(counts.select(F.col("words").alias("rest"), F.col("n").alias("r")), "rest")
        .withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    )
    weakest = scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s))))")
    inside = phrases.where(F.size("words") > 2).select(F.explode(inner).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    kept = weakest.join(inside, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    named = kept.select("words", "a", "cut", F.posexplode("words").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    named = named.groupBy("words", "a", "cut", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("each"))
    named = named.select("lang", F.array_join(F.col("each.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = _first_of_each(named, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.xxhash64("phrase"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
