"""Repeated paragraphs and passages by MinHash banding, exact verification and components.

A paragraph is a line of enough words. Its MinHash over five-word shingles is cut into bands; distinct paragraphs that
collide in a band are candidates, and those whose exact Jaccard similarity reaches the threshold are linked. Passages that are
copied into the middle of other lines have no line of their own: for them the words' GRAM-word runs are winnowed, so that any
SURE words in a row hold an anchor, which a copy holds too. Spans between anchors that several documents have are repeated as they are;
around anchors where a repeated stretch may end, all runs of min_run words are compared, so that its ends are exact.
Clusters are connected components over linked paragraphs and over anchors that stand in one run.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import SLICE_ROWS, unused
from loomwork.operators.components import connected_components
from loomwork.operators.running import global_rank
from loomwork.session import written

SHINGLE = 5
BANDS, ROWS = 8, 4
#: Words of an anchor, and the length from which every run of words holds one.
GRAM, SURE = 16, 51
#: Distinct paragraphs of one candidate component that a task compares; larger components are compared in pairs of blocks.
BLOCK = 4000
#: Bytes of texts whose words are hashed in one go; a longer text is one of its own.
CHUNK_BYTES = 1 << 20
#: Rows up to which the list of needed paragraphs is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 300_000

_RANDOM = np.random.default_rng(20240131)
_XOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the text, and for each line its first word and the one after its last."""
    crcs: list[int] = []
    ends = []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        crcs += map(zlib.crc32, line.split())
        ends.append(len(crcs))
    ends = np.array(ends, np.int64)
    return _mixed(np.array(crcs, dtype=np.uint64) * _BASE + np.uint64(1)), np.stack([np.append(0, ends[:-1]), ends], axis=1)


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of runs of a batch's texts that together are short enough to be worked at once."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lengths):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 4 * SLICE_ROWS]), CHUNK_BYTES, side="right")))
        yield at, [t or "" for t in column.slice(at, n).to_pylist()]
        at += n


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), _BASE, np.uint64), dtype=np.uint64)])


def shingles(h: np.ndarray) -> np.ndarray:
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    powers = _powers(SHINGLE)
    return _mixed(sum((h[i : i + n] * powers[i] for i in range(1, SHINGLE)), h[:n] * powers[0]))


def band_keys(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys from the text's shingles; each paragraph has SHINGLE words or more."""
    edges = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
    if edges[-1] == len(s):
        edges = edges[:-1]
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((s ^ _XOR[k]) * _ODD[k], edges)[::2]
        keys[:, k // ROWS] = _mixed(keys[:, k // ROWS] * _BASE + least)
    return keys + np.arange(BANDS, dtype=np.uint64)


@lru_cache(maxsize=4)
def _scales(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of the base and of its inverse."""
    inverse = np.full(1 << bits, pow(int(_BASE), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return _powers(1 << bits), np.cumprod(inverse, dtype=np.uint64)


class Pieces:
    """64-bit hashes of any pieces of a text's words, which may overlap."""

    def __init__(self, h: np.ndarray) -> None:
        powers, self.inverse = _scales(max(12, len(h).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed(_mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts]) + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        at = np.arange(max(0, n))
        return self.hashes(at, at + size)


_PLACE = np.uint64((1 << 28) - 1)


def anchor_places(grams: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the smallest gram, the last of equals, of each run of SURE - GRAM + 1 grams of one text, or of all its grams if there are fewer.

    A text's grams are size[i] from first[i] on; texts follow each other and size is 1 or more.
    """
    width, step, n = SURE - GRAM + 1, 1, len(grams)
    if not len(first):
        return np.zeros(0, np.int64)
    packed = (grams & ~_PLACE) | (_PLACE - np.arange(n, dtype=np.uint64))
    place_of = lambda least: (_PLACE - (least & _PLACE)).astype(np.int64)
    inside = np.stack([first, first + size], axis=1).ravel()
    short = np.minimum.reduceat(np.append(packed, ~np.uint64(0)), inside)[::2][size < width]
    found = [place_of(short)]
    if n >= width:
        least = packed
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        runs = np.maximum(size - width + 1, 0)
        within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        found.append(place_of(least[np.repeat(first, runs) + within]))
    return np.unique(np.concatenate(found))


def text_units(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, words, hash, gram, bands): paragraphs with their band keys; anchors, whose bands are empty, with the span to the next one's end."""
    wanted = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                yield units(batch.column(0).slice(at, len(texts)), texts)

    def units(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        own = [words_of(t) for t in texts]
        sizes = np.array([len(h) for h, _ in own], np.int64)
        first = np.cumsum(sizes) - sizes
        h = np.concatenate([h for h, _ in own])
        lines = np.concatenate([x + f for (_, x), f in zip(own, first)])
        lines = lines[lines[:, 1] - lines[:, 0] >= max(min_words, SHINGLE)]
        pieces = Pieces(h)
        bands = band_keys(shingles(h), lines[:, 0], lines[:, 1]) if len(lines) else np.zeros((0, BANDS), np.uint64)
        every = pieces.every(GRAM)
        held = sizes >= GRAM
        at = anchor_places(every, first[held], sizes[held] - GRAM + 1)
        # texts without words begin where the next one does; the last that begins there has the words
        text_at = lambda places: np.searchsorted(first, places, side="right") - 1
        following = np.append(at[1:], at[-1:])
        ends = np.where(text_at(following) == text_at(at), following, at) + GRAM
        start, stop = np.concatenate([lines[:, 0], at]), np.concatenate([lines[:, 1], ends])
        hashes = pieces.hashes(start, stop)
        # paragraphs and runs of words of the same length are told apart
        hashes[: len(lines)] = _mixed(hashes[: len(lines)] ^ _BASE)
        grams = np.concatenate([np.zeros(len(lines), np.uint64), every[at]])
        text = text_at(start)
        # an anchor's list is empty: cheaper to write than null, and told by it
        offsets = np.concatenate([np.arange(len(lines) + 1) * BANDS, np.full(len(at), len(lines) * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
        columns = [(start - first[text]).astype(np.int32), (stop - start).astype(np.int32), hashes.view(np.int64), grams.view(np.int64)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(text)), *map(pa.array, columns), lists], names=names)

    names = ["id", "start", "words", "hash", "gram", "bands"]
    return wanted.mapInArrow(run, "id long, start int, words int, hash long, gram long, bands array<long>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list]]:
    """(key, rows) of each run of equal first columns, over all batches of a task."""
    key, rows = None, []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[1:])
    if rows:
        yield key, rows


def colliding(paragraphs: DataFrame) -> DataFrame:
    """(u, v): each paragraph with the smallest of its band's, for bands that distinct paragraphs share."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for b in batches:
            keys, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            rep = np.where(lead < 0, first if first is not None else 0, hashes[np.maximum(lead, 0)])
            key, first = keys[-1], rep[-1]
            with_other = rep != hashes
            yield pa.RecordBatch.from_arrays([pa.array(hashes[with_other]), pa.array(rep[with_other])], names=["u", "v"])

    dealt = paragraphs.select(F.explode("bands").alias("key"), "hash").repartition("key").sortWithinPartitions("key", "hash")
    return dealt.mapInArrow(stars, "u long, v long").distinct()


def linked(items: list[tuple[int, frozenset]], threshold: float) -> list[tuple[int, int]]:
    """Links that connect all items that links of at least the threshold connect, and only those.

    Jaccard distance is a metric. Items stand under leaders within 1 - threshold; one that is farther from a leader than
    that and the leader's farthest item together has no link there, and in between only items of a fitting distance are compared.
    """
    limit = 1 - threshold + 1e-12
    sets: list[frozenset] = []
    under: list[list[tuple[float, int, frozenset]]] = []
    names: list[int] = []
    holding: dict[int, list[int]] = {}
    links = []
    for name, s in items:
        home = None
        for leader, common in Counter(x for v in s for x in holding.get(v, ())).items():
            d = 1 - common / (len(s) + len(sets[leader]) - common)
            if d <= limit:
                links.append((name, names[leader]))
                home = leader if home is None else home
                if home == leader:
                    near = d
            else:
                for e, other, t in under[leader]:
                    if d - limit <= e and (c := len(s & t)) and 1 - c / (len(s) + len(t) - c) <= limit:
                        links.append((name, other))
                        break
        if home is None:
            for v in s:
                holding.setdefault(v, []).append(len(sets))
            sets.append(s)
            names.append(name)
            under.append([])
        else:
            under[home].append((near, name, s))
    return links


def verified(docs: DataFrame, candidates: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v) links among candidates(hash, component, id, start), compared exactly on their shingles.

    Each candidate's text is read again from one document that has it. A component of up to BLOCK candidates is one
    comparison; the candidates of a larger one are dealt into blocks, and each pair of blocks is a comparison.
    """
    n = candidates.count()
    wanted = candidates.groupBy("id").agg(F.collect_list(F.struct("start", "words", "hash", "component", "blocks")).alias("need"))
    wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = []
                for text, need in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h, _ = words_of(text or "")
                    for x in need:
                        own = h[x["start"] : x["start"] + x["words"]]
                        if len(own) == x["words"]:  # else another row with this id
                            rows.append((x["hash"], x["component"], x["blocks"], np.unique(shingles(own)).view(np.int64)))
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["hash", "component", "blocks", "shingles"])

    sets = texts.select("text", "need").mapInArrow(read, "hash long, component long, blocks int, shingles array<long>")
    mine = F.pmod(F.xxhash64("hash"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j.cast("long"), mine).alias("a"), F.greatest(j.cast("long"), mine).alias("b")))
    dealt = sets.withColumn("pair", F.explode(pairs)).select(F.xxhash64("component", "pair.a", "pair.b").alias("key"), "hash", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            links = linked([(name, frozenset(s)) for name, s in dict(rows).items()], threshold)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])

    return dealt.repartition("key").sortWithinPartitions("key", "hash").mapInArrow(compare, "u long, v long")


def runs_around(docs: DataFrame, anchors: DataFrame, min_run: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, hash): all runs of min_run words within reach of the anchors(id, start, gram), as far as SURE words can lie."""
    wanted = anchors.groupBy("id").agg(F.collect_list(F.struct("start", "gram")).alias("need"))
    wanted = F.broadcast(wanted) if anchors.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted, "id")
    names = ["id", "start", "hash"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                of, starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, (text, need) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    h, _ = words_of(text or "")
                    pieces, n = Pieces(h), len(h)
                    place, gram = (np.array([x[k] for x in need], np.int64) for k in ("start", "gram"))
                    place, gram = place[place + GRAM <= n], gram[place + GRAM <= n]
                    place = place[pieces.hashes(place, place + GRAM).view(np.int64) == gram]  # else another row with this id
                    if n < min_run or not len(place):
                        continue
                    marks = np.zeros(n - min_run + 2, np.int64)
                    np.add.at(marks, np.clip(place - (SURE - GRAM), 0, n - min_run + 1), 1)
                    np.add.at(marks, np.clip(place + SURE - min_run + 1, 0, n - min_run + 1), -1)
                    found = np.flatnonzero(np.cumsum(marks)[:-1])
                    of.append(np.full(len(found), i))
                    starts.append(found)
                    hashes.append(pieces.hashes(found, found + min_run))
                ids = part.column(0).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=names)

    return texts.select("id", "text", "need").mapInArrow(read, "id long, start int, hash long")


_DOC = 32


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of intervals that overlap or touch; they stand by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def stretches(doc: np.ndarray, start: np.ndarray, end: np.ndarray, again: np.ndarray, node: np.ndarray, anchor: np.ndarray, min_run: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """[doc, start, end, kept, name] of documents' repeated stretches, and [node, name] links of what stands in one run.

    The rows stand by doc (a number from 0) and start: pieces that other documents have, `again` if an earlier one does. Pieces that
    overlap or touch are a run; an anchor's own words, without a piece (end 0), are none. Runs are cut where `again` changes.
    """
    base = doc.astype(np.int64) << _DOC
    start, piece = start + base, end > 0
    end = end + base
    a, b = merged(start[piece], end[piece])
    c, d = merged(start[piece & again], end[piece & again])
    none = np.zeros(0, np.int64)
    if not len(a):
        return [none, none, none, none.astype(bool), none], [none, none]
    # what lies between the parts that earlier documents have
    left, right = np.sort(np.concatenate([a, d])), np.sort(np.concatenate([c, b]))
    low, high = np.concatenate([left[right > left], c]), np.concatenate([right[right > left], d])
    kept = np.arange(len(low)) < len(low) - len(c)
    run = np.searchsorted(a, start, side="right") - 1
    inside = (run >= 0) & (start + GRAM <= b[run])
    least = np.full((2, len(a)), np.iinfo(np.int64).max)
    for k in (0, 1):
        own = inside & (anchor == bool(k))
        np.minimum.at(least[k], run[own], node[own])
    anchored = np.bincount(run[inside & anchor], minlength=len(a)) > 0
    name = np.where(anchored, least[1], least[0])
    long = b - a >= min_run
    of = np.searchsorted(a, low, side="right") - 1
    low, high, kept, of = low[long[of]], high[long[of]], kept[long[of]], of[long[of]]
    joins = inside & long[run] & (anchor == anchored[run]) & (node != name[run])
    links = np.unique(np.stack([node[joins], name[run][joins]], axis=1), axis=0)
    place = (1 << _DOC) - 1
    return [low >> _DOC, low & place, ((high - 1) & place) + 1, kept, name[of]], [links[:, 0], links[:, 1]]


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, which stand by their first column, in batches that cut no run of equal firsts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut or (held and held[0].column(0)[-1].as_py() != ids[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def repeated_stretches(docs: DataFrame, units: DataFrame, min_run: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, words, kept, hash, link): repeated stretches, whose link is null, and links of anchors, whose id is null."""
    found = units.where(F.size("bands") == 0).drop("bands")
    held = lambda df, key: df.groupBy(key).agg(F.min("id").alias("holder"), F.max("id").alias("last")).where("holder < last").drop("last")
    anchors = written(found.join(held(found, "gram").withColumnRenamed("holder", "least"), "gram"), "anchors")
    spans = held(anchors.where(F.col("words") > GRAM), "hash")
    behind = F.lag(F.struct("holder", (F.col("start") + F.col("words") - GRAM).alias("next"))).over(Window.partitionBy("id").orderBy("start", "hash"))
    placed = written(anchors.join(spans, "hash", "left").withColumn("behind", behind), "placed")
    # no other document can add to an anchor's two spans if its first holder has both
    settled = (F.col("holder") == F.col("least")) & (F.col("behind.holder") == F.col("least")) & (F.col("behind.next") == F.col("start"))
    ends = placed.where(~F.coalesce(settled, F.lit(False))).select("gram").distinct()
    windows = written(runs_around(docs, written(placed.join(ends, "gram").select("id", "start", "gram"), "ends"), min_run, id_col, text_col), "windows")
    again = F.coalesce(F.col("holder") < F.col("id"), F.lit(False)).alias("again")
    end = F.when(F.col("holder").isNull(), 0).otherwise(F.col("start") + F.col("words")).alias("end")
    pieces = placed.select("id", "start", end, again, F.col("gram").alias("hash"), F.lit(True).alias("anchor"))
    pieces = pieces.unionAll(windows.join(held(windows, "hash"), "hash").select("id", "start", (F.col("start") + min_run).alias("end"), again, "hash", F.lit(False).alias("anchor")))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_documents(batches):
            ids, start, end, again, node, anchor = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            doc = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
            out, links = stretches(doc, start, end, again, node, anchor, min_run)
            first = ids[np.searchsorted(doc, out[0])]
            n, m = len(first), len(links[0])
            yield pa.RecordBatch.from_arrays(
                [
                    padded(first, 0, m), padded(out[1].astype(np.int32), 0, m), padded((out[2] - out[1]).astype(np.int32), 0, m), padded(out[3], 0, m),
                    pa.array(np.concatenate([out[4], links[0]])), padded(links[1], n, 0),
                ],
                names=["id", "start", "words", "kept", "hash", "link"],
            )

    def padded(values: np.ndarray, before: int, behind: int) -> pa.Array:
        own = pa.array(values)
        return pa.concat_arrays([pa.nulls(before, own.type), own, pa.nulls(behind, own.type)])

    return pieces.repartition("id").sortWithinPartitions("id", "start").mapInArrow(sweep, "id long, start int, words int, kept boolean, hash long, link long")


def repeated_passages(docs: DataFrame, threshold: float = 0.8, min_words: int = 20, min_run: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_word, n_words, cluster_id, kept): the paragraphs and passages that occur in several documents.

    Words are runs without ASCII white space, numbered from 0 in their text. kind is `paragraph` for a line of min_words or
    more whose cluster (similarity of threshold or more, by links) spans documents, `passage` for a stretch of words, each in a
    run that another document has, exact to the word. Every run of SURE words that two documents have is found whole; shorter ones,
    down to min_run words, where they hold an anchor in both. kept is true for a cluster's first paragraph, by id and place, and for
    a passage that no earlier document has; a run is cut into passages where this changes, and those not kept can be
    removed. Null and empty texts have none. Rows that repeat an id are one
    document. An empty table gives an empty one. Ids of any type that can be sorted are kept as they are; rows with a null id are left out.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        ids = written(global_rank(docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct(), [F.col("id")], "number"), "numbers")
        numbered = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, "id").select("number", "text")
        found = repeated_passages(numbered, threshold, min_words, min_run, "number", "text")
        return found.join(ids, "number").select(F.col("id").alias(id_col), *found.columns[1:])
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    units = written(text_units(known, min_words, id_col, text_col), "units")
    lines = units.where(F.size("bands") > 0)
    distinct = lines.groupBy("hash").agg(F.min(F.struct("id", "start", "words")).alias("first"), F.max("id").alias("last"), F.first("bands").alias("bands"))
    groups = connected_components(colliding(distinct)).withColumnRenamed("node", "hash")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    places = lines.groupBy("hash").agg(F.min(F.struct("id", "start", "words")).alias("first"))
    candidates = written(places.join(groups, "hash").join(sizes, "component").select("hash", "component", "blocks", "first.*"), "candidates")
    links = verified(known, candidates, threshold, id_col, text_col)

    repeated = written(repeated_stretches(known, units, min_run, id_col, text_col), "repeated")
    beside = repeated.where("link is not null").select(F.col("hash").alias("u"), F.col("link").alias("v"))

    nodes = connected_components(links.unionAll(beside)).withColumnRenamed("node", "hash")
    named = lambda df: df.join(nodes, "hash", "left").withColumn("cluster", F.coalesce("component", "hash")).drop("component")

    clustered = named(lines.groupBy("hash").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last")))
    spans = clustered.groupBy("cluster").agg(F.min("first").alias("lead"), F.max("last").alias("most")).where("lead.id < most").drop("most")
    flagged = clustered.join(spans, "cluster").select("hash", "cluster", "lead")
    paragraphs = lines.drop("gram", "bands").distinct().join(flagged, "hash").select(
        "id", F.lit("paragraph").alias("kind"), F.col("start").cast("long").alias("start_word"), F.col("words").cast("long").alias("n_words"),
        F.col("cluster").alias("cluster_id"), (F.struct("id", "start") == F.col("lead")).alias("kept"),
    )
    passages = named(repeated.where("link is null")).select(
        "id", F.lit("passage").alias("kind"), F.col("start").cast("long").alias("start_word"), F.col("words").cast("long").alias("n_words"),
        F.col("cluster").alias("cluster_id"), "kept",
    )
    return paragraphs.unionAll(passages).withColumnRenamed("id", id_col)


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words that found, as repeated_passages gives it, lists as not kept. All rows and columns, of any name, stay."""
    of, own_spans = unused(docs.columns, "__id"), unused(docs.columns, "__spans")
    spans = found.where("not kept").groupBy(F.col(f"`{id_col}`").alias(of)).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(own_spans))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")

        def one(text, own):
            if text is None or own is None or not len(own):
                return text
            places, out, at = [m.span() for m in word.finditer(text)], [], 0
            for s in own:
                a, b = places[s["start_word"]][0], places[s["start_word"] + s["n_words"] - 1][1]
                out.append(text[at : max(a, at)])
                at = max(at, b)
            return "".join([*out, text[at:]])

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    kept = cut(F.col(f"`{text_col}`"), F.col(own_spans))
    return docs.join(spans, F.col(f"`{id_col}`") == F.col(of), "left").withColumn(text_col, kept).select([F.col(f"`{c}`") for c in docs.columns])
