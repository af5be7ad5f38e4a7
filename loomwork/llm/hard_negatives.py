"""Hard negatives by exact integer similarity: Strassen products of anchor and candidate tiles, then mergeable heaps.

Components become integers, so that scores are exact and reruns agree. Candidates are packed into tiles where they lie;
anchors, a stated query set, into tiles of their own. Every pair of tiles meets once by an equality key of the two tile
numbers. A pair's scores come from Strassen's recursion on int64 arrays, padded with zeros to even sides: seven products
of half the size instead of eight, and additions, all exact. Two passes over the pairs: the first keeps each anchor's
best positives, the second, for each positive, the best negatives whose scores lie in its window. Both are heaps of a fixed size that tasks
fill over their pairs and that merge by ranking, so no task or group holds more than heaps of its tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.session import written

ANCHOR_ROWS = 1024
CANDIDATE_ROWS = 4096
LEAF = 16
#: A hundred times a score must fit in 64 bits.
MOST_SCORE = 1 << 56
#: Stands for a null id in order: behind all others.
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two matrices; odd sides are padded with a row or column of zeros. Sides up to `leaf` are multiplied plainly.

    Sums inside may wrap around, which 64-bit arithmetic undoes: only the product's own entries must fit.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h], out[:i, h:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :h], out[i:, h:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_vectors(rows: DataFrame, scale: int, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v): components times scale, rounded down. Rows with a null label, a null vector or a component that is null or not finite go."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(label.isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


_TILE = "tile long, ids array<long>, labels array<long>, width int, values array<long>"


def tiles(vectors: DataFrame, size: int) -> DataFrame:
    """Up to `size` vectors a row, packed partition by partition without a shuffle; shorter vectors are filled up with zeros."""
    schema = T.StructType.fromDDL(_TILE)
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 33, [], 0

        def tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, labels, vectors = ([x for p in parts for x in p.column(c).to_pylist()] for c in range(3))
            width = max(map(len, vectors), default=0)
            values = np.zeros((len(vectors), width), np.int64)
            for r, v in enumerate(vectors):
                values[r, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, ids, labels, width, values.reshape(-1)), arrow)], schema=arrow)

        for batch in batches:
            while batch.num_rows:
                take = min(size - rows, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, rows = batch.slice(take), rows + take
                if rows == size:
                    yield tile(held)
                    number, held, rows = number + 1, [], 0
        if rows:
            yield tile(held)

    return vectors.mapInArrow(pack, schema)


def paired(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each pair of an anchor tile and a candidate tile once: they meet in the cell of a grid with about one tile of each kind.

    Only the two counts of tiles come to the driver. The tiles of one side are repeated for each cell of the other, so neither is broadcast.
    """
    across, down = max(1, candidates.count()), max(1, anchors.count())
    cell = lambda n: F.expr(f"pmod(xxhash64(tile), {n})")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    named = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns]
    a = anchors.select(*named(anchors, "a"), cell(down).alias("row"), every(across).alias("col"))
    c = candidates.select(*named(candidates, "c"), cell(across).alias("col"), every(down).alias("row"))
    return a.hint("merge").join(c, ["row", "col"]).drop("row", "col")


def tile_of(row: pa.StructScalar | dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of one side of a pair."""
    ids = row[f"{side}_ids"].values.fill_null(_NO_ID).to_numpy()
    labels = row[f"{side}_labels"].values.to_numpy()
    return ids, labels, row[f"{side}_values"].values.to_numpy().reshape(len(ids), -1)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if width and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width > MOST_SCORE:
        raise ValueError("scaled components are too large for scores of 64 bits")
    return strassen(a, np.ascontiguousarray(b.T))


class Heaps:
    """The k best (score, id) of each slot of each anchor tile: what is offered is merged in, and what is given out merges by the same order."""

    NONE = -(1 << 62)

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def offer(self, tile: int, n_slots: int, offers: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Each offer: a slot, scores and ids."""
        scores, ids = np.full((n_slots, self.k), self.NONE), np.full((n_slots, self.k), _NO_ID)
        for slot, s, of in offers:
            if len(s) > 4 * self.k:
                high = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]  # ties at the end stay
                s, of = s[high], of[high]
            first = np.lexsort((of, -s))[: self.k]
            scores[slot, : len(first)], ids[slot, : len(first)] = s[first], of[first]
        if tile in self.held:
            scores, ids = (np.concatenate(x, axis=1) for x in zip(self.held[tile], (scores, ids)))
            first = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            scores, ids = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)
        self.held[tile] = scores, ids

    def empty(self) -> Iterator[pa.RecordBatch]:
        for tile, (scores, ids) in self.held.items():
            slot, at = np.nonzero(scores != self.NONE)
            ids = ids[slot, at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), tile)), pa.array(slot), pa.array(scores[slot, at]), pa.array(ids, mask=ids == _NO_ID)], ["a_tile", "slot", "score", "id"])
        self.held = {}


def heaps_over(pairs: DataFrame, k: int, slots: int, offers) -> DataFrame:
    """(a_tile, slot, place, score, id): the k best of each slot over all pairs. A task merges what its own pairs offer.

    offers(row, a, c) gives the offers of a pair; an anchor tile has `slots` of them for each anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                a, c = tile_of(row, "a"), tile_of(row, "c")
                heaps.offer(row["a_tile"].as_py(), len(a[0]) * slots, offers(row, a, c))
                if len(heaps.held) >= 32:
                    yield from heaps.empty()
        yield from heaps.empty()

    found = pairs.mapInArrow(run, "a_tile long, slot long, score long, id long")
    order = Window.partitionBy("a_tile", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column | str, n_positives: int = 5, n_negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256,
    id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` holds for.

    Rows with a null label or vector, or a component that is null or not finite, take no part. A row without an id is never an anchor
    but may be found, behind others of its score (so may the id 2**63 - 1, which is read as none). Positives are rows of the anchor's label with another id than its own;
    repeated rows are rows of their own there and among negatives, while anchors that are alike in all three columns
    count once. Shorter vectors are filled up with zeros. Anchors without positives, and positives without negatives,
    give no row; an empty table none. Scaled components whose products pass 56 bits end the job with an error. Further columns are not read.
    """
    label = F.col("label") if label is None else label
    vectors = integer_vectors(rows, scale, id_col, label, vector_col)
    held = integer_vectors(rows.where(anchor), scale, id_col, label, vector_col).where(F.col("id").isNotNull())
    candidates = written(tiles(vectors, CANDIDATE_ROWS), "candidates")
    anchors = written(tiles(held.distinct(), ANCHOR_ROWS), "anchors")
    low, high = window

    def positives_of(row, a, c):
        scores = scores_of(a[2], c[2])
        for i, (own, label_) in enumerate(zip(a[0], a[1])):
            mine = (c[1] == label_) & (c[0] != own)
            yield i, scores[i, mine], c[0][mine]

    def negatives_of(row, a, c):
        scores = scores_of(a[2], c[2])
        for i, label_ in enumerate(a[1]):
            others = c[1] != label_
            s, ids = scores[i, others], c[0][others]
            for slot, positive in zip(*(row[x][i].as_py() for x in ("a_slots", "a_scores"))):
                fit = (100 * s >= low * positive) & (100 * s <= high * positive)
                yield i * n_positives + slot, s[fit], ids[fit]

    found = written(heaps_over(paired(anchors.drop("width"), candidates.drop("width")), n_positives, 1, positives_of), "positives")
    best = found.select(F.col("a_tile").alias("tile"), "slot", (F.col("place") - 1).alias("place"), "score")
    by_anchor = best.groupBy("tile", "slot").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("best"))
    by_tile = by_anchor.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("best"))
    nothing = F.array().cast("array<struct<place:int,score:bigint>>")
    lists = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.coalesce(F.try_element_at("best", i.cast("long")), nothing))
    told = anchors.drop("width").join(by_tile, "tile").withColumn("best", lists)
    told = told.select("tile", "ids", "labels", "values", F.expr("transform(best, x -> x.place)").alias("slots"), F.expr("transform(best, x -> x.score)").alias("scores"))
    negatives = heaps_over(paired(told, candidates.drop("width")), n_negatives, n_positives, negatives_of)
    anchor_ids = anchors.select(F.col("tile").alias("a_tile"), F.posexplode("ids").alias("anchor", "anchor_id"))
    positives = found.select("a_tile", F.col("slot").alias("anchor"), (F.col("place") - 1).alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    slot = F.col("slot")
    return (
        negatives.select("a_tile", F.expr(f"slot div {n_positives}").alias("anchor"), (slot % n_positives).alias("at"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(positives, ["a_tile", "anchor", "at"]).join(anchor_ids, ["a_tile", "anchor"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
