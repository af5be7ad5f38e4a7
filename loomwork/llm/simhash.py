"""SimHash fingerprints of word shingles, and their near-duplicate components by BK-trees.

Fingerprints at most `radius` bits apart agree wholly in one of radius + 1 blocks of their bits, and, within the other
bits, wholly in one of radius + 1 blocks again. Every distinct fingerprint goes to the shard of each such pair of
blocks; any two that link meet in one. A shard is a BK-tree: children are keyed by their integer distance to the parent,
and a search follows only edges within the radius of its own distance. A shard with very many values is dealt again by
blocks of the bits that its key leaves open, so often that few values can share them all. The shards are dealt out by a shuffle and
not broadcast, since together they grow with the documents. A task gives a shard's links as a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts, unused
from loomwork.operators.components import connected_components
from loomwork.session import written


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """The SimHash as a signed 64-bit integer: bit i is set if it is in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < size:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        hashes = [xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(len(words) - size + 1)]
    each = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(each), 4096):
        counts += np.unpackbits(each[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(each), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long). Words are split at ASCII white space, A-Z in lower case; a null or wordless text has fingerprint 0."""
    return map_texts(docs, id_col, text_col, "fp long", lambda: lambda text: [(fingerprint(text, size, seed),)])


class BKTree:
    """Integers under Hamming distance; a node is [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while (d := (node[0] ^ value).bit_count()) and (child := node[1].get(d)):
            node = child
        if d:
            node[1][d] = [value, {}]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


#: Values from which a shard is dealt again, and open bits at which it no longer is: 2 ** OPEN_BITS values at most can differ there.
HOT_SHARD, OPEN_BITS = 10_000, 13


def shard_masks(radius: int) -> dict[int, list[int]]:
    """The masks of bits by which values are dealt, and for each mask those by which a hot shard of it is dealt again.

    Key 0 holds the first ones: one block of all bits and one of the bits outside it. A mask that leaves OPEN_BITS or fewer has none.
    """
    tree: dict[int, list[int]] = {}

    def further(held: list[int]) -> list[list[int]]:
        rest = [b for b in range(64) if b not in held]
        return [held + part for part in _parts(rest, radius + 1)]

    def number(bits: list[int]) -> int:
        m = sum(1 << b for b in bits)
        return m - (1 << 64) if m >> 63 else m

    tree[0] = [number(second) for first in further([]) for second in further(first)]
    todo = [second for first in further([]) for second in further(first)]
    while todo:
        held = todo.pop()
        if 64 - len(held) > OPEN_BITS:
            deeper = further(held)
            tree[number(held)] = [number(d) for d in deeper]
            todo += deeper
    return tree


def shards(distinct: DataFrame, radius: int = 2, hot: int = HOT_SHARD) -> DataFrame:
    """(mask, bits, fp): each value in its shards, of which none that can be dealt again holds over `hot` values."""
    tree = shard_masks(radius)
    deal = lambda masks: F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for m in masks]))
    dealt = distinct.select("fp", deal(tree[0]).alias("s")).select("s.*", "fp")
    out = None
    while True:
        full = dealt.groupBy("mask", "bits").count().where((F.col("count") > hot) & F.col("mask").isin(list(tree)))
        full = written(full.select("mask", "bits"), "hot-shards")
        some = full.limit(1).count() > 0
        done = dealt.join(full, ["mask", "bits"], "left_anti") if some else dealt
        out = done if out is None else out.unionByName(done)
        if not some:
            return out
        held = dealt.join(full, ["mask", "bits"], "left_semi")
        again = F.coalesce(*[F.when(F.col("mask") == m, F.array(*map(F.lit, masks))) for m, masks in tree.items() if m])
        held = held.select("fp", F.explode(again).alias("mask"))
        dealt = written(held.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp").distinct(), "dealt-again")


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, earlier one) of one shard, one for each tree of the growing forest that a value joins."""
    parent = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, links = BKTree(), []
    for v in values:
        near = tree.within(v, radius)
        tree.add(v)
        parent[v] = v
        for x in near:
            a, b = root(x), root(v)
            if a != b:
                parent[b] = a
                links.append((v, x))
    return links


def link_forest(distinct: DataFrame, radius: int = 2, hot: int = HOT_SHARD) -> DataFrame:
    """(u, v) links among distinct values of column fp that connect what all links within the radius connect."""
    dealt = shards(distinct, radius, hot).select("fp", F.xxhash64("mask", "bits").alias("shard"))

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in pairs_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([signed(x[i]) for x in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
        shard, values, out = None, [], []
        for b in batches:
            for s, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != shard:
                    if len(values) > 1:
                        out += _forest(values, radius)
                    shard, values = s, []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield out
                out = []
        if len(values) > 1:
            out += _forest(values, radius)
        yield out

    return dealt.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(trees, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id), a row for each document; component_id is the smallest id reachable over links.

    Equal fingerprints link, whatever the texts: wordless ones among each other. Copies are one value until the end, so a
    group's size costs nothing but its rows. Repeated rows give repeated results; an empty table an empty one.
    """
    prints = written(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    groups = connected_components(link_forest(distinct.select("fp"), radius))
    linked = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = written(linked, "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(linked.join(least, "component").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = 2, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id, a null id counting as the largest.

    Of a component's rows with this id, the smallest hash of the text, then of the whole row, decides; rows that are alike
    throughout are one. Rows are told apart by content, so rows with one id, or none, and different texts stay apart.
    """
    own = F.struct(F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]).alias("r"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), own.alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    # the print's id is the row's key: a struct of id and hashes, carried through the pass over the texts
    key = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    prints = written(fingerprints(keyed.select(key.alias("key"), F.col("__text").alias("text")), size, seed, "key", "text"), "row-fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    groups = connected_components(link_forest(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.id").alias("id"), F.col("least.row").alias("row")).distinct()
    names = [unused(docs.columns, stem) for stem in ("__id_of", "__row_of", "__id", "__row")]
    rows = docs.withColumns({names[0]: F.col(f"`{id_col}`"), names[1]: own})
    met = F.col(names[0]).eqNullSafe(F.col(names[2])) & (F.col(names[1]) == F.col(names[3]))
    return rows.join(kept.toDF(*names[2:]), met, "left_semi").dropDuplicates(names[:2]).select([F.col(f"`{c}`") for c in docs.columns])
