"""Best-fit packing of tokenized documents into sequences of a fixed capacity, by large-item matching.

Pieces longer than a third of the capacity stand at most twice in a sequence: they are paired greedily, the longest with
the longest that still fits. Shorter pieces then go, longest first, each to the fullest sequence that still holds it.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths, which never has more
entries than the capacity, and its decisions are runs of equal sequences. Spark ranks the pieces within their length and
looks up the run that holds each rank; no piece passes the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts
from loomwork.operators.running import running_sum
from loomwork.session import written

#: Pieces of one length that one task ranks.
RANKED_TOGETHER = 1000


def encoder(ranks_path: str, pattern: str):
    """text -> numpy array of ids, those that the byte-level BPE of these ranks gives.

    The pattern's lookahead for runs of white space is its slowest part, and matters only where two white-space
    characters stand together; other texts go through the same pattern without it.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens=special)
    gaps = re.compile(r"\s\s")
    return lambda text: (whole if gaps.search(text) else plain).encode_to_numpy(text, allowed_special="all")


def tokenized_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the token ids of each text and end_id, cut into pieces.

    A null or empty text is the end id alone. A document of at most `capacity` ids is one piece; of a longer one all
    pieces but the first have `capacity` ids. Repeated rows give repeated pieces. An empty table gives none.
    """

    def start():
        encode = encoder(ranks_path, pattern)

        def work(text: str) -> list[tuple]:
            ids = np.append(encode(text), end_id).astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            rows = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = ids[a:b]
                rows.append((k, a, b - a, zlib.crc32(part.tobytes())) + ((part.astype(int).tolist(),) if keep_ids else ()))
            return rows

        return work

    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_texts(docs, id_col, text_col, fields, start)


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, pieces per sequence, offset) for runs of equal sequences.

    histogram: how many pieces have each length from 1 to capacity. A run's pieces fill its sequences in turn,
    `pieces per sequence` to each. A sequence's gap at least halves between two lengths it takes in the second step,
    and each length opens a bounded number of runs, so the plan is bounded by the capacity, not by the pieces.
    """
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    taken = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, sequences)]
    gaps: list[int] = []
    sequences = 0

    def put(n: int, first: int, bins: int, each: int, offset: int, pieces: int | None = None) -> None:
        count = bins * each if pieces is None else pieces
        plan.append((n, taken[n], taken[n] + count, first, each, offset))
        taken[n] += count
        left[n] -= count

    def leave(gap: int, first: int, bins: int) -> None:
        if bins and gap:
            if gap not in open_runs:
                insort(gaps, gap)
            open_runs.setdefault(gap, []).append((first, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            mates = [m for m in large if m + n <= capacity and left[m] > (m == n)]
            mate = max(mates, default=0)
            if not mate:
                bins, pair = left[n], 0
            elif mate == n:
                bins, pair = left[n] // 2, n
            else:
                bins, pair = min(left[n], left[mate]), mate
            put(n, sequences, bins, 2 if pair == n else 1, 0)
            if pair and pair != n:
                put(pair, sequences, bins, 1, n)
            leave(capacity - n - pair, sequences, bins)
            sequences += bins

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        at = bisect_left(gaps, n)
        while left[n] and at < len(gaps):
            gap = gaps[at]
            first, bins = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(at)
            each = min(gap // n, left[n])
            full = min(bins, left[n] // each)
            put(n, first, full, each, capacity - gap)
            leave(gap - each * n, first, full)
            first, bins = first + full, bins - full
            if bins and left[n] and left[n] < each:
                rest = left[n]
                put(n, first, 1, rest, capacity - gap)
                leave(gap - rest * n, first, 1)
                first, bins = first + 1, bins - 1
            leave(gap, first, bins)
            at = bisect_left(gaps, n)
        if left[n]:
            each = capacity // n
            full, rest = divmod(left[n], each)
            if full:
                put(n, sequences, full, each, 0)
                leave(capacity - each * n, sequences, full)
                sequences += full
            if rest:
                put(n, sequences, 1, rest, 0)
                leave(capacity - rest * n, sequences, 1)
                sequences += 1
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset (both long) to pieces of 1 to capacity tokens; sequences have no gaps from 0.

    `pieces` is read twice: give a written table where it is costly. order names the columns that number pieces of
    equal length; they need not be unique, as such pieces are interchangeable. A piece of another length is an error. An empty table
    gives an empty one. Columns of other names are kept.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # as many rows as lengths: capacity at most
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    plan = plan_packing(counts, capacity)
    names = "__length long, __low long, __high long, __first long, __each long, __offset long"
    runs = F.broadcast(spark.createDataFrame(plan, names))
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()], "__length long, __blocks long"))
    salted = pieces.join(salts, F.col(length_col) == F.col("__length")).drop("__length")
    ranked = running_sum(salted, [length_col], F.pmod(F.xxhash64(*order), F.col("__blocks")), [F.col(c) for c in order], F.lit(1), "__rank")
    placed = ranked.join(runs, (F.col(length_col) == F.col("__length")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    nth = F.col("__rank") - F.col("__low")
    placed = placed.withColumn("sequence_id", F.col("__first") + F.expr("(__rank - __low) div __each"))
    placed = placed.withColumn("offset", F.col("__offset") + (nth % F.col("__each")) * F.col(length_col))
    return placed.drop("__length", "__low", "__high", "__first", "__each", "__offset", "__rank", "__blocks")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs every document; the pieces are written once.

    With keep_ids each piece has its ids. They stay out of the packing, which moves a few dozen bytes for each piece, and are joined on by
    the number that the piece was written with.
    """
    pieces = tokenized_pieces(docs, ranks_path, pattern, capacity, end_id, keep_ids)
    if not keep_ids:
        return pack(written(pieces, "pieces"), capacity)
    held = written(pieces.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    return pack(held.drop("ids"), capacity).join(held.select("__piece", "ids"), "__piece").drop("__piece")


def in_sequence_order(packed: DataFrame, together: int = 64) -> DataFrame:
    """packed, dealt in blocks of `together` sequences: each partition, and each file it is written to, holds whole sequences one after the other.

    Sequences are numbered without gaps, so their blocks need no sample of the rows.
    """
    return packed.repartition(F.expr(f"sequence_id div {together}")).sortWithinPartitions("sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids: what a trainer reads. Each group has capacity ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
