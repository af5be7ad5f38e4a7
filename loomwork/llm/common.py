"""What the text operators share: Arrow passes over (id, text) in small slices, word numbers and filters of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that are held as Python objects at once.
SLICE_ROWS = 128


def map_texts(docs: DataFrame, id_col: str, text_col: str, fields: str, start: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """One Arrow pass: every row's text (null: empty) to any number of rows of `fields`, each led by the id, kept as it is.

    start() runs once in each task and returns the function of a text. Only the two named columns are read, so further
    columns, whatever their names, neither cost nor clash. Rows with equal ids or texts are worked one by one.
    """
    wanted = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([T.StructField(id_col, wanted.schema["id"].dataType), *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows, of = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = work(text or "")
                    rows += found
                    of += [i] * len(found)
                columns = list(zip(*rows, strict=True)) or [()] * (len(arrow) - 1)
                ids = part.column(0).take(pa.array(of, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return wanted.mapInArrow(run, out)


def unused(columns: list[str], stem: str) -> str:
    """A column name that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Bits of a fixed-size filter: 4 MB, whatever it stands for.
FILTER_BITS = 1 << 25
_BLOCK_BITS = 1 << 15


def filter_bits(keys: DataFrame, col: str) -> Broadcast:
    """A broadcast bit array of FILTER_BITS bits, in which the slot (lowest bits) of each 64-bit key of `col` is set.

    It has the same size at any number of keys: what it lets through is a superset, more of one as more keys are in it, so a
    reader must confirm by a join. At most FILTER_BITS / 32,768 rows of 4 kB come to the driver.
    """
    slot = F.col(col).bitwiseAND(F.lit(FILTER_BITS - 1))
    at = F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(F.lit(_BLOCK_BITS - 1)).alias("place")
    blocks = keys.select(*at).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    bits = np.zeros((FILTER_BITS // _BLOCK_BITS, _BLOCK_BITS // 8), np.uint8)
    for row in blocks.collect():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's slot is set in a filter's bits."""
    slots = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 != 0


class WordNumbers(dict):
    """Words (UTF-8) to 64-bit hashes; forgets all when it holds very many. `fixed` gives words numbers of their own."""

    def __init__(self, seed: int = 0, most: int = 1 << 19, fixed: dict[bytes, int] | None = None) -> None:
        super().__init__(fixed or {})
        self.seed, self.most, self.fixed = seed, most, fixed or {}

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = number = xxh64_intdigest(word, self.seed)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.update(self.fixed)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Each unsigned 64-bit number with its bits well spread."""
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def gram_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` numbers."""
    n = max(0, len(numbers) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + n]
    return mixed(out)
