"""Top N rows of every group by a loser-tree merge of sorted runs.

1. Each input partition is sorted by (bucket, group, order) on the JVM side, which
   spills when it must.  That is a *run*.  While it streams by, all but the first N
   rows of each group of the run are left out - a row that isn't among the first N
   of its own run can't be among the first N of all - and the rest is stored as one
   compressed block per bucket.  So a hot group contributes N rows per run to the
   shuffle, however large it is, and is never gathered.
2. Blocks are shuffled by bucket, a hash of the group.  A task takes one bucket after
   the other and merges its blocks with a loser tree.  Of each block one page is held at
   a time.  Once N rows of the leading group are out, every block *seeks* its next group:
   by halving within the page, and past whole pages that end in the group.

Rows are compared by one binary key whose byte order equals the order asked for,
so a comparison in the tree is one comparison of ``bytes``.

Defined results: rows whose group is null, and rows whose leading order column is
null or not a number, are left aside.  Nulls in a later order column come last.
-0.0 equals 0.0.  Equal rows keep one order if the last order column is unique;
repeated rows count as rows.  An empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sumizh.session import width

#: Rows of a stored block at most; a longer run of a bucket is stored as several blocks.  Rows of a page.
BLOCK_ROWS, PAGE_ROWS = 1 << 16, 1 << 12
#: Buckets for each task of the merge, which holds one at a time.
BUCKETS = 4


def _string_key(column: pa.Array) -> pa.Array:
    """Bytes whose order is the code point order, ended so that no prefix problem arises."""
    raw = column.cast(pa.binary())
    if pc.any(pc.match_substring(raw, b"\x00")).as_py():
        raw = pc.replace_substring(raw, b"\x00", b"\x00\xff")
    return pc.binary_join_element_wise(raw, b"\x00\x00", b"")


def _fixed_key(values: np.ndarray, descending: bool) -> pa.Array:
    """Eight bytes per value in the order of the values."""
    if values.dtype.kind == "f":
        bits = (values.astype("f8") + 0.0).view("i8")
        keys = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view("u8")
    else:
        keys = values.astype("i8").view("u8") ^ np.uint64(1 << 63)
    if descending:
        keys = ~keys
    data = keys.astype(">u8").tobytes()
    offsets = np.arange(0, 8 * len(values) + 1, 8, dtype="i4")
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def order_keys(batch: pa.RecordBatch | pa.Table, order: Sequence[tuple[str, bool]]) -> list[pa.Array]:
    """The parts of the binary key for ``order``: (column, descending) pairs."""
    parts: list[pa.Array] = []
    for name, descending in order:
        column = batch.column(name)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            if descending:
                raise ValueError("a string order column can only be ascending")
            key = _string_key(pc.fill_null(column, ""))
        else:
            nothing = 0.0 if pa.types.is_floating(column.type) else 0
            key = _fixed_key(pc.fill_null(column, nothing).to_numpy(zero_copy_only=False), descending)
        if column.null_count:
            mark = pc.if_else(pc.is_null(column), pa.scalar(b"\x02"), pa.scalar(b"\x01"))
            key = pc.if_else(pc.is_null(column), pa.scalar(b""), key)
        else:
            mark = pa.scalar(b"\x01")
        parts += [mark, key]
    return parts


def _ranks(groups: pa.Array, carried: tuple[object, int] | None) -> tuple[np.ndarray, tuple[object, int]]:
    """Place of each row within its stretch of equal groups, going on from the last batch."""
    n = len(groups)
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first = groups[0].as_py()
    offset = 0
    if carried is not None and carried[0] == first:
        new[0] = False
        offset = carried[1]
    starts = np.where(new, np.arange(n), -1)
    begun = np.maximum.accumulate(starts)
    ranks = np.where(begun < 0, np.arange(n) + offset, np.arange(n) - np.maximum(begun, 0))
    return ranks, (groups[n - 1].as_py(), int(ranks[-1]) + 1)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks(), max_chunksize=PAGE_ROWS)
    return sink.getvalue().to_pybytes()


def _form_runs(order: Sequence[tuple[str, bool]], payload: Sequence[str], n: int):
    """Trim the sorted stream of a partition to N a group and store it block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        bucket: int | None = None
        carried = None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([_pack(pa.concat_tables(held))], pa.binary())],
                names=["bucket", "block"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ranks, carried = _ranks(batch.column("grp"), carried)
            kept = batch.filter(pa.array(ranks < n))
            if not kept.num_rows:
                continue
            group = _string_key(kept.column("grp"))
            key = pc.binary_join_element_wise(group, *order_keys(kept, order), b"")
            table = pa.table([key, pc.binary_length(group), *(kept.column(p) for p in payload)], names=["k", "g", *payload])
            buckets = kept.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
            for lo, hi in zip(cuts, cuts[1:]):
                if bucket is not None and (buckets[lo] != bucket or sum(map(len, held)) >= BLOCK_ROWS):
                    yield block()
                    held = []
                bucket = int(buckets[lo])
                held.append(table.slice(lo, hi - lo))
        if held:
            yield block()

    return run


#: Greater than any key, so that a used-up run loses every match.
END = b"\xff" * 9


class Run:
    """A sorted run, read page by page: (keys, lengths of their parts that are the group, rows)."""

    def __init__(self, pages: Iterable[tuple[list[bytes], list[int], object]]) -> None:
        self.pages = iter(pages)
        self.picked: list[int] = []
        self.places: list[int] = []
        #: Rows kept of pages that were turned: (rows, positions, places).
        self.kept: list[tuple[object, list[int], list[int]]] = []
        self.rows: object = None
        self._turn()

    def _turn(self) -> None:
        if self.picked:
            self.kept.append((self.rows, self.picked, self.places))
            self.picked, self.places = [], []
        self.at = 0
        self.keys, self.lengths, self.rows = next((p for p in self.pages if p[0]), ([], [], None))

    @property
    def head(self) -> bytes:
        return self.keys[self.at] if self.keys else END

    @property
    def group(self) -> bytes:
        return self.keys[self.at][: self.lengths[self.at]]

    def keep(self, place: int) -> None:
        """Take the row at the head, and go on to the next."""
        self.picked.append(self.at)
        self.places.append(place)
        self.at += 1
        if self.at == len(self.keys):
            self._turn()

    def seek(self, group: bytes) -> None:
        """Go on to the first row that isn't of the group."""
        while self.keys and self.keys[-1].startswith(group):
            self._turn()
        low, high = self.at, len(self.keys)
        while low < high:
            middle = (low + high) // 2
            if self.keys[middle].startswith(group):
                low = middle + 1
            else:
                high = middle
        self.at = low


class LoserTree:
    """Tournament over the heads of sorted runs; each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Run]) -> None:
        self.k = len(runs)
        self.runs = runs
        self.heads = [run.head for run in runs]
        self.losers = [0] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[right] < self.heads[left]:
            left, right = right, left
        self.losers[node] = right
        return left

    def moved(self) -> None:
        """The winning run went on: play its matches again up to the root."""
        winner = self.winner
        heads, losers = self.heads, self.losers
        head = heads[winner] = self.runs[winner].head
        node = (winner + self.k) >> 1
        while node:
            other = losers[node]
            rival = heads[other]
            if rival < head:
                losers[node] = winner
                winner, head = other, rival
            node >>= 1
        self.winner = winner


def merge_top_n(runs: list[Run], n: int) -> None:
    """Have the runs keep the first ``n`` rows of each group over all of them."""
    tree = LoserTree(runs)
    while runs and (head := tree.heads[tree.winner]) is not END:
        group = runs[tree.winner].group
        place = 0
        while head.startswith(group):
            run = runs[tree.winner]
            if place < n:
                place += 1
                run.keep(place)
            else:
                run.seek(group)
            tree.moved()
            head = tree.heads[tree.winner]


def _pages(block: bytes) -> Iterator[tuple[list[bytes], list[int], pa.RecordBatch]]:
    for page in pa.ipc.open_stream(block):
        yield page.column("k").to_pylist(), page.column("g").to_pylist(), page


def _merge(payload: Sequence[str], n: int, schema: pa.Schema):
    """Merge the blocks of each bucket of a partition, in which buckets come one after the other."""

    def merged(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs = [Run(_pages(b)) for b in blocks]
        merge_top_n(runs, n)
        parts = []
        for run in runs:
            for rows, at, places in run.kept:
                parts.append(pa.Table.from_batches([rows.select(list(payload))]).take(pa.array(at, pa.int64())).append_column("place", pa.array(places, pa.int32())))
        if parts:
            yield from pa.concat_tables(parts).cast(schema).combine_chunks().to_batches(max_chunksize=BLOCK_ROWS)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        bucket = None
        for batch in batches:
            for number, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if number != bucket and blocks:
                    yield from merged(blocks)
                    blocks = []
                bucket = number
                blocks.append(block.as_buffer())
        if blocks:
            yield from merged(blocks)

    return buckets


def top_n(df: DataFrame, group: str, order: Sequence[tuple[str, bool]], payload: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each value of ``group``, with their ``place`` from 1.

    ``order``: (column, descending) pairs; strings ascending only, by code points.
    ``payload``: the columns that come out beside ``place``.
    """
    lead = F.col(order[0][0])
    kept = df.where(F.col(group).isNotNull() & lead.isNotNull())
    if isinstance(df.schema[order[0][0]].dataType, (T.DoubleType, T.FloatType)):
        kept = kept.where(~F.isnan(lead))
    tasks = width(df.sparkSession)
    buckets = BUCKETS * tasks
    # own names, so that no column of the table can clash with another
    rows = kept.select(
        F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(group).cast("string").alias("grp"),
        *(F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(order)),
        *(F.col(c).alias(f"v{i}") for i, c in enumerate(payload)),
    )
    named = [(f"o{i}", descending) for i, (_, descending) in enumerate(order)]
    values = [f"v{i}" for i in range(len(payload))]
    sort = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in named]
    runs = rows.sortWithinPartitions("bucket", "grp", *sort).mapInArrow(_form_runs(named, values, n), "bucket int, block binary")
    types = [df.schema[c].dataType for c in payload]
    inner = T.StructType([*(T.StructField(v, t) for v, t in zip(values, types)), T.StructField("place", T.IntegerType())])
    merged = runs.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(values, n, to_arrow_schema(inner)), inner)
    return merged.select(*(F.col(v).alias(c) for v, c in zip(values, payload)), "place")
