"""Bounded-space online packing of tokenised documents into windows of a fixed length.

Each input partition keeps at most `open_windows` windows open. Whole windows of a document go out by themselves. The
rest goes to the open window that it fits best; where it fits none and no more may be opened, the fullest one is
filled up with the rest's first ids and emitted. Windows left open at the end of a partition are merged, those of
FAN_IN partitions at a time: the fullest are filled from the emptiest, and the one that remains is cut into runs whose
lengths are powers of two. So no sequence needs padding. An id lies in exactly one piece.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each; a long text
fills many windows; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import io
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, written
from .word_tokens import WordBpe

WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 8
END_ID = 1
ROWS_OUT, IDS_OUT = 20_000, 1 << 19
TEXT_AT_ONCE = 2 << 20


@lru_cache(2)
def tokenizer(file: bytes) -> WordBpe:
    """Of the content of a file; workers need not see the driver's path."""
    return WordBpe(io.StringIO(file.decode("utf-8")))


def tokenised(batches, bpe: WordBpe, id_col: str):
    """(id, ids with the end id) per document."""
    for batch, data, offs in text_batches(batches, limit=TEXT_AT_ONCE):
        raw = data.tobytes()
        docs = [raw[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        ids, sizes = bpe.ids([w for d in docs for w in d])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = ends[np.concatenate(([0], np.cumsum([len(d) for d in docs])))]
        for doc, a, b in zip(batch.column(id_col).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield doc, np.append(ids[a:b], np.uint32(END_ID))


class Packer:
    """Open windows of one partition; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rooms: list[int] = []  # ascending
        self.open: list[list] = []  # pieces of the window with that room

    def add(self, doc, ids: np.ndarray):
        """Places a document; yields the windows that are complete."""
        n, at = len(ids), 0
        while n - at >= self.window:
            yield [(doc, at, ids[at : at + self.window], n)]
            at += self.window
        while at < n:
            need = n - at
            k = bisect.bisect_left(self.rooms, need)
            if k == len(self.rooms) and len(self.rooms) < self.most:
                self._put(self.window - need, [(doc, at, ids[at:], n)])
                return
            take = need if k < len(self.rooms) else self.rooms[k := 0]
            room, pieces = self.rooms.pop(k), self.open.pop(k)
            pieces.append((doc, at, ids[at : at + take], n))
            at += take
            if room > take:
                self._put(room - take, pieces)
            else:
                yield pieces

    def _put(self, room: int, pieces: list) -> None:
        k = bisect.bisect_left(self.rooms, room)
        self.rooms.insert(k, room)
        self.open.insert(k, pieces)


def merged(windows: list[list], window: int):
    """Fills the fullest of the windows from the emptiest; the last one leaves as powers of two."""
    size = lambda pieces: sum(len(p[2]) for p in pieces)
    heap = sorted(windows, key=size, reverse=True)
    lo, hi, rest = 0, len(heap) - 1, None
    while lo <= hi:
        out, lo = heap[lo], lo + 1
        room = window - size(out)
        while room and lo <= hi:
            doc, start, ids, n = heap[hi].pop()
            out.append((doc, start, ids[:room], n))
            if len(ids) > room:
                heap[hi].append((doc, start + room, ids[room:], n))
            room -= min(room, len(ids))
            if not heap[hi]:
                hi -= 1
        if room:
            rest = out
            break
        yield out
    left = size(rest) if rest else 0
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            doc, start, ids, n = rest.pop()
            out.append((doc, start, ids[:want], n))
            if len(ids) > want:
                rest.append((doc, start + want, ids[want:], n))
            want -= min(want, len(ids))
        yield out


def _rows(columns: dict, schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, its ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part", "slot"]

    def emit(columns, pieces, sequence, part=None, slot=None, ids_too=keep_ids):
        offset = 0
        for doc, start, ids, n in pieces:
            raw = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, ids.astype(np.int32) if ids_too else None, part, slot)
            for name, value in zip(names, row, strict=True):
                columns[name].append(value)
            offset += len(ids)

    def first(batches):
        part, count, packer = TaskContext.get().partitionId(), 0, Packer(window, open_windows)
        columns, held = {n: [] for n in names}, 0
        bpe = tokenizer(shared.value)
        for doc, ids in tokenised(batches, bpe, "doc_id"):
            for pieces in packer.add(doc, ids):
                emit(columns, pieces, (part << 40) + count)
                count += 1
            held += len(ids)
            if len(columns["doc_id"]) >= ROWS_OUT or held >= IDS_OUT:
                yield _rows(columns, arrow)
                columns, held = {n: [] for n in names}, 0
        for slot, pieces in enumerate(packer.open):
            emit(columns, pieces, None, part, slot, True)
        if columns["doc_id"]:
            yield _rows(columns, arrow)
        bpe.forget()  # the worker lives on

    def last(key, table):
        columns = {n: [] for n in names}
        group = key[0].as_py()
        table = table.sort_by([("part", "ascending"), ("slot", "ascending"), ("offset", "ascending")])
        windows: dict = {}
        for r in table.to_pylist():
            windows.setdefault((r["part"], r["slot"]), []).append((r["doc_id"], r["start"], np.array(r["ids"], np.uint32), r["doc_tokens"]))
        for count, pieces in enumerate(merged(list(windows.values()), window)):
            emit(columns, pieces, ((1 << 21) + group << 40) + count)
        return pa.Table.from_batches([_rows(columns, arrow)])

    full = f"{fields}, ids array<int>, part long, slot int"
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    arrow = to_arrow_schema(spark.createDataFrame([], full).schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    online = written(texts.mapInArrow(first, full))
    done = online.where("sequence_id IS NOT NULL")
    left = online.where("sequence_id IS NULL").withColumn("group", F.expr(f"part div {FAN_IN}"))
    out = done.unionByName(left.groupBy("group").applyInArrow(last, full))
    return out.drop("part", "slot") if keep_ids else out.drop("part", "slot", "ids")
