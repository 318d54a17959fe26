"""Packing token sequences: length combinations by non-negative least squares, then greedily."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.llm import textnum
from cohortwise.llm.common import gapless_rank, ship_package, written
from cohortwise.llm.tokens import word_tokenizer

WINDOW = 4096
CLASSES = 64
DEPTH = 4
BLOCK = 64  # a piece is cut after a multiple of so many ids


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW,
                 id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 keep_ids: bool = False) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, and cut them into pieces of a window or less.

    One row per piece: id, start, length, ids_crc32, doc_tokens, cut_crcs (the CRC-32 of what lies before
    each place where a piece that does not fill a window may be cut) and, with ``keep_ids``, ids
    (binary, little-endian unsigned 32-bit).  All but a document's last piece fill a window.  A null text
    is empty and has the one id ``end_id``.
    """
    fields = [pa.field("start", pa.int64()), pa.field("length", pa.int64()),
              pa.field("ids_crc32", pa.int64()), pa.field("doc_tokens", pa.int64()),
              pa.field("cut_crcs", pa.binary())]
    if keep_ids:
        fields.append(pa.field("ids", pa.binary()))
    end = np.array([end_id], dtype="<u4").tobytes()

    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer_path)
        for batch in batches:
            row = 0
            for run in textnum.chunked(textnum.each_text(batch.column(1))):
                columns: list[list] = [[] for _ in range(len(fields) + 1)]
                for ids in encoder.encode(run):
                    ids += end
                    for at in range(0, len(ids), 4 * window):
                        piece = ids[at : at + 4 * window]
                        values = (row, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4,
                                  _cut_crcs(piece) if len(piece) < 4 * window else b"")
                        for column, value in zip(columns, values):
                            column.append(value)
                        if keep_ids:
                            columns[-1].append(piece)
                    row += 1
                own = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own, *[pa.array(c, f.type) for c, f in zip(columns[1:], fields)]],
                    names=[id_col, *[f.name for f in fields]])

    types = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *[T.StructField(f.name, types[f.type]) for f in fields]])
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def _cut_crcs(piece: bytes) -> bytes:
    crcs, crc = [], 0
    for at in range(0, len(piece) - 4 * BLOCK, 4 * BLOCK):
        crc = zlib.crc32(piece[at : at + 4 * BLOCK], crc)
        crcs.append(crc)
    return np.array(crcs, dtype="<u4").tobytes()


def crc_of_part(before: int, until: int, length: int) -> int:
    """The CRC-32 of ``length`` bytes, from that of all bytes before them and that of both."""
    nothing = bytes(length)
    return until ^ zlib.crc32(nothing, before) ^ zlib.crc32(nothing)


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling class lists of 2 to ``depth`` parts whose classes add up to a whole window."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0 and len(parts) > 1:
            found.append(parts)
        if left and len(parts) < depth:
            for c in range(min(left, parts[-1] if parts else classes - 1), 0, -1):
                extend((*parts, c), left - c)

    extend((), classes)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400, tolerance: float = 1e-9) -> np.ndarray:
    """Least squares with x >= 0 by an active set: add the steepest column, drop negative ones."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    scale = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= scale:
            break
        active.append(best)
        while active:
            free = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (free > 0).all():
                break
            now = x[active]
            low = free <= 0
            share = float((now[low] / np.maximum(now[low] - free[low], 1e-300)).min())
            now = now + share * (free - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = [j for j in active if x[j] > 1e-12]
        x[:] = 0
        if active:
            x[active] = free
    return x


@dataclass(frozen=True)
class Template:
    """``repeats`` sequences of the same make-up: (length, how many) in order.

    ``cut`` (length, head) is one piece more, of which the head ends the sequence; its tail is a
    piece for later templates.
    """

    repeats: int
    parts: tuple[tuple[int, int], ...]
    cut: tuple[int, int] | None = None


def plan_templates(histogram: dict[int, int], window: int = WINDOW, classes: int = CLASSES,
                   depth: int = DEPTH, block: int = BLOCK) -> list[Template]:
    """Sequences for all pieces counted in ``histogram`` (length to number of pieces).

    Shallow combinations of length classes that fill the window are enumerated; non-negative least
    squares finds how often each should occur to meet the histogram; the numbers are rounded
    down.  Each combination then takes the longest pieces left of its classes, and what the real
    lengths leave open is filled greedily with the longest pieces that fit.  Where none fits and
    ``block`` tokens or more are open, the longest piece left is cut after a multiple of ``block`` and
    its tail goes back to the histogram.  What remains is packed greedily in the same way, so that
    all but the last sequence are padded by less than ``block``.  A template repeats until a length runs out or a combination
    is done, so their number depends on the window and not on the corpus.
    """
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    width = -(-window // classes)
    plan: list[Template] = []

    def longest(limit: int, above: int = 0) -> int:
        have = np.flatnonzero(left[above + 1 : limit + 1])
        return int(have[-1]) + above + 1 if len(have) else 0

    def emit(start: list[int], most: int) -> int:
        """Fill up one sequence from ``start``; repeat it as often as pieces last, at most ``most``."""
        parts: dict[int, int] = {}
        for length in start:
            parts[length] = parts.get(length, 0) + 1
        if any(left[x] < m for x, m in parts.items()):
            return 0
        open_ = window - sum(start)
        limit = open_
        while length := longest(min(open_, limit)):
            more = min(open_ // length, int(left[length]) - parts.get(length, 0))
            if more:
                parts[length] = parts.get(length, 0) + more
                open_ -= more * length
            limit = length - 1
        used, cut = dict(parts), None
        if open_ >= block:
            for x in np.flatnonzero(left)[::-1].tolist():
                if left[x] > parts.get(x, 0):
                    cut = (x, open_ // block * block)
                    used[x] = used.get(x, 0) + 1
                    break
        repeats = min([most, *(int(left[x]) // m for x, m in used.items())])
        for x, m in used.items():
            left[x] -= m * repeats
        if cut:
            left[cut[0] - cut[1]] += repeats
        plan.append(Template(repeats, tuple(sorted(parts.items(), reverse=True)), cut))
        return repeats

    while left[window]:
        emit([window], int(left[window]))
    of_class = np.minimum((np.arange(window + 1) + width - 1) // width, classes)
    wanted = np.bincount(of_class, weights=left, minlength=classes + 1)[1:classes].astype(float)
    shallow = combinations(classes, depth)
    if wanted.sum() and shallow:
        matrix = np.zeros((classes - 1, len(shallow)))
        for j, parts in enumerate(shallow):
            for c in parts:
                matrix[c - 1, j] += 1
        times = np.floor(nnls(matrix, wanted) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(times), key=lambda j: shallow[j], reverse=True):
            todo = int(times[j])
            while todo > 0:
                start = [longest(c * width, (c - 1) * width) for c in shallow[j]]
                if not all(start):
                    break
                # If a class has too few of its longest length, one of each is a start as well.
                used = emit(start, todo) or emit(sorted(set(start), reverse=True), todo)
                todo -= used
    while (length := longest(window)):
        emit([length], int(left[length]))
    return plan


def places(plan: list[Template]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: one entry per template and length.

    Of an entry's pieces ``head`` tokens go there.  Tails have ranks behind the whole pieces of their
    length, from ``tail`` on.
    """
    uses = [(t, length, many) for t in plan
            for length, many in (*t.parts, *([(t.cut[0], 1)] if t.cut else []))]
    behind: Counter[int] = Counter()
    for t, length, many in uses:
        behind[length] += many * t.repeats
    for t in plan:
        if t.cut:
            behind[t.cut[0] - t.cut[1]] -= t.repeats
    rows, sequence = [], 0
    ranks: Counter[int] = Counter()
    for t in plan:
        offset = 0
        for length, many in t.parts:
            rows.append((length, ranks[length], many, sequence, offset, length, 0))
            ranks[length] += many * t.repeats
            offset += length * many
        if t.cut:
            length, head = t.cut
            rows.append((length, ranks[length], 1, sequence, offset, head, behind[length - head]))
            ranks[length] += t.repeats
            behind[length - head] += t.repeats
        sequence += t.repeats
    rows.sort()
    names = ("length", "rank", "many", "sequence", "offset", "head", "tail")
    table = np.array(rows, dtype=np.int64).reshape(-1, len(names))
    return {name: table[:, i] for i, name in enumerate(names)}


def pack(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset, so that no sequence is longer than the window.

    The driver gets the histogram of lengths alone (at most ``window`` rows) and plans templates
    from it.  Pieces are ranked within their length, in 4,096 parts each, and a rank has its
    place in the plan.  A piece that the plan cuts becomes several rows, whose CRCs follow from
    ``cut_crcs``.  Repeated rows and ties are pieces like any other; an empty table
    gives an empty result.
    """
    content = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                          "start", "ids_crc32")
    stable = written(pieces.withColumn("__place", F.md5(content)))
    histogram = {r["length"]: r["n"] for r in
                 stable.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan_templates(histogram, window))
    ranked = gapless_rank(stable, ["length"], F.substring("__place", 1, 3), ["__place"], "__rank")
    step = 1 << 48
    keys = table["length"] * step + table["rank"]
    columns = [c for c in pieces.columns if c != "cut_crcs"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("length").to_numpy()
            row, size, rank = np.arange(len(whole)), whole, batch.column("__rank").to_numpy()
            at = np.zeros(len(whole), dtype=np.int64)
            found = []
            while len(row):
                i = np.searchsorted(keys, size * step + rank, side="right") - 1
                nth, many, head = rank - table["rank"][i], table["many"][i], table["head"][i]
                found.append((row, at, head, table["sequence"][i] + nth // many,
                              table["offset"][i] + nth % many * size))
                more = head < size
                row, at, size, rank = (x[more] for x in (
                    row, at + head, size - head, table["tail"][i] + nth))
            if not found:
                continue
            row, at, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
            out = batch.take(pa.array(row))
            values = {"start": pa.array(out.column("start").to_numpy() + at), "length": pa.array(length),
                      "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            crcs = out.column("ids_crc32").to_numpy().copy()
            ids = out.column("ids").to_pylist() if "ids" in columns else None
            for j in np.flatnonzero(length < whole[row]).tolist():
                begin, end = int(at[j]), int(at[j] + length[j])
                cuts = np.frombuffer(out.column("cut_crcs")[j].as_py(), "<u4")
                until = int(crcs[j]) if end == whole[row[j]] else int(cuts[end // BLOCK - 1])
                before = int(cuts[begin // BLOCK - 1]) if begin else 0
                crcs[j] = crc_of_part(before, until, 4 * (end - begin)) if begin else until
                if ids:
                    ids[j] = ids[j][4 * begin : 4 * end]
            values["ids_crc32"] = pa.array(crcs)
            if ids:
                values["ids"] = pa.array(ids, pa.binary())
            names = [*columns, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(
                [values[c] if c in values else out.column(c) for c in names], names=names)

    schema = T.StructType([*[pieces.schema[c] for c in columns],
                           T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.select(*pieces.columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``token_pieces`` and ``pack``.

    Null ids and repeated rows are documents like any other; other columns are not looked at.
    """
    return pack(token_pieces(docs, tokenizer_path, window, id_col, text_col, end_id, keep_ids),
                window, id_col)
