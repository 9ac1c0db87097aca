"""Suffix-array dedup: removes passages of 50 bytes or more that an earlier document has too.

Bucket-pointer refinement orders suffixes by bucketing them on their first q bytes
and refining each bucket by the buckets in which the suffixes at later offsets lie;
a bucket with one member is never touched again. A bucket's identifier here is a hash
of the bytes that its members share, so that every task knows the identifier at any
offset of its own texts without asking another. Only the first 50 bytes of a suffix
matter, and only whether its bucket holds a smaller document, so:

1. Initial q-gram buckets (q = 20). Of the positions in each 50-byte window one is
   enough, if equal windows choose equal positions: the window's smallest q-gram
   identifier. A bucket is refined if it holds two documents.
2. Members of a bucket are sorted by the identifiers of later and earlier offsets, as far
   as any window around the position reaches (80 bytes): the identifiers of two q-grams
   20 bytes apart give that of 40 bytes, and the updated identifiers are used again for
   the whole reach. Members of one refined bucket share all their windows, so that all
   but the smallest document lose them whole.
3. Only the smallest document of each refined bucket goes on, if its q-gram bucket
   split. A window holds the 15 bytes before its position, or the 15 bytes after its
   q-gram (both at once in one case): so the 35-byte buckets on the left and on the
   right (two q-grams 15 bytes apart) are refined, each to the 50-byte buckets of its
   windows (40 bytes and the q-gram at offset 30).

Why this ends at depth 50: two equal 50-byte windows choose the same position, so
they meet in one q-gram bucket. Either they lie in one refined bucket (2), or the
smallest documents of their refined buckets stand for them in (3), where the equal
window lies in one 35-byte bucket and then in one 50-byte bucket. A document that is
not the smallest of its refined bucket has lost all windows around the position in (2).

Buckets are told apart by hashes: 80 bytes by 64 bits beside 32 of their q-gram,
50 bytes by 64 bits beside 64 of their 35-byte bucket.

Skew: within a batch only the smallest document of a refined bucket travels, the
others are settled on the spot. q-grams that a sample shows to be common are dealt
out by their refined bucket. A 35-byte bucket of more than MOST members is dealt out
by window instead of being held in one task. No case is left out by any of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, cut, dealt_anew, documents, forget, mix, partitions, range_hash, running_hash, text_bytes

#: Bytes of a passage, of an initial bucket, and q-grams in a passage.
LENGTH, Q = 50, 20
WINDOW = LENGTH - Q + 1
#: Bytes before and after the q-gram in the 35-byte buckets.
SIDE = (LENGTH - Q) // 2
_POSITION = np.uint64((1 << 24) - 1)
#: Windows of a long text that are looked at together; with what they reach, their positions fit into _POSITION.
SEGMENT = 1 << 20
#: Text bytes of which a map task sends blocks, and of which a range holds the positions.
BATCH_BYTES, RANGE_BYTES = 4 << 20, 64 << 20
#: Documents of the sample that finds common q-grams, documents of it that make one common, and how many are kept.
SAMPLE, COMMON, MOST_COMMON = 4000, 8, 50_000
#: Members of 35-byte buckets that a task looks at together, and beyond which a bucket is dealt out by window.
TOGETHER, MOST = 50_000, 50_000

NORMAL, SETTLED, SPREAD = 0, 1, 2  # kinds of blocks
COVERED, OPEN, MASKS = 1, 2, 3  # what a document's places are


# --- bucket identifiers ------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """The identifier of the initial bucket at each position that a q-gram starts at."""
    at = np.arange(max(0, len(data) - Q + 1))
    return range_hash(running_hash(data), at, at + Q)


def _refined_by(own: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of buckets refined by the identifiers at a later offset: equal where both are."""
    return mix(mix(own ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) + later)


def _reach(grams: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Identifiers of the bytes [low, high), 2 * Q to 4 * Q of them: of 2 * Q bytes at both ends, which overlap, and the length."""
    twice = lambda at: _refined_by(grams[at], grams[at + Q])
    return _refined_by(_refined_by(twice(low), twice(high - 2 * Q)), (high - low).astype(np.uint64))


# --- positions ---------------------------------------------------------------


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """For each window of WINDOW hashes where its smallest stands, of equal ones the leftmost."""
    best = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(best) - (WINDOW - width)], best[WINDOW - width :])
    return (best & _POSITION).astype(np.int64)


def _chosen(data: np.ndarray, at: np.ndarray, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, ...]:
    """Byte in data, text, bucket and refined bucket of the positions that the windows of texts choose (of those that start in [begin, end))."""
    windows = np.zeros(len(data) + 1, np.int8)
    long = np.diff(at) >= LENGTH
    windows[at[:-1][long]] += 1
    windows[at[1:][long] - LENGTH + 1] -= 1
    windows = np.flatnonzero(np.cumsum(windows, dtype=np.int8))
    windows = windows[(windows >= begin) & (windows < (len(data) if end is None else end))]
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = _grams(data)
    own = _smallest(grams)[windows]
    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    text = np.searchsorted(at, own, side="right") - 1
    low, high = np.maximum(own - (WINDOW - 1), at[text]), np.minimum(own + LENGTH, at[text + 1])
    return own, text, grams[own], _refined_by(_reach(grams, low, high), (own - low).astype(np.uint64))


def positions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place in its text, text, bucket and refined bucket of each chosen position; a single long text is taken in segments."""
    if len(data) <= 2 * SEGMENT:
        own, text, bucket, refined = _chosen(data, at)
        return own - at[text], text, bucket, refined
    found = []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
        for s in range(x, max(x, y - LENGTH + 1), SEGMENT):
            low, high = max(x, s - WINDOW + 1), min(y, s + SEGMENT + WINDOW + LENGTH)
            own, _, bucket, refined = _chosen(data[low:high], np.array([0, high - low]), s - low, s - low + SEGMENT)
            i = int(np.searchsorted(at, x, side="right")) - 1
            found.append((own + low - x, np.full(len(own), i), bucket, refined))
    own, text, bucket, refined = (np.concatenate(c) for c in zip(*found)) if found else _chosen(data[:0], np.zeros(1, np.int64))
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])  # neighbouring segments may choose the same
    return own[new], text[new], bucket[new], refined[new]


# --- initial buckets and their refinement ------------------------------------


def _common(texts: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the q-grams that many documents of a small sample have: those are dealt out. Bounded by MOST_COMMON."""
    few = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, text, bucket, _ = positions(*text_bytes(batch.column("text")))
            order = np.lexsort((text, bucket))
            text, bucket = text[order], bucket[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
            own, n = np.unique(bucket[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["bucket", "n"])

    counted = few.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(f"n >= {COMMON}")
    rows = counted.orderBy(F.desc("n"), "bucket").limit(MOST_COMMON).select("bucket").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


_BLOCK = "range int, kind int, bucket binary, refined binary, place binary, many binary, docs binary, prints binary"


def _initial(ranges: int, common):
    """Blocks of positions, one for each range and batch: buckets, refined buckets, places, and how many each document has."""

    def blocks(kind: int, own: np.ndarray, bucket: np.ndarray, refined: np.ndarray, place: np.ndarray, row: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((row, own))
        own, row, place = own[order], row[order], place[order]
        bucket, refined = (x[order] if len(x) else x for x in (bucket, refined))
        cuts = np.searchsorted(own, np.arange(ranges + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[i], cuts[i + 1])
            here = np.flatnonzero(np.concatenate([[True], row[s][1:] != row[s][:-1]]))
            docs = row[s][here]
            many = np.diff(np.append(here, cuts[i + 1] - cuts[i]))
            yield i, kind, bucket[s].tobytes(), refined[s].tobytes(), place[s].tobytes(), many.astype(np.uint32).tobytes(), ids[docs].tobytes(), prints[docs].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=BATCH_BYTES):
            ids, prints = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
            by_id = np.lexsort((prints, ids))
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))  # rows in the order of their ids
            again = np.zeros(len(ids), bool)
            again[by_id[1:]] = (ids[by_id[1:]] == ids[by_id[:-1]]) & (prints[by_id[1:]] == prints[by_id[:-1]])
            done, found = 0, []
            for part in chunks(iter([batch])):
                place, text, bucket, refined = positions(*text_bytes(part.column("text")))
                keep = ~again[done + text]  # the same row once more has the same places
                found.append((place[keep].astype(np.uint32), rank[done + text[keep]], bucket[keep], refined[keep]))
                done += part.num_rows
            place, row, bucket, refined = (np.concatenate(x) for x in zip(*found))
            ids, prints = ids[by_id], prints[by_id]
            order = np.argsort(refined, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = refined[order[1:]] != refined[order[:-1]]
            starts = np.flatnonzero(new)
            smallest = np.empty(len(order), np.int64)
            if len(starts):
                smallest[order] = ids[np.minimum.reduceat(row[order], starts)][np.cumsum(new) - 1]
            later = ids[row] > smallest  # an earlier document of this batch has it all
            spread = ~later & _among(bucket, common.value)
            normal = ~later & ~spread
            n = np.uint64(ranges)
            rows = [
                *blocks(NORMAL, (bucket[normal] % n).astype(np.int64), (bucket[normal] // n).astype(np.uint32), refined[normal], place[normal], row[normal], ids, prints),
                *blocks(SETTLED, (mix(ids[row[later]].astype(np.uint64)) % n).astype(np.int64), bucket[:0], refined[:0], place[later], row[later], ids, prints),
                *blocks(SPREAD, (refined[spread] % n).astype(np.int64), bucket[:0], refined[spread], place[spread], row[spread], ids, prints),
            ]
            if rows:
                kinds = [pa.int32()] * 2 + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    return run


def _by_document(flag: int, ids: np.ndarray, prints: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, print, flag, places): the values of each document side by side."""
    order = np.lexsort((prints, ids))
    ids, prints = ids[order], prints[order]
    packed = np.column_stack([v[order].astype(np.uint32) for v in values])
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(ids))
    for s in range(0, len(at), 20_000):
        a, b = at[s : s + 20_000], ends[s : s + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(prints[a]), pa.array(np.full(len(a), flag, np.int32)), pa.array([packed[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())], ["doc_id", "print", "flag", "places"])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where ordered rows begin another group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the buckets with two documents: which places a smaller document of the refined bucket covers, and which go on."""
    held: dict[tuple, list[tuple]] = {}
    for batch in batches:
        for r, kind, bucket, refined, place, many, docs, prints in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            many = np.frombuffer(many, np.uint32)
            rows = (np.frombuffer(place, np.uint32), np.repeat(np.frombuffer(docs, np.int64), many), np.repeat(np.frombuffer(prints, np.int32), many))
            if kind == SETTLED:
                yield from _by_document(COVERED, rows[1], rows[2], rows[0])
            else:
                held.setdefault((r, kind), []).append((np.frombuffer(bucket, np.uint32), np.frombuffer(refined, np.uint64), *rows))
    for own in list(held):
        bucket, refined, place, doc, prints = (np.concatenate(x) for x in zip(*held.pop(own)))
        if own[1] == NORMAL:
            # buckets of one document by far: drop them before the full sort
            order = np.argsort(bucket, kind="stable")
            new = _groups(bucket[order])
            starts = np.flatnonzero(new)
            low, high = (f.reduceat(doc[order], starts) for f in (np.minimum, np.maximum))
            keep = order[(low < high)[np.cumsum(new) - 1]]
            bucket, refined, place, doc, prints = (x[keep] for x in (bucket, refined, place, doc, prints))
            if not len(keep):
                continue
        else:
            bucket = np.zeros(len(refined), np.uint32)
        order = np.lexsort((doc, refined, bucket))
        bucket, refined, place, doc, prints = (x[order] for x in (bucket, refined, place, doc, prints))
        first = _groups(bucket, refined)
        covered = doc > doc[first][np.cumsum(first) - 1]
        # a refined bucket's smallest document goes on if its q-gram bucket has another refined bucket
        edge = _groups(bucket)
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(edge))
        goes_on = ~covered & ((kinds > 1)[np.cumsum(edge) - 1] | (own[1] == SPREAD))
        for flag, which in ((COVERED, covered), (OPEN, goes_on)):
            if which.any():
                yield from _by_document(flag, doc[which], prints[which], place[which])


_PLACES = "doc_id long, print int, flag int, places binary"


# --- refinement to full depth ------------------------------------------------


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open positions' bytes on the left and on the right, with their 35-byte buckets; start is where the bytes begin in the text."""
    for batch in chunks(batches):
        data, at = text_bytes(batch.column("text"))
        own = [np.unique(np.frombuffer(b"".join(x), np.uint32)).astype(np.int64) for x in batch.column("places").to_pylist()]
        text = np.repeat(np.arange(len(own)), [len(x) for x in own])
        if not len(text):
            continue
        here = np.concatenate(own) + at[text]
        grams = _grams(data)
        low, high = np.maximum(here - (WINDOW - 1), at[text]), np.minimum(here + LENGTH, at[text + 1])
        raw = data.tobytes()
        for salt, begin, end, core, close in (
            (0, low, np.minimum(here + Q + SIDE, high), here - SIDE, here + Q),  # windows from low to here - SIDE
            (1, np.maximum(here - SIDE + 1, low), high, here, here + Q + SIDE),  # windows from here - SIDE + 1 on
        ):
            full = np.flatnonzero((core >= begin) & (close <= end) & (end - begin >= LENGTH))
            if not len(full):
                continue
            key = mix(_refined_by(grams[core[full]], grams[close[full] - Q]) + np.uint64(salt)).view(np.int64)
            pieces = [raw[x:y] for x, y in zip(begin[full].tolist(), end[full].tolist())]
            own_text = pa.array(text[full])
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(own_text), batch.column("print").take(own_text), pa.array(begin[full] - at[text[full]]), pa.array(pieces, pa.binary())], ["key", "doc_id", "print", "start", "bytes"])


def _windows(key: np.ndarray, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its bytes and bucket of every 50-byte window."""
    data, at = text_bytes(column)
    many = np.maximum(np.diff(at) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(many)), many)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    begin = at[row] + inner
    return row, inner, _refined_by(_reach(_grams(data), begin, begin + LENGTH), key.view(np.uint64)[row])


def _refine(table: pa.Table) -> pa.Table:
    """Masks of the covered windows of members of whole 35-byte buckets."""
    key, doc = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
    order = np.argsort(key, kind="stable")
    new = _groups(key[order])
    starts = np.flatnonzero(new)
    low, high = (f.reduceat(doc[order], starts) for f in (np.minimum, np.maximum))
    kept = order[(low < high)[np.cumsum(new) - 1]]
    out = pa.schema([("doc_id", pa.int64()), ("print", pa.int32()), ("flag", pa.int32()), ("places", pa.binary())])
    if not len(kept):
        return out.empty_table()
    few = table.take(pa.array(kept)).combine_chunks()
    doc, prints, start = (few.column(c).to_numpy() for c in ("doc_id", "print", "start"))
    row, inner, bucket = _windows(few.column("key").to_numpy(), few.column("bytes").chunk(0))
    order = np.argsort(bucket, kind="stable")
    new = _groups(bucket[order])
    smallest = np.empty(len(row), np.int64)
    smallest[order] = np.minimum.reduceat(doc[row[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    covered = doc[row] > smallest
    mask = np.bincount(row[covered], weights=np.exp2(inner[covered]), minlength=len(doc)).astype(np.int64)  # 16 windows at most
    some = np.flatnonzero(mask)
    return pa.Table.from_batches(_by_document(MASKS, doc[some], prints[some], start[some], mask[some]), out) if len(some) else out.empty_table()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "bytes", 1 << 19):
        row, inner, bucket = _windows(batch.column("key").to_numpy(), batch.column("bytes"))
        at = batch.column("start").to_numpy()[row] + inner
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column("print").take(pa.array(row)), pa.array(at)], ["bucket", "doc_id", "print", "start"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            start = batch.column("start").to_numpy()
            yield from _by_document(MASKS, batch.column("doc_id").to_numpy(), batch.column("print").to_numpy(), start, np.ones(len(start)))


def _refined(sides: DataFrame) -> DataFrame:
    """The covered windows in 35-byte buckets, as places of documents."""
    keys = sides.groupBy("key").agg(F.count("*").alias("n"))
    large = cut(keys.where(f"n > {MOST}").select("key"), "large")  # a table of its own: mostly so small that the joins broadcast it
    small = sides.join(large, "key", "left_anti")
    bins = max(1, -(-sides.count() // TOGETHER))
    masks = small.groupBy(F.pmod("key", F.lit(bins)).alias("bin")).applyInArrow(_refine, _PLACES)
    windows = sides.join(large, "key").mapInArrow(_dealt, "bucket long, doc_id long, print int, start long")
    smallest = windows.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("bucket", "low")
    later = windows.join(dealt_anew(smallest, "bucket"), "bucket").where("doc_id > low").select("doc_id", "print", "start")
    return masks.unionByName(later.mapInArrow(_single, _PLACES))


# --- results -----------------------------------------------------------------


def _spans(size: int, found: list | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's maximal covered runs."""
    low, high = [], []
    for e in found or []:
        values = np.frombuffer(e["places"], np.uint32).astype(np.int64)
        if e["flag"] == COVERED:
            low.append(np.maximum(values - (WINDOW - 1), 0))
            high.append(np.minimum(values + LENGTH, size))
        else:
            row, bit = np.nonzero(values[1::2, None] >> np.arange(WINDOW) & 1)
            low.append(values[::2][row] + bit)
            high.append(low[-1] + LENGTH)
    if not low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.concatenate(low), np.concatenate(high)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new], np.append(high[:-1][new[1:]], high[-1])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        data, at = text_bytes(batch.column("text"))
        out: list[list] = [[], [], [], []]
        for x, y, found in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("found").to_pylist()):
            low, high = _spans(y - x, found)
            sha = hashlib.sha256()
            for s, e in zip([0, *high.tolist()], [*low.tolist(), y - x]):
                sha.update(data[x + s : x + e])
            for column, value in zip(out, (y - x, int((high - low).sum()), len(low), sha.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _without(names: list[str]):
    """The texts without their covered runs, each run shrunk to whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, at = text_bytes(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for i, (x, y, found) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), batch.column("_found").to_pylist())):
                low, high = _spans(y - x, found)
                if not len(low):
                    continue
                raw = data[x:y]
                tail = np.append((raw & 0xC0) == 0x80, False)  # bytes that go on a character
                parts, done = [], 0
                for s, e in zip(low.tolist(), high.tolist()):
                    while s < e and tail[s]:
                        s += 1
                    while e > s and tail[e]:
                        e -= 1
                    parts.append(raw[done:s].tobytes())
                    done = e
                texts[i] = (b"".join(parts) + raw[done:].tobytes()).decode()
            columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c) for c in names], names)

    return run


#: What tells rows apart beside the id: rows that share an id may have other texts.
def _print() -> Column:
    return F.hash("text")


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, print, found): what each document loses, for the documents that lose anything."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.where(f"doc_id is not null and octet_length(text) >= {LENGTH}").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _print().alias("print"))
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(partitions(spark), -(-(size or 0) // RANGE_BYTES))
    common = spark.sparkContext.broadcast(_common(texts, rows))
    settled = cut(texts.mapInArrow(_initial(ranges, common), _BLOCK).repartition(ranges, "range").mapInArrow(_settle, _PLACES), "settled")
    common.unpersist()
    unsettled = settled.where(f"flag = {OPEN}").groupBy("doc_id", "print").agg(F.collect_list("places").alias("places"))
    sides = cut(texts.join(unsettled, ["doc_id", "print"]).mapInArrow(_sides, "key long, doc_id long, print int, start long, bytes binary"), "sides")
    places = settled.where(f"flag = {COVERED}").unionByName(_refined(sides))
    found = cut(places.groupBy("doc_id", "print").agg(F.collect_list(F.struct("flag", "places")).alias("found")), "found")
    forget(settled, sides)
    return found


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text).

    A byte is removed if a 50-byte string that covers it also starts in a document with a
    smaller doc_id, judged on the UTF-8 bytes of the input. Null texts are empty; texts
    under 50 bytes lose nothing; a text of any length is taken whole, in segments. Rows with
    a null doc_id lose nothing and are nobody's earlier document; rows that share a doc_id
    are never each other's. An empty table gives no rows; other columns are not read.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _print().alias("print")).join(_found(docs), ["doc_id", "print"], "left")
    return marked.select("doc_id", "text", "found").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the passages that repeated_passages finds: text is cut, at whole characters, and n_chars (if there) counted anew.

    Rows are kept, even where no text is left; null texts stay null. Other columns of any
    name stay as they are, but for names that begin with an underscore and `found` or `print`.
    """
    held = docs.withColumn("text", F.col("text").cast("string"))
    extra = _found(docs).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), F.col("found").alias("_found"))
    marked = held.join(extra, (held["doc_id"] == extra["_id"]) & (F.hash(held["text"]) == extra["_print"]), "left").drop("_id", "_print")
    schema = ", ".join(f"`{c}` {'long' if c == 'n_chars' else t}" for c, t in held.dtypes)
    return marked.mapInArrow(_without(held.columns), schema)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
