"""Best-fit packing: documents' token pieces into sequences of a fixed length.

The pieces enter as a histogram of lengths, at most `capacity` numbers whatever the
corpus holds. A configuration is a way to fill a sequence. The configuration linear
program (fewest configurations that cover the histogram) is solved by multiplicative
weights: lengths that lag behind in coverage weigh more, and a knapsack dynamic
program finds the configurations of the greatest weight. The solution is rounded down
to whole sequences; what it leaves is covered again, and the rest packed best-fit.
The plan is that, or best-fit alone where it needs fewer sequences. Equal sequences
are held as one configuration and a count, also by best-fit, so that the plan's size
depends on the number of lengths, not on the corpus. The plan then numbers the slots
of each length; pieces take the slots by their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, cut, documents, forget, mix, range_hash, running_sums

#: Pieces of a length that are ranked together.
RANKED = 100_000
#: Words whose ids a Python worker keeps (in a table of twice as many slots, a power of two), and the slots in which a word may lie.
CACHE, PROBES = 1 << 20, 8
#: Rounds of multiplicative weights in each program, and the weights' step.
ROUNDS, STEP = (16, 8, 8), 1.5


# --- tokens ------------------------------------------------------------------

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that are composed already and lower-case the same way everywhere; texts with others go to the tokenizer whole.
_PLAIN = regex.compile(r"[\x00-\xFFŒœ‐-‧€]")
_SPACE, _LETTER, _NUMBER, _OTHER, _FOREIGN = range(5)


def _kinds() -> np.ndarray:
    """For each code point up to the last plain one, and one more for all beyond: white space, letter, number, something else, or not plain."""
    out = np.full(0x20AE, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        out[[i for i in range(len(out)) if regex.match(pattern, chr(i))]] = kind
    out[[i for i in range(len(out)) if not _PLAIN.match(chr(i))]] = _FOREIGN
    return out


def word_bounds(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of _WORDS start and stop in lower-cased code points."""
    kind = kinds[points]
    start = (kind != _SPACE) & (kind == _NUMBER)
    start[:1] |= kind[:1] != _SPACE
    start[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE)
    # an apostrophe that begins a run takes one of the endings s, t, m, d, re, ve, ll with it
    after = np.append(points[1:], [0, 0])
    mark = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == _LETTER))
    first, second = after[mark], after[mark + 1]
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    for taken, n in ((mark[one], 1), (mark[two], 2)):
        start[taken + 1] = False
        behind = taken + n + 1
        behind = behind[behind < len(start)]
        start[behind[kind[behind] == _LETTER]] = True
    space = kind == _SPACE
    edge = np.append(start | space, True)
    bounds = np.flatnonzero(edge)
    begin = np.flatnonzero(start)
    return begin, bounds[np.searchsorted(bounds, begin) + 1]


class WordTable:
    """A hash table of words' ids, looked up for many words at once. Words that find no slot are just not kept."""

    def __init__(self):
        self.keys = np.zeros(2 * CACHE, np.uint64)
        self.start, self.many = np.zeros(2 * CACHE, np.int64), np.zeros(2 * CACHE, np.int32)
        self.flat, self.held = np.zeros(0, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out, open_ones = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for probe in range(PROBES):
            slot = ((hashes[open_ones] + np.uint64(probe)) & mask).astype(np.int64)
            found = self.keys[slot]
            hit = found == hashes[open_ones]
            out[open_ones[hit]] = slot[hit]
            open_ones = open_ones[~hit & (found != 0)]
            if not len(open_ones):
                break
        return out

    def keep(self, hashes: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Distinct new hashes, with all their ids side by side."""
        mask = np.uint64(len(self.keys) - 1)
        start = len(self.flat) + np.cumsum(many) - many
        self.flat = np.concatenate([self.flat, ids])
        open_ones = np.flatnonzero(hashes != 0)
        for probe in range(PROBES):
            slot = ((hashes[open_ones] + np.uint64(probe)) & mask).astype(np.int64)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            at, word = slot[own], open_ones[own]
            self.keys[at], self.start[at], self.many[at] = hashes[word], start[word], many[word]
            self.held += len(own)
            open_ones = np.delete(open_ones, own)


class Encoder:
    """Token ids of texts by a tokenizer that works word by word: a batch's words are found and looked up together, unseen ones encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = type(self.tokenizer.model).__name__
        normal = str(self.tokenizer.normalizer)
        self.by_word = model == "BPE" and "Lowercase" in normal and "NFC" in normal and _WORDS.pattern in str(self.tokenizer.pre_tokenizer).replace("\\\\", "\\")
        suffix = (getattr(self.tokenizer.model, "end_of_word_suffix", None) or "") if self.by_word else ""
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = bool(suffix) and token.endswith(suffix)
        self.kinds = _kinds()
        lower = np.arange(len(self.kinds), dtype=np.uint32)
        for i in np.flatnonzero(self.kinds < _FOREIGN).tolist():
            lower[i] = ord(chr(i).lower())
        self.lower, self.values = lower, mix(np.arange(1, len(lower) + 1, dtype=np.uint64))
        self.table = WordTable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words side by side, and how many each has: encoded as one text where the ids show the words' ends."""
        (ids,) = self._encode([" ".join(words)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            return ids, np.diff(ends, prepend=0)
        each = self._encode(words)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        whole = "\n".join(texts)
        points = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.kinds) - 1)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        foreign = np.ones(len(texts), bool)
        if self.by_word:
            foreign = np.diff(np.searchsorted(np.flatnonzero(self.kinds[points] == _FOREIGN), at)) > 0
        others = iter(self._encode([t for t, own in zip(texts, foreign.tolist()) if own]))
        begin, stop = word_bounds(self.lower[points], self.kinds)
        begin, stop = (x[~foreign[np.searchsorted(at, begin, side="right") - 1]] for x in (begin, stop))
        hashes = range_hash(running_sums(self.values[self.lower[points]]), begin, stop)
        slot = self.table.find(hashes)
        start, many, flat = self.table.start[slot], self.table.many[slot].astype(np.int64), self.table.flat
        unseen = np.flatnonzero(slot < 0)
        if len(unseen):
            fresh, first, back = np.unique(hashes[unseen], return_index=True, return_inverse=True)
            ids, n = self._words([whole[a:b] for a, b in zip(begin[unseen[first]].tolist(), stop[unseen[first]].tolist())])
            start[unseen], many[unseen] = (len(flat) + np.cumsum(n) - n)[back], n[back]
            if self.table.held < CACHE:
                self.table.keep(fresh, ids, n)
            flat = np.concatenate([flat, ids])
        last = np.cumsum(many)
        ids = flat[np.repeat(start - (last - many), many) + np.arange(int(last[-1]) if len(last) else 0)]
        place = np.concatenate([[0], last])[np.searchsorted(begin, at)].tolist()
        for i, own in enumerate(foreign.tolist()):
            yield next(others) if own else ids[place[i] : place[i + 1]]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the id `end`, cut into pieces of `capacity` ids.

    Null texts are empty and give one piece with `end` alone. tokenizer is the path of a
    file for the tokenizers library that every machine has. Every row gives its pieces: rows
    with a null doc_id keep it, rows that repeat an id repeat its pieces. An empty table
    gives no rows; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    last = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids = np.concatenate([ids, last], dtype="<u4")
                for piece, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    for column, value in zip(out, (doc_id, piece, s, len(part), zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan ----------------------------------------------------------------


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to `capacity` the greatest value of items that fit (any number of each), and the item that comes last (-1: none)."""
    by_length = np.zeros(capacity + 1)
    by_length[lengths] = values
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        sums = by_length[1 : c + 1] + best[c - 1 :: -1][:c]
        at = c - 1 - int(sums[::-1].argmax())  # of equal ones the longest item: shorter ones stay for later gaps
        if sums[at] > best[c - 1] + 1e-12 and by_length[at + 1] > 0:
            best[c], last[c] = sums[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _configuration(first: int, last: np.ndarray, capacity: int, left: np.ndarray) -> dict[int, int]:
    """The configuration that the dynamic program gives beside one item of length `first`, of items that are left."""
    own = {first: 1}
    c = capacity - first
    while c > 0:
        item = int(last[c])
        if item < 0:
            c -= 1
            continue
        if own.get(item, 0) < left[item]:
            own[item] = own.get(item, 0) + 1
            c -= item
        else:
            c -= 1  # used up: the best of a smaller rest
    return own


def _cover(left: np.ndarray, capacity: int, rounds: int) -> list[tuple[dict[int, int], float]]:
    """Fractional configurations whose sum covers `left` at most, by multiplicative weights."""
    lengths = np.flatnonzero(left)
    need = left[lengths].astype(np.float64)
    place = {int(x): i for i, x in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    total = float((lengths * need).sum()) / capacity
    chosen: list[tuple[dict[int, int], float]] = []
    for r in range(rounds):
        lag = np.clip((r + 1) / rounds - covered / need, -1, 1)
        weights = lengths * np.exp(STEP * lag)
        best, last = knapsack(lengths, weights, capacity)
        # every length beside its best company; those of nearly the greatest weight step together
        beside = weights + best[capacity - lengths]
        order = np.argsort(-(lag + 1e-3 * beside / max(beside.max(), 1e-9)), kind="stable")
        budget, used = total / rounds, 0.0
        for i in order.tolist():
            if used >= budget:
                break
            short = need[i] * (r + 1) / rounds - covered[i]
            if short <= 0:
                continue
            own = _configuration(int(lengths[i]), last, capacity, left)
            step = min(short / own[int(lengths[i])], budget - used, *(max(0.0, need[place[x]] - covered[place[x]]) / n for x, n in own.items()))
            if step <= 0:
                continue
            for x, n in own.items():
                covered[place[x]] += step * n
            used += step
            chosen.append((own, step))
    return chosen


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequence that has room; equal sequences are filled together."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    free = np.zeros(capacity + 1, np.int64)  # open sequences by room
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = length + int((free[length:] > 0).argmax())
            if free[at]:
                own, times = rooms[at].pop()
                free[at] -= times
            else:
                at = capacity
                own, times = {}, -(-n // (capacity // length))
            fits = at // length  # a sequence that has taken one is the fullest with room, until it has none
            full, part = divmod(n, fits)
            if full >= times:
                full, part = times, 0
            for many, each in ((full, fits), (int(part > 0), part), (times - full - (part > 0), 0)):
                if many:
                    room = at - each * length
                    rooms.setdefault(room, []).append((own | {length: own.get(length, 0) + each} if each else own, many))
                    free[room] += many
            n -= full * fits + part
    return [(own, many) for room in rooms.values() for own, many in room]


def plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: number} and how often each is used; together they hold exactly the histogram."""
    every = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        every[length] = n
    left = every.copy()
    out: list[tuple[dict[int, int], int]] = []
    for rounds in ROUNDS:
        if not left.any():
            break
        merged: dict[tuple, float] = {}
        for own, x in _cover(left, capacity, rounds):
            key = tuple(sorted(own.items()))
            merged[key] = merged.get(key, 0.0) + x
        for key, x in sorted(merged.items(), key=lambda m: -m[1]):
            n = min(int(x + 1e-9), *(int(left[length]) // a for length, a in key))
            if n > 0:
                for length, a in key:
                    left[length] -= n * a
                out.append((dict(key), n))
    out += _best_fit(left, capacity)
    plain = _best_fit(every, capacity)
    return min(out, plain, key=lambda p: sum(n for _, n in p))


def _slots(configurations: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of slots: where it starts among all slots ordered by length, its first sequence, slots a sequence, and offset in it."""
    rows, sequence = [], 0
    for own, times in configurations:
        offset = 0
        for length, n in sorted(own.items(), reverse=True):
            rows.append((length, times * n, sequence, n, offset))
            offset += length * n
        sequence += times
    rows.sort(key=lambda r: r[0])
    length, many, first, each, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    start = np.cumsum(many) - many
    begin = np.zeros(capacity + 2, np.int64)
    for x, s in zip(length[::-1].tolist(), start[::-1].tolist()):
        begin[x] = s
    return {"start": start, "first": first, "each": each, "offset": offset, "begin": begin}


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces(..., length) with sequence_id and offset: gapless from 0 in each sequence, `capacity` at most.

    Lengths lie between 1 and capacity. Rows that agree in all columns are interchangeable.
    Columns named sequence_id or offset are replaced. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = cut(pieces.select(*names), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` numbers
    # a length is ranked in as many parts as its most common one needs
    parts = max(1, -(-max(histogram.values(), default=0) // RANKED))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("length", "_part").count()
    shared = spark.sparkContext.broadcast(_slots(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranks = Window.partitionBy("length", "_part").orderBy(*names)
    ranked = pieces.withColumn("_rank", F.row_number().over(ranks) - 1).join(offsets, ["length", "_part"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("sequence_id"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            slot = batch.column("sequence_id").to_numpy() + p["begin"][length]
            run = np.searchsorted(p["start"], slot, side="right") - 1
            inner = slot - p["start"][run]
            sequence, offset = p["first"][run] + inner // p["each"][run], p["offset"][run] + inner % p["each"][run] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(place, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "sequence_id long, offset long"]))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir), word_tokenizer()))
