"""SentencePiece encoding and decoding with a unigram model's Viterbi search.

The pieces lie in a double-array trie over their UTF-8 bytes. White space becomes the
marker U+2581; no piece runs on from another character into a marker, so that a text
falls into stretches between which the best segmentation never interacts. Distinct
stretches are searched together, position by position, in NumPy. Characters without a
piece fall back to the pieces of their bytes. Decoding joins pieces and bytes and
turns markers back into spaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, documents

MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Stretches whose ids a Python worker keeps, and the longest of them in characters; bytes that are searched together.
CACHE, LONGEST, TOGETHER = 300_000, 40, 1 << 20


def double_array(keys: list[bytes]) -> dict[str, np.ndarray]:
    """base, check and value (place of the key that ends there, or -1): the child of state s by byte b is t = base[s] + b + 1 if check[t] = s."""
    root: dict = {}
    for i, key in enumerate(keys):
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0], queue = 0, [(0, root)]
    after = [1] * 10  # where the search goes on, for nodes of so many children (by the bits of their number)
    block = np.arange(512)[:, None]
    for state, node in queue:
        codes = np.array(sorted(b + 1 for b in node if b >= 0), np.int64)
        value[state] = node.get(-1, -1)
        if not len(codes):
            continue
        kind = len(codes).bit_length()
        at = max(1, after[kind] - int(codes[0]))
        while True:
            if at + len(block) + 300 >= len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
            fits = (check[at + block + codes] < 0).all(axis=1)
            if fits.any():
                at += int(fits.argmax())
                break
            at += len(block)
        after[kind] = at + int(codes[0])
        base[state] = at
        check[at + codes] = state
        queue.extend((at + b + 1, node[b]) for b in sorted(x for x in node if x >= 0))
    used = int(np.flatnonzero(check >= 0).max()) + 300
    pad = max(0, used - len(check))
    return {"base": np.pad(base, (0, pad))[:used], "check": np.pad(check, (0, pad), constant_values=-1)[:used], "value": np.pad(value, (0, pad), constant_values=-1)[:used]}


def load_model(path: str) -> dict:
    """Pieces, scores and trie of a sentencepiece model file.

    Only models that leave characters as they are (normaliser `identity`) and keep extra
    white space are taken; others raise ValueError.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = proto.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("the model's normaliser changes characters")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    bytes_at, keys, ids = {}, [], []
    out = [b""] * n
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
            out[i] = bytes([int(piece[3:5], 16)])
        elif not special[i]:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece runs on into a white-space marker")
            keys.append(piece.encode())
            ids.append(i)
            out[i] = piece.replace(MARK, " ").encode()
    scores = np.array([sp.get_score(i) for i in ids])
    return double_array(keys) | {
        "ids": np.array(ids, np.int32), "scores": scores, "unknown": float(scores.min()) - UNKNOWN_PENALTY, "unknown_id": sp.unk_id(),
        "bytes": np.array([bytes_at.get(b, sp.unk_id()) for b in range(256)], np.int32), "fallback": len(bytes_at) == 256, "output": out, "prefix": bool(normal.add_dummy_prefix),
        "alone": "" if any("\n" in k.decode() for k in keys) else "\n",
    }


def _character_length(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def viterbi(stretches: list[bytes], model: dict) -> list[np.ndarray]:
    """The ids of each stretch's best segmentation; of equal ones that with the earlier start of the last piece."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(stretches)
    sizes = np.array([len(s) for s in stretches], np.int64)
    order = np.argsort(sizes, kind="stable")
    base, check, value, scores = model["base"], model["check"], model["value"], model["scores"]
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * (sizes[order[b]] + 1) <= TOGETHER:
            b += 1
        group, width = order[a:b], int(sizes[order[b - 1]])
        a = b
        if not width:
            continue
        code = np.zeros((len(group), width), np.int16)
        for row, i in enumerate(group):
            code[row, : sizes[i]] = np.frombuffer(stretches[i], np.uint8).astype(np.int16) + 1
        best = np.full((len(group), width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((len(group), width + 1), np.int32), np.full((len(group), width + 1), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((code[:, s] > 0) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            started, step = rows, _character_length(code[rows, s] - 1)
            single = np.zeros(len(group), bool)
            stop = np.zeros(len(group), np.int64)
            stop[rows] = s + step
            state = np.zeros(len(rows), np.int64)
            for t in range(s, width):
                following = base[state] + code[rows, t]
                ok = (check[following] == state) & (code[rows, t] > 0)
                rows, state = rows[ok], following[ok]
                if not len(rows):
                    break
                v = value[state]
                ends = v >= 0
                r, v = rows[ends], v[ends]
                single[r[stop[r] == t + 1]] = True
                better = best[r, s] + scores[v] > best[r, t + 1]
                r, v = r[better], v[better]
                best[r, t + 1], back[r, t + 1], piece[r, t + 1] = best[r, s] + scores[v], s, v
            lost = started[~single[started]]
            end = np.minimum(stop[lost], width)
            better = best[lost, s] + model["unknown"] > best[lost, end]
            lost, end = lost[better], end[better]
            best[lost, end], back[lost, end], piece[lost, end] = best[lost, s] + model["unknown"], s, -1
        for row, i in enumerate(group):
            at, ids = int(sizes[i]), []
            links, pieces = back[row], piece[row]
            while at > 0:
                s = int(links[at])
                if pieces[at] >= 0:
                    ids.append(int(model["ids"][pieces[at]]))
                elif model["fallback"]:
                    ids.extend(int(model["bytes"][x]) for x in reversed(stretches[i][s:at]))
                else:
                    ids.append(model["unknown_id"])
                at = s
            out[i] = np.array(ids[::-1], np.int32)
    return out


class Codec:
    def __init__(self, model: dict):
        self.model, self.known = model, {}
        alone = model["alone"]
        self.stretch = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; an empty text has none."""
        prefix = MARK if self.model["prefix"] else ""
        parts = [self.stretch.findall((prefix + t).replace(" ", MARK)) if t else [] for t in texts]
        missing = list({w for own in parts for w in own if w not in self.known})
        fresh = {w: ids.astype("<u4").tobytes() for w, ids in zip(missing, viterbi([w.encode() for w in missing], self.model))}
        for w, ids in fresh.items():
            if len(self.known) >= CACHE:
                break
            if len(w) <= LONGEST:
                self.known[w] = ids
        known = self.known
        for own in parts:
            yield b"".join([known[w] if w in known else fresh[w] for w in own])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become spaces, byte pieces bytes (malformed ones U+FFFD), control pieces nothing."""
        output = self.model["output"]
        text = b"".join([output[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for docs(doc_id, text): a text's ids as array<int>, and what they decode to.

    Null and empty texts have no ids and decode to an empty text. Decoding returns the text
    itself, but for a U+2581 in it, which comes back as a space. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in chunks(batches, limit=1 << 20):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(texts)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def id_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): digests of encode_texts, made beside the encoding."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in chunks(batches, limit=1 << 20):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            ids = list(codec.encode(texts))
            same = [codec.decode(np.frombuffer(x, "<u4")) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return id_digests(documents(spark, sf_dir), piece_model())
