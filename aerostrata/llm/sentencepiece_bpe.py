"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (identity map, spaces become U+2581, one is put in front),
cut where no piece of the vocabulary can cross, and the distinct chunks of a block are encoded together:
flat numpy arrays hold the symbols of all chunks, each round takes the minimum pair rank of every chunk
(segmented reduction), merges all its leftmost non-overlapping occurrences at once and compacts the arrays,
until no chunk has a mergeable pair. A piece whose merge can open a pair of the same or a better rank
("eager" pieces, found from the vocabulary) is merged only up to the first place where that happens,
so that the order equals that of a priority queue. Symbols outside the vocabulary become byte pieces.

Cases: null text counts as empty; an empty text has the end id alone; U+2581 in a text counts as a space.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.int64(1 << 40)
#: Chunks kept encoded during a task; the store is emptied when full and when the task ends, as workers are used again. Longer chunks are not kept.
CACHE_CHUNKS, CACHE_CHARS = 150_000, 40


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, i
        shift += 7


def _fields(data: bytes) -> Iterable[tuple[int, object]]:
    """(number, value) of a protocol buffer message, one level deep."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(data, i)
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class PieceModel:
    """Vocabulary and pair ranks of a BPE model file."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE models with the identity map and no user-defined or unused pieces are supported")
        if normalizer.get(4, 1) or not normalizer.get(3, 1) or not trainer.get(35, 0):
            raise ValueError("only models that keep white space, put a space in front and fall back to bytes are supported")
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.size = len(pieces)
        self.end_id = self.pieces.index("</s>")
        ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.byte_set = frozenset(self.byte_ids.tolist())
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        rank = np.full(self.size, NO_RANK, np.int64)
        for i in ids.values():
            rank[i] = order[pieces[i][1]]
        self.rank = rank
        self.char_ids = np.arange(0x110000, dtype=np.int64) + self.size  # unknown characters: size + code point
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        keys, merged = [], []
        self.eager = np.zeros(self.size, bool)
        crossing: set[str] = set()
        follows: set[tuple[str, str]] = set()
        for p, i in ids.items():
            if len(p) > 1:
                crossing.update(p)
                follows.update(zip(p[1:], p, strict=False))
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    merged.append(i)
                    for x in (a, b):
                        self.eager[x] |= len(self.pieces[x]) > 1 and rank[i] <= rank[x]
        self._index(np.array(keys, np.int64), np.array(merged, np.int64))
        self.chunks = re.compile(self._chunk_pattern(ids, crossing, follows))
        # long runs of spaces merge from the left into equal pieces, whatever follows far behind
        self.space_run = 0
        heads = [len(self.pieces[i]) for i in self.encode_chunks([SPACE * 200])[0]]
        if len(set(heads[:4])) == 1:
            self.space_run = heads[0]
        self.names = [str(i) for i in range(self.size)]
        self.shown = [self._shown(i) for i in range(self.size)]

    @staticmethod
    def _chunk_pattern(ids: dict[str, int], crossing: set[str], follows: set[tuple[str, str]]) -> str:
        """Cuts that no piece crosses: before a space after something else, around characters that no longer
        piece holds, and before a mark after a letter where no piece has such a pair."""
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with inner spaces are not supported")
        letter = "A-Za-zÀ-ÖØ-öø-ÿ"
        letters = re.compile(f"[{letter}]")
        alone = {chr(c) for c in range(128) if chr(c) not in crossing and chr(c) != " "}
        after = {b for b, a in follows if letters.match(a)}
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - alone - after
        a, m = "".join(map(re.escape, sorted(alone))), "".join(map(re.escape, sorted(marks)))
        body = f"[^{SPACE}{a}{letter}]*(?:[{letter}]+[^{SPACE}{a}{letter}{m}][^{SPACE}{a}{letter}]*)*[{letter}]*"
        return "|".join([f"[{a}]"] * bool(a) + [f"{SPACE}+{body}", f"(?=[^{SPACE}{a}]){body}"])

    def _shown(self, i: int) -> str:
        kind = self.kinds[i]
        return "" if kind in (CONTROL, BYTE) else " ⁇ " if kind == UNKNOWN else self.pieces[i]

    def _index(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Pairs in a table of one entry a slot; the few that share a slot are kept sorted beside it."""
        slots = self._slot(keys)
        self.slot_key = np.full(1 << 20, -1, np.int64)
        self.slot_id = np.zeros(1 << 20, np.int64)
        first = np.unique(slots, return_index=True)[1]
        self.slot_key[slots[first]], self.slot_id[slots[first]] = keys[first], merged[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_ids = np.append(keys[rest], 1 << 60), np.append(merged[rest], 0)
        self.shared = np.zeros(1 << 20, bool)
        self.shared[slots[rest]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id and rank of symbol pairs; NO_RANK where they don't merge."""
        key = left << 21 | right
        slot = self._slot(key)
        hit = self.slot_key[slot] == key
        ids = np.where(hit, self.slot_id[slot], 0)
        look = np.flatnonzero(~hit & self.shared[slot])
        if len(look):
            at = np.searchsorted(self.more_keys, key[look])
            found = self.more_keys[at] == key[look]
            ids[look[found]] = self.more_ids[at[found]]
            hit[look[found]] = True
        return ids, np.where(hit, self.rank[ids], NO_RANK)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of all words (numbered in order) until no pair remains."""
        done_sym, done_word = [], []
        sym, w = symbols, word
        n = len(sym)
        ids, rank = np.zeros(n, np.int64), np.full(n, NO_RANK, np.int64)
        inner = np.flatnonzero(w[:-1] == w[1:])
        ids[inner], rank[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.r_[starts, len(sym)])
            each = np.repeat(least, lens)
            live = each < NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(w[~live])
                sym, w, ids, rank, each = sym[live], w[live], ids[live], rank[live], each[live]
                if not len(sym):
                    break
            take = rank == each
            # of overlapping occurrences every second one from the left
            at = np.arange(len(sym))
            opens = take & ~np.r_[False, take[:-1]]
            since = at - np.maximum.accumulate(np.where(opens, at, 0))
            take &= (since & 1) == 0
            chosen = np.flatnonzero(take)
            wary = chosen[self.eager[ids[chosen]]]
            if len(wary):
                chosen = self._before_turn(sym, w, ids, rank, take, chosen, wary)
                take = np.zeros(len(sym), bool)
                take[chosen] = True
            sym = sym.copy()
            sym[chosen] = ids[chosen]
            stay = np.ones(len(sym), bool)
            stay[chosen + 1] = False
            place = np.cumsum(stay) - 1
            sym, w, ids, rank = sym[stay], w[stay], ids[stay], rank[stay]
            left = place[chosen]
            touched = np.zeros(len(sym), bool)
            touched[left] = True
            touched[left[left > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            ids[fresh], rank[fresh] = 0, NO_RANK
            fresh = fresh[fresh < len(sym) - 1]
            fresh = fresh[w[fresh] == w[fresh + 1]]
            ids[fresh], rank[fresh] = self.pair(sym[fresh], sym[fresh + 1])
        out_sym, out_word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, w])
        order = np.argsort(out_word, kind="stable")
        return out_sym[order], out_word[order]

    def _before_turn(self, sym, w, ids, rank, take, chosen, wary):
        """The chosen merges of each word up to the first one that opens a pair of no worse rank."""
        n = len(sym)
        bad = np.zeros(len(wary), bool)
        has = (wary > 0) & (w[np.maximum(wary - 1, 0)] == w[wary])
        i = wary[has]
        two = np.maximum(i - 2, 0)
        before = np.where((i >= 2) & take[two], ids[two], sym[i - 1])
        bad[has] |= self.pair(before, ids[i])[1] <= rank[i]
        has = (wary + 2 < n) & (w[np.minimum(wary + 2, n - 1)] == w[wary])
        i = wary[has]
        bad[has] |= self.pair(ids[i], sym[i + 2])[1] <= rank[i]
        if not bad.any():
            return chosen
        stops = wary[bad]
        words, first = np.unique(w[stops], return_index=True)
        limit = np.full(len(chosen), n)
        at = np.minimum(np.searchsorted(words, w[chosen]), len(words) - 1)
        hit = words[at] == w[chosen]
        limit[hit] = stops[first][at[hit]]
        return chosen[chosen <= limit]

    def encode_chunks(self, chunks: Sequence[str]) -> list[list[int]]:
        """Ids of each chunk."""
        if not chunks:
            return []
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        sym, word = self.merge(self.char_ids[points], np.repeat(np.arange(len(chunks)), lens))
        bounds = np.searchsorted(word, np.arange(len(chunks) + 1))
        flat, bounds = sym.tolist(), bounds.tolist()
        plain = bool((sym < self.size).all())
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if not plain:
            top, byte_ids = self.size, self.byte_ids.tolist()
            out = [ids if max(ids) < top else [y for x in ids for y in ([x] if x < top else [byte_ids[b] for b in chr(x - top).encode()])] for ids in out]
        return out

    def split(self, text: str) -> list[str]:
        """Chunks of a normalised text that merge independently."""
        if not text:
            return []
        found = self.chunks.findall(SPACE + text.replace(" ", SPACE))
        run, long = self.space_run, SPACE * (2 * self.space_run + 2)
        if run > 1 and long in text.replace(" ", SPACE):
            out = []
            for c in found:
                spaces = len(c) - len(c.lstrip(SPACE))
                cut = max(0, (spaces - run - 2) // run * run)
                out += [c[:run]] * (cut // run) + [c[cut:]]
            return out
        return found

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the end id last."""
        return [i for ids in self.encode_chunks(self.split(text or "")) for i in ids] + [self.end_id]

    def decode_part(self, ids: Sequence[int]) -> str:
        """Pieces joined, byte runs read as UTF-8; spaces still marked."""
        if self.byte_set.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_lossy(bytes(held)))
                held.clear()
            out.append(self.shown[i])
        return "".join(out) + _lossy(bytes(held))

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids, as the model's library gives it."""
        return self.finish(self.decode_part(ids))

    @staticmethod
    def finish(marked: str) -> str:
        """Drop the space put in front, show the others."""
        return marked.removeprefix(SPACE).replace(SPACE, " ")


def _lossy(data: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is none."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model_of(data: bytes) -> PieceModel:
    return PieceModel(data)


class _Store:
    """Encoded and decoded chunks that a worker keeps between blocks."""

    def __init__(self):
        self.model, self.ids, self.shown = None, {}, {}

    def fill(self, model: PieceModel, split: Sequence[Sequence[str]]) -> list[str]:
        """Encode what is not there yet; returns the chunks that are not to be kept."""
        if self.model is not model or len(self.ids) > CACHE_CHUNKS:
            self.model, self.ids, self.shown = model, {}, {}
        need: set[str] = set()
        for chunks in split:
            need.update(chunks)
        fresh = list(need.difference(self.ids))
        name = model.names
        for c, ids in zip(fresh, model.encode_chunks(fresh), strict=True):
            self.ids[c] = " ".join([name[i] for i in ids])
            shown = model.decode_part(ids)
            self.shown[c] = c if shown == c else shown  # one copy of the string
        return [c for c in fresh if len(c) > CACHE_CHARS]

    def clear(self) -> None:
        self.model, self.ids, self.shown = None, {}, {}

    def drop(self, chunks: Sequence[str]) -> None:
        for c in chunks:
            del self.ids[c], self.shown[c]


_STORE = _Store()


def _forget() -> None:
    _STORE.clear()


def _rows(data: bytes, texts: Sequence[str | None], want_ids: bool, want_digests: bool):
    """Columns: number of ids and, as asked, ids, digest of the ids, digest of the decoded text."""
    model = model_of(data)
    split = [model.split(t or "") for t in texts]
    gc.disable()  # the store holds only strings; collections would walk it again and again
    try:
        passing = _STORE.fill(model, split)
    finally:
        gc.enable()
    ids_of, shown_of, end = _STORE.ids.__getitem__, _STORE.shown.__getitem__, [model.names[model.end_id]]
    joined = [" ".join([*map(ids_of, chunks), *end]) for chunks in split]
    out: list = [[j.count(" ") + 1 for j in joined]]
    if want_ids:
        lists = [np.fromstring(j, np.int32, sep=" ") for j in joined]
        bounds = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lists))) if lists else [])
    if want_digests:
        out.append([hashlib.sha256(j.encode()).hexdigest() for j in joined])
        out.append([hashlib.sha256(model.finish("".join(map(shown_of, chunks))).encode()).hexdigest() for chunks in split])
    _STORE.drop(passing)
    return out


def read_model(path: str | None = None) -> bytes:
    """The model file (0.5 MB), read once on the driver and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(
    df: DataFrame, text: str = "text", path: str | None = None, ids: bool = True, digests: bool = False, keep: Sequence[str] | None = None
) -> DataFrame:
    """Encode every text to its end and decode the ids again.

    Adds n_tokens and, as asked, ids (array<int>), ids_sha256 and decoded_sha256; other columns stay (all, or those in `keep`).
    A map over the scan: no shuffle, memory bounded by a block of texts and a bounded store of chunks.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_model(path))
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else []
    return append_columns(df, [F.col(text)], fields, lambda texts: _rows(sent.value, texts, ids, digests), keep, _forget)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ids=False, digests=True, keep=["doc_id"])
