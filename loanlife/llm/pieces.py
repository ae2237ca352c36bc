"""Piece encoding and decoding with byte spans, from a SentencePiece BPE model file.

A text is normalised by longest-prefix lookups in the model's compiled character map (a double-array
trie over UTF-8 bytes); each normalised character remembers the source bytes it came from. The
normalised text is cut where no piece of the vocabulary can cross (before a run of word marks, and
around line ends and tabs if only single-character pieces hold them); merges inside a cut do not
depend on what is around it, so cuts are encoded once and looked up afterwards. Pieces are projected
onto source bytes through the recorded alignment.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.llm.words import slices

MARK = "▁"
CACHED = 400_000
_NEVER = float("inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at:at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacements compiled into a double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest key at ``at`` and what replaces it; ``(0, None)`` if none."""
        units, found = self.units, (0, None)
        node = self._step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start:self.strings.index(0, start)]
        return found

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Normaliser:
    """Normalised text with one source byte range per character."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True,
                 remove_extra: bool = False, escape: bool = True):
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        self.mark = MARK if escape else " "

    @property
    def plain(self) -> bool:
        return self.map is None and not self.remove_extra

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text and, for each of its characters, first and end source byte."""
        if self.map is None:
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
            ends = np.cumsum(size)
            chars, begins = text, ends - size
        else:
            chars, begins, ends = self._mapped(text.encode())
        if self.remove_extra:
            chars, begins, ends = _single_spaces(chars, begins, ends)
        chars = chars.replace(" ", self.mark)
        if self.dummy_prefix and chars:
            at = begins[:1]
            return (self.mark + chars, np.concatenate([at, begins]), np.concatenate([at, ends]))
        return chars, begins, ends

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        chars, begins, ends, at = [], [], [], 0
        while at < len(data):
            n, put = self.map.longest(data, at)
            if n == 0:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                put = data[at:at + n]
            new = put.decode()
            chars.append(new)
            # What one lookup made shares its source: the first character takes it, the others
            # stand at its end only if they are further characters of the same replacement.
            begins += [at] * len(new)
            ends += [at + n] * len(new)
            at += n
        return "".join(chars), np.array(begins, np.int64), np.array(ends, np.int64)


def _single_spaces(chars: str, begins: np.ndarray, ends: np.ndarray):
    gap = np.array([c == " " for c in chars], dtype=bool)
    before = np.concatenate([[True], gap[:-1]])
    keep = ~(gap & before)
    kept = np.flatnonzero(keep)
    if len(kept) and gap[kept[-1]]:
        kept = kept[:-1]
    return "".join(chars[i] for i in kept.tolist()), begins[kept], ends[kept]


class Model:
    """Vocabulary, scores and normaliser of a BPE model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        charsmap, flags, model_type, byte_fallback = b"", {3: 1, 4: 1, 5: 1}, 1, 0
        suffix = 0
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    model_type = v if n == 3 else model_type
                    suffix = v if n == 24 else suffix
                    byte_fallback = v if n == 35 else byte_fallback
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n in flags:
                        flags[n] = v
        if model_type != 2 or suffix or {_USER, _UNUSED} & set(self.kinds):
            raise ValueError("only BPE models of plain pieces with leading word marks are read")
        self.byte_fallback = bool(byte_fallback)
        self.normaliser = Normaliser(charsmap, bool(flags[3]), bool(flags[4]), bool(flags[5]))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces)
                      if self.kinds[i] == _BYTE}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        long = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("a piece holds a word mark after other characters")
        inside = set("".join(long))
        walls = "".join(c for c in "\n\t\r" if c not in inside)
        body = re.escape(MARK + walls)
        self.cuts = re.compile(f"{MARK}+[^{body}]*|[^{body}]+|[{re.escape(walls)}]" if walls
                               else f"{MARK}+[^{body}]*|[^{body}]+")

    def merge(self, text: str) -> list[str]:
        """Pieces of one cut: the best-scored neighbours are joined first, then the leftmost."""
        rank = self.rank.get
        parts = list(text)
        if len(parts) > 48:
            return self._merge_long(parts)
        best = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while best:
            low = min(best)
            if low == _NEVER:
                break
            at = best.index(low)
            del best[at]
            both = parts[at] = parts[at] + parts.pop(at + 1)
            if at:
                best[at - 1] = rank(parts[at - 1] + both, _NEVER)
            if at < len(best):
                best[at] = rank(both + parts[at + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        rank = self.rank.get
        n = len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                both = parts[i] + parts[j]
                r = rank(both)
                if r is not None:
                    heapq.heappush(heap, (r, i, j, both))
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or nxt[i] != j or j >= n or parts[j] is None \
                    or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in parts if p is not None]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of the pieces one after another, word marks as blanks."""
        parts = []
        for i in ids:
            kind = self.kinds[i]
            if kind == _BYTE:
                parts.append(bytes([int(self.pieces[i][3:5], 16)]))
            elif kind == _UNKNOWN:
                parts.append(" ⁇ ".encode())
            elif kind != _CONTROL:
                parts.append(self.pieces[i].replace(MARK, " ").encode())
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the blank that encoding puts first is taken off again."""
        data = self.decode_bytes(ids)
        if self.normaliser.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class Merger:
    """Merges of many cuts at once: every round joins the best pair of each cut."""

    def __init__(self, model: Model):
        symbols = dict(model.ids)
        for c in set("".join(model.ids)):
            symbols.setdefault(c, len(model.pieces) + len(symbols))
        self.span = len(model.pieces) + len(symbols) + 1
        order = {s: i for i, s in enumerate(sorted(set(model.rank.values())))}
        keys, made, ranks = [], [], []
        for piece, i in model.ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    made.append(i)
                    ranks.append(order[model.rank[piece]])
        self.bits = max(len(keys), 8).bit_length() + 2
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.made = np.zeros(1 << self.bits, dtype=np.int32)
        self.ranks = np.full(1 << self.bits, len(order), dtype=np.int32)
        self.never, self.probes = len(order), 1
        todo = np.arange(len(keys))
        keys, made, ranks = np.array(keys), np.array(made), np.array(ranks)
        while len(todo):  # open addressing, one probe deeper each time
            slot = self._slots(keys[todo], self.probes - 1)
            free = self.keys[slot] < 0
            slot, kept = np.unique(slot[free], return_index=True)
            put = todo[free][kept]
            self.keys[slot], self.made[slot], self.ranks[slot] = keys[put], made[put], ranks[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            self.probes += bool(len(todo))
        self.of_char = np.full(0x110000, self.span - 1, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & (
            (1 << self.bits) - 1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.span + right
        slot = self._slots(keys, 0)
        rank = np.where(self.keys[slot] == keys, self.ranks[slot], self.never)
        made = self.made[slot]
        more = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for probe in range(1, self.probes):
            if not len(more):
                break
            slot = self._slots(keys[more], probe)
            hit = self.keys[slot] == keys[more]
            rank[more[hit]], made[more[hit]] = self.ranks[slot[hit]], self.made[slot[hit]]
            more = more[~hit & (self.keys[slot] >= 0)]
        return rank, made

    def merge(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all cuts, how many each has, and the code points they start at."""
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        cut = np.repeat(np.arange(len(cuts)), sizes)
        at = np.arange(len(points))
        symbol = self.of_char[points]
        rank = np.full(len(points), self.never, dtype=np.int32)
        made = np.zeros(len(points), dtype=np.int32)
        inner = np.flatnonzero(cut[1:] == cut[:-1])
        rank[inner], made[inner] = self._find(symbol[inner], symbol[inner + 1])
        done: list[tuple] = []
        while len(cut):
            begin = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, begin),
                             np.diff(np.append(begin, len(cut))))
            active = best < self.never
            if not active.all():
                idle = ~active
                done.append((cut[idle], at[idle], symbol[idle]))
                cut, at, symbol, rank, made, best = (
                    x[active] for x in (cut, at, symbol, rank, made, best))
                if not len(cut):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.concatenate([[True], cut[hit[1:]] != cut[hit[:-1]]])]
            symbol[hit] = made[hit]
            stay = np.ones(len(cut), dtype=bool)
            stay[hit + 1] = False
            cut, at, symbol, rank, made = (x[stay] for x in (cut, at, symbol, rank, made))
            here = hit - np.arange(len(hit))
            rank[here] = self.never
            for i in (here[here + 1 < len(cut)], here[here > 0] - 1):
                i = i[cut[i] == cut[i + 1]]
                rank[i], made[i] = self._find(symbol[i], symbol[i + 1])
        cut, at, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        return symbol[order], np.bincount(cut, minlength=len(cuts)), points[at[order]]


class Encoder:
    """Encodes and decodes texts with one model; cuts seen before are looked up.

    Of every cut its ids are kept, with the source bytes each piece stands for, in arrays that all cuts
    share. A slice of rows is then encoded by gathering: ids, and spans as running sums of the bytes.
    """

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.merger = Merger(self.model)
        self.names = [str(i) for i in range(len(self.model.pieces))]
        self.sizes = np.array([len(p.encode()) - 2 * p.count(MARK) for p in self.model.pieces])
        shown = [self.model.decode_bytes([i]) for i in range(len(self.model.pieces))]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_ends = np.cumsum([0, *map(len, shown)])
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ends = np.zeros(1, dtype=np.int64)       # of each cut in the next two
        self.ids, self.bytes = np.zeros((2, 0), dtype=np.int32)

    def normal(self, text: str) -> str:
        """The normalised text with word marks."""
        normal = self.model.normaliser
        if not normal.plain:
            return normal(text)[0]
        chars = text.replace(" ", MARK)
        return MARK + chars if chars and normal.dummy_prefix else chars

    def _alone(self, cut: str) -> tuple[list[int], list[int]]:
        """Ids of one cut and the source bytes of each; bytes of a character count for its last."""
        ids, sizes = [], []
        for piece in self.model.merge(cut):
            known, size = self.model.ids.get(piece), len(piece.encode()) - 2 * piece.count(MARK)
            if known is None and self.model.byte_fallback:
                raw = piece.encode()
                ids += [self.model.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [size]
            else:
                ids.append(self.model.unknown if known is None else known)
                sizes.append(size)
        return ids, sizes

    def learn(self, cuts: set[str]) -> None:
        """Encode cuts not yet known."""
        if len(self.slots) + len(cuts) > CACHED:
            self._forget()
        new = [c for c in cuts if c not in self.slots]
        short = [c for c in new if len(c) <= 48]
        single = [c for c in new if len(c) > 48]
        ids, sizes, counts, named = [], [], [], []
        if short:
            symbols, count, _ = self.merger.merge(short)
            owner = np.repeat(np.arange(len(short)), count)
            good = np.ones(len(short), dtype=bool)
            good[owner[symbols >= len(self.names)]] = False    # characters outside the vocabulary
            kept = symbols[good[owner]]
            ids.append(kept)
            sizes.append(self.sizes[kept])
            counts.append(count[good])
            named = [c for c, ok in zip(short, good.tolist()) if ok]
            single += [c for c, ok in zip(short, good.tolist()) if not ok]
        for c in single:
            own, own_sizes = self._alone(c)
            ids.append(own)
            sizes.append(own_sizes)
            counts.append([len(own)])
        for c in (*named, *single):
            self.slots[c] = len(self.slots)
        if counts:
            self.ids = np.concatenate([self.ids, *ids]).astype(np.int32)
            self.bytes = np.concatenate([self.bytes, *sizes]).astype(np.int32)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def encode_rows(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of each text, with first and end source byte of each piece (see ``encode_spans``)."""
        plain = self.model.normaliser.plain
        # A word mark of the source's own is three bytes long, a blank's one: told apart one by one.
        easy = [plain and MARK not in t for t in texts]
        cuts = [self.model.cuts.findall(self.normal(t)) if ok else []
                for t, ok in zip(texts, easy)]
        self.learn(set().union(*cuts))
        each = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        slot = np.fromiter((self.slots[c] for own in cuts for c in own), dtype=np.int64,
                           count=int(each.sum()))
        begin, end = self.ends[slot], self.ends[slot + 1]
        n = end - begin
        past = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin - past[:-1], n) + np.arange(past[-1])
        ids, upto = self.ids[at], np.cumsum(self.bytes[at], dtype=np.int64)
        row_ends = past[np.concatenate([[0], np.cumsum(each)])]
        extra = int(self.model.normaliser.dummy_prefix)      # the blank put first has no byte
        out = []
        for i, ok in enumerate(easy):
            a, b = row_ends[i], row_ends[i + 1]
            if not ok:
                out.append(tuple(np.array(v, dtype=np.int64) for v in self.encode_spans(texts[i])))
                continue
            last = upto[a:b] - (upto[a - 1] if a else 0) - extra
            first = np.concatenate([[0], last[:-1]])[:b - a]
            out.append((ids[a:b], np.maximum(first, 0), np.maximum(last, 0)))
        return out

    def decode_rows(self, rows: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of the text each row of ids decodes to."""
        ids = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        begin = self.shown_ends[ids]
        n = self.shown_ends[ids + 1] - begin
        past = np.concatenate([[0], np.cumsum(n)])
        data = self.shown[np.repeat(begin - past[:-1], n) + np.arange(past[-1])].tobytes()
        ends = past[np.cumsum([0, *map(len, rows)])].tolist()
        out = []
        for a, b in zip(ends, ends[1:]):
            if self.model.normaliser.dummy_prefix and data[a:a + 1] == b" " and a < b:
                a += 1
            own = data[a:b]
            out.append(own if own.isascii() else own.decode("utf-8", "replace").encode())
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_rows([text])[0][0].tolist()

    def encode_spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with first and end source byte of each piece.

        A character written as several byte pieces belongs to the last of them; the others have
        empty spans before it. The blank put first has an empty span, too.
        """
        chars, begins, ends = self.model.normaliser(text)
        ids, first, last, at = [], [], [], 0
        for cut in self.model.cuts.findall(chars):
            for piece in self.model.merge(cut):
                known = self.model.ids.get(piece)
                a, b = int(begins[at]), int(ends[at + len(piece) - 1])
                at += len(piece)
                if known is None and self.model.byte_fallback:
                    raw = piece.encode()
                    ids += [self.model.bytes[x] for x in raw]
                    first += [a] * len(raw)
                    last += [a] * (len(raw) - 1) + [b]
                else:
                    ids.append(self.model.unknown if known is None else known)
                    first.append(a)
                    last.append(b)
        return ids, first, last

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """Number of ids, hash of the ids, hash of the text decoded from them, CRC of the spans."""
        rows = self.encode_rows(texts)
        name = self.names.__getitem__
        return [(len(ids), hashlib.sha256(",".join(map(name, ids.tolist())).encode()).hexdigest(),
                 hashlib.sha256(data).hexdigest(),
                 zlib.crc32(np.stack([first, last], axis=1).astype("<i8").tobytes()))
                for (ids, first, last), data in
                zip(rows, self.decode_rows([ids for ids, _, _ in rows]))]


@lru_cache(maxsize=2)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def read_model(path: str) -> bytes:
    """The model file, read on the driver; its bytes (a fixed, small size) travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, ids, begins, ends``.

    ``begins`` and ``ends`` are byte offsets into the UTF-8 source. Null and empty texts have no ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                rows = enc.encode_rows([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch(
                    [part.column(0), *(pa.array([r[k] for r in rows], pa.list_(pa.int32()))
                                       for k in range(3))],
                    names=["doc_id", "ids", "begins", "ends"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.record_batch(
                    [part.column(0), pa.array([data.decode() for data in made.decode_rows(
                        [np.array(x or [], dtype=np.int64) for x in part.column(1).to_pylist()])],
                        pa.string())],
                    names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256, spans_crc32`` of the text encoded and decoded again.

    ``spans_crc32`` is the CRC of first and end source byte of every piece, as little-endian 64-bit
    numbers.

    Null and empty texts have no ids; repeated rows and null ids give rows like any other. Other
    columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                rows = enc.digests([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.string()),
                     pa.array([r[3] for r in rows], pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
