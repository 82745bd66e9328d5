"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A text, with a space put before it, is cut before each run of spaces; a stretch is a run, as white-space markers U+2581,
and what follows it up to the next. Where no piece has a marker behind another character, none spans a cut, and the best
path of a text is the best paths of its stretches (else a text is one stretch). Stretches are looked up once for each
batch of new ones: the trie is walked for all of them together, position by position. What no piece covers becomes byte
pieces, as does a U+2581 of the text itself; so decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
#: Characters of a table of long stretches; one that is longer has a table of its own.
CELLS = 1_000_000
#: Tables of at most so many stretches are filled one by one.
FEW = 24
#: Stretches that one task remembers at most; beyond it starts anew.
REMEMBERED = 400_000


def fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint():
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
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


@dataclass
class Pieces:
    texts: list[str]
    scores: list[float]
    kinds: list[int]

    @classmethod
    def read(cls, path: str) -> Pieces:
        """Pieces of a model file. Those of a unigram model keep their log scores. A BPE model has ranks instead of
        probabilities; its normal pieces get the logarithms of Zipf's law over their ranks, which sums to 1."""
        with open(path, "rb") as f:
            whole = list(fields(f.read()))
        out, unigram = cls([], [], []), True
        for number, value in whole:
            if number == 1:
                piece = dict(fields(value))
                out.texts.append(piece[1].decode())
                out.scores.append(piece.get(2, 0.0))
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
        if not unigram:
            ranked = sorted((i for i, k in enumerate(out.kinds) if k == NORMAL), key=lambda i: (-out.scores[i], i))
            whole = math.log(sum(1 / (rank + 2) for rank in range(len(ranked))))
            for rank, i in enumerate(ranked):
                out.scores[i] = -math.log(rank + 2) - whole
        return out


class DoubleArray:
    """A trie over bytes: from state s by byte b to t = base[s] + b + 1 if check[t] == s; value[t] is a piece or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for b in key:
                found = children[node].get(b)
                if found is None:
                    found = children[node][b] = len(children)
                    children.append({})
                node = found
            ends[node] = value
        room = len(children) * 2 + 4096
        base, check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        value, used = np.full(room, -1, np.int32), np.zeros(room, bool)
        used[0], first = True, 1
        queue = [(0, 0)]
        for node, state in queue:
            value[state] = ends.get(node, -1)
            if not children[node]:
                continue
            steps = np.array(sorted(children[node])) + 1
            place, b = first, -1
            while b < 0:
                if place + 2048 + 260 >= len(used):
                    grow = len(used)
                    base, check = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32))
                    value, used = np.append(value, np.full(grow, -1, np.int32)), np.append(used, np.zeros(grow, bool))
                free = place + np.flatnonzero(~used[place : place + 2048]) - int(steps[0])
                free = free[free >= 0]
                fits = np.flatnonzero(~used[free[:, None] + steps].any(axis=1))
                if len(fits):
                    b = int(free[fits[0]])
                elif len(free) < 200:
                    first = place + 2048  # nearly full: later nodes don't look here again
                place += 2048
            base[state] = b
            for c, child in children[node].items():
                t = b + c + 1
                used[t], check[t] = True, state
                queue.append((child, t))
        n = int(np.flatnonzero(used)[-1]) + 260
        self.base, self.check, self.value = (np.resize(x[:n], n) if len(x) >= n else np.append(x, np.full(n - len(x), -1, np.int32)) for x in (base, check, value))


class Unigram:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        whole = {p.encode(): i for i, (p, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k in (NORMAL, USER)}
        self.trie = DoubleArray(whole)
        #: Some piece could join stretches.
        self.joins = any(re.search(f"[^{MARK}]{MARK}", pieces.texts[i]) for i in whole.values())
        self._lists: tuple[list, list, list, list] | None = None
        self.longest = max(map(len, whole), default=1)
        self.bytes = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model lacks byte pieces")
        self.scores = np.array(pieces.scores, dtype=np.float64)
        #: A character that no piece covers costs this, however many bytes it has.
        self.uncovered = min((s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == NORMAL), default=0.0) - 10.0
        #: Ids of each stretch as 32-bit numbers.
        self.seen: dict[str, bytes] = {}

    def paths(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """Ids of the best path of each stretch, its marker included. Of equal paths the one whose last piece starts
        first wins, then that of the prefix."""
        out: list[tuple[int, ...] | None] = [None] * len(stretches)
        for block in range(0, len(stretches), 20_000):
            for i, ids in enumerate(self._block([s.encode("utf-8", "surrogatepass") for s in stretches[block : block + 20_000]])):
                out[block + i] = ids
        return out

    def _block(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        trie, n = self.trie, len(raw)
        if n <= FEW:
            return [self._one(r) for r in raw]
        size = np.array([len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        size, most = size[order], int(size.max(initial=0))
        filled = b"".join([raw[i].ljust(most + 1, b"\0") for i in order])
        text = np.frombuffer(filled, np.uint8).reshape(n, most + 1).T.copy()
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        came = np.zeros((most + 1, n), np.int32)
        piece = np.full((most + 1, n), -1, np.int32)
        for start in range(most):
            m = int(np.searchsorted(-size, -start, side="left"))  # stretches longer than start
            lead = text[start, :m]
            live = np.flatnonzero((best[start, :m] > -np.inf) & ((lead & 0xC0) != 0x80))
            if not len(live):
                continue
            # a character without a piece: byte pieces
            b = text[start, live]
            step = 1 + (b >= 0xC0) + (b >= 0xE0).astype(np.int64) + (b >= 0xF0)
            stop = np.minimum(start + step, size[live])
            better = best[start, live] + self.uncovered > best[stop, live]
            at, to = live[better], stop[better]
            best[to, at], came[to, at], piece[to, at] = best[start, at] + self.uncovered, start, -1
            state = np.zeros(len(live), np.int32)
            for k in range(min(self.longest, most - start)):
                keep = size[live] > start + k
                live, state = live[keep], state[keep]
                t = trie.base[state] + text[start + k, live] + 1
                ok = trie.check[t] == state
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                found = trie.value[state]
                has = np.flatnonzero(found >= 0)
                if len(has):
                    cols, ids = live[has], found[has]
                    score = best[start, cols] + self.scores[ids]
                    better = score > best[start + k + 1, cols]
                    cols, ids = cols[better], ids[better]
                    best[start + k + 1, cols], came[start + k + 1, cols], piece[start + k + 1, cols] = score[better], start, ids
        out: list = [None] * n
        came_t, piece_t, bytes_of = came.T.tolist(), piece.T.tolist(), self.bytes
        for k, i in enumerate(order):
            at, ids = len(raw[i]), []
            while at > 0:
                p, before = piece_t[k][at], came_t[k][at]
                if p >= 0:
                    ids.append(p)
                else:
                    ids += bytes_of[np.frombuffer(raw[i][before:at], np.uint8)].tolist()[::-1]
                at = before
            out[i] = tuple(ids[::-1])
        return out

    def _one(self, raw: bytes) -> tuple[int, ...]:
        """As _block(), for one stretch, whose length costs time and memory in proportion."""
        if self._lists is None:
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n, uncovered = len(raw), self.uncovered
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            own, lead = best[start], raw[start]
            if own == -math.inf or lead & 0xC0 == 0x80:
                continue
            stop = min(n, start + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
            if own + uncovered > best[stop]:
                best[stop], came[stop], piece[stop] = own + uncovered, start, -1
            state = 0
            for at in range(start, min(n, start + self.longest)):
                t = base[state] + raw[at] + 1
                if check[t] != state:
                    break
                state = t
                found = value[t]
                if found >= 0 and own + scores[found] > best[at + 1]:
                    best[at + 1], came[at + 1], piece[at + 1] = own + scores[found], start, found
        ids: list[int] = []
        while n:
            before = came[n]
            ids += [piece[n]] if piece[n] >= 0 else self.bytes[list(raw[before:n])].tolist()[::-1]
            n = before
        return tuple(ids[::-1])

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers; null and empty texts have none."""
        cut = [([t] if self.joins else stretches(t)) if t else [] for t in texts]
        seen = self.seen
        new = list({s for c in cut for s in c if s not in seen})
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = list({s for c in cut for s in c})
        seen.update((s, np.array(ids, np.int32).tobytes()) for s, ids in zip(new, self.paths_of(new), strict=True))
        get = seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def paths_of(self, found: list[str]) -> list[tuple[int, ...]]:
        """As paths(), for stretches as the text has them: without the first marker, which is put before all, with spaces
        for the others, and with the text's own U+2581 as bytes."""
        out: list = [None] * len(found)
        mark = MARK.encode()
        short = [i for i, s in enumerate(found) if len(s) < 48 and MARK not in s]
        for low, high in ((0, 12), (12, 48)):  # apart, so that a table is about as wide as its stretches
            of = [i for i in short if low <= len(found[i]) < high]
            for start in range(0, len(of), 20_000):
                some = of[start : start + 20_000]
                for i, ids in zip(some, self._block([mark + found[i].replace(" ", MARK).encode("utf-8", "surrogatepass") for i in some]), strict=True):
                    out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._cut_paths([found[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _cut_paths(self, found: list[str]) -> list[tuple[int, ...]]:
        parts: list[str] = []
        plan: list[list[int | tuple[int, ...]]] = []
        own = tuple(self.bytes[list(MARK.encode())].tolist())
        for s in found:
            row: list[int | tuple[int, ...]] = []
            for k, piece in enumerate(s.split(MARK)):
                piece = piece.replace(" ", MARK)
                if k:
                    row.append(own)
                marked = piece if k else MARK + piece
                if marked:
                    row.append(len(parts))
                    parts.append(marked)
            plan.append(row)
        # in order of length, so that a table is about as wide as its stretches
        ids: dict[int, tuple[int, ...]] = {}
        some: list[int] = []
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for k, i in enumerate(order):
            some.append(i)
            if k + 1 == len(order) or (len(some) + 1) * len(parts[order[k + 1]]) > CELLS:
                ids.update(zip(some, self._block([parts[x].encode("utf-8", "surrogatepass") for x in some]), strict=True))
                some = []
        return [sum((ids[x] if isinstance(x, int) else x for x in row), ()) for row in plan]

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        texts, kinds = self.pieces.texts, self.pieces.kinds
        for i in ids:
            if kinds[i] == BYTE:
                out.append(int(texts[i][1:-1], 16))
            elif kinds[i] != CONTROL:
                out += texts[i].replace(MARK, " ").encode()
        return out.decode("utf-8", "surrogatepass")[1:] if out else ""

    def decoder(self):
        """decode() for many: bytes of each piece are looked up."""
        table = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, k in zip(self.pieces.texts, self.pieces.kinds, strict=True)]
        get = table.__getitem__
        return lambda ids: b"".join(map(get, ids))[1:].decode("utf-8", "surrogatepass")


def stretches(text: str) -> list[str]:
    """The parts of " " + text that begin with its runs of spaces, each without its first space."""
    found = text.split(" ")
    if "" in found:
        found = [s[1:] for s in re.findall(" +[^ ]*", " " + text)]
    return found


def encode(docs: DataFrame, model: str | Pieces = MODEL) -> DataFrame:
    """docs with piece_ids (array<int>), n_pieces and decoded_exactly; where docs has a column of such a name, the new
    one's ends in underscores.

    model: a path that the driver reads, or pieces. They are broadcast: a vocabulary's size is fixed. Null and empty
    texts have no ids; the whole text is encoded, decoded again and compared. Of paths with equal scores the one whose
    last piece starts first wins, then that of the prefix. An empty table gives an empty one.
    """
    pieces = model if isinstance(model, Pieces) else Pieces.read(model)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    names = [fresh(docs, n) for n in ("piece_ids", "n_pieces", "decoded_exactly")]
    schema = docs.selectExpr("*", *(f"{e} as `{n}`" for e, n in zip(("cast(null as array<int>)", "0", "true"), names, strict=True))).schema

    def run(batches):
        coder = Unigram(sent.value)
        back = coder.decoder()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column("text").to_pylist()
                ids = coder.encode_packed(texts)
                same = [back(np.frombuffer(i, np.int32).tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) // 4 for i in ids], np.int32)
                starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                made = [pa.ListArray.from_arrays(starts, flat), pa.array(sizes), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | Pieces = MODEL, ids: str = "piece_ids") -> DataFrame:
    """encoded with the column decoded, the text of its column `ids`; null ids give null. Where there is a column decoded,
    the new one's name ends in underscores."""
    pieces = model if isinstance(model, Pieces) else Pieces.read(model)
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)
    name = fresh(encoded, "decoded")
    schema = encoded.selectExpr("*", f"'' as `{name}`").schema

    def run(batches):
        back = Unigram(sent.value).decoder()
        for b in batches:
            texts = [None if i is None else back(i) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return encoded.mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
