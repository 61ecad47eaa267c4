"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The model file is compiled to three machines held in arrays:

* the normaliser, one state that reads a space as the space mark and puts one in front of a text; it is composed with
  the pieces when they are compiled;
* the pieces, a trie whose arcs read characters and whose final states write a piece, and beside it a byte
  fallback arc for every character without a piece;
* the merges, which read pairs of neighbouring pieces: a pair weighs nothing if the model's merges leave the
  two texts side by side as exactly these pieces, and infinity if some merge joins them first.

A normalised input is composed with them. The states of the composition are pairs of a position and the last piece; every
arc weighs one for its piece plus what the merges charge for the pair. Weights add along a path and the least path
wins (tropical semiring): states are relaxed in the order of positions, for all units of a batch at once. A prefix of
a text has exactly one segmentation of finite weight, so one state of each position stays finite, and the path to the end
is the segmentation of the merge model.

The model here is a merge model (BPE): adding up piece scores along a path, as for a unigram model, would
not give its segmentation, so the scores order the merges and do not add.

Defined results: a null or empty text has no tokens; text of any length is encoded whole; repeated rows are
encoded each; other columns are ignored. Control pieces in a text are plain text; a space mark in a
text is taken for a space, so that such a text does not come back (round_trip is false).
"""

from __future__ import annotations

import re
import struct
from itertools import islice
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import slices_by_bytes, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Largest model file that is sent to the executors.
MODEL_BYTES = 64 << 20
MARK = "▁"
#: Text composed at a time, and units up to UNIT_CHARS that a worker remembers (two generations of so many).
SLICE_BYTES = 2 << 20
KNOWN_UNITS, UNIT_CHARS = 60_000, 24
#: Units of more characters are relaxed one by one, this many positions at a time.
LONG_UNIT, POSITIONS = 64, 20_000
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The last piece of a state at the start or after a byte fallback arc: nothing merges over it.
NONE = -1
#: The weight of what no path reaches.
FAR = 1 << 30


def _fields(data: bytes):
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Arcs:
    """A fixed table from whole numbers to whole numbers, looked up many at a time (open addressing)."""

    def __init__(self, found: dict[int, int]):
        bits = max(4, (4 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        slots = self._slots(keys)
        while len(keys):
            free = np.nonzero(self.keys[slots] < 0)[0]
            taken, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], -1)
        open_ = np.nonzero((held != keys) & (held >= 0))[0]
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Transducer:
    def __init__(self, model: bytes):
        self.texts, ids, scores, self.byte_ids = [], {}, {}, np.zeros(256, np.uint16)
        self.prefix, charsmap, kind_of_model = True, b"", 1
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, own = piece[1].decode(), piece.get(3, NORMAL), len(self.texts)
                if kind in (NORMAL, USER):
                    ids[text], scores[text] = own, struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif kind == BYTE:
                    self.byte_ids[int(text[1:-1], 16)] = own
                self.texts.append(b"" if kind in (UNKNOWN, CONTROL) else bytes([int(text[1:-1], 16)]) if kind == BYTE else text.replace(MARK, " ").encode())
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, charsmap = bool(spec.get(3, 1)), spec.get(2, b"")
        if kind_of_model != 2 or charsmap:
            raise ValueError("only merge models with the identity normaliser are supported")
        if len(self.texts) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        if any(c not in ids for text in ids for c in text) or any(MARK in text.lstrip(MARK) for text in ids):
            raise ValueError("characters of pieces must be pieces, and no piece may go on over a space mark")
        # no piece goes over a space into the next word, nor over a line end unless the model has one
        self.units = re.compile(" *[^ \n]+| +|\n+" if "\n" not in ids else " *[^ ]+| +")
        self._compile_pieces(ids)
        self._compile_merges(ids, scores)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _compile_pieces(self, ids: dict[str, int]) -> None:
        chars = sorted(c for c in ids if len(c) == 1)
        #: codes of characters; 0 has no piece
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        if MARK in ids:
            self.codes[ord(" ")] = self.codes[ord(MARK)]  # the normaliser's arc, composed with the pieces beforehand
        self.width, self.longest = len(chars) + 1, max(map(len, ids))
        arcs, writes = {}, [NONE]
        for text, own in ids.items():
            node = 0
            for char in text:
                key = node * self.width + int(self.codes[ord(char)])
                node = arcs.get(key, 0)
                if not node:
                    node = arcs[key] = len(writes)
                    writes.append(NONE)
            writes[node] = own
        self.trie, self.writes = Arcs(arcs), np.array(writes, np.int32)

    def _compile_merges(self, ids: dict[str, int], scores: dict[str, float]) -> None:
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: when a piece is made (characters are there from the start), and the two pieces of its last merge
        self.made = np.full(len(self.texts), -1, np.int32)
        self.left, self.right = np.zeros(len(self.texts), np.int32), np.zeros(len(self.texts), np.int32)
        pairs = {}
        for text, own in ids.items():
            if len(text) < 2:
                continue
            self.made[own] = order[scores[text]]
            for k in range(1, len(text)):
                if text[:k] in ids and text[k:] in ids:
                    pairs[ids[text[:k]] << 16 | ids[text[k:]]] = order[scores[text]]
            parts = list(text)
            while len(parts) > 2:
                made = [order[scores[a + b]] if a + b in ids else len(order) for a, b in zip(parts, parts[1:])]
                at = made.index(min(made))  # the first of equals
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts[0] not in ids or parts[1] not in ids:
                raise ValueError("a piece that no merges make")
            self.left[own], self.right[own] = ids[parts[0]], ids[parts[1]]
        self.merges = Arcs(pairs)

    def admits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces weighs nothing: undoes the merges of the two, last first, and looks for one over the border that would have come before."""
        ok = np.ones(len(before), bool)
        at = np.nonzero((before >= 0) & (after >= 0))[0]
        a, b = before[at].astype(np.int64), after[at].astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int32).max, np.int32)
        while len(at):
            crossing = self.merges.get(a << 16 | b)
            bad = (crossing >= 0) & (crossing < limit)
            ok[at[bad]] = False
            of_a, of_b = self.made[a], self.made[b]
            on = ~bad & ((of_a >= 0) | (of_b >= 0))
            at, a, b, of_a, of_b = at[on], a[on], b[on], of_a[on], of_b[on]
            undo_b = of_b >= of_a  # of equal merges the left one comes first
            limit = np.where(undo_b, of_b + 1, of_a)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return ok

    def _compose(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all arcs over characters; ``ends`` has the end of each one's unit. Bytes are arcs of piece NONE."""
        alive, node = np.nonzero(code)[0], None
        lone = np.nonzero(code == 0)[0]
        found = [(lone, lone + 1, np.full(len(lone), NONE, np.int32))]
        node = np.zeros(len(alive), np.int64)
        for length in range(1, self.longest + 1):
            inside = alive + length <= ends[alive]
            alive, node = alive[inside], node[inside]
            node = self.trie.get(node * self.width + code[alive + length - 1])
            alive, node = alive[node > 0], node[node > 0].astype(np.int64)
            piece = self.writes[node]
            whole = piece >= 0
            found.append((alive[whole], alive[whole] + length, piece[whole]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _relax(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state (a position of a unit, its end included): the last piece, and the state before on the shortest path."""
        code = self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        unit, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        start, end, piece = self._compose(code, (first + sizes)[unit])
        own = unit[start]
        place = start - first[own]
        order = np.argsort(place.astype(np.int16) if len(sizes) > 1 else place, kind="stable")
        start, end, piece, place = (start + own)[order], (end + own)[order], piece[order], place[order]
        states = len(code) + len(sizes)
        weight = np.full(states, FAR, np.int32)
        weight[first + np.arange(len(sizes))] = 0
        last, back = np.full(states, NONE, np.int32), np.zeros(states, np.int64)
        steps = np.concatenate([[0], np.cumsum(np.bincount(place))])
        for low, high in zip(steps[:-1], steps[1:]):
            s, e, p = start[low:high], end[low:high], piece[low:high]
            total = np.where(self.admits(last[s], p), weight[s] + 1, FAR)
            less = total < weight[e]
            e = e[less]
            weight[e], last[e], back[e] = total[less], p[less], s[less]
        return last, back

    def _relax_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long unit, by runs of positions; all pairs of arcs that meet are weighed beforehand."""
        code = self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        weight, last, back = [0] + [FAR] * len(code), [NONE] * (len(code) + 1), [0] * (len(code) + 1)
        for low in range(0, len(code), POSITIONS):
            part = code[low : low + POSITIONS + self.longest]
            start, end, piece = self._compose(part, np.full(len(part), len(part)))
            order = np.argsort(start, kind="stable")
            start, end, piece = (x[order] for x in (start, end, piece))
            starts = np.searchsorted(start, np.arange(len(part) + 1))
            after = np.repeat(np.arange(len(end)), np.diff(np.append(starts, len(start)))[np.minimum(end, len(part))])
            following = starts[np.minimum(end[after], len(part))] + np.arange(len(after)) - np.searchsorted(after, after)
            pairs = np.unique(piece[after].astype(np.int64) << 32 | (piece[following].astype(np.int64) & 0xFFFFFFFF))
            # pieces that end where this run begins
            begins = piece[start < self.longest]
            held = np.unique(np.array(last[max(0, low - self.longest) : low + self.longest + 1], np.int64))
            pairs = np.unique(np.concatenate([pairs, np.repeat(held, len(begins)) << 32 | (np.tile(begins, len(held)).astype(np.int64) & 0xFFFFFFFF)]))
            before, behind = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            free = set(pairs[self.admits(before, behind)].tolist())
            kept = start < min(POSITIONS, len(code) - low)
            for s, e, p in zip((start[kept] + low).tolist(), (end[kept] + low).tolist(), piece[kept].tolist()):
                total = weight[s] + 1
                if total < weight[e] and (last[s] << 32 | (p & 0xFFFFFFFF)) in free:
                    weight[e], last[e], back[e] = total, p, s
        return np.array(last, np.int32), np.array(back, np.int64)

    def shortest_paths(self, units: list[str]) -> list[bytes]:
        """Ids (16 bits each) of the shortest path of each unit."""
        out = [b""] * len(units)
        short = [n for n, u in enumerate(units) if 0 < len(u) <= LONG_UNIT]
        groups = [short] if short else []
        groups += [[n] for n, u in enumerate(units) if len(u) > LONG_UNIT]
        for group in groups:
            text, sizes = "".join(units[n] for n in group), np.array([len(units[n]) for n in group])
            last, back = self._relax(text, sizes) if len(sizes) > 1 or sizes[0] <= LONG_UNIT else self._relax_long(text)
            ends = np.cumsum(sizes + 1) - 1
            firsts = ends - sizes
            on, at, home = np.zeros(len(last), bool), ends, firsts
            while len(at):
                on[at] = True
                at = back[at]
                more = at != home
                at, home = at[more], home[more]
            states = np.nonzero(on)[0]
            ids, times = last[states], np.ones(len(states), np.int64)
            lone = np.nonzero(ids == NONE)[0]
            if len(lone):
                unit = np.searchsorted(ends, states[lone])
                spelt = [text[p].encode() for p in (states[lone] - unit - 1).tolist()]
                times[lone] = [len(x) for x in spelt]
                ids, places = np.repeat(ids, times), np.repeat(np.arange(len(states)), times)
                ids[np.isin(places, lone)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
            written = np.concatenate([[0], np.cumsum(times)])
            cuts = 2 * written[np.searchsorted(states, np.concatenate([[0], ends + 1]))]
            flat = ids.astype(np.uint16).tobytes()
            for n, low, high in zip(group, cuts[:-1].tolist(), cuts[1:].tolist()):
                out[n] = flat[low:high]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts. Units that repeat are composed once; a bounded number is remembered from call to call."""
        front = " " if self.prefix else ""
        split = [self.units.findall(front + t.replace(MARK, " ")) if t else [] for t in texts]
        known, new = {}, []
        for unit in set().union(*split):
            ids = self.young.get(unit) or self.old.get(unit)
            if ids is None:
                new.append(unit)
            else:
                known[unit] = ids
        known.update(zip(new, self.shortest_paths(new)))
        self.young.update((unit, known[unit]) for unit in known if len(unit) <= UNIT_CHARS)
        if len(self.young) > KNOWN_UNITS:
            self.old, self.young = dict(islice(self.young.items(), KNOWN_UNITS)), {}
        return [np.frombuffer(b"".join(map(known.__getitem__, units)), np.uint16) for units in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        text = b"".join(map(self.texts.__getitem__, ids if isinstance(ids, list) else ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def read_model(path: str) -> bytes:
    model = Path(path).read_bytes()
    if len(model) > MODEL_BYTES:
        raise ValueError("the model is too large to send to every executor")
    return model


def encode_documents(docs: DataFrame, model_path: str = MODEL, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns, token_ids, n_tokens, and round_trip: whether decoding gives the text back."""
    machine = docs.sparkSession.sparkContext.broadcast(Transducer(read_model(model_path)))  # some 30 MB of tables
    ids = list(id_columns)

    def run(batches):
        import pyarrow as pa

        compiled = machine.value
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                coded = compiled.encode_all(texts)
                ends = np.cumsum([0] + [len(c) for c in coded]).astype(np.int32)
                flat = pa.array(np.concatenate(coded).astype(np.int32))
                same = pa.array([compiled.decode(c) == t for c, t in zip(coded, texts)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ids), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(np.diff(ends).astype(np.int64)), same],
                    [*ids, "token_ids", "n_tokens", "round_trip"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    return docs.select(*ids, "text").mapInArrow(run, f"{kinds}, token_ids array<int>, n_tokens long, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", "n_tokens", F.crc32(joined.cast("binary")).alias("ids_crc32"), "round_trip")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
