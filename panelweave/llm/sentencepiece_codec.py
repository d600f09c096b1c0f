"""SentencePiece encoding and decoding with merge-type vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelweave.llm.texts import blocks

SPACE = "▁"
CACHED_UNITS = 400_000  # units of text kept per worker
CACHED_LENGTH = 48  # longer units are rare and are not kept

MERGED_TOGETHER = 8_000  # units
_NEVER = np.int64(1 << 62)


class MergeVocabulary:
    """Pieces, scores and ids of a merge-type model, taken from the bytes of its file."""

    def __init__(self, model: bytes) -> None:
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        self.bytes_id = {int(names[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self.id_of = {names[i]: i for i in range(n) if i not in special}
        self.score_of = {p: library.get_score(i) for p, i in self.id_of.items()}
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        shown = [b"" if i in special else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.bytes_id.items():
            shown[i] = bytes([b])
        shown[self.unknown] = " ⁇ ".encode()
        self.shown_length = np.fromiter(map(len, shown), np.int64, n)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        order = {s: k for k, s in enumerate(sorted(set(self.score_of.values()), reverse=True))}
        pairs = {
            self.id_of[p[:k]] << 32 | self.id_of[p[k:]]: (order[self.score_of[p]], i)
            for p, i in self.id_of.items()
            for k in range(1, len(p))
            if p[:k] in self.id_of and p[k:] in self.id_of
        }
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_rank, self.pair_piece = (np.array([pairs.get(p, (0, 0))[j] for p in self.pairs.tolist()], np.int64) for j in (0, 1))
        self.cut_words = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.cut_lines = self.cut_words and not any("\n" in p for p in self.id_of)
        if not self.cut_words:
            # pieces that reach over a word boundary: texts are not cut
            self.unit = re.compile(r".+", re.S)
        elif not self.cut_lines:
            self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n[^{SPACE}\n]*")

    def merge(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already written as the space mark.

        An agenda holds the adjacent pairs of symbols that make up a piece, best score first
        and leftmost among equals. Taking a pair joins its symbols and puts the two new
        neighbours on the agenda; a pair whose symbols have changed since is passed over.
        """
        symbols, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.score_of, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
                joined = pair + symbols[follower]
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined], left, follower, joined))
            leader = before[left]
            if leader >= 0:
                joined = symbols[leader] + pair
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined], leader, left, joined))
        ids: list[int] = []
        for s in symbols:
            if s:
                found = self.id_of.get(s)
                if found is not None:
                    ids.append(found)
                elif self.bytes_id:
                    ids.extend(self.bytes_id[b] for b in s.encode())
                else:
                    ids.append(self.unknown)
        return ids

    def merge_all(self, units: list[str]) -> list[bytes]:
        """``merge`` of many short units at once, as little-endian unsigned 32-bit ids.

        The symbols of some thousand units stand in one array. Each round takes, in every unit,
        the pair that heads its agenda (least key of score order and position) and joins it.
        """
        out: list[bytes] = []
        for i in range(0, len(units), MERGED_TOGETHER):
            out.extend(self._merge_some(units[i : i + MERGED_TOGETHER]))
        return out

    def _merge_some(self, units: list[str]) -> list[bytes]:
        symbols = self.char_id[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")].astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        whole = np.minimum.reduceat(symbols, starts) >= 0
        unknown = {i: np.array(self.merge(units[i]), "<u4").tobytes() for i in np.flatnonzero(~whole).tolist()}
        stay = np.repeat(whole, sizes)
        symbols, who, sizes = symbols[stay], np.flatnonzero(whole), sizes[whole]
        starts = np.cumsum(sizes) - sizes
        done_symbols, done_who, done_sizes = [], [], []
        rank, joined = self._pair_keys(symbols, starts)
        while len(who):
            order = np.where(rank < _NEVER, (rank << 32) | np.arange(len(symbols)), _NEVER)
            best = np.minimum.reduceat(order, starts)
            open_ = best < _NEVER
            if not open_.all():
                stay = np.repeat(open_, sizes)
                done_symbols.append(symbols[~stay])
                done_who.append(who[~open_])
                done_sizes.append(sizes[~open_])
                symbols, rank, joined = symbols[stay], rank[stay], joined[stay]
                who, sizes = who[open_], sizes[open_]
                if not len(who):
                    break
                best = (np.cumsum(stay) - 1)[best[open_] & 0xFFFFFFFF]
            else:
                best = best & 0xFFFFFFFF
            symbols[best] = joined[best]
            left = np.ones(len(symbols), bool)
            left[best + 1] = False
            symbols, rank, joined = symbols[left], rank[left], joined[left]
            best = best - np.arange(len(best))  # one symbol less in each unit before
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            for at, valid in ((best, best < ends), (best - 1, best > starts)):
                at = at[valid]
                rank[at], joined[at] = self._look_up(symbols[at], symbols[at + 1])
            rank[ends] = _NEVER
        raw = np.concatenate(done_symbols).astype("<u4").tobytes() if done_symbols else b""
        out: list[bytes] = [b""] * len(units)
        begin = 0
        for i, n in zip(np.concatenate([*done_who, []]).astype(int).tolist(), np.concatenate([*done_sizes, []]).astype(int).tolist()):
            out[i] = raw[begin : begin + 4 * n]
            begin += 4 * n
        for i, ids in unknown.items():
            out[i] = ids
        return out

    def _pair_keys(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, joined = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], joined[:-1] = self._look_up(symbols[:-1], symbols[1:])
        rank[starts[1:] - 1] = _NEVER
        return rank, joined

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score order and piece of each pair; no order where it makes up no piece."""
        wanted = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        found = self.pairs[at] == wanted
        return np.where(found, self.pair_rank[at], _NEVER), self.pair_piece[at]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: pieces with the space mark as a space, byte ids as they are."""
        lengths = self.shown_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.shown_start[ids] - (ends - lengths), lengths)
        return self.shown_bytes[at].tobytes()


class Codec:
    """Encoder of one worker: keeps the ids of short units, and checks each new unit."""

    def __init__(self, model: bytes) -> None:
        self.vocabulary = MergeVocabulary(model)
        self.kept: dict[str, bytes] = {}
        # the model may rewrite texts before it cuts them; then the library says how
        probe = " a ﬁ  b\t"
        self.plain = self.vocabulary.library.normalize(probe) == (SPACE + probe.replace(" ", SPACE))

    def units(self, text: str) -> list[str]:
        """Units of a text whose ids do not depend on what stands beside them. A plain word
        stands for itself with one space mark in front, one after a line end for itself."""
        if not text:
            return []
        if not self.plain:
            return self.vocabulary.unit.findall(self.vocabulary.library.normalize(text))
        spaced = text.replace("\n", " \n") if self.vocabulary.cut_lines else text
        if self.vocabulary.cut_words and "  " not in spaced and spaced[0] != " " and spaced[-1] != " " and SPACE not in text:
            return spaced.split(" ")
        return self.vocabulary.unit.findall(SPACE + text.replace(" ", SPACE))

    def marked(self, unit: str) -> str:
        return unit if unit[0] in (SPACE, "\n") or not self.plain or not self.vocabulary.cut_words else SPACE + unit

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units, through the agenda and compared with the library. The library puts a
        space in front of a text, so units are shown to it without theirs."""
        v = self.vocabulary
        if self.plain and v.cut_words:
            short = [u for u in new if len(u) <= CACHED_LENGTH and u[0] != "\n"]
            made = dict(zip(short, v.merge_all([self.marked(u) for u in short])))
            shown = [u for u in short if u != SPACE]
            for u, ids in zip(shown, v.library.encode([self.marked(u)[1:].replace(SPACE, " ") for u in shown], num_threads=1)):
                if array("I", ids).tobytes() != made[u]:
                    raise ValueError(f"agenda and library differ on {u!r}")
        else:
            made = {}
        for u in new:
            if u not in made:
                parts = ("\n", u[1:]) if v.cut_lines and u[0] == "\n" else (self.marked(u),)
                made[u] = b"".join(np.array(v.merge(p), "<u4").tobytes() for p in parts if p)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, begin and end included."""
        if len(self.kept) > CACHED_UNITS:
            self.kept = {}
        units = [self.units(t) for t in texts]
        new = set(itertools.chain.from_iterable(units)).difference(self.kept)
        known = self.kept
        if new:
            made = self.learn(list(new))
            long = {u for u in made if len(u) > CACHED_LENGTH}
            known.update(made)
        begin, end = (struct.pack("<I", i) for i in (self.vocabulary.begin, self.vocabulary.end))
        out = [b"".join((begin, *map(known.__getitem__, one), end)) for one in units]
        for u in long if new else ():
            del known[u]
        return out

    def decode(self, encoded: list[bytes]) -> list[str]:
        """Texts of ids: byte ids are read as UTF-8, and the space that encoding puts in
        front is taken away."""
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        raw = self.vocabulary.decode(ids)
        ends = np.cumsum(self.vocabulary.shown_length[ids])[np.cumsum([len(e) // 4 for e in encoded]) - 1] if encoded else []
        out, begin = [], 0
        for end in ends:
            if raw[begin : begin + 1] == b" ":
                out.append(raw[begin + 1 : end].decode("utf-8", "replace"))
            else:
                out.append(raw[begin:end].decode("utf-8", "replace"))
            begin = end
        return out


_codecs: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The worker's codec, so that tasks of one worker share what it keeps."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_decode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = (), text_column: str = "text") -> DataFrame:
    """Encode every text with begin and end ids, decode the ids again, and digest both.

    ``model`` is the content of a merge-type model file (under a megabyte for 32,000 pieces,
    sent with the tasks). Adds n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded UTF-8); ``keep`` may name ``ids`` and
    ``decoded`` to get those too. A column of the input with one of these names is replaced.
    A null text counts as empty: begin and end id only, decoded to an empty text. Narrow: one
    pass over the rows, no shuffle, whole texts whatever their length.
    """
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
    sql = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
    out = ["n_tokens", "ids_sha256", "decoded_sha256", *keep]
    made = {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    # without the decoded text the input text need not travel back
    stay = [c for c in docs.columns if c not in made and (keep or c != text_column)]
    source = docs.select(*stay, *([] if text_column in stay else [text_column]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in stay] + [f"{c} {sql[c]}" for c in out])

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in blocks(batches, text_column):
            encoded = codec.encode([t or "" for t in batch.column(text_column).to_pylist()])
            decoded = codec.decode(encoded)
            columns = {
                "n_tokens": [len(e) // 4 for e in encoded],
                "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                "decoded": decoded,
            }
            if "ids" in out:
                columns["ids"] = [np.frombuffer(e, "<i4") for e in encoded]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in stay] + [pa.array(columns[c], kinds[c]) for c in out], names=[*stay, *out])

    return source.mapInArrow(run, schema)
