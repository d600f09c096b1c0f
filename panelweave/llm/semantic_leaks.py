"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import settled
from panelweave.llm.texts import blocks, mix, runs_within, utf8, words

TERMS = 1 << 15  # buckets of hashed words
RANK = 80
PASSAGE = 32  # words
STRIDE = 16  # words between passages: a run of STRIDE + 1 words lies whole in one of them
QUERY_STRIDE = 8
COSINE = 0.44  # for a full passage; less for shorter items, which share their passage with other text
WHOLE_MATCH = 0.8  # share of an item's words, in order, that settles a leak by itself
PARAPHRASE = 0.5  # share that does with the answer
ANSWER = 4  # closing words of an item
RUNS_TOGETHER = 1 << 9  # sums of rows taken at a time, so that they stay in cache
CHUNKS = 64
SLOTS = 1 << 12  # of the table that tells which words stand around a passage
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(PUNCTUATION.encode())] = False


def plain(text: Column) -> Column:
    """Lower case without punctuation, so that marks and capitals do not hide a passage."""
    return F.translate(F.lower(text), PUNCTUATION, "")


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-bit word hashes of each plain text with a word, as bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = utf8(batch.column("text"))
            keep = _IS_WORD[data]  # as in ``plain``; these bytes stand in no other character
            hashes, owner = words(data[keep], np.append(0, np.cumsum(keep))[offsets])
            bounds = runs_within(owner, batch.num_rows)
            have = np.flatnonzero(np.diff(bounds))
            raw = (hashes >> np.uint64(32)).astype(np.uint32).tobytes()
            packed = [raw[4 * bounds[i] : 4 * bounds[i + 1]] for i in have.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(have)), pa.array(packed, pa.binary())], names=["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id bigint, words binary")


def terms_of(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Term of each word; a word that repeats the one before gets the empty term TERMS, so that
    a passage of one repeated word is no heavier than others."""
    terms = (hashes >> np.uint32(32 - 15)).astype(np.int64)
    terms[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] = TERMS
    return terms


def row_sums(matrix: np.ndarray, picks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows that each group of neighbouring ``picks`` names. Groups start at
    ``begins`` and have 1 to STRIDE picks; the larger come first, so that a step adds one row to
    each of many groups."""
    sizes = np.diff(np.append(begins, len(picks)))
    order = np.argsort((STRIDE - sizes).astype(np.uint16), kind="stable")
    out = np.empty((len(begins), matrix.shape[1]), matrix.dtype)
    row = np.empty((RUNS_TOGETHER, matrix.shape[1]), matrix.dtype)
    for a in range(0, len(order), RUNS_TOGETHER):
        part = order[a : a + RUNS_TOGETHER]
        first, size = begins[part], sizes[part]
        total = matrix.take(picks[first], axis=0)
        for j in range(1, size[0]):
            n = np.searchsorted(-size, -j)  # groups of more than j picks
            total[:n] += np.take(matrix, picks[first[:n] + j], axis=0, out=row[:n], mode="clip")
        out[part] = total
    return out


@dataclass
class Passages:
    """Words of some texts, cut into runs of STRIDE words. A passage is two neighbouring runs of
    a text, or its only one."""

    hashes: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.terms = terms_of(self.hashes, np.repeat(np.arange(len(self.sizes)), self.sizes))
        counts = -(-self.sizes // STRIDE)
        self.owner = np.repeat(np.arange(len(self.sizes)), counts)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begins = (np.cumsum(self.sizes) - self.sizes)[self.owner] + number * STRIDE
        joined = self.owner[1:] == self.owner[:-1]
        follows, led = np.append(joined, False), np.insert(joined, 0, False)
        self.first = np.flatnonzero(follows | ~led)
        self.paired = follows[self.first]

    def rows(self, matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Rows of the TF-IDF matrix, each scaled to length 1, times the weighted matrix."""
        runs = row_sums(matrix, self.terms, self.begins)
        rows = runs[self.first]
        rows[self.paired] += runs[self.first[self.paired] + 1]
        return rows * self.scales(weights)[:, None]

    def scales(self, weights: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(np.square(weights)[self.terms], self.begins)
        total = squares[self.first]
        total[self.paired] += squares[self.first[self.paired] + 1]
        return (1 / np.sqrt(np.maximum(total, 1e-9))).astype(np.float32)


def unpacked(batches) -> Iterator[tuple[pa.RecordBatch, Passages]]:
    for batch in blocks(batches, "words", 1 << 19):
        raw = batch.column("words").to_pylist()
        yield batch, Passages(np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4)


@dataclass
class LatentSpace:
    """Term weights, and the projection to whitened latent coordinates (weights included)."""

    weights: np.ndarray
    projection: np.ndarray


def document_weights(tokens: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term over all documents; 0 for the empty term."""

    def frequencies(batches) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS + 1, np.int64), 0
        for _, p in unpacked(batches):
            bounds = np.append(0, np.cumsum(p.sizes)).tolist()
            for a, b in zip(bounds, bounds[1:]):
                total[p.terms[a:b]] += 1  # once for a term, however often it is listed
            n += len(p.sizes)
        total[TERMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["term", "n"])

    counted = tokens.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(TERMS + 1)
    for r in counted.toLocalIterator():
        frequency[r["term"]] = r["n"]
    weights = np.log((frequency[TERMS] + 1) / (frequency + 1))
    weights[TERMS] = 0
    return weights.astype(np.float32)


def fit(tokens: DataFrame, rank: int = RANK, seed: int = 3) -> LatentSpace:
    """Randomised singular value decomposition of the matrix A of all passages (rows: TF-IDF of
    length 1).

    Tasks send Y = A^T A G for a random test matrix G, summed over their own passages and cut
    into chunks of terms; the chunks are added up in two steps. From Y and G the driver gets the
    leading right singular vectors and values (A^T A is about Y (G^T Y)^-1 Y^T), TERMS x rank
    numbers whatever the corpus. The projection divides by the values, so all latent directions
    count alike.
    """
    weights = document_weights(tokens)
    test = np.random.default_rng(seed).standard_normal((TERMS + 1, rank)).astype(np.float32)
    test[TERMS] = 0
    weighted = test * weights[:, None]

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS + 1, rank))
        for _, p in unpacked(batches):
            if not len(p.begins):
                continue
            rows = p.rows(weighted, weights) * p.scales(weights)[:, None]
            runs = np.zeros((len(p.begins), rank), np.float32)  # of the passages that a run is in
            runs[p.first] += rows
            runs[p.first[p.paired] + 1] += rows[p.paired]
            order = np.argsort(p.terms.astype(np.uint16), kind="stable")
            terms = p.terms[order]
            run = np.repeat(np.arange(len(p.begins)), np.diff(np.append(p.begins, len(terms))))[order]
            new = np.append(True, terms[1:] != terms[:-1])
            cuts = np.flatnonzero(new)
            place = np.arange(len(terms)) - np.repeat(cuts, np.diff(np.append(cuts, len(terms))))
            groups = np.flatnonzero(place % STRIDE == 0)
            total[terms[cuts]] += np.add.reduceat(row_sums(runs, run, groups), np.flatnonzero(new[groups]), axis=0)
        size = TERMS // CHUNKS
        for i in range(CHUNKS):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i * size : (i + 1) * size].astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part"])

    fan = F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(8))  # task number
    sums = _added(_added(tokens.mapInArrow(multiply, "chunk bigint, part binary").withColumn("fan", fan), ["chunk", "fan"]), ["chunk"])
    parts = {r["chunk"]: np.frombuffer(r["part"], np.float32) for r in sums.toLocalIterator()}
    if not parts:
        return LatentSpace(weights, np.zeros((TERMS + 1, 1), np.float32))
    y = np.concatenate([parts[i] for i in sorted(parts)]).reshape(TERMS, rank).astype(np.float64) * weights[:TERMS, None]
    middle = test[:TERMS].T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    if not good.any():
        return LatentSpace(weights, np.zeros((TERMS + 1, 1), np.float32))
    left, singular, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    real = singular > singular.max() * 1e-6
    projection = np.zeros((TERMS + 1, int(real.sum())), np.float32)
    projection[:TERMS] = left[:, real] / singular[real] * weights[:TERMS, None]
    return LatentSpace(weights, projection)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of packed arrays by key."""
    names = [*keys, "part"]

    def add(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, p in zip(*(batch.column(c).to_pylist() for c in names)):
                value = np.frombuffer(p, np.float32).astype(np.float64)
                held[tuple(key)] = held[tuple(key)] + value if tuple(key) in held else value
        columns = [pa.array([k[i] for k in held], pa.int64()) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v.astype(np.float32).tobytes() for v in held.values()], pa.binary())], names=names)

    schema = ", ".join([f"{k} bigint" for k in keys] + ["part binary"])
    return parts.select(*names).repartition(CHUNKS, *keys).mapInArrow(add, schema)


def lcs_length(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit per pattern word and a step per text word."""
    at: dict[int, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    row, full = 0, (1 << len(pattern)) - 1
    for w in text:
        hit = row | at.get(w, 0)
        row = hit & ~(hit - ((row << 1) | 1)) & full
    return row.bit_count()


class Certain:
    """Words that a passage cannot lack where an item is accepted, looked up exactly.

    WHOLE_MATCH of an item's words leaves few of its words out, so of its rarest words, one more
    than those, at least one stands there; by PARAPHRASE its closing words stand there in a row.
    So these two kinds of runs of words lead to every accepted pair, whatever its cosine.
    """

    def __init__(self, spelled: list[np.ndarray], weights: np.ndarray) -> None:
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        listed: dict[int, dict[bytes, list[int]]] = {}
        for k, x in enumerate(spelled):
            need = next(n for n in range(len(x) + 1) if n / len(x) >= WHOLE_MATCH)
            rarest = np.argsort(-weights[x >> np.uint32(32 - 15)], kind="stable")[: len(x) - need + 1]
            for run in {x[-ANSWER:].tobytes(), *(x[j : j + 1].tobytes() for j in rarest)}:
                listed.setdefault(len(run) // 4, {}).setdefault(run, []).append(k)
        self.tables = []
        for size, runs in listed.items():
            keys = self.keys(np.frombuffer(b"".join(runs), np.uint32).reshape(-1, size))
            order = np.argsort(keys, kind="stable")
            owned = list(runs.values())
            slots = np.zeros(1 << 16, bool)
            slots[np.frombuffer(b"".join(runs), np.uint32)[::size] & np.uint32(0xFFFF)] = True
            counts = np.array([len(owned[i]) for i in order], np.int64)
            self.tables.append((size, slots, keys[order], np.cumsum(counts) - counts, counts, np.array([k for i in order for k in owned[i]], np.int64)))

    @staticmethod
    def keys(runs: np.ndarray) -> np.ndarray:
        """One number for each run of words; equal runs have equal numbers."""
        total = np.zeros(len(runs), np.uint64)
        for j in range(runs.shape[1]):
            total = mix(total + runs[:, j].astype(np.uint64))
        return total

    def mark(self, want: np.ndarray, hashes: np.ndarray, begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Set ``want`` (passage, item) where such a run stands among the words that are compared
        with the item. ``begins`` are of neighbouring passages, in order; ``starts`` and ``ends``
        bound the texts."""
        longest = int(self.sizes.max(initial=0))
        low, high = max(0, begins[0] - longest), min(len(hashes), begins[-1] + PASSAGE + longest)
        for size, slots, keys, offsets, counts, owned in self.tables:
            at = np.flatnonzero(slots[hashes[low:high] & np.uint32(0xFFFF)]) + low
            text = np.searchsorted(ends, at, side="right")
            whole = at + size <= ends[text]
            at, text = at[whole], text[whole]
            met = self.keys(hashes[at[:, None] + np.arange(size)])
            key = np.minimum(np.searchsorted(keys, met), len(keys) - 1)
            same = keys[key] == met
            at, text, key = at[same], text[same], key[same]
            for a in range(0, len(at), 256):
                n = counts[key[a : a + 256]]
                of = np.repeat(np.arange(a, a + len(n)), n)
                item = owned[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + offsets[key[of]]]
                first = np.searchsorted(begins, np.maximum(at[of] + size - PASSAGE - self.sizes[item], starts[text[of]]))
                last = np.searchsorted(begins, np.minimum(at[of] + self.sizes[item], ends[text[of]] - 1), side="right")
                reached = np.maximum(last - first, 0)
                passage = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached) + np.repeat(first, reached)
                want[passage, np.repeat(item, reached)] = True


def leaks(docs: DataFrame, items: DataFrame, rank: int = RANK, cosine: float = COSINE, tokens: DataFrame | None = None) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of it.

    Latent coordinates are those of the randomised SVD of all passages, divided by its values. Every passage
    (PASSAGE words, every STRIDE) of every whole text is compared, in blocks, with the passages
    of the items; pairs whose cosine reaches ``cosine`` (times the square root of the share of a
    passage that a shorter item fills) are candidates, and so are, whatever their cosine, all pairs
    that the rule below can accept (see ``Certain``). For these the longest
    common subsequence of the item's words and the words around the passage is taken: from
    WHOLE_MATCH of the item's words it is a leak, from PARAPHRASE only if the item's closing
    ANSWER words stand there in a row.

    ``items`` (item_id, text) is the stated query set. It is read in slices of 4,096 items, one
    search pass each, so what a task holds of it is bounded. Returns doc_id, item_id, cosine,
    lcs_share and answer_found (of the best passage), one row per id pair. Null and empty texts
    and items without words match nothing.
    """
    tokens = settled(tokenised(docs), "words") if tokens is None else tokens
    space = fit(tokens, rank)
    listed = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), plain(F.col("text")).alias("text"))
    found: DataFrame | None = None
    n = listed.count()
    slices = max(1, -(-n // 4096))
    for i in range(slices):
        part = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i) if slices > 1 else listed
        rows = part.collect()  # about 4,096 items
        got = _search(tokens, space, [(r["item_id"], r["text"]) for r in rows], cosine)
        found = got if found is None else found.unionByName(got)
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_found"), F.struct("lcs_share", "answer_found", "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _search(tokens: DataFrame, space: LatentSpace, items: list[tuple[int, str]], cosine: float) -> DataFrame:
    hashed = [(i, (words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] >> np.uint64(32)).astype(np.uint32)) for i, t in items]
    hashed = [(i, h) for i, h in hashed if len(h)]
    certain = Certain([h for _, h in hashed], space.weights)
    queries, of, marks = [], [], []
    for k, (_, h) in enumerate(hashed):
        last = max(len(h) - PASSAGE, 0)
        for a in sorted({min(a, last) for a in range(0, last + QUERY_STRIDE, QUERY_STRIDE)}):
            part = h[a : a + PASSAGE]
            queries.append(space.projection[terms_of(part, np.zeros(len(part), np.int64))].sum(axis=0))
            of.append(k)
            marks.append(cosine * (len(part) / PASSAGE) ** 0.5)
    least = np.array(marks, np.float32)
    query = np.array(queries, np.float32).reshape(len(of), space.projection.shape[1])
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    of_item, spelled = np.array(of, np.int64), [h.tolist() for _, h in hashed]
    first_query = np.searchsorted(of_item, np.arange(len(spelled) + 1)).tolist()
    longest = max(map(len, spelled), default=0)
    reach = np.arange(-longest, PASSAGE + longest)
    item_sizes = np.array([len(x) for x in spelled], np.int64)
    item_slots = np.full((len(spelled), longest), SLOTS, np.int64)
    for k, (_, h) in enumerate(hashed):
        item_slots[k, : len(h)] = h & np.uint32(SLOTS - 1)

    def search(batches) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"]
        for batch, p in unpacked(batches):
            if not len(p.begins) or not len(of_item):
                continue
            rows = p.rows(space.projection, space.weights)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            ends = np.cumsum(p.sizes)
            begins = p.begins[p.first]
            lows, highs = (ends - p.sizes)[p.owner[p.first]], ends[p.owner[p.first]]
            best: dict[tuple[int, int], float] = {}
            for a in range(0, len(rows), 1024):
                near = rows[a : a + 1024] @ query.T
                want = np.zeros((len(near), len(spelled)), bool)
                close, which = np.divmod(np.flatnonzero(near >= least), len(least))
                want[close, of_item[which]] = True
                certain.mark(want, p.hashes, begins[a : a + 1024], ends - p.sizes, ends)
                at, items_at = np.divmod(np.flatnonzero(want), len(spelled))
                if not len(at):
                    continue
                met, which_met = np.unique(at, return_inverse=True)
                around = (begins[a + met])[:, None] + reach
                outside = (around < lows[a + met][:, None]) | (around >= highs[a + met][:, None])
                slots = (p.hashes[np.where(outside, 0, around)] & np.uint32(SLOTS - 1)).astype(np.int64)
                slots[outside] = SLOTS
                there = np.zeros((len(met), SLOTS + 1), np.uint8)
                there[np.arange(len(met))[:, None], slots] = 1
                there[:, SLOTS] = 0
                for b in range(0, len(at), 4096):
                    # item words that stand around the passage: no common subsequence is longer
                    item = items_at[b : b + 4096]
                    hits = there[which_met[b : b + 4096][:, None], item_slots[item]].sum(axis=1, dtype=np.int64)
                    good = np.flatnonzero(hits >= PARAPHRASE * item_sizes[item]) + b
                    for i, k in zip(at[good].tolist(), items_at[good].tolist()):
                        best[a + i, k] = float(near[i, first_query[k] : first_query[k + 1]].max())
            out, ids = [], batch.column("doc_id").to_pylist()
            for (i, k), score in best.items():
                text, item, begin = p.owner[p.first[i]], spelled[k], p.begins[p.first[i]]
                low = ends[text] - p.sizes[text]
                around = p.hashes[max(low, begin - len(item)) : min(ends[text], begin + PASSAGE + len(item))].tolist()
                tail, met = item[-ANSWER:], set(around)
                answer = met.issuperset(tail) and any(around[j : j + len(tail)] == tail for j in range(len(around) - len(tail) + 1))
                if not answer and sum(w in met for w in item) < WHOLE_MATCH * len(item):
                    continue
                share = lcs_length(item, around) / len(item)
                if share < PARAPHRASE:
                    continue
                if share >= WHOLE_MATCH or answer:
                    out.append((ids[text], hashed[k][0], score, share, answer))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return tokens.mapInArrow(search, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean")
