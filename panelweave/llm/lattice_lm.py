"""Language model scores from a lattice of subword pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import id_crc, settled
from panelweave.llm.sentencepiece_codec import SPACE, codec_of

COMMON_WORDS = 65_536  # bound of the word table that goes to every task; all others are joined
FLUSH = 200_000  # distinct words a task holds before it sends them
BYTES_TOGETHER = 1 << 17
_LN10 = float(np.log(10))


class PieceLattice:
    """All segmentations of words into pieces and single bytes, weighed by unigram scores."""

    def __init__(self, pieces: dict[bytes, list[float]]) -> None:
        """``pieces``: natural log scores of each byte string; two ids may share one."""
        self.mark = SPACE.encode()
        children: dict[int, int] = {}
        score = [-np.inf]
        for p, values in pieces.items():
            node = 0
            for b in p:
                key = node << 8 | b
                node = children.setdefault(key, len(score))
                if node == len(score):
                    score.append(-np.inf)
            for v in values:
                score[node] = np.logaddexp(score[node], v)
        keys = sorted(children)
        self.keys = np.array(keys, np.int64)
        self.nodes = np.array([children[k] for k in keys], np.int64)
        self.score = np.array(score)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and score of each piece that stands in the words; all places walk down the
        tree of pieces together, a byte at a time. ``ends``: where the word of a place ends."""
        place, state, step = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        found: list[tuple[np.ndarray, ...]] = []
        while len(place):
            wanted = state << 8 | data[place + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            place, state = place[hit], self.nodes[at[hit]]
            step += 1
            piece = self.score[state] > -np.inf
            found.append((place[piece], place[piece] + step, self.score[state[piece]]))
            more = place + step < ends[place]
            place, state = place[more], state[more]
        return tuple(np.concatenate(x) for x in zip(*found))

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word: the forward recursion sums, at every
        byte, over the pieces that end there."""
        if not words:
            return np.zeros(0)
        marked = [self.mark + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.frombuffer(b"".join(marked), np.uint8)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        begin, end, score = self.edges(data, (starts + sizes)[word])
        owner = word[begin]
        # node of a word's place p: its number plus p, as each word has one node more than bytes
        source, target = begin + owner, end + owner
        depth = end - starts[owner]
        order = np.lexsort((target, depth))
        source, target, score, depth = source[order], target[order], score[order], depth[order]
        forward = np.full(len(data) + len(words), -np.inf)
        forward[starts + np.arange(len(words))] = 0.0
        bounds = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            value, into = forward[source[a:b]] + score[a:b], target[a:b]
            first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
            top = np.maximum.reduceat(value, first)
            spread = np.repeat(top, np.diff(np.append(first, b - a)))
            with np.errstate(invalid="ignore"):
                forward[into[first]] = top + np.log(np.add.reduceat(np.exp(value - spread), first))
        return forward[starts + sizes + np.arange(len(words))]


def split(text: str | None) -> list[bytes]:
    """Words: runs of bytes other than ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """Every distinct word of all texts with its count in those that ``learn`` picks (0 where
    only others have it). Tasks count in bounded portions and the sums are shuffled by word."""
    source = docs.select(F.col(text).alias("text"), learn.alias("learn"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def send():
            done = list(counts.items())
            counts.clear()
            for i in range(0, len(done), 20_000):
                part = done[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["word", "c"])

        for batch in batches:
            for t, learned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = split(t)
                if learned:
                    counts.update(found)
                else:
                    for w in found:
                        counts[w] += 0
                if len(counts) > FLUSH:
                    yield from send()
        yield from send()

    return source.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def piece_scores(words: DataFrame, n_texts: int, model: bytes) -> tuple[dict[bytes, list[float]], float]:
    """Natural log unigram scores of the pieces of a vocabulary and of the end of a text.

    The pieces are those of the model file; their frequencies are those of its own
    segmentation of the training words, one added to each, so every byte has a score.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        v = codec_of(model).vocabulary
        total = np.zeros(v.library.get_piece_size())
        for batch in batches:
            texts = [SPACE + w.decode() for w in batch.column(0).to_pylist()]
            weights = batch.column(1).to_numpy()
            for i in range(0, len(texts), 20_000):
                short = [(t, c) for t, c in zip(texts[i : i + 20_000], weights[i : i + 20_000]) if len(t) < 200]
                encoded = v.merge_all([t for t, _ in short])
                ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
                total += np.bincount(ids, weights=np.repeat([c for _, c in short], [len(e) // 4 for e in encoded]), minlength=len(total))
                for t, c in zip(texts[i : i + 20_000], weights[i : i + 20_000]):
                    if len(t) >= 200:
                        np.add.at(total, v.merge(t), c)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met].astype(np.int64))], names=["id", "n"])

    met = words.filter("c > 0").select("word", "c").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    v = codec_of(model).vocabulary
    n = np.ones(v.library.get_piece_size())
    for r in met:  # a row per piece of the vocabulary at most
        n[r["id"]] += r["n"]
    usable = {**{p.encode(): [i] for p, i in v.id_of.items()}}
    for b, i in v.bytes_id.items():
        usable.setdefault(bytes([b]), []).append(i)
    for b in range(256):
        if bytes([b]) not in usable and not v.bytes_id:
            raise ValueError("the vocabulary has no pieces for single bytes")
    total = sum(n[i] for ids in usable.values() for i in ids) + n_texts + 1
    return {p: [float(np.log(n[i] / total)) for i in ids] for p, ids in usable.items()}, float(np.log((n_texts + 1) / total))


def lattice_scores(docs: DataFrame, learn: Column, model: bytes, common_words: int = COMMON_WORDS) -> DataFrame:
    """Log10 probabilities of all texts under a unigram model of subword pieces, summed over all
    segmentations, beside those of an add-one unigram model of words.

    Words are runs of bytes other than ASCII white space with A-Z in lower case; each text ends
    in one end token. A piece holds a word's beginning at most in front, so the lattice of a
    text falls apart at the words: its probability is the product of those of its words and of
    the end. Words are counted, and their lattices summed, once per distinct word. The
    ``common_words`` most frequent ones go to every task (the bound of what is broadcast); the
    rest are joined, a row per document and distinct word.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score. A null text is empty:
    one end token. Repeated rows each have their row. With nothing to learn from, all counts
    are 0 and the scores those of the added ones.
    """
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("_learn"))
    words = settled(word_counts(rows, F.col("_learn")), "words")
    n_texts = rows.filter("_learn").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, distinct = sums["n"] + n_texts, sums["v"] + (n_texts > 0)
    pieces, end_score = piece_scores(words, n_texts, model)
    floor = float(np.log10(n + distinct + 1))

    def measure(batches) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(pieces)
        for batch in batches:
            listed, scores, held, size = batch.column(0).to_pylist(), [], [], 0
            by_size = sorted(range(len(listed)), key=lambda i: len(listed[i]))
            out = np.zeros(len(listed))
            for i in [*by_size, None]:
                if i is not None:
                    held.append(i)
                    size += len(listed[i]) + 3
                if held and (i is None or size > BYTES_TOGETHER):
                    out[held] = lattice.word_scores([listed[j] for j in held])
                    held, size = [], 0
            del scores
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out / _LN10)], names=["word", "c", "p"])

    scored = settled(words.mapInArrow(measure, "word binary, c bigint, p double"), "word-scores")
    common = scored.orderBy(F.desc("c"), "word").limit(common_words).collect()  # at most common_words rows
    place = {bytes(r["word"]): i for i, r in enumerate(common)}
    table = np.array([(r["c"], r["p"]) for r in common] or [(0, 0.0)]).T
    base = np.log10(table[0] + 1) - floor

    def gather(batches) -> Iterator[pa.RecordBatch]:
        kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("p", pa.float64())]
        for batch in batches:
            own: list[tuple] = []
            for row, doc_id, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = split(t)
                at = np.fromiter(map(place.get, found, [-1] * len(found)), np.int64, len(found)) if found else np.zeros(0, np.int64)
                known = at[at >= 0]
                own.append((row, doc_id, None, 1, len(found) + 1, int((table[0][known] > 0).sum()) + (n_texts > 0), float(base[known].sum()) + float(np.log10(n_texts + 1)) - floor, float(table[1][known].sum()) + end_score / _LN10))
                for w, times in Counter([found[i] for i in np.flatnonzero(at < 0)]).items():
                    own.append((row, None, w, times, 0, 0, 0.0, 0.0))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*own), kinds)], names=[k for k, _ in kinds])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = settled(
        numbered.mapInArrow(gather, "row bigint, doc_id bigint, word binary, times bigint, n_tokens bigint, n_known bigint, base double, p double"), "doc-words"
    )
    whole = found.filter("word IS NULL").drop("word", "times")
    rare = (
        found.filter("word IS NOT NULL").select("row", "word", "times").join(scored, "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("r_tokens"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
            F.sum(F.col("times") * (F.log10(F.col("c") + 1) - floor)).alias("r_base"),
            F.sum(F.col("times") * F.col("p")).alias("r_p"),
        )
    )
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(rare, "row", "left").select(
        "doc_id",
        F.col("n_tokens").alias("n_tokens"),
        (F.col("n_known") + more("r_known")).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + more("r_base")).alias("base_score"),
        (F.col("p") + more("r_p")).alias("score"),
    )


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 7 == 2
