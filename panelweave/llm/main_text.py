"""Main text of web pages: what the pages of a host repeat is boilerplate, found by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import settled
from panelweave.llm.html_blocks import blocks
from panelweave.llm.texts import blocks as batches_of
from panelweave.llm.texts import mix
from panelweave.session import measured

LEAST_REPEAT = 8  # tokens: the words of a block and one token for its tag
SHARD_TOKENS = 1 << 15  # tokens whose suffixes are sorted in one array
FIELD, BLOCK = "\x1f", "\x1e"  # white space, so no text of a block holds them
STREAM = "host string, k1 long, k2 long, stream string, tokens int"
FOUND = (
    "kind string, host string, k1 long, k2 long, stream string, covered array<int>, h1 long, h2 long, "
    "low struct<k1: long, k2: long>, high struct<k1: long, k2: long>, at array<int>"
)
RUNS = "array<struct<block: int, text: string>>"
KEY = ["host", "k1", "k2"]


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; '' where there is none."""
    name = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(name), F.lit(""))


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with their host and a 128-bit key of the html: equal pages of a host are one page."""
    text = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", text.alias("html")).select(
        "*", host(F.col("url")).alias("host"), F.xxhash64("html").alias("k1"), F.xxhash64(F.lit(1), "html").alias("k2")
    )


def outer_stream(page: str) -> str:
    """The blocks that the markup does not declare to be the main text: place, mark, tag, text."""
    return BLOCK.join(FIELD.join((str(i), "01"[b.marked], b.tag, b.text)) for i, b in enumerate(blocks(page)) if not b.content)


def stream_tokens(stream: str) -> list[tuple[str, int, bool]]:
    """Tokens with the block each stands in (-1 for a tag) and whether the block is marked."""
    out = []
    for block in stream.split(BLOCK) if stream else []:
        place, marked, tag, text = block.split(FIELD)
        out.append(("<" + tag, -1, marked == "1"))
        out += [(word, int(place), marked == "1") for word in text.split(" ")]
    return out


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "html"):
        outer = [outer_stream(page) for page in batch.column("html").to_pylist()]
        counts = [s.count(" ") + 2 * s.count(BLOCK) + 2 if s else 0 for s in outer]
        columns = [batch.column(c) for c in KEY] + [pa.array(outer, pa.string()), pa.array(counts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*KEY, "stream", "tokens"])


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and how many tokens neighbours in that order have in common.

    By prefix doubling: ``ranks[k]`` orders suffixes by their first 2^k tokens. The same ranks
    then give the common prefix of two suffixes, in falling powers of two.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while n and ranks[-1].max() < n - 1:
        step = 1 << (len(ranks) - 1)
        beyond = np.zeros(n, np.int64)
        beyond[: max(n - step, 0)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + beyond, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        padded = np.concatenate([ranks[k], -1 - np.arange(2)])
        same = padded[np.minimum(a, n)] == padded[np.where(b < n, b, n + 1)]
        common += same.astype(np.int64) << k
        a += same.astype(np.int64) << k
        b += same.astype(np.int64) << k
    return order, common


def string_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of ``length`` tokens from each start."""
    out = np.zeros((2, len(starts)), np.uint64)
    for seed in (0, 1):
        total = np.full(len(starts), seed + 1, np.uint64)
        for j in range(length):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + j])
        out[seed] = total
    return out.view(np.int64)


def repeats(pages: pd.DataFrame, least: int) -> pd.DataFrame:
    """Repeats among the pages of one shard, each host for itself.

    The token streams are concatenated with a separator of its own after each page, so no match
    crosses pages, and a token of another host is another token. Neighbours in suffix order with
    ``least`` tokens in common form groups; a group with two pages covers those tokens wherever
    they stand. Returns a row for each page that still has unmarked words not covered
    (``page``), and, for hosts of several shards, one for each distinct string of ``least``
    tokens (``string``): two pages that have it, or its only page and its places there.
    """
    pages = pages.drop_duplicates(KEY, ignore_index=True)
    ids, page, place, tokens = [], [], [], []
    number: dict = {}
    for p, (h, stream) in enumerate(zip(pages["host"], pages["stream"])):
        told = stream_tokens(stream)
        tokens.append(told)
        ids += [number.setdefault((h, t), len(number)) for t, _, _ in told] + [-1 - p]
        page += [p] * (len(told) + 1)
        place += range(len(told) + 1)
    ids, page, place = np.array(ids, np.int64), np.array(page, np.int64), np.array(place, np.int64)
    lengths = np.array([len(t) for t in tokens], np.int64)
    order, common = suffix_array(ids)
    heads = np.flatnonzero(np.concatenate([[True], common < least])) if len(ids) else np.zeros(0, np.int64)
    group = np.zeros(len(ids), np.int64)
    group[heads[1:]] = 1
    group = np.cumsum(group)
    first, last = (f.reduceat(page[order], heads) if len(heads) else heads for f in (np.minimum, np.maximum))
    starts = order[(first < last)[group]] if len(heads) else order
    edge = np.zeros(len(ids) + 1, np.int64)
    for j, sign in ((0, 1), (least, -1)):
        np.add.at(edge, starts + j, sign)
    covered = np.cumsum(edge)[:-1] > 0
    keys = list(zip(pages["k1"].tolist(), pages["k2"].tolist()))
    rows = []
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    for p, told in enumerate(tokens):
        mine = covered[begin[p] : begin[p] + len(told)]
        if any(b >= 0 and not m and not c for (_, b, m), c in zip(told, mine)):
            rows.append(("page", pages["host"][p], *keys[p], pages["stream"][p], np.flatnonzero(mine).tolist(), None, None, None, None, None))
    split = pages["split"].to_numpy(bool)
    if split.any():
        text_hash = np.zeros(len(number) + 1, np.uint64)
        text_hash[: len(number)] = [xxhash.xxh3_64_intdigest(t) for _, t in number]
        hashes = text_hash[np.maximum(ids, -1)]  # all separators are the last one, which no string reaches
        whole = (place + least <= lengths[page]) & split[page]  # a string that ends in its page
        sample = order[heads]
        told = np.flatnonzero(whole[sample])
        h1, h2 = string_hashes(hashes, sample[told], least)
        ends = np.append(heads, len(ids))
        for g, a, b in zip(told.tolist(), h1.tolist(), h2.tolist()):
            single = first[g] == last[g]
            low, high = sorted((keys[first[g]], keys[last[g]]))
            ends_of = [{"k1": k[0], "k2": k[1]} for k in (low, high)]
            at = sorted(place[order[ends[g] : ends[g + 1]]].tolist()) if single else None
            rows.append(("string", pages["host"][first[g]], *(low if single else (None, None)), None, None, a, b, *ends_of, at))
    names = ["kind", *KEY, "stream", "covered", "h1", "h2", "low", "high", "at"]
    return pd.DataFrame(rows, columns=names, dtype=object)  # as objects, so that no long beside a null becomes a double


def sharded(outer: DataFrame, shard_tokens: int) -> DataFrame:
    """Deal streams into shards of about ``shard_tokens`` tokens: small hosts share one, a larger
    host is dealt over several by page key, and marked ``split``."""
    sizes = measured(outer.groupBy("host").agg(F.sum("tokens").alias("host_tokens")))
    total = sizes.agg(F.sum("host_tokens")).first()[0] or 0
    bins = F.lit(max(1, -(-total // shard_tokens)))
    parts = F.ceil(F.col("host_tokens") / shard_tokens)
    split = F.col("host_tokens") > shard_tokens
    shard = F.when(split, F.concat_ws("|", "host", F.pmod(F.col("k2"), parts).cast("string"))).otherwise(F.pmod(F.xxhash64("host"), bins).cast("string"))
    return outer.join(sizes, "host").select(*KEY, "stream", split.alias("split"), shard.alias("shard"))


def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words of unmarked blocks that no repeat covers, with the place of their block."""
    for batch in batches:
        out = []
        for stream, covered, more, least in zip(*(batch.column(c).to_pylist() for c in ("stream", "covered", "more", "least"))):
            gone = set(covered)
            for start in more or []:
                gone.update(range(start, start + least))
            runs, open_block = [], None
            for i, (token, block, marked) in enumerate(stream_tokens(stream)):
                if block < 0 or marked or i in gone:
                    open_block = None
                elif open_block == block:
                    runs[-1][1].append(token)
                else:
                    runs.append((block, [token]))
                    open_block = block
            out.append([{"block": b, "text": " ".join(words)} for b, words in runs])
        kind = pa.list_(pa.struct([("block", pa.int32()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(out, kind)], [*KEY, "runs"])


def outer_runs(pages: DataFrame, least: int = LEAST_REPEAT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """What stays of the text outside the declared main text: (host, k1, k2) and its unique runs.

    Streams of a host are searched in shards. A host of several shards is made whole by its
    distinct strings: one that two shards have, or that one shard has twice, covers its only
    occurrence in any other shard too. So the shard size never shows in the result.
    """
    outer = settled(pages.select(*KEY, "html").mapInArrow(streams, STREAM).filter("tokens > 0"), "streams")
    found = settled(
        sharded(outer, shard_tokens).groupBy("shard").applyInPandas(lambda p: repeats(p, least), FOUND), "repeats"
    )
    strings = found.filter("kind = 'string'").select(*KEY, "h1", "h2", "low", "high", "at")
    known = strings.groupBy("host", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    hits = strings.filter("at IS NOT NULL").join(known, ["host", "h1", "h2"], "left_semi")
    more = hits.groupBy(*KEY).agg(F.flatten(F.collect_list("at")).alias("more"))
    left = found.filter("kind = 'page'").select(*KEY, "stream", "covered").join(more, KEY, "left")
    runs = left.withColumn("least", F.lit(least)).mapInArrow(unique_runs, f"host string, k1 long, k2 long, runs {RUNS}")
    return runs.filter("size(runs) > 0")


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Declared main text and unique runs of each page in page order."""
    for batch in batches_of(batches, "html"):
        texts = []
        for page, runs in zip(batch.column("html").to_pylist(), batch.column("runs").to_pylist()):
            parts = [(i, b.text) for i, b in enumerate(blocks(page)) if b.content]
            parts += [(r["block"], r["text"]) for r in runs or []]
            parts.sort(key=lambda x: x[0])
            texts.append(" ".join(t for _, t in parts))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, least: int = LEAST_REPEAT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Main text of each page.

    Markup that declares itself (``article``, or ``main`` where a page has none) is kept whole,
    however often it is repeated: copies and quotations are text. All other text of the pages of
    a host goes through suffix arrays: substrings of ``least`` tokens or more that stand on two
    distinct pages of the host are boilerplate, what is left are unique runs. Those are kept unless
    their element is declared to be something else (navigation, header, footer, sidebar, form, advert,
    notice, comments), which also serves hosts with too few pages to repeat anything.

    Needs page_id, url and html; returns page_id, url, text, n_chars (code points), a row for each
    row. A null html is empty; a null url is a host of its own; equal pages of a host are one page
    and do not repeat each other; an empty table gives no rows; other columns are not looked at.
    Page texts are not shuffled: the runs kept outside declared text, written and measured, come
    to the pages.
    """
    own = keyed(pages)
    runs = measured(outer_runs(own, least, shard_tokens))
    joined = own.join(runs, KEY, "left").select("page_id", "url", "html", "runs")
    kind = dict(pages.select("page_id", "url").dtypes)
    return joined.mapInArrow(assembled, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
