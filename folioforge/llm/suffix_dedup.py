"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

Every byte covered by a string of ``span`` bytes that also starts elsewhere is removed.

*Which suffixes.*  A window of ``span`` bytes is represented by its anchor: the place of its
smallest gram hash, so equal windows have anchors at equal offsets, and a text has about two
anchors per window length.  Seen from the anchor, a window has at least half its length on
one side.  That side, up to ``span`` bytes long, is the anchor's suffix (leftwards it is read
backwards), and the other side, up to ``span - reach`` bytes, is its context.

*Distinguishing prefixes.*  Suffixes whose first ``reach`` bytes occur once in the corpus
share no window with any other; counting hashes of these prefixes finds them, and they are
not sorted.  Where all suffixes with a prefix are the same in full, context included, every
window is repeated, and they need no sorting either.

*The sort.*  The rest is exchanged as sorted, front-coded runs: each suffix as the length of
what it shares with the one before and the remainder.  A loser tree merges runs and keeps
what each loser shares with the winner, so no byte that is known to be equal is compared
again, and the merged order comes with the common prefixes of neighbours.  These span a tree
of groups with a common prefix of d bytes; in each, every suffix looks for the longest
context it shares with another, c bytes, and its windows that have at most d bytes on the
suffix's side and at most c on the other are repeated.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import ROW, text_of, with_row_id
from folioforge.session import cut_lineage, ship_package

SPAN = 200
GRAM = 8
#: Bytes a window has at least on its suffix's side, and at most on the other.
REACH = SPAN // 2 + GRAM // 2
SIDE = SPAN - REACH
#: Windows whose anchors are found at once, bytes of a run, and suffixes in a merge.
SLICE, RUN_BYTES, MERGE = 1 << 20, 32 << 20, 50_000
FORWARD, BACKWARD = 0, 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows in a row that share their anchor: the anchor, the first and last start."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    m, width, windows = len(codes) - GRAM + 1, SPAN - GRAM + 1, len(codes) - SPAN + 1
    gram = np.zeros(m, np.uint64)
    for i in range(GRAM):
        gram = (gram << np.uint64(8)) | codes[i : i + m]
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    # Sliding minima: the tail of one block and the head of the next.
    padded = np.full(-(-m // width) * width, _NONE)
    padded[:m] = ranked
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, 1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(tails[:windows], heads[width - 1 : width - 1 + windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], change])
    return at[first], first, np.concatenate([change - 1, [windows - 1]])


def suffix_places(data: bytes) -> list[tuple[int, int]]:
    """``(anchor, direction)`` of all suffixes that the windows of a text need, once each."""
    found: set[tuple[int, int]] = set()
    for base in range(0, max(len(data) - SPAN + 1, 0), SLICE):
        part = data[base : base + SLICE + SPAN - 1]
        at, first, last = _anchors(part)
        forward = at - last <= SIDE
        backward = at - first > SIDE
        found.update((p, FORWARD) for p in (at[forward] + base).tolist())
        found.update((p, BACKWARD) for p in (at[backward] + base).tolist())
    return sorted(found)


def sides(data: bytes, anchor: int, direction: int) -> tuple[bytes, bytes]:
    """Suffix and context; both start at the same place and lead away from it."""
    if direction == FORWARD:
        return data[anchor : anchor + SPAN], data[max(anchor - SIDE, 0) : anchor][::-1]
    pivot = anchor + GRAM
    return data[max(pivot - SPAN, 0) : pivot][::-1], data[pivot : pivot + SIDE]


def covered(anchor: int, direction: int, low: int, high: int) -> tuple[int, int]:
    """Bytes of the windows that have ``low`` to ``high`` bytes on the suffix's side."""
    if direction == FORWARD:
        return anchor + low - SPAN, anchor + high
    pivot = anchor + GRAM
    return pivot - high, pivot - low + SPAN


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


_HEAD = struct.Struct("<HHHqqI")


def front_coded(items: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of ``(suffix, context, prefix hash, full hash, count)``."""
    out, before = [], b""
    for suffix, context, prefix, full, count in items:
        same = _common(before, suffix)
        rest = suffix[same:]
        out += [_HEAD.pack(same, len(rest), len(context), prefix, full, count), rest, context]
        before = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, tuple[bytes, bytes, int, int, int]]]:
    """The items of a run, each with what its suffix shares with the one before."""
    at, before = 0, b""
    while at < len(run):
        same, rest, side, prefix, full, count = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        before = before[:same] + run[at : at + rest]
        at += rest
        yield same, (before, run[at : at + side], prefix, full, count)
        at += side


def merged(runs: list[bytes]) -> Iterator[tuple[int, tuple[bytes, bytes, int, int, int]]]:
    """One sorted run out of many, each item with what it shares with the one before.

    ``shared[r]`` is what the head of run r shares with the last item that went out.  Of two
    heads the one that shares more is smaller; only if they share the same do bytes decide,
    and only those beyond.  The loser then knows what it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    streams = [decoded(r) for r in runs]
    heads: list = [None] * size
    shared = [0] * size

    def advance(r: int) -> None:
        shared[r], heads[r] = next(streams[r], (0, None))

    for r in range(len(runs)):
        advance(r)
        shared[r] = 0

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        k = _common(x, y, shared[a])
        first, second = (a, b) if x[k:] <= y[k:] else (b, a)
        shared[second] = k
        return first, second

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if size > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], heads[winner]
        advance(winner)  # what it shares with its run's last item is what it shares with the output
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _longest_shared(contexts: list[bytes]) -> list[int]:
    """For each, the longest prefix that it shares with another."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    best = [0] * len(contexts)
    for i, j in zip(order, order[1:], strict=False):
        k = _common(contexts[i], contexts[j])
        best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def repeats(items: list[tuple[bytes, bytes, int, int, int]], shared: list[int]) -> list[list[tuple[int, int]]]:
    """For each of the sorted items, which windows are repeated: the least and most bytes on
    the suffix's side.  ``shared[i]``: what items i - 1 and i share, at least ``REACH``."""
    found: list[list[tuple[int, int]]] = [[] for _ in items]
    for i, (suffix, context, _, _, count) in enumerate(items):
        if count > 1:
            found[i].append((SPAN - len(context), len(suffix)))

    def group(low: int, high: int, depth: int) -> None:
        for i, c in enumerate(_longest_shared([x[1] for x in items[low:high]]), low):
            if SPAN - c <= depth:
                found[i].append((SPAN - c, depth))

    # Groups are the maximal stretches that share at least their depth.
    open_groups: list[tuple[int, int]] = []
    for i in range(1, len(items) + 1):
        depth, low = shared[i] if i < len(items) else -1, i - 1
        while open_groups and open_groups[-1][1] > depth:
            low, d = open_groups.pop()
            group(low, i, d)
        if depth >= 0 and (not open_groups or open_groups[-1][1] < depth):
            open_groups.append((low, depth))
    return [_union(f) for f in found]


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of whole numbers, both ends included, as few and sorted."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] <= r[1]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _suffixes(rows: DataFrame) -> DataFrame:
    """``(_row, anchor, direction, prefix, full)`` of all suffixes of ``(_row, text)``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(batch[ROW], batch["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for anchor, direction in suffix_places(data):
                    suffix, context = sides(data, anchor, direction)
                    prefix = xxhash.xxh3_64_intdigest(suffix[:REACH], direction)
                    full = xxhash.xxh3_64_intdigest(suffix + b"\0" + context, len(suffix))
                    out.append((row, anchor, direction, prefix, full))
                if len(out) >= 100_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pd.DataFrame:
        row, anchor, direction, prefix, full = zip(*out, strict=True)
        return pd.DataFrame(
            {
                ROW: row,
                "anchor": anchor,
                "direction": np.array(direction, np.int32),
                "prefix": np.array(prefix, np.uint64).view(np.int64),
                "full": np.array(full, np.uint64).view(np.int64),
            }
        )

    return rows.mapInPandas(find, f"{ROW} long, anchor long, direction int, prefix long, full long")


def _runs(wanted: DataFrame, parts: int) -> DataFrame:
    """``(part, run)`` from ``(text, wanted)``: sorted, front-coded runs for each merge."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        size = 0
        for batch in batches:
            for text, list_ in zip(batch["text"], batch["wanted"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in list_:
                    suffix, context = sides(data, w["anchor"], w["direction"])
                    item = (suffix, context, w["prefix"], w["full"], min(w["count"], 2))
                    waiting.setdefault(w["prefix"] % parts, []).append(item)
                    size += len(suffix) + len(context)
                if size >= RUN_BYTES:
                    yield from blocks(waiting)
                    waiting, size = {}, 0
        yield from blocks(waiting)

    def blocks(waiting: dict[int, list]) -> Iterator[pd.DataFrame]:
        for part, items in waiting.items():
            yield pd.DataFrame({"part": [part], "run": [front_coded(sorted(items))]})

    return wanted.mapInPandas(sort, "part long, run binary")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of each suffix of one part."""
    out: list[tuple] = []
    items: list[tuple] = []
    shared: list[int] = []

    def close() -> None:
        if len(items) > 1 or (items and items[0][4] > 1):
            for item, ranges in zip(items, repeats(items, shared), strict=True):
                if ranges:
                    out.append((item[2], item[3], [{"low": a, "high": b} for a, b in ranges]))

    for k, item in merged(list(pdf["run"])):
        if items and k < REACH:
            close()
            items, shared = [], []
        items.append(item)
        shared.append(k)
    close()
    return pd.DataFrame(out, columns=["prefix", "full", "ranges"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(_row, spans)`` of rows that have any: the bytes ``[start, end)`` to remove, sorted
    and apart.  Null texts are empty; texts shorter than ``SPAN`` bytes have none."""
    ship_package(docs.sparkSession)
    rows = with_row_id(docs.select(text_of(docs).alias("text")))
    long_ones = rows.filter(F.octet_length("text") >= SPAN)
    prefixes = _suffixes(long_ones).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("full").alias("least"), F.max("full").alias("most")
    )
    shared_prefixes = cut_lineage(
        prefixes.filter("n > 1").select("prefix", (F.col("least") != F.col("most")).alias("differ")),
        "prefixes",
    )
    members = cut_lineage(_suffixes(long_ones).join(shared_prefixes, "prefix"), "suffixes")

    # One of the suffixes that are the same in full stands for all; hot ones shrink in the
    # map-side aggregate.
    one = F.struct(ROW, "anchor", "direction")
    kinds = members.filter("differ").groupBy("prefix", "full").agg(F.min(one).alias("one"), F.count(F.lit(1)).alias("count"))
    kinds = cut_lineage(kinds.select(f"one.{ROW}", "one.anchor", "one.direction", "prefix", "full", "count"), "kinds")
    wanted = kinds.groupBy(ROW).agg(
        F.collect_list(F.struct("anchor", "direction", "prefix", "full", "count")).alias("wanted")
    )
    parts = max(1, kinds.count() // MERGE)
    runs = cut_lineage(_runs(rows.join(wanted, ROW).select("text", "wanted"), parts), "runs")
    ranges = runs.groupBy("part").applyInPandas(
        _merge, "prefix long, full long, ranges array<struct<low:int,high:int>>"
    )
    ranges = cut_lineage(ranges.select("prefix", "full", "ranges"), "ranges")

    sorted_ones = (
        members.filter("differ").join(ranges, ["prefix", "full"]).select(ROW, "anchor", "direction", "ranges")
    )
    # All suffixes with this prefix are the same; how long their sides are, the text will tell.
    same = members.filter("NOT differ").select(
        ROW, "anchor", "direction", F.lit(None).cast("array<struct<low:int,high:int>>").alias("ranges")
    )
    found = sorted_ones.unionByName(same)
    return found.groupBy(ROW).agg(F.collect_list(F.struct("anchor", "direction", "ranges")).alias("found"))


def spans_of(n_bytes: int, found) -> list[tuple[int, int]]:
    """Bytes to remove from a text of ``n_bytes``, for what was found at its anchors."""
    out = []
    for f in found if found is not None else ():
        anchor, direction, ranges = f["anchor"], f["direction"], f["ranges"]
        if ranges is None:
            before, after = (anchor, n_bytes - anchor) if direction == FORWARD else (n_bytes - anchor - GRAM, anchor + GRAM)
            ranges = [{"low": SPAN - min(before, SIDE), "high": min(after, SPAN)}]
        for r in ranges:
            if r["low"] <= r["high"]:
                start, end = covered(anchor, direction, r["low"], r["high"])
                out.append((start, end - 1))
    return [(a, b + 1) for a, b in _union(out)]


def cleaned(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept])`` of every row.

    ``kept`` is what is left, as bytes: a span may end within a character.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,spans:array<struct<start:long,end:long>>,kept:binary>")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, f in zip(text, found, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            spans = spans_of(len(data), f)
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            listed = [{"start": a, "end": b} for a, b in spans] if keep_text else None
            out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), listed, kept if keep_text else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    rows = with_row_id(docs.select("doc_id", text_of(docs).alias("text")))
    judged = rows.join(repeated_spans(docs), ROW, "left").select("doc_id", cut("text", "found").alias("c"))
    result = judged.select("doc_id", "c.*")
    return result if keep_text else result.drop("spans", "kept")
