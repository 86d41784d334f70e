"""Packing documents into sequences of bounded length with fitted patterns.

Documents become pieces of at most ``capacity`` tokens.  All that decides a packing is how
many pieces there are of each length, a table of at most ``capacity`` rows.  Patterns of two
or three lengths that fill a sequence are enumerated (all pairs, and the triples that the fit
asks for), and how often each is used is fitted to that table by non-negative least squares;
repeat counts are rounded, as far as pieces are there.
What is left is packed largest first, each gap taking the largest length that fits, again by
counts.  Pieces then take the places of their length by their number among its pieces, so
planning costs the same for any number of documents, and no sequence is packed in a task.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.rows import ROW, text_of, with_row_id
from folioforge.session import cut_lineage, ship_package

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k"
#: Numbering buckets of each length; a length with a third of all pieces is that many groups.
BUCKETS = 4096
#: Rounds that fit the counts, and how often patterns of three lengths are added to the fit.
ROUNDS, PRICINGS = 300, 12
#: Bits of a piece's number within its length.
RANK_BITS = 44

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:binary>>"


@lru_cache
def _encoder(name: str):
    """Text to token ids as little-endian unsigned 32-bit integers.

    The rank file of the vocabulary is several times faster than its JSON form and gives the
    same ids, told which added tokens the JSON form finds in a text.  Where its splitter gives
    up (extreme runs of white space), the JSON form takes over for that text.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plain = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    added = plain.get_added_tokens_decoder()
    # What else could be asked of an added token, the fast form does not know.
    exact = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
    special = {t.content: i for i, t in added.items()}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    # An added token has an id of its own, whether or not the ranks list it.
    ranks = {token: rank for token, rank in ranks.items() if token.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        try:
            if not exact:
                raise ValueError
            ids = fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # the splitter's panic is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            ids = plain.encode(text, add_special_tokens=False).ids
        return np.append(ids, END).astype("<u4").tobytes()

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a document; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(i, i + capacity) for i in range(first, n, capacity)]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False
) -> DataFrame:
    """``(_row, doc_id, piece, start, length, ids_crc32[, ids])``, one row per piece.

    A document is its tokens and ``END``; a null text is an empty one, so every row has a
    piece.  ``ids`` are little-endian unsigned 32-bit integers.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf(PIECES)
    def tokenized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer)
        for batch in batches:
            out = []
            for text in batch:
                data = encode(text)
                parts = [(a, b, data[4 * a : 4 * b]) for a, b in cuts(len(data) // 4, capacity)]
                out.append(
                    [
                        {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids), "ids": ids if keep_ids else None}
                        for i, (a, b, ids) in enumerate(parts)
                    ]
                )
            yield pd.Series(out)

    rows = with_row_id(docs.select("doc_id", text_of(docs).alias("t")))
    found = rows.select(ROW, "doc_id", F.inline(tokenized("t")))
    return found if keep_ids else found.drop("ids")


def _pairs(there: np.ndarray) -> np.ndarray:
    """Rows of two lengths that fill a sequence exactly; the third length is 0, none."""
    capacity = len(there) - 1
    a = np.arange(1, capacity // 2 + 1)
    a = a[there[a] & there[capacity - a]]
    return np.stack([a, capacity - a, np.zeros_like(a)], 1)


def _priced(left_over: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Rows of three lengths that fill a sequence exactly: for each shortest one, those of which
    the fit has left most, which is what it would gain by them."""
    capacity, found = len(there) - 1, []
    value = np.where(there, left_over, -np.inf)
    for a in np.flatnonzero(there[: capacity // 3 + 1]):
        b = np.arange(a, (capacity - a) // 2 + 1)
        gain = value[b] + value[capacity - a - b]
        if len(b) and value[a] + gain.max() > 0:
            b = b[gain.argmax()]
            found.append((a, b, capacity - a - b))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by multiplicative updates: the repeats of each pattern, and
    how many pieces of each length they leave over."""
    wanted = counts.astype(float)
    wanted[0] = 0
    goal = wanted[patterns].sum(1)
    x = goal / (3 * max(len(patterns), 1)) + 1e-9

    def used() -> np.ndarray:
        n = np.bincount(patterns.ravel(), np.repeat(x, 3), len(counts))
        n[0] = 0
        return n

    for _ in range(rounds):
        x *= goal / (used()[patterns].sum(1) + 1e-12)
    return x, wanted - used()


def _fitted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their repeats.  Pairs come first, then triples as the fit asks for them."""
    there = counts > 0
    there[0] = False
    patterns = _pairs(there)
    for _ in range(PRICINGS):
        left_over = _fit(patterns, counts, ROUNDS // 4)[1]
        more = np.unique(np.concatenate([patterns, _priced(left_over, there)]), axis=0)
        if len(more) == len(patterns):
            break
        patterns = more
    return patterns, _fit(patterns, counts, ROUNDS)[0]


def by_patterns(counts: np.ndarray) -> tuple[list[tuple[int, list[int]]], np.ndarray]:
    """The part of the plan that patterns make up, and what they leave of each length.

    Repeats are rounded to whole numbers, most used patterns first, as far as pieces are there.
    """
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    made = [(int(left[capacity]), [capacity])] if left[capacity] else []
    left[capacity] = 0
    patterns, repeats = _fitted(left)
    for i in np.argsort(-repeats, kind="stable"):
        lengths = [int(n) for n in patterns[i] if n]
        times = min(round(repeats[i]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if times > 0:
            made.append((times, lengths))
            for n in lengths:
                left[n] -= times
    return made, left


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Patterns with their repeats that use up ``counts[length]`` pieces of each length."""
    made, left = by_patterns(counts)
    capacity = len(counts) - 1
    there = [int(n) for n in np.flatnonzero(left)]
    while there:
        lengths, room, taken = [], capacity, {}
        at = len(there)
        while (at := bisect_right(there, room, 0, at)) > 0:
            n = there[at - 1]
            if taken.get(n, 0) < left[n]:
                lengths.append(n)
                taken[n] = taken.get(n, 0) + 1
                room -= n
            else:
                at -= 1
        times = min(int(left[n]) // k for n, k in taken.items())
        made.append((times, lengths))
        for n, k in taken.items():
            left[n] -= times * k
            if not left[n]:
                there.remove(n)
    return made


def _places(made: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of pieces of one length: the first one's key, sequence and offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in made:
        offset = 0
        for n in lengths:
            rows.append(((n << RANK_BITS) + used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    keys, sequences, offsets = np.array(rows, np.int64).reshape(-1, 3).T
    return keys, sequences, offsets


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Offsets of a sequence start at 0 and leave no gaps.  ``order`` names columns that tell
    rows apart; rows that share them are interchangeable.  No rows give no sequences.
    """
    ship_package(parts.sparkSession)
    dealt = cut_lineage(
        parts.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS))), "pieces"
    )
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("_n").alias("n")).limit(capacity + 1).collect():
        if row["length"] is None or not 1 <= row["length"] <= capacity:
            raise ValueError(f"pieces have 1 to {capacity} tokens, not {row['length']}")
        histogram[row["length"]] = row["n"]
    # As large as the plan, which depends on the capacity and not on the number of pieces.
    shared = parts.sparkSession.sparkContext.broadcast(_places(plan(histogram)))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = shared.value
        key = (length.to_numpy(np.int64) << RANK_BITS) + rank.to_numpy(np.int64)
        run = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + key - keys[run], "offset": offsets[run]})

    along = Window.partitionBy("length").orderBy("_bucket")
    before = counts.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_nth", F.row_number().over(within) - 1).join(
        before, ["length", "_bucket"]
    )
    at = placed("length", F.col("_before") + F.col("_nth"))
    return numbered.withColumn("_at", at).select(
        *[c for c in parts.columns], "_at.sequence_id", "_at.offset"
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(pieces(docs, capacity, tokenizer, keep_ids), [ROW, "piece"], capacity).drop(ROW)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
