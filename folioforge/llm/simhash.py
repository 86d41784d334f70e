"""Near duplicates by SimHash, with pigeonhole blocks.

``linked`` groups documents whose 64-bit fingerprints of word shingles differ in few bits.
A fingerprint is cut into more blocks than bits may differ, so two close ones agree on all
blocks of some choice; fingerprints meet in a join on the blocks of each choice and are then
compared bit by bit.  Equal fingerprints are one node from the start.  Of a bucket with many
nodes, no pairs are made: its nodes meet at the bit patterns one step away from them, which
links exactly those within two steps.

``near_duplicates`` finds documents that share most of their five-word shingles.  Rows with
close fingerprints meet first, by the same blocks.  Word shingles differ too fast under edits for
fingerprints alone, whose blocks miss pairs, so what they leave apart meets in a join on the
rarest shingles of each text, by which no similar pair can be missed.  Either way the shingles
themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.components import components
from folioforge.llm.rows import ROW, bounded_sample, text_of, with_row_id, without_rows
from folioforge.session import cut_lineage, drop_table, ship_package

WORDS, BITS, SEED = 3, 2, 42
#: Widths of the blocks of a fingerprint; pairs agree on all but ``BITS`` of them.
WIDTHS = (13, 13, 13, 13, 12)
#: Nodes of a bucket up to which its pairs are compared one by one.
SMALL = 32
#: Shingles whose bits are counted at once.
SLICE = 1 << 16

NEAR_WORDS, SIMILARITY = 5, 0.8
#: Rows, about, whose shingles are counted to tell frequent ones; only their order is from it.
ORDER_ROWS = 20_000
#: The most frequent of them that are told apart from the others.
ORDER_TOKENS = 200_000
#: Rounds at most in which rows meet a few rows of other groups before all pairs are made.
STAR_ROUNDS, STARS = 2, 4
#: Bits of a table at most (32 MB), and for each value as long as it is smaller.
MOST_BITS, BITS_PER_VALUE = 1 << 28, 16
#: Longs of a row's parities, by which pairs that differ too much are told before they are made.
PARITY_LONGS = 16
#: Shingles before a shared one by which a pair is told to have met already.
EARLIER = 8
#: Pairs are broadcast up to so many bytes, at so many a pair.
BROADCAST_BYTES, PAIR_BYTES = 64 << 20, 64


def _shingles(text: str, size: int) -> Iterator[list[int]]:
    """XXH64 of all shingles, repeats included, in slices; no word, no shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    first_to_last = list(zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True))
    for i in range(0, len(first_to_last), SLICE):
        yield [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in first_to_last[i : i + SLICE]]


def fingerprint(text: str, size: int = WORDS) -> int:
    """64 bits, each 1 if set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingles(text, size):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        ones += np.add.reduce(bits.reshape(-1, 64), 0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_udf(size: int):
    """Of texts, as signed longs."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.uint64(fingerprint(t, size)).astype(np.int64) for t in texts], dtype="int64")

    return of


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` as a signed long; null texts have no words."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("t")).select("doc_id", _fingerprint_udf(size)("t").alias("fp"))


def _choices(fp: Column, bits: int) -> Column:
    """The blocks of each choice as ``(choice, key)``."""
    masks, at = [], 0
    for width in WIDTHS:
        masks.append(((1 << width) - 1) << at)
        at += width
    chosen = [sum(masks[i] for i in c) for c in combinations(range(len(WIDTHS)), len(WIDTHS) - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(
        *[F.struct(F.lit(m).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("key")) for m in signed]
    )


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``(a, b)`` between different values of ``fp``: enough to connect all those that
    differ in up to ``bits`` (at most 2) bits, and none that differ in more."""
    if not 0 < bits <= 2:
        raise ValueError("bits is 1 or 2")
    blocks = nodes.select("fp").distinct().select("fp", F.inline(_choices(F.col("fp"), bits)))
    blocks = cut_lineage(blocks, "blocks")
    sizes = blocks.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut_lineage(blocks.join(sizes, ["choice", "key"]), "buckets")
    few = met.filter(F.col("n") <= SMALL)
    a = few.select("choice", "key", F.col("fp").alias("a"))
    b = few.select("choice", "key", F.col("fp").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    close = a.join(b, ["choice", "key"]).filter((F.col("a") < F.col("b")) & (differing <= bits))
    # Members of a bucket differ outside the choice only.  Two that differ in one bit meet at
    # either of them; two that differ in two meet at the pattern between them.
    steps = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    free = F.filter(
        F.array(*map(F.lit, steps)), lambda s: s.bitwiseAND(F.col("choice")) == F.lit(0)
    )
    around = F.concat(F.array("fp"), F.transform(free, lambda s: F.col("fp").bitwiseXOR(s)))
    if bits == 2:
        many = met.filter(F.col("n") > SMALL).select("choice", "fp", F.explode(around).alias("at"))
        first = many.groupBy("choice", "at").agg(F.min("fp").alias("a"))
        far = many.join(first, ["choice", "at"]).filter("a != fp").select("a", F.col("fp").alias("b"))
    else:
        many = met.filter(F.col("n") > SMALL).select("fp", F.explode(around).alias("a"))
        far = many.join(nodes.select(F.col("fp").alias("a")).distinct(), "a").filter("a != fp").select("a", F.col("fp").alias("b"))
    return close.select("a", "b").unionByName(far).distinct()


def linked(docs: DataFrame, size: int = WORDS, bits: int = BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest ``doc_id`` of the component; null ids are left out of
    that, so it is null only where all are.  Repeated rows each get a row; no rows, none.
    """
    rows = cut_lineage(fingerprints(docs, size), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut_lineage(rooted.join(named, "root").select("fp", "component_id"), "components")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(by_fp, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def prefix_length(n: int, similarity: float) -> int:
    """How many shingles of a set of ``n``, in one order for all sets, must be looked at.

    A set shares at least ``similarity * n`` of them with any that is so similar, and the first
    that they share comes before all others.
    """
    return int(n - similarity * n + 1e-6) + 1


def _close_rows(texts: DataFrame, size: int = WORDS, bits: int = BITS) -> DataFrame:
    """``(a, b)``: enough to connect all rows whose fingerprints differ in up to ``bits``, and
    none that differ in more.  Of equal fingerprints, every row meets the first one."""
    rows = cut_lineage(texts.select(ROW, _fingerprint_udf(size)("t").alias("fp")), "fingerprints")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(ROW).alias("least")), "nodes")
    equal = rows.join(nodes, "fp").filter(F.col(ROW) != F.col("least")).select(F.col("least").alias("a"), F.col(ROW).alias("b"))
    of = {x: nodes.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in "ab"}
    close = links(nodes.select("fp"), bits).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.unionByName(close.join(of["a"], "fp_a").join(of["b"], "fp_b").select("a", "b"))


def _token_sets(size: int):
    """A function of a text: its different shingles as sorted 64-bit hashes."""

    def hashes(text: str) -> np.ndarray:
        parts = [np.array(h, np.uint64) for h in _shingles(text, size)]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)

    return hashes


def _worded(docs: DataFrame) -> DataFrame:
    """``(_row, t)`` of the texts that have words."""
    rows = with_row_id(docs.select(text_of(docs).alias("t")))
    return rows.filter(F.col("t").rlike("[^\\x20\\x09-\\x0D]"))


def _frequent(texts: DataFrame, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of rows have, sorted, with their number.

    Prefixes take shingles in the order of this number.  Any order finds all pairs; this one
    leaves what many texts have in common to the end, and so makes fewer candidates.
    """

    @F.pandas_udf("array<long>")
    def tokens(t: pd.Series) -> pd.Series:
        return t.map(lambda x: hashes(x).view(np.int64))

    some = bounded_sample(texts, ORDER_ROWS, ROW).select(F.explode(tokens("t")).alias("token"))
    counted = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    found = counted.orderBy(F.desc("n"), "token").limit(ORDER_TOKENS).toPandas().sort_values("token")
    return found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


class Bits:
    """A table of bits that is set for the values of a column: it may say yes for others."""

    def __init__(self, values: DataFrame, bound: int = MOST_BITS) -> None:
        """From one column of longs that are as good as random; ``bound`` bits at most."""
        (name,) = values.columns
        n = values.count()
        self.width = max(6, min(bound, BITS_PER_VALUE * max(n, 1)).bit_length() - 1)
        at = F.shiftrightunsigned(F.col(name), 64 - self.width)
        words = values.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        # A row for each word of the table, which is as large as bound says.
        set_ = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        table = np.zeros(1 << (self.width - 6), np.int64)
        table[set_["word"].to_numpy()] = set_["bits"].to_numpy()
        self.shared = values.sparkSession.sparkContext.broadcast(table)

    def contains(self):
        """A function of arrays of longs, for use in tasks."""
        shared, width = self.shared, self.width

        def there(values: np.ndarray) -> np.ndarray:
            at = values.view(np.uint64) >> np.uint64(64 - width)
            words = shared.value.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)]
            return (words >> (at & np.uint64(63))) & np.uint64(1) == 1

        return there


def _meetings(texts: DataFrame, hashes, similarity: float) -> DataFrame:
    """``(_row, size, place, token)``: the shingles in the prefixes of several rows, one of those
    that the same rows have, and the place of each in its row's prefix.

    Most shingles of a prefix are in one row only.  They are counted in one exchange, by
    themselves; a table of bits of the others then keeps them from any further one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, hashes))

    @F.pandas_udf("struct<size:int,tokens:array<long>>")
    def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens, numbers = shared.value

        def of(text: str) -> tuple[int, np.ndarray]:
            own = hashes(text).view(np.int64)
            number = np.zeros(len(own), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                number = np.where(tokens[at] == own, numbers[at], 0)
            return len(own), own[np.lexsort((own, number))[: prefix_length(len(own), similarity)]]

        for part in batches:
            yield pd.DataFrame([of(t) for t in part], columns=["size", "tokens"])

    prefixes = cut_lineage(texts.select(ROW, prefix("t").alias("p")).select(ROW, "p.*"), "prefixes")
    counted = prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(counted.filter("n > 1").select("token"), "repeated")
    there = Bits(repeated).contains()

    @F.pandas_udf("array<struct<place:int,token:long>>")
    def kept(tokens: pd.Series) -> pd.Series:
        def of(own: np.ndarray) -> list[tuple[int, int]]:
            at = np.flatnonzero(there(own))
            return list(zip(at.tolist(), own[at].tolist(), strict=True))

        return tokens.map(of)

    rows = cut_lineage(prefixes.select(ROW, "size", F.inline(kept("tokens"))), "kept-prefixes")
    drop_table(prefixes)
    drop_table(repeated)
    met = cut_lineage(rows.join(_one_of_each(rows), "token"), "meetings")
    drop_table(rows)
    return met


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``(token)``: of shingles that the same rows have, several of them, the one that comes first.

    Shingles of one passage often have the same rows.  They come in the same order in all of
    them, and a pair that meets at any of them and may be similar also may by the first one, so
    the others add nothing.  Sets of rows are told apart by their number and two sums of 64 bits.
    """
    sums = [F.sum(F.xxhash64(F.lit(i), ROW).cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    members = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), *sums, F.min(F.struct(ROW, "place"))["place"].alias("at")
    )
    return members.filter("n > 1").groupBy("n", "h0", "h1").agg(F.min_by("token", "at").alias("token")).select("token")


def _open_meetings(met: DataFrame, roots: DataFrame, turn: int = 0) -> DataFrame:
    """The meetings of rows of different groups, with their ``root``; and of each meeting the
    ``stars``, some of its rows with their roots, others with each ``turn``."""
    known = roots.withColumnRenamed("node", ROW)
    grouped = met.join(known, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    drawn = [
        F.min(F.struct(F.xxhash64(F.lit(turn * STARS + i), ROW).alias("by"), F.col(ROW).alias("row"), "root", "size", "place"))
        for i in range(STARS)
    ]
    mixed = grouped.groupBy("token").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.array(*drawn).alias("stars")
    )
    return cut_lineage(grouped.join(mixed.filter("r0 != r1"), "token"), "open")


def _may_be_similar(na: Column, pa: Column, nb: Column, pb: Column, similarity: float) -> Column:
    """Whether sets of these sizes that share a shingle at these places may be similar: what comes
    before it in either row, the other lacks, and enough has to be left after it."""
    enough = similarity / (1 + similarity) * (na + nb) - 1e-6
    sizes = F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-6
    return sizes & (na - pa >= enough) & (nb - pb >= enough)


def _few_odd(wa: list[Column], wb: list[Column], na: Column, nb: Column, similarity: float) -> Column:
    """Whether the parities of two sets differ in no more classes than those of similar ones can.

    Every parity in which two sets differ is a shingle that one of them lacks.
    """
    odd = reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(wa, wb, strict=True)])
    return odd <= (1 - 2 * similarity / (1 + similarity)) * (na + nb) + 1e-6


def _stars(open_: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: for each row and draw one star of another group, of those that may be similar."""
    met = open_.select(
        F.col(ROW).alias("b"), "root", F.col("size").alias("nb"), "place", F.posexplode("stars").alias("draw", "star")
    )
    may = _may_be_similar(F.col("star.size"), F.col("star.place"), F.col("nb"), F.col("place"), similarity)
    apart = met.filter((F.col("root") != F.col("star.root")) & may).groupBy("b", "nb", "draw").agg(F.min("star").alias("star"))
    pairs = apart.select(F.col("star.row").alias("a"), "b", F.col("star.size").alias("na"), "nb").distinct()
    of = {x: parities.select(F.col(ROW).alias(x), F.col("parities").alias(f"w{x}")) for x in "ab"}
    words = {x: [F.col(f"w{x}")[i] for i in range(PARITY_LONGS)] for x in "ab"}
    few = _few_odd(words["a"], words["b"], F.col("na"), F.col("nb"), similarity)
    return pairs.join(of["a"], "a").join(of["b"], "b").filter(few).select("a", "b")


def _parities(halves: np.ndarray) -> np.ndarray:
    """Of each of ``64 * PARITY_LONGS`` classes of shingles, whether a set has an odd number."""
    counts = np.bincount(halves % np.uint32(64 * PARITY_LONGS), minlength=64 * PARITY_LONGS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _all_pairs(open_: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: all pairs of rows of different groups that may be similar.

    A pair is made where it meets first.  Shingles come in the same order in all rows, so one
    that both have among those just before a shared shingle is a place where they met before.
    """
    in_order = Window.partitionBy(ROW).orderBy("place")
    earlier = F.array_compact(F.array(*[F.lag("token", i).over(in_order) for i in range(1, EARLIER + 1)]))
    held = open_.withColumn("earlier", earlier).join(parities, ROW)

    def side(x: str) -> DataFrame:
        words = [F.col("parities")[i].alias(f"w{x}{i}") for i in range(PARITY_LONGS)]
        return held.select(
            "token", F.col(ROW).alias(x), F.col("root").alias(f"r{x}"), F.col("place").alias(f"p{x}"),
            F.col("size").alias(f"n{x}"), F.col("earlier").alias(f"e{x}"), *words,
        )

    words = {x: [F.col(f"w{x}{i}") for i in range(PARITY_LONGS)] for x in "ab"}
    may = (
        (F.col("ra") != F.col("rb"))
        # The smaller one is a; of equally large ones, the first.
        & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & _may_be_similar(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), similarity)
        & _few_odd(words["a"], words["b"], F.col("na"), F.col("nb"), similarity)
        & ~F.arrays_overlap("ea", "eb")
    )
    return side("a").join(side("b"), "token").filter(may).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(_row, root)``: rows with at least one near duplicate, and their group's first row.

    Rows are linked if the Jaccard similarity of their different shingles is at least
    ``similarity``.  Null and empty texts, and those without words, are near duplicates of
    none; repeated rows are of each other; an empty table gives no rows.

    Rows with close fingerprints meet first.  Then every row meets a few rows of other groups that
    it shares a shingle of the prefixes with, some drawn anew in each round, while rounds link
    rows; all pairs that this leaves in different groups are compared after that, so a large
    group of copies, whether or not all are similar to its first one, makes no pairs of its own.
    """
    ship_package(docs.sparkSession)
    hashes = _token_sets(size)

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / max(len(x) + len(y) - both, 1)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    texts = _worded(docs)
    met = _meetings(texts, hashes, similarity)
    # Sets are made of the rows that meet another one, again told by bits; a row's number is
    # spread by a hash for that.
    spread = F.xxhash64(ROW)
    meets = Bits(met.select(ROW).distinct().select(spread.alias("h"))).contains()

    @F.pandas_udf("struct<s:binary,parities:array<long>>")
    def shingle_set(hashed: pd.Series, t: pd.Series) -> pd.DataFrame:
        wanted = meets(hashed.to_numpy(np.int64))
        own = [halves(x) if w else None for w, x in zip(wanted, t, strict=True)]
        return pd.DataFrame(
            {
                "s": pd.Series([None if x is None else x.tobytes() for x in own], dtype=object),
                "parities": pd.Series([None if x is None else _parities(x) for x in own], dtype=object),
            }
        )

    def halves(text: str) -> np.ndarray:
        # Two texts are compared by half of each hash: of 400 shingles each, unlike ones agree
        # in one of some 25,000 pairs.  What meets whom is told by whole hashes.
        return np.unique((hashes(text) >> np.uint64(32)).astype(np.uint32))

    # Declared not deterministic, so that the filter does not make every set a second time.
    sets = texts.select(ROW, shingle_set.asNondeterministic()(spread, "t").alias("x")).select(ROW, "x.*")
    sets = cut_lineage(sets.filter("s IS NOT NULL"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs close in the shingles themselves.  A set moves to the pairs it is in, and
        goes on with them to the other one."""
        pairs = cut_lineage(pairs, "pairs")
        few = pairs.count() * PAIR_BYTES <= BROADCAST_BYTES
        of_a = sets.select(F.col(ROW).alias("a"), F.col("s").alias("sa"))
        of_b = sets.select(F.col(ROW).alias("b"), F.col("s").alias("sb"))
        held = of_b.join(F.broadcast(pairs) if few else pairs, "b")
        firsts = pairs.select("a").distinct()
        needed = of_a.join(F.broadcast(firsts) if few else firsts, "a", "left_semi")
        links = cut_lineage(held.join(needed, "a").filter(jaccard("sa", "sb") >= similarity).select("a", "b"), "links")
        drop_table(pairs)
        return links

    parities = sets.select(ROW, "parities")
    edges = verified(_close_rows(texts))
    for turn in range(STAR_ROUNDS):
        open_ = _open_meetings(met, components(edges), turn)
        found = verified(_stars(open_, parities, similarity))
        drop_table(open_)
        edges = edges.unionByName(found)
        if found.isEmpty():
            break
    open_ = _open_meetings(met, components(edges))
    drop_table(met)
    more = verified(_all_pairs(open_, parities, similarity))
    drop_table(open_)
    drop_table(sets)
    return components(edges.unionByName(more)).select(F.col("node").alias(ROW), "root")


def drop_near_duplicates(docs: DataFrame, size: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each group and all others, with all their columns.

    Documents are grouped as ``near_duplicates`` says; columns of any name are kept.
    """
    gone = near_duplicates(docs, size, similarity).filter(F.col(ROW) != F.col("root")).select(ROW)
    return without_rows(docs, gone)
