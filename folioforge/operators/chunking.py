"""Page text to retrieval chunks, entirely as column expressions.

A page is one row, so chunking is a map: no shuffle, no Python worker, and pages of one
book spread over all executors.  Only greedy packing is sequential; it is a fold over
the page's own pieces that carries the open chunk and the finished ones.

Expressions are written as Spark SQL.  ``x`` below is a column name or any SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import WS_CHARS
from folioforge.functions.structure import chunk_id


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = fv.CHUNK_SIZE
    overlap: int = fv.CHUNK_OVERLAP
    min_chunk_size: int = fv.MIN_CHUNK_SIZE

    def __post_init__(self) -> None:
        if self.overlap >= self.chunk_size:
            raise ValueError(
                f"overlap ({self.overlap}) must be smaller than chunk_size ({self.chunk_size})"
            )


# --- SQL building blocks ----------------------------------------------------------

_NONE = "cast(array() AS array<string>)"


def _regex(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, '{WS_CHARS}')"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once and bound to ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _non_empty(parts: str) -> str:
    return f"filter(transform({parts}, part -> {_strip('part')}), part -> part <> '')"


# --- headings ---------------------------------------------------------------------


def strip_headings(x: str) -> Column:
    """Struct ``<body, headings, section>``.

    Leading page numbers are dropped and chapter or section lines moved to ``headings``;
    the first line that is neither ends the scan.
    """
    top = f"""slice(
        filter(
            transform(lines, (l, i) -> named_struct('i', i, 's', {_strip('l')})),
            line -> line.s <> ''),
        1, {fv.HEADING_SCAN_LINES})"""
    heading = " OR ".join(
        f"line.s RLIKE {_regex(p)}" for p in (fv.CHAPTER_LINE, fv.SECTION_HEADING_LINE)
    )
    body = f"""CASE WHEN acc.next = 0 THEN {x}
        ELSE array_join(slice(lines, acc.next + 1, size(lines)), chr(10)) END"""
    scan = f"""aggregate(
        {top},
        named_struct('next', 0, 'heads', {_NONE}, 'more', true),
        (acc, line) -> CASE
            WHEN NOT acc.more THEN acc
            WHEN line.s RLIKE {_regex(fv.PAGE_NUMBER_LINE)}
            THEN named_struct('next', line.i + 1, 'heads', acc.heads, 'more', true)
            WHEN {heading}
            THEN named_struct('next', line.i + 1, 'heads', concat(acc.heads, array(line.s)),
                              'more', true)
            ELSE named_struct('next', acc.next, 'heads', acc.heads, 'more', false) END,
        acc -> named_struct(
            'body', {_strip(body)},
            'headings', acc.heads,
            'section', coalesce(try_element_at(acc.heads, 1), '')))"""
    return F.expr(_let("lines", f"split({x}, '\n', -1)", scan))


# --- splitting --------------------------------------------------------------------


def _paragraphs(x: str) -> str:
    return _non_empty(f"split({x}, {_regex(fv.PARAGRAPH_BREAK)}, -1)")


def _sentences(x: str) -> str:
    return _non_empty(f"split(regexp_replace({x}, '\n+', ' '), {_regex(fv.SENTENCE_BREAK)}, -1)")


def _windows(x: str, cfg: ChunkSettings) -> str:
    step = cfg.chunk_size - cfg.overlap
    span = -(-cfg.chunk_size // step)
    steps = f"regexp_extract_all({x}, r'(?s).{{1,{step}}}', 0)"
    window = f"substring(array_join(slice(steps, i + 1, {span}), ''), 1, {cfg.chunk_size})"
    windows = _let("steps", steps, f"transform(steps, (b, i) -> {_strip(window)})")
    return f"filter({windows}, w -> length(w) >= {cfg.min_chunk_size})"


def _tail(pieces: str, sep: str, limit: int) -> str:
    """Trailing text of a finished chunk that seeds the next one."""
    return f"""aggregate(
        reverse({pieces}),
        named_struct('kept', {_NONE}, 'room', {limit}, 'more', true),
        (t, q) -> CASE
            WHEN NOT t.more THEN t
            WHEN length(q) <= t.room
            THEN named_struct('kept', concat(array(q), t.kept), 'room', t.room - length(q),
                              'more', true)
            WHEN t.room > 0
            THEN named_struct('kept', concat(array(right(q, t.room)), t.kept), 'room', 0,
                              'more', false)
            ELSE named_struct('kept', t.kept, 'room', 0, 'more', false) END,
        t -> {_strip(f"array_join(t.kept, '{sep}')")})"""


def _pack(texts: str, split: str, sep: str, cfg: ChunkSettings) -> str:
    """Greedy packing; ``split`` turns an oversized ``piece`` into its own chunks."""
    pieces = f"""transform({texts}, piece -> named_struct(
        'text', piece, 'size', length(piece),
        'split', CASE WHEN length(piece) > {cfg.chunk_size} THEN {split} END))"""
    flushed = f"""CASE WHEN size(acc.open) > 0
        THEN concat(acc.done, array(array_join(acc.open, '{sep}'))) ELSE acc.done END"""
    reseeded = f"""named_struct(
        'done', {flushed},
        'open', CASE WHEN seed = '' THEN array(p.text) ELSE array(seed, p.text) END,
        'size', length(seed) + p.size)"""
    return f"""aggregate(
        {pieces},
        named_struct('done', {_NONE}, 'open', {_NONE}, 'size', 0),
        (acc, p) -> CASE
            WHEN p.split IS NOT NULL
            THEN named_struct('done', concat({flushed}, p.split), 'open', {_NONE}, 'size', 0)
            WHEN acc.size + p.size > {cfg.chunk_size} AND size(acc.open) > 0
            THEN {_let('seed', _tail('acc.open', sep, cfg.overlap), reseeded)}
            ELSE named_struct('done', acc.done, 'open', concat(acc.open, array(p.text)),
                              'size', acc.size + p.size) END,
        acc -> {flushed})"""


def _packed_sentences(sentences: str, cfg: ChunkSettings) -> str:
    return _pack(sentences, _windows("piece", cfg), " ", cfg)


def _packed_paragraphs(paragraphs: str, cfg: ChunkSettings) -> str:
    """A paragraph over the target is packed by sentences, or cut into windows."""
    resplit = f"""flatten(transform({_packed_sentences('sents', cfg)}, c -> CASE
        WHEN length(c) > {2 * cfg.chunk_size} THEN {_windows('c', cfg)} ELSE array(c) END))"""
    choice = f"CASE WHEN size(sents) <= 1 THEN {_windows('piece', cfg)} ELSE {resplit} END"
    return _pack(paragraphs, _let("sents", _sentences("piece"), choice), "\n\n", cfg)


def _chunk_texts(x: str, cfg: ChunkSettings) -> str:
    def fits(chunks: str) -> str:
        longest = f"array_max(transform({chunks}, c -> length(c)))"
        return f"size({chunks}) > 0 AND {longest} <= {2 * cfg.chunk_size}"

    fallback = _let(
        "by_sentence",
        _packed_sentences(_sentences("body"), cfg),
        f"CASE WHEN {fits('by_sentence')} THEN by_sentence ELSE {_windows('body', cfg)} END",
    )
    chosen = _let(
        "by_paragraph",
        _packed_paragraphs(_paragraphs("body"), cfg),
        f"CASE WHEN {fits('by_paragraph')} THEN by_paragraph ELSE {fallback} END",
    )
    return _let("body", _strip(x), f"CASE WHEN body = '' THEN {_NONE} ELSE {chosen} END")


def split_paragraphs(x: str) -> Column:
    return F.expr(_paragraphs(x))


def split_sentences(x: str) -> Column:
    return F.expr(_sentences(x))


def char_windows(x: str, cfg: ChunkSettings = ChunkSettings()) -> Column:
    """Overlapping character windows, stripped, short ones dropped.

    The text is cut into steps once and a window is put together from the steps it
    covers, so long texts are not searched from their start for every window.
    """
    return F.expr(_windows(x, cfg))


def pack_sentences(x: str, cfg: ChunkSettings = ChunkSettings()) -> Column:
    """Chunks from an array of sentences."""
    return F.expr(_packed_sentences(x, cfg))


def pack_paragraphs(x: str, cfg: ChunkSettings = ChunkSettings()) -> Column:
    """Chunks from an array of paragraphs."""
    return F.expr(_packed_paragraphs(x, cfg))


def split_text(x: str, cfg: ChunkSettings = ChunkSettings()) -> Column:
    """Chunk texts: by paragraphs, else by sentences, else by character windows.

    A fallback is evaluated only for a page whose preferred split left a chunk of more
    than twice the target size.
    """
    return F.expr(_chunk_texts(x, cfg))


def place_chunks(body: str, texts: str) -> Column:
    """Add offsets: each text is searched from the end of the one before it.

    A text that is not literally in the body (its line breaks became blanks) is placed
    at the cursor, as published.  The fold carries what is left of the body from the cursor on,
    so that what lies before it is neither searched nor stepped over again.
    """
    skipped = "CASE WHEN hit > 0 THEN hit - 1 ELSE 0 END"
    put = f"""named_struct(
        'pos', acc.pos + {skipped} + length(t),
        'rest', substring(acc.rest, {skipped} + length(t) + 1),
        'out', concat(acc.out, array(named_struct(
            'content', t, 'start_char', acc.pos + {skipped},
            'end_char', acc.pos + {skipped} + length(t)))))"""
    # Most texts are not there any more, which a byte search finds out fastest.
    hit = "CASE WHEN contains(acc.rest, t) THEN locate(t, acc.rest) ELSE 0 END"
    return F.expr(
        f"""aggregate(
            {texts},
            named_struct('pos', 0, 'rest', {body}, 'out', cast(array() AS
                array<struct<content:string,start_char:int,end_char:int>>)),
            (acc, t) -> {_let('hit', hit, put)},
            acc -> acc.out)"""
    )


def chunk_documents(df: DataFrame, cfg: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Documents (``schemas.DOCUMENT``) to chunks (``schemas.CHUNK``); blank ones have none."""
    kept = f"""filter({_chunk_texts('head.body', cfg)},
        t -> length({_strip('t')}) >= {cfg.min_chunk_size})"""
    found = """map_filter(
        map('headings', array_join(head.headings, '; '), 'section', head.section),
        (k, v) -> v <> '')"""
    metadata = """map_concat(
        map_filter(coalesce(metadata, cast(map() AS map<string,string>)),
                   (k, v) -> NOT map_contains_key(found, k)),
        found)"""
    return (
        df.select(
            F.expr("coalesce(id, 'unknown') AS doc_id"),
            "metadata",
            F.expr("coalesce(book_title, 'Unknown') AS book_title"),
            F.expr("coalesce(page_number, 0) AS page_number"),
            "doc_seq",
            strip_headings("coalesce(content, '')").alias("head"),
        )
        .select("*", F.expr(kept).alias("texts"), F.expr(found).alias("found"))
        .select(
            "doc_id",
            F.expr(metadata).alias("metadata"),
            "book_title",
            "page_number",
            F.size("texts").alias("total_chunks"),
            F.col("head.section").alias("section"),
            F.col("head.headings").alias("headings"),
            "doc_seq",
            F.col("head.body").alias("body"),
            "texts",
        )
        .select(
            *["doc_id", "metadata", "book_title", "page_number", "total_chunks", "section", "headings", "doc_seq"],
            # The outer form: the inner one makes the optimizer infer a filter on the
            # array, push it below the projections and so chunk every page twice.
            # The body is a column of its own, or every chunk would carry all of ``head``.
            F.posexplode_outer(place_chunks("body", "texts")).alias("chunk_index", "chunk"),
        )
        .filter(F.col("chunk_index").isNotNull())
        .select(
            chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"),
            F.col("chunk.content").alias("content"),
            "metadata",
            "book_title",
            "page_number",
            "chunk_index",
            "total_chunks",
            F.col("chunk.start_char").alias("start_char"),
            F.col("chunk.end_char").alias("end_char"),
            "section",
            "headings",
            "doc_seq",
        )
    )
