"""Reports as text.

A report is a list of sections, each a table with a title and an order.  Rows become lines in
Spark: ``write`` puts every line of every section into text files in that order, and ``head``
gives a bounded number of lines of each for the console, with a word on what is left out.
"""

from __future__ import annotations

import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators import evaluation

#: Rows of a section that a console shows, and characters of a wrapped line.
SHOWN, WIDTH = 20, 100


@dataclass
class Section:
    """A table under a title; ``order`` sorts its rows, ``texts`` names columns to wrap."""

    title: str
    table: DataFrame
    order: list = field(default_factory=list)
    texts: tuple[str, ...] = ()

    def sorted(self) -> DataFrame:
        return self.table.orderBy(*self.order) if self.order else self.table

    def lines(self) -> DataFrame:
        """``line``: one for each row, ``name value`` pairs; texts follow behind a bar."""
        return self.sorted().select(F.concat_ws(" | ", *_cells(self)).alias("line"))


def _shown(table: DataFrame, name: str) -> Column:
    kind, value = table.schema[name].dataType.typeName(), F.col(name)
    if kind in ("double", "float"):
        value = F.format_string("%.4f", value)
    elif kind in ("array", "map", "struct"):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit("-"))


def _cells(section: Section) -> list[Column]:
    plain = [c for c in section.table.columns if c not in section.texts]
    pairs = F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), _shown(section.table, c)) for c in plain])
    return [pairs, *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ") for c in section.texts]]


def write(sections: list[Section], path: str) -> None:
    """Every section as text files in a numbered folder, complete and in order."""
    for i, section in enumerate(sections):
        name = "".join(c if c.isalnum() else "-" for c in section.title.lower())
        section.lines().write.text(f"{path}/{i:02d}-{name}")


def save_json(report: dict[str, DataFrame], path: str) -> None:
    """Every section as JSON lines below ``path``."""
    for name, section in report.items():
        section.write.json(f"{path}/{name}")


def head(sections: list[Section], shown: int = SHOWN) -> Iterator[str]:
    """Titles and the first lines of each section; at most ``shown`` rows of each are read."""
    for section in sections:
        yield f"== {section.title} =="
        rows = section.lines().limit(shown + 1).collect()
        for row in rows[:shown]:
            yield textwrap.fill(row["line"], width=WIDTH, subsequent_indent="    ")
        if not rows:
            yield "nothing"
        elif len(rows) > shown:
            yield f"... more than {shown}; the written report has them all"


# --- reports ----------------------------------------------------------------------


def hits(found: DataFrame, preview_chars: int = 300) -> list[Section]:
    """Ranked hits with a preview of their text."""
    table = found.withColumn("content", F.substring("content", 1, preview_chars))
    return [Section("hits", table, ["query_id", "rank"], ("content",))]


def answers(found: DataFrame, show_chunks: bool = False, preview_chars: int = 300) -> list[Section]:
    """Answers with what they cite, and optionally the chunks that were retrieved for them."""
    cited = found.select("query_id", F.inline("citations")).withColumnRenamed("index", "number")
    sections = [
        Section("answers", found.select("query_id", "answer"), ["query_id"], ("answer",)),
        Section("sources", cited, ["query_id", "number"]),
    ]
    if show_chunks:
        chunks = found.select("query_id", F.inline("chunks"))
        preview = chunks.withColumn("content", F.substring("content", 1, preview_chars))
        sections.append(Section("retrieved chunks", preview, ["query_id", F.desc("score")], ("content",)))
    return sections


def evaluated(results: DataFrame, k: int, levels: tuple[str, ...] = ("easy", "medium", "hard")) -> list[Section]:
    """Measures overall and by group, the queries without a relevant hit, and every query.

    Of difficulties, ``levels`` are reported, in this order.
    """
    slices = evaluation.breakdown(results, k)
    level = F.array_position(F.array(*map(F.lit, levels)), F.col("name"))
    by_level = slices.filter((F.col("slice") == "difficulty") & (level > 0))
    return [
        Section(f"all queries at k={k}", evaluation.summarize(results, k)),
        Section("by book", slices.filter("slice = 'book'").drop("slice"), ["name"]),
        Section("by difficulty", by_level.drop("slice"), [level]),
        Section("nothing relevant found", evaluation.failures(results), ["query_id"]),
        Section("each query", evaluation.per_entry(results), ["query_id"], ("query",)),
    ]


def extraction(report: dict[str, DataFrame]) -> list[Section]:
    """The sections of ``diagnostics.run``."""
    return [
        Section("corpus", report["overall"]),
        Section("mis-decoded text", report["mojibake"]),
        Section("mis-decoded patterns", report["mojibake_patterns"], [F.desc("matches"), "pattern"]),
        Section("sizes", report["chunk_size"], ["measure"]),
        Section("pages", report["pages"]),
        Section("left-over headings", report["headings"]),
        Section("heading samples", report["heading_samples"], ["kind", "position"], ("sample",)),
        Section("captions", report["captions"]),
        Section("mathematics", report["equations"]),
        Section("text defects", report["text_hygiene"]),
        Section("pages without text", report["empty_pages"], ["doc_seq"]),
        Section("books", report["per_book"], ["book"]),
        Section("most mis-decoded", report["worst_chunks"], [F.desc("mojibake_count"), "book", "page"], ("preview",)),
    ]


def chunks(report: dict[str, DataFrame]) -> list[Section]:
    """The sections of ``chunk_report.run``."""
    return [
        Section("chunks", report["totals"]),
        Section("books", report["books"], ["book_title"]),
        Section("sizes", report["sizes"], ["measure"]),
        Section("chunks of a page", report["pages"], ["chunks_on_page"]),
        Section("cut sentences", report["boundaries"]),
        Section("left-over headings", report["residue"]),
        Section("neighbouring chunks", report["adjacent"]),
        Section("identical chunks", report["duplicates"]),
        Section("samples", report["samples"], [], ("preview",)),
    ]
