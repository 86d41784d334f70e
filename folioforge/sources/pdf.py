"""PDF files to pages.

Files are read as binary rows and parsed where they lie, one file per Python row, pages
streamed out in small batches.  The parser is pluggable; the default needs ``pymupdf``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = (
    "file string, page0 int, total_pages int, text string, "
    "images array<struct<path:string,xref:int,width:int,height:int,format:string,page:int>>"
)
_BATCH = 64


@dataclass
class ParsedImage:
    xref: int
    data: bytes
    ext: str
    width: int = 0
    height: int = 0


@dataclass
class ParsedPage:
    text: str
    total_pages: int
    # Callables so that one broken image costs only itself.
    images: list[Callable[[], ParsedImage]] = field(default_factory=list)


def pymupdf_pages(data: bytes) -> Iterator[ParsedPage]:
    """Pages of a PDF through the optional pymupdf library."""
    import pymupdf

    with pymupdf.open(stream=data, filetype="pdf") as doc:
        for page in doc:

            def load(xref: int) -> ParsedImage:
                raw = doc.extract_image(xref)
                return ParsedImage(
                    xref, raw["image"], raw["ext"], raw.get("width", 0), raw.get("height", 0)
                )

            refs = [img[0] for img in page.get_images(full=True)]
            yield ParsedPage(
                str(page.get_text()), len(doc), [lambda x=x: load(x) for x in refs]
            )


def _store_images(page: ParsedPage, folder: str, page_no: int) -> list[dict]:
    stored = []
    for i, load in enumerate(page.images, start=1):
        try:
            image = load()
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"page_{page_no:04d}_img_{i:03d}.{image.ext}")
            with open(path, "wb") as out:
                out.write(image.data)
        except Exception as e:  # one unreadable image must not lose the page
            print(f"Failed to extract image on page {page_no}: {e}")
            continue
        stored.append(
            {
                "path": path,
                "xref": image.xref,
                "width": image.width,
                "height": image.height,
                "format": image.ext,
                "page": page_no,
            }
        )
    return stored


def read_pdf_pages(
    spark: SparkSession,
    pdf_dir: str,
    image_root: str | None = None,
    parse: Callable[[bytes], Iterable[ParsedPage]] = pymupdf_pages,
    titles: DataFrame | None = None,
) -> DataFrame:
    """One row per page: ``(file, page0, total_pages, text, images)``.

    With ``image_root`` (a folder all executors can write) images are stored below the
    book's title, joined from ``titles`` (``file``, ``title``, ``ordinal``; the first entry of
    a file counts) or the file's stem; without it none are read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .load(pdf_dir)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    # Titles meet the names of files; the contents are read where they are joined.
    if titles is None:
        files = files.withColumn("title", F.lit(None).cast("string"))
    else:
        known = titles.groupBy("file").agg(F.min_by("title", "ordinal").alias("title"))
        files = files.join(known, "file", "left")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data, title in zip(batch["file"], batch["content"], batch["title"]):
                title = re.sub(r"\.pdf$", "", name) if title is None else title
                folder = re.sub(r"[^\w\s-]", "", title).strip().replace(" ", "_")
                rows: list = []
                for page0, page in enumerate(parse(data)):
                    images = (
                        _store_images(page, os.path.join(image_root, folder), page0 + 1)
                        if image_root
                        else []
                    )
                    rows.append((name, page0, page.total_pages, page.text, images))
                    if len(rows) == _BATCH:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return files.mapInPandas(pages, _PAGE)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "page0", "total_pages", "text", "images"])
