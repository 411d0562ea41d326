"""Sources: document files, parquet bundles, and an optional PDF decoder.

Decoding PDF pages needs a library that may be absent; everything else reads tables of glyphs, boxes and tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLYPHS = "path string, page_number int, seq long, text string, fontname string, size double, x0 double, top double, x1 double, bottom double, width double, matrix array<double>, page_width double, page_height double, error string"


def document_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of one folder (not of those below) with their bytes; fails when there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return files.select(F.col("path"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "length", "content")


def decode_glyphs(files: DataFrame, opener=None) -> DataFrame:
    """Glyphs of every page of every file. ``opener(bytes)`` yields pages as dicts with width, height and chars.

    Without one, the PDF library is imported on the workers. A page or file that fails gives one row with
    ``error`` and does not stop the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in GLYPHS.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    pages = opener(content) if opener else _open_pdf(content)
                    for number, page in enumerate(pages, 1):
                        for seq, c in enumerate(page["chars"]):
                            x0, x1 = c.get("x0", 0.0), c.get("x1", 0.0)
                            xy = [round(v, 2) for v in (x0, c.get("top", 0.0), x1, c.get("bottom", 0.0), x1 - x0)]
                            rows.append([path, number, seq, c.get("text", ""), c.get("fontname", ""), c.get("size", 10.0), *xy, list(c.get("matrix", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))), page["width"], page["height"], None])
                except Exception as e:  # noqa: BLE001  any decoder's failure is the file's
                    rows.append([path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"])
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, GLYPHS)


def _open_pdf(content: bytes):
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            yield {"width": float(page.width), "height": float(page.height), "chars": page.chars}


def recover_pages(pages: DataFrame, reader) -> DataFrame:
    """Paragraphs of pages whose text is corrupt. ``reader(path, page_number)`` returns the text; None keeps the glyphs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [reader(p, n) for p, n in zip(f["path"], f["page_number"], strict=True)]
            out = f[["path", "page_number"]].assign(type="paragraph", text=[None if t is None else t.strip() for t in texts], column_id=1)
            yield out[out["text"].notna()]

    return pages.where("corrupt").select("path", "page_number").mapInPandas(run, "path string, page_number int, type string, text string, column_id int")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a bundle folder."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
