"""Documents (ext_id, text) from folders of text files and from wiki dumps."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """A row for each file below ``path`` that can be decoded and isn't empty; its name is ``ext_id``."""
    codecs.lookup(encoding)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, data in zip(f["path"], f["content"]):
                try:
                    text = bytes(data).decode(encoding)
                except UnicodeDecodeError:
                    continue
                if text:
                    out.append((p.rsplit("/", 1)[-1], text))
            yield pd.DataFrame(out, columns=["ext_id", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "ext_id string, text string")


def articles(docs: DataFrame, least: int = 100) -> DataFrame:
    """Texts of more than ``least`` characters that aren't redirects."""
    return docs.filter((F.length("text") > least) & ~F.col("text").startswith("#REDIRECT"))


def wiki_dump(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Articles of an XML dump (also .bz2): the title is ``ext_id``."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return articles(pages.select(F.col("title").alias("ext_id"), F.col("revision.text._VALUE").alias("text")), least)
