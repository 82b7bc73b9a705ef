"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

One raw-content dictionary of sample text per language goes to every task. A whole text is cut into pieces short
enough that the dictionary, not the text's own past, decides; each piece is compressed with every dictionary and the
sizes are summed. A text is rejected when the best and the second language differ by less than a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldtrace.llm.common import whole
from fieldtrace.llm.labels import bounded_sample

#: Documents sampled per language, bytes taken from each and bytes of a dictionary: the bound of the training data.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1024, 96 * 1024
#: Bytes of a text that are compressed at a time.
PIECE = 256
LEVEL = 6
#: The second-best language must need this part more bytes than the best. Mixed and foreign texts fall below it.
MARGIN = 0.005
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
FOUND = StructType([StructField("lang_pred", StringType()), StructField("margin", DoubleType())])


@dataclass(frozen=True)
class Dictionaries:
    """Raw content by language, in the order of the language codes."""

    content: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for _, data in self.content:
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def train(docs: DataFrame) -> Dictionaries:
    """Dictionaries from a bounded sample of the rows with text and lang: ``SAMPLE_DOCS`` documents per language.

    Texts are lower-cased, in training and use. Each gives ``SAMPLE_BYTES`` from its middle; the driver holds one dictionary per language.
    """
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and trim(text) <> ''")
    data = F.lower("text").cast("binary")
    size = F.length(data)
    middle = F.greatest(F.lit(1), ((size - SAMPLE_BYTES) / 2).cast("int"))
    picked = bounded_sample(usable, "lang", SAMPLE_DOCS, "|lang").select("lang", "doc_id", F.substring(data, middle, F.lit(SAMPLE_BYTES)).alias("part"))
    by_language: dict[str, list[bytes]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], str(r["doc_id"]), bytes(r["part"]))):
        by_language.setdefault(row["lang"], []).append(bytes(row["part"]))
    return Dictionaries(tuple((lang, b"\n".join(parts)[-DICTIONARY_BYTES:]) for lang, parts in sorted(by_language.items())))


def identifier(dictionaries: Dictionaries):
    """A column function text -> (lang_pred, margin): margin is the share of bytes that the best language saves."""

    @pandas_udf(FOUND)
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages = [lang for lang, _ in dictionaries.content]
        encoders = [c.compress for c in dictionaries.compressors()]
        for texts in parts:
            names, margins = [], []
            for text in texts:
                if not text or not languages or not LETTER.search(text):
                    names.append(UNKNOWN)
                    margins.append(0.0)
                    continue
                data = text.lower().encode("utf-8", "replace")
                pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = np.array([sum(map(len, map(encode, pieces))) for encode in encoders])
                order = np.argsort(sizes, kind="stable")
                names.append(languages[order[0]])
                margins.append(1.0 if len(sizes) == 1 else float(sizes[order[1]] - sizes[order[0]]) / float(sizes[order[1]]))
            yield pd.DataFrame({"lang_pred": names, "margin": margins})

    return identify


def identified(docs: DataFrame, dictionaries: Dictionaries, margin: float = MARGIN) -> DataFrame:
    """Each row with its language.

    Columns: doc (struct of all columns of docs), doc_id, lang_pred (``und`` if the text is null, has no letter or
    nothing was learned), score (0 to 1, grows with the margin: 0.5 at the rejection margin, 0 for ``und``), rejected
    (``und`` or a margin below the threshold). Equal sizes go to the first language code. Every row is told by itself,
    repeated ones alike; texts of any length are compressed whole, piece by piece; an empty table gives no rows.
    """
    found = docs.select(whole(docs), "doc_id", identifier(dictionaries)(F.col("text")).alias("_found"))
    at = F.col("_found.margin")
    return found.select(
        "doc", "doc_id", F.col("_found.lang_pred").alias("lang_pred"), (at / (at + F.lit(margin))).alias("score"),
        ((F.col("_found.lang_pred") == UNKNOWN) | (at < margin)).alias("rejected"),
    )
