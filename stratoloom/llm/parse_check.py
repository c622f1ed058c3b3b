"""Source files that do not parse, per file and as rates per project and language.

Every file is recognised by generalised LL parsing (:mod:`gll`), all dialects of its language
together; a file that every dialect refuses is flagged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_frames
from .lexers import LANGUAGES, language


#: Verdicts a Python worker keeps, so that of copies only one is parsed.
_KEPT = 200_000
_verdicts: dict[tuple, bool] = {}


def refused(text: str | None, lang: str | None) -> bool:
    """Whether no dialect of the language derives the text.

    Null texts, unknown or null languages are not refused; a blank text is valid except as JSON.
    """
    lang_ = language(lang)
    if text is None or lang_ is None:
        return False
    name = lang.strip().lower()
    if name != "json" and not text.strip():
        return False
    key = (name, len(text), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    verdict = _verdicts.get(key)
    if verdict is None:
        if len(_verdicts) >= _KEPT:
            _verdicts.clear()
        verdict = _verdicts[key] = not lang_.valid(text)
    return verdict


def flag_unparsable(files: DataFrame, content: str = "content", lang: str = "language", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns with ``checked`` (a text in a supported language) and ``unparsable``.

    Runs where the rows are read, without a shuffle; texts are never cut.  Null content or an
    unsupported language gives ``checked`` false and ``unparsable`` false.  Repeated rows give
    repeated results.  The texts themselves do not leave the Python workers.
    """
    supported = F.lower(F.trim(F.col(lang))).isin(*LANGUAGES) & F.col(content).isNotNull()
    rows = files.select(*[F.col(f"`{c}`") for c in keep], F.when(supported, F.col(content)).alias("_text"), F.when(supported, F.col(lang)).alias("_lang"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = b["_lang"].notna()
            bad = [refused(t, g) if h else False for t, g, h in zip(b["_text"], b["_lang"], has, strict=True)]
            yield b[list(keep)].assign(checked=has.to_numpy(), unparsable=bad)

    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("checked", "boolean").add("unparsable", "boolean")
    return map_frames(rows, check, schema)


def parse_rates(flagged: DataFrame, *by: str) -> DataFrame:
    """Files checked, files refused and their share per group; groups without checked files are left out."""
    return (
        flagged.where("checked")
        .groupBy(*by)
        .agg(F.count("*").alias("files"), F.sum(F.col("unparsable").cast("long")).alias("unparsable_files"))
        .withColumn("unparsable_share", F.col("unparsable_files") / F.col("files"))
    )
