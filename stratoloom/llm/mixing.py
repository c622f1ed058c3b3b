"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, broadcast_if_small, few_or_raise, map_frames

#: Folder of the public tokenizers' vocabulary files.
TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: More sources than this do not fit the plan, which the driver holds.
MOST_SOURCES = 100_000
_BINS = 4096
_encodings: dict[str, object] = {}


def encoding(folder: str, name: str = "byte_bpe_50k"):
    """The byte-level tokenizer of a vocabulary file of ranks, built once per process."""
    path = f"{folder}/{name}.tiktoken"
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # the public word pattern of this vocabulary
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


_LONG_SPACE = re.compile(r"\s{4096,}")


def token_count(enc, text: str) -> int:
    """The number of tokens of a text.

    The word pattern's machine runs out of stack on very long runs of white space, so these are counted
    by themselves: a word never begins before the last white space character in front of it, and what
    stands before a run always ends with it, so the pieces are those of the whole text.
    """
    n = at = 0
    for m in _LONG_SPACE.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : stop]))
        at = stop
    return n + len(enc.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, keep: tuple[str, ...], text: str = "text", folder: str = TOKENIZER_FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """The ``keep`` columns with ``tokens``, the size of the whole text; null texts have 0.

    Works where the rows are read; texts do not leave the Python workers.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for b in batches:
            yield b[list(keep)].assign(tokens=[token_count(enc, t) if t else 0 for t in b["_text"]])

    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("tokens", "long")
    return map_frames(rows, count, schema)


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What every target source has, should give and can give.

    ``sized`` has ``source, tokens``; the total is that of all documents, those without a source
    or without a target included.  Returns ``source, weight, max_repeats, docs, size, wanted, given,
    capped, whole, fraction``: each document is used ``whole`` times, and once more with
    probability ``fraction``; ``capped`` means that ``size * max_repeats < weight * total``.
    A source without documents gives nothing (and is capped if it should).  Repeated targets
    count once (greatest weight), null sources and weights are left out.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("size"))
    total = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.where("source is not null and weight is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    p = t.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    p = p.withColumns({"docs": F.coalesce("docs", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    p = p.withColumn("wanted", F.col("weight") * F.col("total"))
    p = p.withColumn("capped", F.col("size") * F.col("max_repeats") < F.col("wanted"))
    p = p.withColumn("given", F.least(F.col("wanted"), (F.col("size") * F.col("max_repeats")).cast("double")))
    ratio = F.when(F.col("size") > 0, F.col("given") / F.col("size")).otherwise(F.lit(0.0))
    p = p.withColumn("whole", F.floor(ratio + 1e-12).cast("int")).withColumn("fraction", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    return p.select("source", "weight", "max_repeats", "docs", "size", "wanted", "given", "capped", "whole", "fraction")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, weight_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """How often every document is used, and the shares really reached.

    ``sized`` has ``doc_id, source, tokens`` and perhaps ``weight_col`` (relative inclusion odds
    within a source; null or not positive counts as 1).  Returns ``(documents, shares)``:
    ``doc_id, source, tokens, copies`` (documents with at least one copy), and one row per target
    source with ``source, weight, wanted, given, docs_used, tokens_used, share, share_after_caps,
    exhausted``: ``share`` is that of all tokens used, ``share_after_caps`` what it should be now that
    capped sources give less than their weight, ``exhausted`` that every copy allowed was used and
    the source still gives less than is wanted.

    After the certain whole copies, the rest of a source is a Pareto sample: documents are ranked
    by the odds of a random number (a hash of id and seed) over the odds of their inclusion
    probability, and taken in this order until the tokens still wanted are reached.  A document
    whose probability reaches 1 is certain.  The cut-off is found by histograms of the ranks,
    narrowed bin by bin, so no source, however large, is ever sorted in one task; equal ranks are
    taken together, so the sample ends with the last rank that still fits.
    """
    spark = sized.sparkSession
    cuts = Cuts(spark, "mix")
    # only these columns, so that others of the same names cannot clash
    sized = sized.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), *([F.col(weight_col).alias("_w")] if weight_col else []))
    plan = cuts.cut(source_plan(sized, targets))
    plan_rows = few_or_raise(plan, MOST_SOURCES, "target sources")
    docs = sized.where(F.col("source").isNotNull()).join(broadcast_if_small(plan.select("source", "whole", "fraction", F.col("size").alias("_size"))), "source")
    uniform = (F.expr(f"(xxhash64({seed}, cast(doc_id as string)) & 9007199254740991) + 1") / F.lit(float(2**53 + 2))).alias("u")
    if weight_col:
        w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0).cast("double")
        sums = docs.groupBy("source").agg(F.sum(w * F.col("tokens")).alias("_ws"))
        docs = docs.join(broadcast_if_small(sums), "source")
        chance = F.when(F.col("_ws") > 0, w * F.col("fraction") * F.col("_size") / F.col("_ws")).otherwise(0.0)
    else:
        chance = F.col("fraction")
    docs = docs.withColumns({"chance": F.least(F.lit(1.0), chance), "u": uniform})
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    # squeezed into [0, 1): order is kept, certain documents come first
    rank = F.when(F.col("chance") >= 1, F.lit(0.0)).when(F.col("chance") <= 0, F.lit(None)).otherwise(q / (1 + q))
    ranked = cuts.cut(docs.select("doc_id", "source", "tokens", "whole", rank.alias("rank")))

    need = {r.source: r.given - r.whole * r.size for r in plan_rows if r.fraction > 0 and r.size > 0}
    low: dict[str, float] = {s: 0.0 for s in need}
    width: dict[str, float] = {s: 1.0 for s in need}
    left, open_ = dict(need), set(need)
    cutoff: dict[str, float] = {}
    while open_:
        # the histograms of all sources together stay small for the driver
        n_bins = max(16, min(_BINS, 1_000_000 // len(open_)))
        zoom = spark.createDataFrame([(s, low[s], width[s]) for s in sorted(open_)], "source string, low double, width double")
        inside = ranked.join(broadcast_if_small(zoom), "source").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
        hist = inside.groupBy("source", F.least(F.lit(n_bins - 1), F.floor((F.col("rank") - F.col("low")) / F.col("width") * n_bins)).cast("int").alias("bin")).agg(
            F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last")
        )
        bins: dict[str, list] = {s: [] for s in open_}
        for r in few_or_raise(hist, n_bins * len(open_), "rank histogram"):
            bins[r.source].append(r)
        for s in sorted(open_):
            hit = None
            for r in sorted(bins[s], key=lambda r: r.bin):
                if r.tokens > left[s]:
                    hit = r
                    break
                left[s] -= r.tokens
            if hit is None:
                cutoff[s] = low[s] + width[s]
                open_.discard(s)
            elif hit.n == 1 or hit.first == hit.last or width[s] < 1e-14:
                # one rank over the goal: taken if that comes closer
                take = abs(hit.tokens - left[s]) < left[s]
                cutoff[s] = math.nextafter(hit.last, 2.0) if take else hit.first
                open_.discard(s)
            else:
                low[s], width[s] = hit.first, math.nextafter(hit.last, 2.0) - hit.first
    cut_df = spark.createDataFrame([(s, float(c)) for s, c in cutoff.items()], "source string, cutoff double")
    used = (
        ranked.join(broadcast_if_small(cut_df), "source", "left")
        .withColumn("copies", F.col("whole") + F.when(F.col("rank") < F.col("cutoff"), 1).otherwise(0))
        .where("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    sums = used.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    whole = sums.agg(F.sum("tokens_used").alias("all_used")).crossJoin(plan.agg(F.sum("given").alias("all_given")))
    used_tokens = F.coalesce("tokens_used", F.lit(0))
    shares = (
        plan.join(sums, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source",
            "weight",
            "wanted",
            "given",
            F.coalesce("docs_used", F.lit(0)).alias("docs_used"),
            used_tokens.alias("tokens_used"),
            F.coalesce(F.try_divide("tokens_used", "all_used"), F.lit(0.0)).alias("share"),
            F.coalesce(F.try_divide("given", "all_given"), F.lit(0.0)).alias("share_after_caps"),
            ((used_tokens == F.col("size") * F.col("max_repeats")) & (used_tokens < F.col("wanted"))).alias("exhausted"),
        )
    )
    return used, shares
