"""Code-quality measures: debt, hot spots, impact, reflexion, grades."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, few_or_raise
from .graph import bfs


# The weights and bounds of the measures below.
def technical_debt(markers, lines, complexity, churn, fix_share):
    """0.3 markers per thousand lines + 0.25 min(complexity/20, 1) + 0.2 min(churn, 10)/10 + 0.15 fix share + 0.1 min(lines/1000, 1)."""
    one = F.lit(1.0)
    per_k = F.when(lines > 0, markers / (lines / 1000.0)).otherwise(0.0)
    return 0.3 * per_k + 0.25 * F.least(complexity / 20.0, one) + 0.2 * F.least(churn, F.lit(10.0)) / 10.0 + 0.15 * fix_share + 0.1 * F.least(lines / 1000.0, one)


def hot_spots(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """The rows with the weighted sum of their measures, each over its maximum (0 where that is 0)."""
    top = df.agg(*[F.max(c).alias(f"_m_{c}") for c in weights])
    # one row
    j = df.crossJoin(F.broadcast(top))
    score = sum((w * F.when(F.col(f"_m_{c}") > 0, F.col(c) / F.col(f"_m_{c}")).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return j.withColumn(name, score).drop(*[f"_m_{c}" for c in weights])


def maintainability(lines, complexity):
    """The index of 0 to 100 from lines and complexity: volume is lines times the greater of log2(lines) and 1."""
    volume = lines * F.greatest(F.log2(F.greatest(lines, F.lit(1))), F.lit(1.0))
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(lines, F.lit(1)).cast("double"))
    return F.least(F.lit(171.0), F.greatest(F.lit(0.0), raw)) * 100 / 171


def change_impact(imports: DataFrame, co_change: DataFrame, similar: DataFrame, target, depth: int = 3) -> DataFrame:
    """Files a change of ``target`` may touch: ``id, score, source``.

    Direct importers score 1, further ones 1 / (d + 1); co-changes 0.8 of their weight, similar files 0.5; of several
    sources the first in this order counts.  ``imports`` has ``src, dst`` (src imports dst), the others ``a, b, weight``.
    """
    reach = bfs(imports.select(F.col("dst").alias("src"), F.col("src").alias("dst")), [target], depth).where("hops > 0")
    parts = [reach.select("id", F.when(F.col("hops") == 1, 1.0).otherwise(1 / (F.col("hops") + 1)).alias("score"), F.lit(0).alias("p"), F.lit("import").alias("source"))]
    for df, factor, p, label in ((co_change, 0.8, 1, "co-change"), (similar, 0.5, 2, "similar")):
        both = df.select("a", "b", "weight").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
        parts.append(both.where(F.col("a") == F.lit(target)).groupBy(F.col("b").alias("id")).agg((F.max("weight") * factor).alias("score")).select("id", "score", F.lit(p).alias("p"), F.lit(label).alias("source")))
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("id") != F.lit(target))
    return allp.groupBy("id").agg(F.min(F.struct("p", "score", "source")).alias("x")).select("id", F.col("x.score").alias("score"), F.col("x.source").alias("source"))


def reflexion(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Planned against real dependencies: ``src, dst, verdict`` convergence, divergence or absence."""
    e = expected.select("src", "dst").distinct().withColumn("e", F.lit(True))
    a = actual.select("src", "dst").distinct().withColumn("a", F.lit(True))
    v = F.when(F.col("e") & F.col("a"), "convergence").when(F.col("a"), "divergence").otherwise("absence")
    return e.join(a, ["src", "dst"], "full").select("src", "dst", v.alias("verdict"))


def inheritance_depth(classes: DataFrame, name: str, parent: str) -> DataFrame:
    """``id, dit, noc``: the longest chain of known parents above a class and its number of direct children.

    A class may have several rows, one per parent.  Where no class has two known parents the depths
    come from pointer doubling; else classes are settled in the order of their depth, one round
    each.  ``dit`` is null for classes in or below a loop, null names are dropped.
    """
    from .hierarchy import resolve_hierarchy

    cuts = Cuts(classes.sparkSession, "dit")
    c = classes.where(F.col(name).isNotNull())
    ids = cuts.cut(c.select(F.col(name).alias("id")).distinct())
    links = cuts.cut(c.where(F.col(parent).isNotNull()).select(F.col(name).alias("id"), F.col(parent).alias("up")).distinct().join(ids.select(F.col("id").alias("up")), "up"))
    noc = links.groupBy(F.col("up").alias("id")).agg(F.countDistinct("id").alias("noc"))
    parents = links.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if ids.schema["id"].dataType.simpleString() in ("int", "bigint") and parents.where("n > 1").isEmpty():
        one = ids.join(links, "id", "left")
        deep = resolve_hierarchy(one, "id", "up", with_path=False).select("id", F.when(F.col("depth") >= 0, F.col("depth")).alias("dit"))
    else:
        done = cuts.cut(ids.join(links.select("id").distinct(), "id", "left_anti").withColumn("dit", F.lit(0)))
        open_, left = links, -1
        while True:
            step = cuts.cut(open_.join(done.select(F.col("id").alias("up"), "dit"), "up", "left"))
            n = step.count()
            if n in (0, left):
                break
            left = n
            ready = step.groupBy("id").agg(F.max("dit").alias("d"), F.bool_and(F.col("dit").isNotNull()).alias("all")).where("all")
            nxt = cuts.cut(done.unionByName(ready.select("id", (F.col("d") + 1).alias("dit"))))
            open_ = step.select("id", "up").join(ready.select("id"), "id", "left_anti")
            done = nxt
        deep = ids.join(done, "id", "left")
    return deep.join(noc, "id", "left").select("id", "dit", F.coalesce("noc", F.lit(0)).alias("noc"))


def reviewers(ownership: DataFrame, files: list, most: int = 3) -> list[tuple]:
    """A small set of reviewers that covers the changed files: greedy by files still uncovered, then lines, then name.

    ``ownership`` has ``file, author, lines``; only the rows of the changed files reach the driver.
    """
    rows = few_or_raise(ownership.where(F.col("file").isin(files)).groupBy("author", "file").agg(F.sum("lines").alias("lines")), 100_000, "owners of changed files")
    left, out = {r.file for r in rows}, []
    by: dict = {}
    for r in rows:
        by.setdefault(r.author, {})[r.file] = r.lines
    while left and len(out) < most:
        best = min(by, key=lambda a: (-len(left & by[a].keys()), -sum(by[a][f] for f in left & by[a].keys()), a))
        got = left & by[best].keys()
        if not got:
            break
        out.append((best, len(got)))
        left -= got
    return out


def grade(score):
    """A to F for a score of 0 to 100: 90, 80, 70 and 60 are the steps."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def grade_report(dimensions: DataFrame) -> DataFrame:
    """Per pillar its mean score and grade, and the whole as the mean of the pillars: ``pillar, score, grade``."""
    p = dimensions.groupBy("pillar").agg(F.avg("score").alias("score"))
    whole = p.agg(F.avg("score").alias("score")).select(F.lit("overall").alias("pillar"), "score")
    return p.unionByName(whole).withColumn("grade", grade(F.col("score")))


def digest(alerts: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Alerts of several queries (``key, message``) as one list: ``severity, kind, key, message``, gravest first (1)."""
    out = None
    for df, kind, severity in alerts:
        p = df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "message")
        out = p if out is None else out.unionByName(p)
    return out.orderBy("severity", "kind", "key")


# ---- information --------------------------------------------------------------
def compressed_size(s: str) -> int:
    import zstandard

    return len(zstandard.ZstdCompressor(level=3).compress(s.encode("utf-8", "surrogatepass")))


def compression_distance(a: str, b: str, size_a: int | None = None, size_b: int | None = None) -> float:
    """Normalised compression distance of two texts by zstd; their own compressed sizes may be given."""
    x = compressed_size(a) if size_a is None else size_a
    y = compressed_size(b) if size_b is None else size_b
    return (compressed_size(a + b) - min(x, y)) / max(x, y, 1)


def edge_entropy(edges: DataFrame, src: str, weight: str) -> DataFrame:
    """Entropy in bits of each source's edge weights: ``src, edges, entropy``."""
    t = edges.groupBy(src).agg(F.sum(weight).alias("_t"))
    p = edges.join(t, src).where(F.col(weight) > 0).withColumn("_p", F.col(weight) / F.col("_t"))
    return p.groupBy(src).agg(F.count(F.lit(1)).alias("edges"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


# ---- query correction ---------------------------------------------------------
def ngram_counts(tokens: DataFrame, n: int) -> DataFrame:
    """``gram, n`` for all runs of up to ``n`` words of a column ``words`` (arrays)."""
    from ..functions.text import ngrams

    out = None
    for k in range(1, n + 1):
        p = tokens.select(F.explode(ngrams("words", k)).alias("gram"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def words_near(counts: DataFrame, query_words: list[str], most_edits: int = 2) -> DataFrame:
    """``word, near, edits``: the counted words within so many edits of each query word (a stated, small list)."""
    from ..functions.text import damerau
    from ..session import map_frames

    def look(batches):
        import pandas as pd

        for b in batches:
            out = [(w, q, d) for w in b["gram"] for q in query_words if abs(len(q) - len(w)) <= most_edits and (d := damerau(q, w, most_edits)) >= 0]
            yield pd.DataFrame(out, columns=["word", "near", "edits"])

    one = counts.where(~F.col("gram").contains(" ")).select("gram")
    return map_frames(one, look, "word string, near string, edits int")


class BigramModel:
    """A bigram model with absolute back-off to unigrams, for the words near some queries.

    The counts stay distributed; the driver holds the candidates of the query words and the pairs of
    these, at most ``most`` of either.
    """

    def __init__(self, counts: DataFrame, queries: list[str] | None = None, most_edits: int = 2, most: int = 100_000, discount: float = 0.4):
        self.counts, self.most_edits, self.most, self.discount = counts, most_edits, most, discount
        self.near: dict[str, list[tuple[str, int]]] = {}
        self.one: dict[str, int] = {}
        self.two: dict[str, int] = {}
        sums = counts.where(~F.col("gram").contains(" ")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
        self.total, self.words = max(1, sums.n or 0), sums.words
        self._load({w for q in queries or () for w in q.split()})

    def _load(self, words: set[str]) -> None:
        """Bring the candidates of further query words, their counts and those of their pairs."""
        fresh = sorted(words - self.near.keys())
        if not fresh:
            return
        self.near |= {w: [] for w in fresh}
        for r in few_or_raise(words_near(self.counts, fresh, self.most_edits), self.most, "words near the queries"):
            self.near[r.near].append((r.word, r.edits))
        known = sorted({w for x in self.near.values() for w, _ in x})
        parts = F.split("gram", " ")
        both = (F.size(parts) == 2) & parts[0].isin(known) & F.element_at(parts, -1).isin(known)
        self.one = {r.gram: r.n for r in few_or_raise(self.counts.where(F.col("gram").isin(known)), self.most, "candidates")}
        self.two = {r.gram: r.n for r in few_or_raise(self.counts.where(both), self.most, "pairs of candidates")}

    def cost(self, before: str | None, word: str) -> float:
        """Negative log probability of a word after another."""
        single = (self.one.get(word, 0) + 1) / (self.total + self.words + 1)
        if before is None or before not in self.one:
            return -math.log(single)
        pair = self.two.get(f"{before} {word}", 0) / self.one[before]
        return -math.log((1 - self.discount) * pair + self.discount * single)

    def correct(self, query: list[str], edit_cost: float = 3.0) -> list[str]:
        """The cheapest path through the lattice of known words near each query word (Viterbi, sums of costs)."""
        self._load(set(query))
        layers = [[(k, d * edit_cost) for k, d in sorted(self.near.get(w, ()))] or [(w, 0.0)] for w in query]
        best = {k: (c + self.cost(None, k), [k]) for k, c in layers[0]} if layers else {}
        for layer in layers[1:]:
            nxt = {}
            for k, c in layer:
                prev = min(best, key=lambda p: (best[p][0] + self.cost(p, k), p))
                nxt[k] = (best[prev][0] + self.cost(prev, k) + c, [*best[prev][1], k])
            best = nxt
        return min(best.values(), key=lambda x: (x[0], x[1]))[1] if best else []
