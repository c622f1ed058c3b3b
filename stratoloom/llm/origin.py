"""Generated, minified and vendored files and data blobs, so that hand-written source remains.

Vendored packages are found through Merkle hashes: bottom-up hashes over the directory trees of all
projects, where a subtree that unrelated repositories share marks a vendored package, whatever the
names of its directories.  Header, name and layout rules look at every file by itself: they catch
generated and compacted files and data, and vendored ones that only one repository holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cuts, map_frames
from .lexers import language

# Customary names.
VENDOR_DIRS = frozenset("node_modules bower_components jspm_packages third_party third-party thirdparty vendored site-packages godeps pods carthage".split())
#: Only at the root of a project; deeper they are also names of things of the business.
ROOT_VENDOR_DIRS = frozenset("vendor extern external externals".split())
#: Languages whose files prove nothing when they are shared: everyone has the same licences and notes.
PROSE = frozenset(["", "markdown", "text", "jsonl"])
GENERATED_DIRS = frozenset("__generated__ generated-sources generated_sources __pycache__ .next".split())
ROOT_GENERATED_DIRS = frozenset("gen generated".split())
OUTPUT_PATHS = re.compile(r"(?:^|/)(?:target|build)/(?:[^/]+/)*out/|(?:^|/)target/(?:debug|release)/|(?:^|/)build/generated/")
GENERATED_NAMES = re.compile(
    r"_pb2(?:_grpc)?\.pyi?$|[._]pb\.(?:go|js|ts|cc|h|rb|dart|swift)$|_pb\.js$|_grpc\.pb\.go$|[._](?:generated|gen|autogen|g)\.[a-z]+$|^zz_generated|_bindgen\.rs$|\.designer\.cs$|\.freezed\.dart$"
)
MINIFIED_NAMES = re.compile(r"[.-]min\.(?:m?js|css)$|\.(?:bundle|chunk)(?:\.[0-9a-z]+)?\.(?:m?js|css)$")
LOCK_NAMES = frozenset(
    "package-lock.json npm-shrinkwrap.json composer.lock composer.lock.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock pipfile.lock pdm.lock uv.lock gemfile.lock go.sum mix.lock flake.lock packages.lock.json podfile.lock bun.lock".split()
)
LOCK_SUFFIX = re.compile(r"[-.]lock(?:\.(?:json|ya?ml|toml))?$")
GENERATED_HEADER = re.compile(
    r"^(?:code |file |source )?generated (?:by|from|on|with|at|using|automatically)\b|^auto-?generated\b|^@generated\b|^<auto-?generated|^[^.;]{0,60}\bdo not (?:edit|modify|change|touch)\b"
    r"|\. do not edit\b|\bdon't (?:touch|edit|modify)\b|^(?:this file (?:was|is|has been) )?(?:automatically|auto-?)\s?(?:created|generated|produced|built|written|emitted)\b"
    r"|^this (?:file|code|source) (?:was|is|has been) (?:produced|generated|created|emitted|written|built) (?:by|from|with)\b|\bto regenerate\b|^machine[- ](?:written|generated|made)\b"
    r"|\bedits will be (?:overwritten|lost)\b|\bchanges (?:are|will be) (?:lost|overwritten)\b",
    re.I,
)
VENDOR_HEADER = re.compile(
    r"\bupstream (?:release|archive|sources?|version)\b|\bsend (?:fixes|patches) upstream\b|\bthird[- ]party\)|^this is an external component\b|\bredistributed from\b|^@license \S+ v?\d"
    r"|\bvendored (?:from|copy)\b|\bcopied (?:unchanged|verbatim) from\b|^imported from \S+ (?:release|version|v?\d)|^local copy of \S+\d",
    re.I,
)
_LINE = re.compile(r"[ \t\f\r﻿]*(//+!?|#+!?|--|;+|%|\*+/?|/\*+!?|<!--|\"\"\"|''')?(.*)")
_SPACES = re.compile(r"\s+")


def opening_comments(text: str) -> list[str]:
    """The lines of the comments before the first code line, without their marks."""
    out, block = [], ""
    pos, n = 0, len(text)
    while pos < n:
        end = text.find("\n", pos)
        end = n if end < 0 else end
        line = text[pos:end]
        pos = end + 1
        bare = line.strip().lstrip("﻿")
        if not bare:
            continue
        if block:
            head, stop, _ = bare.partition(block)
            out.append(head.lstrip("*").strip())
            if stop:
                block = ""
            continue
        mark = _LINE.match(bare)[1] or ""
        if mark.startswith("/*"):
            head, stop, _ = bare[len(mark) :].partition("*/")
            out.append(head.strip())
            if not stop:
                block = "*/"
            elif _.strip():
                break
        elif mark == "<!--":
            head, stop, _ = bare[4:].partition("-->")
            out.append(head.strip())
            block = "" if stop else "-->"
        elif mark in ('"""', "'''"):
            head, stop, _ = bare[3:].partition(mark)
            out.append(head.strip())
            block = "" if stop else mark
        elif mark.startswith(("//", "#")) and not bare.startswith(("#[", "#![", "#include", "#define")) or mark and mark[0] in ";%" or mark == "--":
            out.append(bare[len(mark) :].strip())
        else:
            break
    return out


def literal_share(text: str, lang: str | None) -> float:
    """Share of literals and the commas between them among the characters outside comments and documentation.

    0 for languages without a lexer, for JSON (which is data by its nature) and for a text that is
    one bracketed value and no declaration, such as a configuration under a wrong name.
    """
    lang_ = language(lang)
    if lang_ is None or lang.strip().lower() == "json" or text.lstrip()[:1] in ("{", ""):
        return 0.0
    string, number, char = (lang_.grammar.kind.get(k) for k in ("STR", "NUM", "CHAR"))
    kinds, data, total, fresh = lang_.kinds, 0, 0, True
    for s in lang_.find(text):
        k = kinds[s]
        if k.__class__ is tuple or k == -1 or k == -2:
            fresh = fresh or k.__class__ is tuple or k == -2
            continue
        if fresh and s[:3] in ('"""', "'''"):
            continue  # a text in place of a comment
        fresh = False
        total += len(s)
        if k is not None and k in (string, number, char) or s in (",", "-"):
            data += len(s)
    return data / total if total else 0.0


def is_minified(text: str) -> bool:
    """Whether a script was compacted: nearly all of it on very long lines with hardly any white space."""
    n = len(text)
    if not n:
        return False
    long = sum(len(line) for line in text.split("\n") if len(line) > 300)
    return long >= 0.6 * n and len(_SPACES.findall(text)) <= 0.08 * n


def classify(path: str | None, lang: str | None, text: str | None) -> str | None:
    """``generated``, ``minified``, ``vendored`` or ``data``, or None for what looks hand-written.

    A null path has no name rules, a null text only them.  The first rule that fits counts, in the
    order generated, minified, vendored, data.
    """
    parts = (path or "").replace("\\", "/").lstrip("./").split("/")
    name, dirs = parts[-1].lower(), [p.lower() for p in parts[:-1]]
    root = dirs[0] if dirs else ""
    if name in LOCK_NAMES or LOCK_SUFFIX.search(name) or GENERATED_NAMES.search(name) or GENERATED_DIRS.intersection(dirs) or root in ROOT_GENERATED_DIRS or OUTPUT_PATHS.search((path or "").lower()):
        return "generated"
    heads = opening_comments(text) if text else []
    if any(GENERATED_HEADER.search(h) for h in heads):
        return "generated"
    if MINIFIED_NAMES.search(name):
        return "minified"
    script = (lang or "").strip().lower() in ("javascript", "typescript", "css")
    if text and script and is_minified(text):
        return "minified"
    if VENDOR_DIRS.intersection(dirs) or root in ROOT_VENDOR_DIRS and len(dirs) > 1 or any(VENDOR_HEADER.search(h) for h in heads):
        return "vendored"
    if text and literal_share(text, lang) >= 0.75:
        return "data"
    return None


def classify_files(files: DataFrame, keep: tuple[str, ...], path: str = "relative_path", lang: str = "language", content: str = "content") -> DataFrame:
    """The ``keep`` columns with ``origin`` (null: hand-written by its own looks), ``fingerprint`` and ``solid``.

    ``fingerprint`` hashes the text without its opening comments and white space (null for a null
    text), so that copies of a package under different headers stay equal; ``solid`` says that what
    is left is code, neither blank nor prose.  Works where the rows are read, on whole texts,
    without a shuffle.
    """
    rows = files.select(*[F.col(f"`{c}`") for c in keep], F.col(path).alias("_path"), F.col(lang).alias("_lang"), F.col(content).alias("_text"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            origin, prints, solid = [], [], []
            for p, g, t in zip(b["_path"], b["_lang"], b["_text"], strict=True):
                origin.append(classify(p, g, t))
                body = "" if t is None else _body(t)
                prints.append(None if t is None else xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63))
                solid.append(body != "" and (g or "").strip().lower() not in PROSE)
            yield b[list(keep)].assign(origin=pd.Series(origin, dtype=object, index=b.index), fingerprint=pd.Series(prints, dtype="Int64", index=b.index), solid=solid)

    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("origin", "string").add("fingerprint", "long").add("solid", "boolean")
    return map_frames(rows, look, schema)


def _body(text: str) -> str:
    """The text from its first code line on, white space squeezed."""
    lines = text.split("\n")
    at, block = 0, False
    for at, line in enumerate(lines):  # noqa: B007
        bare = line.strip()
        if block:
            block = "*/" not in bare
        elif bare.startswith("/*"):
            block = "*/" not in bare
        elif bare and not bare.startswith(("//", "# ", "#!")) and bare != "#":
            break
    return _SPACES.sub(" ", "\n".join(lines[at:])).strip()


def merkle_trees(files: DataFrame, project: str = "project_id", path: str = "relative_path", fingerprint: str = "fingerprint", solid: str | None = None) -> DataFrame:
    """Merkle hashes of all directories: ``project_id, dir, files, solid, hash``.

    A directory's hash covers the names and hashes of its subdirectories and the fingerprints of
    its files (not their names, which copies may change).  It is a sum of hashes, so the children
    of a directory are combined before the shuffle however many they are.  Levels are done from
    the deepest up, one small shuffle each.  Files without fingerprint count by their path, so
    they never make two trees equal; rows with a null project or path are left out.  ``solid``
    counts the files below for which the column of that name holds (all of them without one).
    """
    cuts = Cuts(files.sparkSession, "merkle")
    parts = F.split(F.regexp_replace(F.col(path), r"\\", "/"), "/")
    f = (
        files.where(F.col(project).isNotNull() & F.col(path).isNotNull())
        .select(
            F.col(project).alias("project_id"),
            parts.alias("parts"),
            F.coalesce(F.col(fingerprint), F.xxhash64(F.lit("unread"), F.col(project), F.col(path))).alias("h"),
            (F.col(solid) if solid else F.lit(True)).cast("long").alias("one"),
        )
        .select("project_id", F.expr("slice(parts, 1, size(parts) - 1)").alias("dirs"), "h", "one")
    )
    nodes = cuts.cut(f.groupBy("project_id", "dirs").agg(F.count("*").alias("files"), F.sum("one").alias("solid"), F.sum(_wrap("h")).alias("s")))
    deepest = nodes.agg(F.max(F.size("dirs"))).first()[0] or 0
    levels, below = [], None
    for depth in range(deepest, 0, -1):
        here = nodes.where(F.size("dirs") == depth).select("project_id", "dirs", "files", "solid", "s")
        if below is not None:
            up = below.select("project_id", F.expr("slice(dirs, 1, size(dirs) - 1)").alias("dirs"), "files", "solid", _wrap(F.xxhash64(F.element_at("dirs", -1), "hash")).alias("s"))
            here = here.unionByName(up)
        below = cuts.cut(here.groupBy("project_id", "dirs").agg(F.sum("files").alias("files"), F.sum("solid").alias("solid"), F.xxhash64(F.sum("s"), F.sum("files")).alias("hash")))
        levels.append(below)
    if not levels:
        return nodes.select("project_id", F.array_join("dirs", "/").alias("dir"), "files", "solid", F.xxhash64("s").alias("hash")).where("dir <> ''")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("project_id", F.array_join("dirs", "/").alias("dir"), "files", "solid", "hash")


def _wrap(h) -> F.Column:
    """A hash as a summand that cannot overflow when many are added."""
    return (h if not isinstance(h, str) else F.col(h)).cast("decimal(20,0)")


def shared_subtrees(trees: DataFrame, projects: DataFrame) -> DataFrame:
    """Directories whose whole contents lie in at least two unrelated repositories.

    Projects are related if they have the same root commits (null: unrelated to any other), so forks
    and what was made from one template prove nothing, and neither do trees without a ``solid`` file.
    Returns ``project_id, dir, hash, files, repositories``.
    """
    alone = F.concat(F.lit("project "), F.col("project_id").cast("string"))
    repo = projects.groupBy("project_id").agg(F.max("git_root_commits").alias("root")).select("project_id", F.coalesce("root", alone).alias("repo"))
    t = trees.where("solid > 0").join(repo, "project_id", "left").withColumn("repo", F.coalesce("repo", alone))
    groups = t.groupBy("hash", "files").agg(F.countDistinct("repo").alias("repositories")).where("repositories >= 2")
    return t.join(groups, ["hash", "files"]).select("project_id", "dir", "hash", "files", "repositories")


def flag_not_handwritten(files: DataFrame, projects: DataFrame, key: str = "file_id", by: str = "indexed_at", copy_of: str = "duplicate_of_file_id") -> DataFrame:
    """Every current file with ``origin`` and ``shared_by``: ``file_id, project_id, relative_path, language, origin, shared_by``.

    Of rows with one file_id the one with the latest ``indexed_at`` is current.  A file below a
    directory that ``shared_by`` unrelated repositories hold (:func:`shared_subtrees`) is
    ``vendored``; for the others the verdict of :func:`classify` counts, which comes first for
    generated and compacted files.  Files that the index itself names as copies of another file
    (``copy_of`` not null, where there is that column) do not take part in the trees, as an exact
    copy of a hand-written file is hand-written.  ``shared_by`` is 0 for all others.
    """
    from ..sources.tables import latest

    cuts = Cuts(files.sparkSession, "origin")
    extra = (copy_of,) if copy_of in files.columns else ()
    looked = classify_files(files.where(F.col(key).isNotNull()), (key, "project_id", "relative_path", "language", by, *extra))
    now = cuts.cut(latest(looked, key, by))
    own = now.where(F.col(copy_of).isNull()) if extra else now
    shared = cuts.cut(shared_subtrees(merkle_trees(own, solid="solid"), projects))
    above = F.expr("transform(sequence(1, greatest(size(parts) - 1, 1)), i -> array_join(slice(parts, 1, i), '/'))")
    places = own.where("project_id is not null").select(F.col(key).alias("k"), F.col("project_id").alias("p"), F.split(F.regexp_replace("relative_path", r"\\", "/"), "/").alias("parts")).where("size(parts) > 1")
    hit = (
        places.select("k", "p", F.explode(above).alias("d"))
        .join(shared.select(F.col("project_id").alias("p"), F.col("dir").alias("d"), "repositories"), ["p", "d"])
        .groupBy("k")
        .agg(F.max("repositories").alias("shared_by"))
    )
    vendored = F.when(F.col("shared_by").isNotNull() & ~F.coalesce(F.col("origin").isin("generated", "minified"), F.lit(False)), F.lit("vendored"))
    return now.join(hit, F.col(key) == F.col("k"), "left").select(
        key, "project_id", "relative_path", "language", F.coalesce(vendored, "origin").alias("origin"), F.coalesce("shared_by", F.lit(0)).alias("shared_by")
    )
