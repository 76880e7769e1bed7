"""Files on disk as a DataFrame, found as the reference search finds them.

Roots are classified, duplicates and overlaps pruned, and directories walked on the driver
(names only); contents are read by the executors, so the roots must be on storage that all
of them see. Spark's own file listing is not used: it leaves out empty files and names that
begin with a dot or underscore.

Ignore files: .ignore anywhere, and .gitignore and .git/info/exclude inside a git working
tree, from the root and its parents down; the user's global git excludes are read if
core.excludesFile's default path exists. Later and deeper rules win.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linequarry.functions.shipping import ship
from linequarry.operators.lines import BINARY_PROBE


@dataclass
class Roots:
    """Effective roots and what was pruned on the way."""

    files: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    input_roots: int = 0
    pruned_roots: int = 0
    overlap_pruned_roots: int = 0

    @property
    def effective_roots(self) -> int:
        return len(self.files) + len(self.directories)


def normalise(roots: list[str]) -> Roots:
    """A root equal to an earlier one goes, and one under a directory root, in whatever order. What isn't a file counts as a directory."""
    out, seen = Roots(input_roots=len(roots)), []
    for r in roots:
        real = os.path.realpath(r)
        if any(real == s for _, s, _ in seen):
            out.pruned_roots += 1
        else:
            seen.append((r, real, os.path.isfile(r)))
    above = [s for _, s, is_file in seen if not is_file]
    for r, real, is_file in seen:
        if any(real != d and real.startswith(d.rstrip("/") + "/") for d in above):
            out.pruned_roots += 1
            out.overlap_pruned_roots += 1
        else:
            (out.files if is_file else out.directories).append(r)
    return out


def pruned_frame(roots: DataFrame) -> DataFrame:
    """The same pruning for roots in a DataFrame (canonical, is_file, index): one row per root that stays."""
    first = roots.groupBy("canonical").agg(F.min(F.struct("index", "is_file")).alias("r")).select("canonical", "r.*")
    parts = F.split(F.regexp_replace("canonical", "/+$", ""), "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")
    dirs = first.where("NOT is_file").select(F.regexp_replace("canonical", "/+$", "").alias("dir"))
    under = first.where(F.size(parts) > 1).select("canonical", above).join(dirs, "dir").select("canonical").distinct()
    return first.join(under, "canonical", "left_anti")


class Rules:
    """The patterns of one ignore file."""

    def __init__(self, base: str, text: str):
        self.base, self.rules = base, [r for r in map(self.rule, text.splitlines()) if r]

    @staticmethod
    def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            return None
        keep = line.startswith("!")
        line = line[keep:].removeprefix("\\")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        out, i, line = "", 0, line.lstrip("/")
        while i < len(line):
            if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                out, i = out + "/.+", i + 3
            elif line[i] == "*":
                while line.startswith("*", i):
                    i += 1
                out += "[^/]*"
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
                inner = line[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
            else:
                i += line[i] == "\\" and i + 1 < len(line)
                out, i = out + re.escape(line[i]), i + 1
        return re.compile((r"\A" if anchored else r"\A(?:.*/)?") + out + r"\Z", re.S), keep, only_dir

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept; None: no rule speaks."""
        own = os.path.relpath(path, self.base)
        for pattern, keep, only_dir in reversed(self.rules):
            if (is_dir or not only_dir) and pattern.match(own):
                return not keep
        return None


def read_rules(base: str, *names: str) -> list[Rules]:
    out = []
    for name in names:
        try:
            with open(os.path.join(base, name), encoding="utf-8", errors="replace") as f:
                out.append(Rules(base, f.read()))
        except OSError:
            pass
    return out


def walk(root: str, hidden: bool = False, follow_symlinks: bool = False) -> Iterator[str]:
    """Regular files below a directory, errors passed over."""
    parents, top = [], os.path.realpath(root)
    while (up := os.path.dirname(top)) != top:
        top = up
        parents.append(top)
    chain = [*reversed(parents), os.path.realpath(root)]
    start = max((i for i, d in enumerate(chain) if os.path.isdir(os.path.join(d, ".git"))), default=None)
    rules: list[Rules] = []
    if start is not None:
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        for r in read_rules(home, "git/ignore"):
            r.base = chain[start]
            rules.append(r)
    for i, d in enumerate(chain[:-1]):
        rules += read_rules(d, *([".git/info/exclude", ".gitignore"] if start is not None and i >= start else []), ".ignore")

    def below(at: str, real: str, rules: list[Rules], git: bool, above: tuple) -> Iterator[str]:
        git = git or os.path.isdir(os.path.join(real, ".git"))
        rules = rules + read_rules(real, *([".git/info/exclude", ".gitignore"] if git else []), ".ignore")
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                if (not hidden and e.name.startswith(".")) or (e.is_symlink() and not follow_symlinks):
                    continue
                is_dir, own = e.is_dir(), os.path.join(real, e.name)
                if next((v for r in reversed(rules) if (v := r.verdict(own, is_dir)) is not None), False):
                    continue
                if is_dir:
                    target = os.path.realpath(e.path)
                    if target not in above:
                        yield from below(e.path, own, rules, git, (*above, target))
                elif e.is_file():
                    yield e.path
            except OSError:
                continue

    yield from below(root, os.path.realpath(root), rules, start is not None, (os.path.realpath(root),))


@dataclass
class Discovered:
    roots: Roots
    paths: list[str]
    duplicate_paths: int
    uris: list[str] = field(default_factory=list)


def discover(roots: list[str], hidden: bool = False, follow_symlinks: bool = False) -> Discovered:
    """The files of all roots; those named directly pass by the hidden and ignore rules. Paths are told apart only between several roots. URIs are left to found_files()."""
    uris = list(dict.fromkeys(r for r in roots if is_uri(r)))
    own = normalise([r for r in roots if not is_uri(r)])
    paths = [*own.files, *(p for d in own.directories for p in walk(d, hidden, follow_symlinks))]
    unique = list(dict.fromkeys(paths)) if own.effective_roots > 1 else paths
    own.input_roots, own.directories, own.pruned_roots = len(roots), own.directories + uris, own.pruned_roots + sum(map(is_uri, roots)) - len(uris)
    return Discovered(own, unique, len(paths) - len(unique), uris)


def read_contents(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in paths:
        for path in pdf["path"]:
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield pd.DataFrame({"path": [path], "length": [len(data)], "content": [data]})


def files(spark: SparkSession, paths: list[str], per_task: int = 64) -> DataFrame:
    """path, length, content of the files that can be read."""
    ship(spark)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    spread = rows.repartition(max(1, -(-len(paths) // per_task)))
    return spread.mapInPandas(read_contents, "path string, length long, content binary")


def found_files(spark: SparkSession, found: Discovered) -> DataFrame:
    """path, length, content of all that discover() found."""
    own = files(spark, found.paths)
    return own.unionByName(stored_files(spark, found.uris)) if found.uris else own


def is_uri(root: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", root) is not None


def stored_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """path, length, content of the files below URIs of any storage that Spark reads; listed, split and read by Spark.

    Spark leaves out names that begin with a dot or an underscore, and ignore files have no say.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uris).select("path", "length", "content")


def as_text(found: DataFrame) -> DataFrame:
    """path, length, text of the files that aren't binary: UTF-8, what is invalid replaced. For search on bytes that may be invalid see byte_text()."""
    return not_binary(found).select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def byte_text(found: DataFrame) -> DataFrame:
    """path, length, text of the files that aren't binary, one character for each byte: for a plan on_bytes()."""
    return not_binary(found).select("path", "length", F.decode("content", "ISO-8859-1").alias("text"))


def not_binary(found: DataFrame) -> DataFrame:
    nul = F.position(F.lit(b"\0"), F.substring("content", 1, BINARY_PROBE)) > 0
    return found.where(~nul)


def depth(path: Column) -> Column:
    """A path's number of components."""
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def path_depth(found: DataFrame) -> DataFrame:
    """One row: the deepest path's number of components."""
    return found.agg(F.max(depth(F.col("path"))).cast("long").alias("max_depth"))


class Prepared:
    """Files discovered once and searched often, bound to their roots and options. Contents are read again by each search, and never kept."""

    def __init__(self, spark: SparkSession, roots: list[str], hidden: bool = False, follow_symlinks: bool = False):
        self.roots, self.hidden, self.follow_symlinks = list(roots), hidden, follow_symlinks
        self.found = discover(roots, hidden, follow_symlinks)
        self.files = found_files(spark, self.found)

    def for_search(self, roots: list[str], hidden: bool = False, follow_symlinks: bool = False) -> DataFrame:
        if list(roots) != self.roots:
            raise ValueError("prepared for other roots")
        if (hidden, follow_symlinks) != (self.hidden, self.follow_symlinks):
            raise ValueError("prepared with other options")
        return self.files


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line, text of large plain files, split between tasks: a line's number is its place in its block plus the lines of the blocks before."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cr = F.col("text").endswith("\r")
    text: Column = F.when(cr, F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text"))
    # Ids grow by one inside a task's read of a block.
    return raw.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), text.alias("text"))
