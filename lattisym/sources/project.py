"""Projects on disk: root, discovery, reading.

Listing is a driver task over paths only; contents are read by Spark's binaryFile source in parallel.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import supported_extensions

# Files that mark a project's root, and directories that are never read.
ROOT_MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "go.mod", "tsconfig.json", "package.json", ".git")
SKIPPED = ("venv", ".venv", "__pycache__", ".git", "node_modules", ".lattisym", ".pytest_cache")


def find_project_root(start: str | Path) -> Path:
    """The nearest directory at or above start that holds a marker; else FileNotFoundError."""
    here = Path(start).resolve()
    for place in (here, *here.parents):
        if any((place / m).exists() for m in ROOT_MARKERS):
            return place
    raise FileNotFoundError(f"no project root at or above {start}; looked for {', '.join(ROOT_MARKERS)}")


class IgnoreRules:
    """Patterns of a .gitignore file: the last one that matches a path or one of its directories decides."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((keep, only_dirs, re.compile(("" if anchored else "(?:.*/)?") + self._regex(line.lstrip("/")) + r"\Z", re.S)))

    @staticmethod
    def _regex(pattern: str) -> str:
        out = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[!?[^\]]+\])", pattern):
            if part == "**/":
                out += "(?:.*/)?"
            elif part == "/**":
                out += "/.*"
            elif part == "*":
                out += "[^/]*"
            elif part == "?":
                out += "[^/]"
            elif part.startswith("[") and part.endswith("]"):
                out += "[" + ("^" + part[2:] if part.startswith("[!") else part[1:])
            else:
                out += re.escape(re.sub(r"\\(.)", r"\1", part))
        return out

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            verdict = False
            for keep, only_dirs, rule in self.rules:
                if (k < len(parts) or not only_dirs) and rule.match("/".join(parts[:k])):
                    verdict = not keep
            if verdict:
                return True
        return False


def discover(root: str | Path, timeout: int = 30) -> list[str]:
    """Sorted relative paths of a project's source files: those that git tracks, or else all that .gitignore leaves."""
    root = Path(root)
    try:
        listed = subprocess.run(["git", "-C", str(root), "ls-files", "--cached", "--exclude-standard", "-z"], capture_output=True, timeout=timeout, check=True)
        paths = [p for p in listed.stdout.decode("utf-8", "replace").split("\0") if p]
    except (OSError, subprocess.SubprocessError):
        rules = IgnoreRules((root / ".gitignore").read_text().splitlines() if (root / ".gitignore").exists() else [])
        paths = [p for x in root.rglob("*") if not rules.ignores(p := x.relative_to(root).as_posix())]
    wanted = tuple(supported_extensions())
    return sorted(p for p in paths if p.endswith(wanted) and not set(p.split("/")) & set(SKIPPED) and (root / p).is_file())


def read_sources(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """(file_path, source) of a project's files; undecodable bytes become U+FFFD, files that are gone are skipped."""
    root = Path(root).resolve()
    paths = discover(root) if paths is None else paths
    if not paths:
        return spark.createDataFrame([], "file_path string, source string")
    rows = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([(root / p).as_uri() for p in paths if (root / p).is_file()])
    return rows.select(_relative(root), F.col("content").cast("string").alias("source"))


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, source) of all source files below a folder of any file system; selection is by columns, so it needs no listing on the driver."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x[1:] for x in supported_extensions()) + "}").load(folder)
    relative = F.regexp_replace("path", "^.*?" + re.escape(folder.split("://")[-1].rstrip("/")) + "/", "")
    rows = rows.withColumn("file_path", relative)
    return rows.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, SKIPPED)))).select("file_path", F.col("content").cast("string").alias("source"))


def _relative(root: Path):
    prefix = root.as_uri().removeprefix("file://").rstrip("/") + "/"
    return F.try_url_decode(F.regexp_replace(F.substring_index("path", prefix, -1), r"\+", "%2B")).alias("file_path")

