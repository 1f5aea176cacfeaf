"""Where sources come from: configuration, work spaces, file trees, git."""

from __future__ import annotations

import json
import os
import re
import subprocess
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.extract import EXTENSIONS, IGNORED, scan_sources
from codelode.operators.maintenance import content_hash
from codelode.session import shared_folder

#: A project's own file, looked for in a folder and those above it.
CONFIG_NAME = ".codelode.json"


@dataclass
class Project:
    name: str
    roots: list[str]
    include: list[str] = field(default_factory=list)


class Catalog:
    """Projects by name, one of them active; kept in a JSON file if one is given."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.projects, self.active = path, {}, None
        if path and os.path.exists(path):
            stored = json.loads(Path(path).read_text())
            self.projects = {p["name"]: Project(**p) for p in stored["projects"]}
            self.active = stored.get("active")

    def add(self, project: Project) -> None:
        self.projects[project.name] = project
        self.active = project.name
        self._save()

    def switch(self, name: str) -> Project:
        if name not in self.projects:
            raise KeyError(f"no project {name}; there are: {', '.join(sorted(self.projects)) or 'none'}")
        self.active = name
        self._save()
        return self.projects[name]

    def for_folder(self, folder: str) -> Project | None:
        """The project whose root is the longest that holds the folder."""
        held = [(len(r), p.name) for p in self.projects.values() for r in p.roots if (folder + "/").startswith(r.rstrip("/") + "/")]
        return self.projects[max(held)[1]] if held else None

    def _save(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps({"projects": [vars(p) for p in self.projects.values()], "active": self.active}, indent=1))


def find_config(folder: str) -> Project | None:
    """The nearest configuration in the folder or above it."""
    for place in [Path(folder), *Path(folder).parents]:
        if (place / CONFIG_NAME).is_file():
            c = json.loads((place / CONFIG_NAME).read_text())
            return Project(c.get("name", place.name), [str(place / r) for r in c.get("roots", ["."])], c.get("include", []))
    return None


def workspaces(root: str) -> list[str]:
    """Package folders that a monorepo's own files name; the first kind of file that is there decides. Trailing /* is dropped."""
    r = Path(root)

    def read(name: str) -> str:
        return (r / name).read_text() if (r / name).is_file() else ""

    def listed(value: object) -> list[str]:
        return list(value.get("packages", [])) if isinstance(value, dict) else list(value or [])

    named: list[str] = []
    if text := read("pnpm-workspace.yaml"):
        named = re.findall(r"^\s*-\s*['\"]?([^'\"#\n]+?)['\"]?\s*$", text, re.M)
    elif text := read("lerna.json"):
        named = listed(json.loads(text).get("packages"))
    elif text := read("nx.json"):
        named = [v for v in json.loads(text).get("workspaceLayout", {"appsDir": "apps", "libsDir": "libs"}).values()]
    elif text := read("go.work"):
        named = [x for b in re.findall(r"use\s*\(([^)]*)\)", text) for x in b.split()] + re.findall(r"^use\s+([^(\s]+)\s*$", text, re.M)
    elif "[workspace]" in (text := read("Cargo.toml")):
        named = re.findall(r"['\"]([^'\"]+)['\"]", (re.search(r"members\s*=\s*\[([^\]]*)\]", text) or [None, ""])[1])
    elif text := read("package.json"):
        named = listed(json.loads(text).get("workspaces"))
    return [str((r / re.sub(r"/\*+$", "", n.removeprefix("./"))).resolve()) for n in named if not n.startswith("!")]


def scan_tree(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(file, content, hash) of the source files below the roots, each path once, ignored directories left out."""
    endings = ",".join(e[1:] for group in EXTENSIONS.values() for e in group)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").load([f"file://{r}" if r.startswith("/") else r for r in roots])
    path = F.regexp_replace("path", r"^file:/*", "/")
    return raw.select(path.alias("file"), F.col("content").cast("string").alias("content")).where(~path.rlike(IGNORED)).dropDuplicates(["file"]).withColumn("hash", content_hash(F.col("content")))


def index_tree(spark: SparkSession, roots: list[str], known: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols, references and imports of a tree; with ``known`` (path, hash) only of files that are new or changed, judged before they are parsed."""
    scanned = scan_tree(spark, roots)
    if known is not None:
        scanned = scanned.join(known.select(F.col("path").alias("file"), "hash"), ["file", "hash"], "left_anti")
    return {"files": scanned.select(F.col("file").alias("path"), "hash"), **scan_sources(scanned.select("file", "content"))}


def git_diff(spark: SparkSession, folder: str, ref: str = "unstaged") -> DataFrame:
    """(diff_id, diff_text) of a work tree: ``staged``, ``unstaged`` or against a ref; a row per file, of any length and number.

    Git runs on the driver with an argument list, never by a shell, and writes to the
    shared folder, from which Spark reads. diff_id is the ref and the file's old path.
    """
    if ref in ("staged", "unstaged"):
        args = ["--staged"] if ref == "staged" else []
    else:
        if not re.fullmatch(r"[\w.~^@/{}][\w.~^@/{}-]*", ref):
            raise ValueError(f"not a git ref: {ref}")
        args = [ref]
    place = f"{shared_folder(spark)}/diff-{uuid.uuid4().hex}"
    os.makedirs(place)
    with open(f"{place}/diff.txt", "wb") as out:
        subprocess.run(["git", "-C", folder, "diff", *args, "--"], stdout=out, check=True)
    # Cut into sections as Spark reads it, so that neither the driver nor one row holds the whole.
    raw = spark.read.option("lineSep", "\ndiff --git ").text(f"{place}/diff.txt").where(F.col("value") != "")
    head = F.when(F.col("value").startswith("diff --git "), F.col("value")).otherwise(F.concat(F.lit("diff --git "), F.col("value")))
    new = F.regexp_extract(head, r"^diff --git a/(.*) b/", 1)
    return raw.select(F.concat(F.lit(f"{ref}:"), new).alias("diff_id"), head.alias("diff_text"))
