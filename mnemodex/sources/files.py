"""Project trees as tables: scan with ignore rules, manifests of dependencies."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are never read.
IGNORED_FOLDERS = """
.angular .astro .build .bundle .cache .cmake .dart_tool .eggs .expo .git .gradle .hg .hypothesis .idea .ipynb_checkpoints .mvn .mypy_cache .next .nox .npm .nuxt
.parcel-cache .pnpm-store .pytest_cache .rollup.cache .ruff_cache .serverless .svelte-kit .svn .swiftpm .tox .turbo .venv .vercel .vite .vs .yarn .zig-cache
__pycache__ bower_components build cmake-build-debug cmake-build-release cmakefiles coverage deriveddata dist eggs htmlcov jspm_packages node_modules obj out
pip-wheel-metadata site-packages storybook-static target testresults vendor venv zig-cache zig-out
""".split()
IGNORED_FILES = ".coverage .ds_store .env coverage.xml memory.sqlite npm-debug.log pnpm-debug.log project.assets.json yarn-debug.log yarn-error.log".split()
GENERATED_FRAGMENTS = ["/__generated__/", "/build/generated/", "/gen/", "/generated-sources/", "/generated/", "/target/generated-sources/", "/vendor/"]
GENERATED_ENDINGS = [".freezed.dart", ".g.dart", ".grpc.pb.cc", ".grpc.pb.go", ".map", ".pb.cc", ".pb.go", ".pb.h", ".pb.swift"]
MINIFIED_ENDINGS = [".min.cjs", ".min.css", ".min.js", ".min.mjs"]
LOCK_FILES = """
bun.lock bun.lockb cargo.lock composer.lock gemfile.lock go.sum gradle.lockfile npm-shrinkwrap.json package-lock.json package.resolved packages.lock.json pipfile.lock
pnpm-lock.yaml poetry.lock pubspec.lock uv.lock yarn.lock
""".split()
SECRET_FILES = [".envrc", ".netrc", ".npmrc", ".pypirc", ".sentryclirc", ".yarnrc", ".yarnrc.yml"]
SECRET_ENDINGS = ["der", "key", "p12", "pem", "pfx"]
BINARY_ENDINGS = """
7z a avif bin bmp bz2 cer class crt d db db-shm db-wal der dll doc docx dsym dylib ear exe flac gif gz heic heif ico jar jpeg jpg key la lib lo m4a mkv mov mp3 mp4 nupkg o obj otf
pdb pdf pem pfx png ppt pptx pyc pyo rar rlib so sqlite sqlite3 tar test tgz tif tiff ttf war wasm wav webp woff woff2 xls xlsx xz zip zst
""".split()
#: Folders that a tree is split into for its tasks, rows of a listing and bytes of contents that a task holds at a time.
SPREAD, BATCH, HELD = 256, 10_000, 8 << 20


def _listed(path: Column, lines: list[str], negation: bool) -> Column:
    """Whether the lines of an ignore file list a path; the last line that fits wins."""
    out, parts = F.lit(False), F.split(path, "/")
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        negated = negation and line.startswith("!")
        raw = line[1:] if negated else line
        pattern, rooted = raw.strip("/"), raw.startswith("/") or "/" in raw.strip("/")
        if not pattern:
            continue
        if "*" in pattern and not raw.endswith("/"):
            body = "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern) + "$"
            fits = path.rlike(body) if rooted else F.exists(parts, lambda p: p.rlike(body))  # noqa: B023
        elif rooted:
            fits = (path == pattern) | path.startswith(pattern + "/")
        else:
            fits = F.array_contains(parts, pattern)
        out = F.when(fits, F.lit(not negated)).otherwise(out)
    return out


def skip_reason(path: Column, patterns: list[str] = (), own: list[str] = ()) -> Column:
    """Why a path is not read, or null; the first rule that fits. ``patterns`` are lines of the repository's ignore file, ``own`` of the project's, without negation."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    ending = F.regexp_extract(name, r".\.([^.]+)$", 1)
    ends = lambda endings: reduce(or_, [name.endswith(x) for x in endings])
    rule = (
        F.when(F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in IGNORED_FOLDERS])), "hard_directory")
        .when(reduce(or_, [F.contains(low, F.lit(x)) for x in GENERATED_FRAGMENTS]) | ends(GENERATED_ENDINGS), "generated")
        .when(ends(MINIFIED_ENDINGS), "minified")
        .when(name.isin(LOCK_FILES), "lockfile")
        .when((name == ".env") | name.startswith(".env.") | name.isin(SECRET_FILES), "secret")
        .when(name.isin(IGNORED_FILES), "ignored_file")
        .when(ending.isin(SECRET_ENDINGS), "secret")
        .when(ending.isin(BINARY_ENDINGS), "binary")
        .when(_listed(path, list(patterns), True), "vcs_ignore")
        .when(_listed(path, list(own), False), "project_ignore")
    )
    return rule


def _place(root: str):
    """The file system of a folder and its path there; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


def _entries(system, folder: str) -> tuple[list, list]:
    """The folders and the files right in a folder. Linked folders of a local tree are not followed, so a tree has no circles."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    local = isinstance(system, fs.LocalFileSystem)
    folders = [e for e in found if e.type == fs.FileType.Directory and not (local and os.path.islink(e.path))]
    return folders, [e for e in found if e.type == fs.FileType.File]


def _ignored(folder) -> bool:
    return folder.base_name.lower() in IGNORED_FOLDERS


def listing(spark: SparkSession, root: str, patterns: list[str] = (), own: list[str] = ()) -> DataFrame:
    """(path, size, mtime, reason) of all files under ``root``, without their content; reason is null for those to be read. An ignored folder is one row and isn't entered.

    The driver looks at folders level by level until there are ``SPREAD``; tasks list what is below, each row as it is found. A folder that isn't there has no rows.
    """
    system, top = _place(root)
    units, level = [], [top]
    while level and len(level) < SPREAD:
        units += [(folder, False) for folder in level]
        level = [f.path for folder in level for f in _entries(system, folder)[0] if not _ignored(f)]
    units += [(folder, True) for folder in level]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_system, above = _place(root)
        rows: list[tuple] = []
        made = lambda: pd.DataFrame(rows, columns=["path", "size", "mtime"])
        for batch in batches:
            for start, deep in zip(batch["folder"], batch["deep"]):
                open_ = [start]
                while open_:
                    folders, found = _entries(own_system, open_.pop())
                    open_ += [f.path for f in folders if deep and not _ignored(f)]
                    for e in [f for f in folders if _ignored(f)] + found:
                        rows.append((e.path[len(above.rstrip("/")) + 1 :], e.size or 0, e.mtime_ns // 1_000_000 if e.mtime_ns is not None else 0))
                        if len(rows) == BATCH:
                            yield made()
                            rows.clear()
        yield made()

    found = spark.createDataFrame(units, "folder string, deep boolean").repartition(min(len(units), SPREAD)).mapInPandas(walk, "path string, size long, mtime long")
    return found.withColumn("reason", skip_reason(F.col("path"), patterns, own))


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the listed ``paths`` (path) under ``root``: only these files are opened, by the tasks that have their paths. Files that are gone since have no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _place(root)
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as file:
                        body = file.read()
                except FileNotFoundError:
                    continue
                rows.append((path, body))
                held += len(body)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "content"])

    return paths.select("path").distinct().mapInPandas(read, "path string, content binary")


def ignore_patterns(root: str) -> tuple[list[str], list[str]]:
    """The lines of a project's ignore files, ``.gitignore`` and ``.mnemodexignore``; either may be missing."""
    system, top = _place(root)

    def lines(name: str) -> list[str]:
        try:
            with system.open_input_stream(f"{top.rstrip('/')}/{name}") as file:
                return file.read().decode("utf-8").splitlines()
        except FileNotFoundError:
            return []

    return lines(".gitignore"), lines(".mnemodexignore")


def diagnostics(scanned: DataFrame) -> DataFrame:
    """(reason, entries): a skipped folder counts once, whatever it holds; read files count as ``read``."""
    parts = F.split("path", "/")
    depth = F.array_position(F.transform(parts, lambda p: F.lower(p).isin(IGNORED_FOLDERS).cast("int")), 1)
    entry = F.when(F.col("reason") == "hard_directory", F.array_join(F.slice(parts, F.lit(1), depth.cast("int")), "/")).otherwise(F.col("path"))
    return scanned.groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.countDistinct(entry).alias("entries"))


#: Names, in lower case, that ``parse_manifest`` knows, besides those that end in .csproj.
MANIFESTS = ["package.json", "composer.json", "pyproject.toml", "cargo.toml", "requirements.txt", "go.mod", "pubspec.yaml", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile", "package.swift"]


def parse_manifest(path: str, body: str) -> dict:
    """(name, dependencies, scripts) that a package's manifest declares; what can't be parsed declares nothing."""
    file, name, deps, scripts = path.rsplit("/", 1)[-1].lower(), None, [], []
    try:
        if file in ("package.json", "composer.json"):
            data = json.loads(body)
            name = data.get("name")
            groups = ("dependencies", "devDependencies", "peerDependencies") if file == "package.json" else ("require", "require-dev")
            deps, scripts = [d for g in groups for d in data.get(g) or {}], list(data.get("scripts") or {})
        elif file in ("pyproject.toml", "cargo.toml"):
            data = tomllib.loads(body)
            head = data.get("project") or data.get("package") or (data.get("tool") or {}).get("poetry") or {}
            name = head.get("name")
            declared = head.get("dependencies") or data.get("dependencies") or []
            deps = [re.split(r"[\s<>=!~\[;]", d)[0] for d in declared] if isinstance(declared, list) else [d for d in declared if d != "python"]
            scripts = list(head.get("scripts") or {})
        elif file == "requirements.txt":
            deps = [m[0] for m in re.findall(r"(?m)^\s*([A-Za-z0-9_.-]+)\s*(\[[^\]]*\])?\s*(?:[<>=!~;]|$)", body)]
        elif file == "go.mod":
            name = (re.findall(r"(?m)^module\s+(\S+)", body) or [None])[0]
            deps = re.findall(r"(?m)^(?:require)?\s+([a-z0-9.-]+\.[a-z]+/\S+)\s+v", body)
        elif file == "pubspec.yaml":
            name = (re.findall(r"(?m)^name:\s*(\S+)", body) or [None])[0]
            block = re.findall(r"(?ms)^(?:dev_)?dependencies:\s*\n((?:[ \t]+[^\n]*\n?)*)", body)
            deps = [d for b in block for d in re.findall(r"(?m)^ {2}([A-Za-z0-9_]+):", b)]
        elif file == "pom.xml":
            name = (re.findall(r"<artifactId>([^<]+)</artifactId>", re.sub(r"(?s)<(dependencies|parent)>.*?</\1>", "", body)) or [None])[0]
            deps = [a for block in re.findall(r"(?s)<dependency>(.*?)</dependency>", body) for a in re.findall(r"<artifactId>([^<]+)", block)]
        elif file in ("build.gradle", "build.gradle.kts"):
            deps = re.findall(r"(?:implementation|api|compileOnly|testImplementation)[ (]+[\"']([^\"']+)", body)
        elif file == "gemfile":
            deps = re.findall(r"(?m)^\s*gem\s+[\"']([^\"']+)", body)
        elif file == "package.swift":
            name = (re.findall(r"Package\(\s*name:\s*\"([^\"]+)", body) or [None])[0]
            deps = re.findall(r"\.package\([^)]*url:\s*\"([^\"]+)", body)
        elif file.endswith(".csproj"):
            name, deps = path.rsplit("/", 1)[-1][:-7], re.findall(r"<PackageReference\s+Include=\"([^\"]+)", body)
    except (ValueError, AttributeError, TypeError):
        pass
    return {"name": name, "dependencies": sorted(set(map(str, deps))), "scripts": scripts}


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, dependencies, scripts) of the manifests among ``files`` (path, text)."""
    @F.pandas_udf("name string, dependencies array<string>, scripts array<string>")
    def parse(path: pd.Series, body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_manifest(p, b or "") for p, b in zip(path, body)], columns=["name", "dependencies", "scripts"])

    name = F.lower(F.substring_index("path", "/", -1))
    chosen = files.filter(name.isin(MANIFESTS) | name.endswith(".csproj"))
    return chosen.withColumn("m", parse("path", "text")).select("path", "m.*")
