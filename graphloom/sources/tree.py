"""Source trees: discovery, ignore rules, languages, fingerprints, manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Path segments that are never scanned, languages by extension and by interpreter.
EXCLUDED_SEGMENTS = [".git", "vendor", "node_modules", "coverage", ".next", ".nuxt", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".stryker-tmp", "build", "dist"]
EXCLUDED_PREFIXES = ["public/build", "storage/framework"]
EXTENSIONS = {"php": "php", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "pyi": "python"}
INTERPRETERS = {"php": "php", "node": "typescript", "bun": "typescript", "deno": "typescript", "python": "python"}
MANIFESTS = {"composer.json": "composer", "package.json": "node", "pyproject.toml": "python", "requirements.txt": "python", "tsconfig.json": "typescript"}


#: One step of a glob: what it matches, and how that reads as a regular expression.
_GLOB = re.compile(r"(?P<deep>\*\*/)|(?P<all>\*\*)|(?P<some>\*)|(?P<one>\?)|\[(?P<not>[!^]?)(?P<set>\]?(?:\[:[a-z]+:\]|[^\]])*)\]|(?P<plain>.)", re.DOTALL)
_POSIX = re.compile(r"\[:([a-z]+):\]")
_POSIX_NAMES = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit"}


def _class(negated: str, body: str) -> str:
    """A character class: ranges and named classes keep their meaning, all else is literal."""
    out = []
    for i, part in enumerate(_POSIX.split(body)):
        if i % 2:
            out.append(f"\\p{{{_POSIX_NAMES[part]}}}")
        else:
            out += ["-" if c == "-" and 0 < k < len(part) - 1 else re.sub(r"([^\w\s])", r"\\\1", c) for k, c in enumerate(part)]
    return f"[{'^' if negated else ''}{''.join(out)}]"


def ignore_regex(pattern: str) -> str | None:
    """A gitignore-like pattern, without its ``!``, as a regular expression over relative paths; None for an empty one."""
    p = pattern.replace("\\", "/").strip()
    anchored = p.startswith("/") or "/" in p.strip("/")
    p = p.strip("/")
    if not p:
        return None
    if p.endswith("/**"):
        p, anchored = p[:-3], True
    step = {"deep": lambda _: "(?:.*/)?", "all": lambda _: ".*", "some": lambda _: "[^/]*", "one": lambda _: "[^/]", "plain": re.escape}
    body = "".join(_class(m["not"], m["set"]) if m["set"] else step[m.lastgroup](m[0]) for m in _GLOB.finditer(p))
    return f"^{body}(?:/.*)?$" if anchored else f"(?:^|.*/){body}(?:/.*)?$"


def ignored(path: str, patterns: list[str]) -> Column:
    """Excluded segments always hide a path; else the last pattern that matches decides, and ``!`` takes back."""
    by_user = F.lit(False)
    for p in (x.strip() for x in patterns):
        negated = p.startswith("!")
        if (regex := ignore_regex(p[1:] if negated else p)) is not None:
            by_user = F.when(F.col(path).rlike(regex), F.lit(not negated)).otherwise(by_user)
    always = F.arrays_overlap(F.split(F.col(path), "/"), F.array(*[F.lit(s) for s in EXCLUDED_SEGMENTS]))
    for p in EXCLUDED_PREFIXES:
        always = always | (F.col(path) == p) | F.col(path).startswith(p + "/")
    return always | by_user


def language(path: str, first_line: str | None = None) -> Column:
    """By extension, or by the interpreter line of a file without one."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        out = F.when(ext == e, lang).otherwise(out)
    if first_line is not None:
        for name, lang in INTERPRETERS.items():
            out = F.when((ext == "") & F.col(first_line).rlike(rf"^#!.*\b{name}"), lang).otherwise(out)
    return out


def relative_ok(path: str) -> Column:
    """A valid relative path: no empty, ``.`` or ``..`` segment, no backslash, no zero byte, not absolute."""
    return (F.col(path) != "") & ~F.exists(F.split(F.col(path), "/"), lambda s: s.isin("", ".", "..")) & ~F.col(path).contains("\\") & ~F.col(path).contains("\0")


def discover(spark: SparkSession, root: str, patterns: list[str] | None = None, max_files: int = 100_000, max_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Source files and diagnostics of a tree.

    Files: ``relative_path, language, size, mtime, content_hash, line_count, content``.  Too large a file is left
    out with a diagnostic; too many fail the call.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.concat(F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/+", "/"), F.lit("/"))
    rel = F.expr("substring(p, length(b) + 1)")
    rows = raw.withColumn("p", F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")).withColumn("b", base).withColumn("relative_path", rel).drop("p", "b").where(~ignored("relative_path", patterns or []))
    small = rows.where(F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    files = small.select("relative_path", text.alias("text"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash"))
    files = files.withColumn("first_line", F.substring_index("text", "\n", 1)).withColumn("language", language("relative_path", "first_line")).withColumn("line_count", T.line_count(F.col("text"))).where(F.col("language").isNotNull() | F.element_at(F.split("relative_path", "/"), -1).isin(*MANIFESTS)).drop("first_line")
    if files.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    told = rows.where(F.col("length") > max_bytes).select(F.lit("warning").alias("severity"), F.lit("FILE_TOO_LARGE").alias("code"), F.col("relative_path").alias("message"))
    return files, told


def input_hash(files: DataFrame) -> DataFrame:
    """One hash over sorted ``path=hash`` lines.

    Lines are hashed in groups by the first byte of the path's hash, then the 256 groups together, so no
    task sees all paths.
    """
    line = F.concat("relative_path", F.lit("="), "content_hash")
    groups = files.select(F.substring(F.md5(F.col("relative_path").cast("binary")), 1, 2).alias("g"), line.alias("line")).groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: F.concat(x["g"], F.lit("="), x["h"])), "\n"), 256).alias("input_hash"))


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if text.find("\n", i) >= 0 else n
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise ValueError("comment without end")
            i = end + 2
        elif c == "," and re.match(r"(?:\s|//[^\n]*\n|/\*.*?\*/)*[}\]]", text[i + 1 :], re.DOTALL):
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def load_jsonc(text: str) -> object:
    return json.loads(strip_jsonc(text))


def manifest_units(files: DataFrame) -> DataFrame:
    """Manifests with their kind, name, and the paths that they name as entry points: ``relative_path, kind, name, entry_points, packages``."""
    base = F.element_at(F.split("relative_path", "/"), -1)
    kind = F.lit(None).cast("string")
    for name, k in MANIFESTS.items():
        kind = F.when(base == name, k).otherwise(kind)
    rows = files.withColumn("kind", kind).where("kind is not null")
    named = F.when(F.col("kind") == "python", F.regexp_extract("text", r'(?m)^name\s*=\s*"([^"]+)"', 1)).otherwise(F.get_json_object("text", "$.name"))
    entries = F.array_distinct(F.filter(F.array(F.get_json_object("text", "$.main"), F.get_json_object("text", "$.module"), F.get_json_object("text", "$.bin")), lambda x: x.isNotNull() & ~x.startswith("{")))
    asked = requirements(rows).groupBy("relative_path").agg(F.array_sort(F.collect_set("package")).alias("packages"))
    return rows.select("relative_path", "kind", named.alias("name"), entries.alias("entry_points")).join(asked, "relative_path", "left").withColumn("packages", F.coalesce("packages", F.array().cast("array<string>")))


def frameworks(units: DataFrame) -> list[str]:
    """The frameworks that some manifest asks for; a handful at most."""
    known = F.create_map(*[F.lit(x) for kv in FRAMEWORK_PACKAGES.items() for x in kv])
    return sorted(r[0] for r in units.select(F.explode("packages").alias("p")).select(known[F.col("p")].alias("f")).where("f is not null").distinct().collect())


def entry_points(units: DataFrame) -> DataFrame:
    """Paths of the files that manifests name as entry points: ``relative_path``."""
    folder = F.regexp_replace("relative_path", r"[^/]*$", "")
    return units.select(folder.alias("folder"), F.explode("entry_points").alias("e")).select(F.concat("folder", F.regexp_replace("e", r"^\./", "")).alias("relative_path")).distinct()


# Packages by which a manifest tells that a framework is used.
FRAMEWORK_PACKAGES = {"laravel/framework": "laravel", "symfony/framework-bundle": "symfony", "django": "django", "fastapi": "fastapi", "next": "nextjs", "@nestjs/core": "nestjs", "react": "react", "vue": "vue"}


def requirements(files: DataFrame) -> DataFrame:
    """Packages that manifests ask for: ``relative_path, package, constraint``; and the workspaces of node manifests as ``workspace:<glob>``."""
    base = F.element_at(F.split("relative_path", "/"), -1)
    maps = [F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>") for k in ("require", "require-dev", "dependencies", "devDependencies")]
    empty = F.expr("map()").cast("map<string,string>")
    json = files.where(base.isin("composer.json", "package.json")).select("relative_path", F.explode(F.map_entries(F.map_concat(*[F.coalesce(m, empty) for m in maps]))).alias("e")).select("relative_path", F.col("e.key").alias("package"), F.col("e.value").alias("constraint"))
    spaces = files.where(base == "package.json").select("relative_path", F.explode(F.from_json(F.get_json_object("text", "$.workspaces"), "array<string>")).alias("w")).select("relative_path", F.concat(F.lit("workspace:"), "w").alias("package"), F.lit(None).cast("string").alias("constraint"))
    block = F.regexp_extract("text", r"(?ms)^dependencies\s*=\s*\[(.*?)^\s*\]", 1)
    lines = F.when(base == "requirements.txt", F.split("text", "\n")).otherwise(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)))
    named = F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    python = files.where(base.isin("requirements.txt", "pyproject.toml")).select("relative_path", F.explode(lines).alias("line")).select("relative_path", F.lower(named).alias("package"), F.trim(F.regexp_replace("line", r"^\s*[A-Za-z0-9._-]+(\[[^\]]*\])?", "")).alias("constraint")).where("package <> ''")
    return json.where("package <> 'php' AND NOT startswith(package, 'ext-')").unionByName(spaces).unionByName(python)


def psr4_prefixes(files: DataFrame) -> DataFrame:
    """Namespace prefixes of composer manifests: ``relative_path, namespace, directory``."""
    rows = files.where(F.col("relative_path").rlike(r"(^|/)composer\.json$"))
    found = F.from_json(F.get_json_object("text", "$.autoload.psr-4"), "map<string,string>")
    return rows.select("relative_path", F.explode(found).alias("namespace", "directory"))
