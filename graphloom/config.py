"""Project configuration: read, checked, and overlaid in the order argument, checked-in file, default."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from .operators.policy import Policy
from .operators.snapshot import BUDGETS
from .schema import between
from .sources.tree import ignore_regex, load_jsonc

#: Names under which a checked-in configuration is looked for; only one may be there.
FILES = ("graphloom.json", "graphloom.jsonc")
# Framework hints that are understood.
FRAMEWORKS = ("laravel", "symfony", "django", "fastapi", "nextjs", "nestjs", "react", "vue")
_KEYS = {"version", "ignores", "limits", "boundaries", "frameworks", "snapshot_retention", "policies", "quality_budgets", "dead_code_suppressions"}


class ConfigError(ValueError):
    """A configuration that is not taken, with the reason."""


@dataclass(frozen=True)
class ProjectConfig:
    ignores: tuple[str, ...] = ()
    max_files: int | None = None
    max_file_bytes: int | None = None
    boundaries: tuple[dict[str, str], ...] = ()
    frameworks: tuple[str, ...] = ()
    snapshot_retention: int | None = None
    policies: tuple[Policy, ...] = ()
    quality_budgets: dict[str, int] = field(default_factory=dict)
    dead_code_suppressions: tuple[str, ...] = ()

    def overlaid(self, **arguments: Any) -> ProjectConfig:
        """What an argument says goes before what the file says; arguments that are None say nothing."""
        unknown = set(arguments) - {f.name for f in fields(self)}
        if unknown:
            raise ConfigError(f"unknown arguments {sorted(unknown)}")
        return replace(self, **{k: v for k, v in arguments.items() if v is not None})


def _known(value: Any, allowed: set[str], what: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ConfigError(f"{what} must be an object")
    if extra := sorted(set(value) - allowed):
        raise ConfigError(f"unknown {what} key(s): {', '.join(extra)}")
    return value


def _strings(value: Any, what: str, most: int) -> tuple[str, ...]:
    if not isinstance(value, list) or len(value) > most or any(not isinstance(x, str) or not x for x in value):
        raise ConfigError(f"{what} must be a list of up to {most} non-empty strings")
    return tuple(value)


def _number(value: Any, what: str, low: int, high: int) -> int | None:
    if value is None:
        return None
    if not isinstance(value, int) or isinstance(value, bool):
        raise ConfigError(f"{what} must be an integer")
    try:
        return between(what, value, low, high)
    except ValueError as e:
        raise ConfigError(str(e)) from e


def _climbs(path: str) -> bool:
    return path.startswith("/") or ".." in path.replace("\\", "/").split("/")


def boundaries(rows: Any) -> tuple[dict[str, str], ...]:
    """Explicit boundaries: unique names, and exactly one of a path and a namespace prefix."""
    if not isinstance(rows, list) or len(rows) > 50:
        raise ConfigError("boundaries must be a list of up to 50 objects")
    seen: set[str] = set()
    for b in rows:
        _known(b, {"name", "path_prefix", "namespace_prefix"}, "boundary")
        name = b.get("name")
        if not isinstance(name, str) or not name or name in seen:
            raise ConfigError(f"boundary name {name!r} is empty or repeated")
        seen.add(name)
        given = [k for k in ("path_prefix", "namespace_prefix") if b.get(k) is not None]
        if len(given) != 1 or not isinstance(b[given[0]], str):
            raise ConfigError(f"boundary {name!r} must have either path_prefix or namespace_prefix")
        if given == ["path_prefix"] and _climbs(b["path_prefix"]):
            raise ConfigError(f"boundary {name!r} must lie within the project")
    return tuple(rows)


def _policies(rows: Any) -> tuple[Policy, ...]:
    if not isinstance(rows, list) or len(rows) > 50:
        raise ConfigError("policies must be a list of up to 50 objects")
    out = []
    for p in rows:
        _known(p, {"id", "from_boundary", "allow_targets", "deny_targets", "edge_kinds"}, "policy")
        if not all(isinstance(p.get(k), str) and p[k] for k in ("id", "from_boundary")):
            raise ConfigError("policies need id and from_boundary")
        if p.get("allow_targets") is None and p.get("deny_targets") is None:
            raise ConfigError("policies need allow_targets or deny_targets")
        lists = {k: _strings(p[k], f"policy {k}", 100) for k in ("allow_targets", "deny_targets", "edge_kinds") if p.get(k) is not None}
        out.append(Policy(p["id"], p["from_boundary"], **lists))
    return tuple(out)


def parse(text: str) -> ProjectConfig:
    """A configuration file's content, with or without comments; unknown keys are errors."""
    if len(text.encode()) > 1_000_000:
        raise ConfigError("configuration is over 1000000 bytes")
    try:
        data = load_jsonc(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from e
    _known(data, _KEYS, "configuration")
    if data.get("version") != 1:
        raise ConfigError("version must be 1")
    ignores = _strings(data.get("ignores", []), "ignores", 100)
    for pattern in ignores:
        if len(pattern.encode()) > 500 or _climbs(pattern) or "\0" in pattern:
            raise ConfigError(f"ignore pattern {pattern!r} must be relative and short")
        ignore_regex(pattern)
    limits = _known(data.get("limits", {}), {"max_files", "max_file_bytes"}, "limits")
    frameworks = _strings(data.get("frameworks", []), "frameworks", 20)
    if bad := sorted(set(frameworks) - set(FRAMEWORKS)):
        raise ConfigError(f"unknown frameworks {bad}")
    budgets = _known(data.get("quality_budgets", {}), set(BUDGETS), "quality_budgets")
    return ProjectConfig(
        ignores, _number(limits.get("max_files"), "max_files", 1, 100_000), _number(limits.get("max_file_bytes"), "max_file_bytes", 1, 100_000_000),
        boundaries(data.get("boundaries", [])), tuple(dict.fromkeys(frameworks)), _number(data.get("snapshot_retention"), "snapshot_retention", 0, 20), _policies(data.get("policies", [])),
        {k: _number(v, k, 0, 100_000) for k, v in budgets.items()}, _strings(data.get("dead_code_suppressions", []), "dead_code_suppressions", 200),
    )


def load(spark, root: str) -> ProjectConfig:
    """The configuration checked in at a folder's top, read through Spark; the default where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f"{root.rstrip('/')}/{name}" for name in FILES if files.exists(path(f"{root.rstrip('/')}/{name}"))]
    if len(found) > 1:
        raise ConfigError(f"keep only one of {', '.join(FILES)}")
    return parse(spark.read.text(found[0], wholetext=True).first()[0]) if found else ProjectConfig()
