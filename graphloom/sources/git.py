"""Git history and working trees as tables."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

#: Git runs without hooks, filters, pagers or prompts.
_SAFE = ["-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-c", "core.pager=cat", "-c", "diff.external="]


def run_git(root: str, args: list[str], timeout: float = 10.0, most: int = 32 << 20) -> str:
    env = {"PATH": os.environ.get("PATH", ""), "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    done = subprocess.run(["git", *_SAFE, "-C", root, *args], capture_output=True, timeout=timeout, env=env, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed")
    if len(done.stdout) > most:
        raise RuntimeError("git output is too large")
    return done.stdout.decode("utf-8", "replace")


def parse_log(text: str) -> list[tuple[str, str, str, int]]:
    """``commit, path, author, epoch`` from a log in the format that ``history`` asks for."""
    out = []
    for block in text.split("\x1e")[1:]:
        head, _, rest = block.partition("\n")
        commit, author, epoch = head.split("\x1f")
        out += [(commit, p, author, int(epoch)) for p in dict.fromkeys(filter(None, rest.split("\n")))]
    return out


def history(spark: SparkSession, root: str, since_days: int = 90, max_commits: int = 500) -> tuple[DataFrame, bool]:
    """Commits for ``counts.churn`` and whether there were more than ``max_commits``."""
    rows = parse_log(run_git(root, ["log", f"--since={since_days}.days", f"--max-count={max_commits + 1}", "--name-only", "--format=%x1e%H%x1f%an%x1f%ct"]))
    kept = list(dict.fromkeys(r[0] for r in rows))[:max_commits]
    more = len({r[0] for r in rows}) > max_commits
    return spark.createDataFrame([r for r in rows if r[0] in set(kept)], "commit_id string, path string, author string, ts long"), more


def parse_name_status(text: str) -> list[tuple[str, str, str | None]]:
    """``status, path, previous path`` from ``git diff --name-status -z``."""
    parts = text.split("\0")
    out, i = [], 0
    while i < len(parts) - 1:
        status = parts[i]
        if re.match(r"[RC]", status):
            out.append((status[0], parts[i + 2], parts[i + 1]))
            i += 3
        else:
            out.append((status[0], parts[i + 1], None))
            i += 2
    return out


def changes(spark: SparkSession, root: str, base: str = "HEAD", max_files: int = 500) -> DataFrame:
    """Changed and untracked files of a working tree."""
    if not re.fullmatch(r"[\w./~^@{}-]+", base) or base.startswith("-"):
        raise ValueError("not a revision")
    rows = parse_name_status(run_git(root, ["diff", "--name-status", "-z", "-M", base]))
    rows += [("?", p, None) for p in run_git(root, ["ls-files", "--others", "--exclude-standard", "-z"]).split("\0") if p]
    if len(rows) > max_files:
        raise ValueError(f"more than {max_files} changed files")
    return spark.createDataFrame(rows, "status string, path string, previous string")
