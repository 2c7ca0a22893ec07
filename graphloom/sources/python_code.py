"""Facts of Python sources, one contribution per file, from the standard syntax tree."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CONTRIBUTION

# Base classes that say what a class is for.
DJANGO_BASES = {"django.db.models.Model": "django.model", "django.views.View": "django.view", "django.views.generic.View": "django.view", "django.views.generic.ListView": "django.view", "django.views.generic.DetailView": "django.view", "django.utils.deprecation.MiddlewareMixin": "django.middleware"}


def imported(module: str, package: bool, level: int, name: str | None) -> str | None:
    """The absolute name of ``from``'s module; None if the dots climb above the top."""
    if not level:
        return name or ""
    here = module.split(".")
    kept = len(here) - level + (1 if package else 0)
    return ".".join([*here[:kept], *([name] if name else [])]) if kept > 0 else None


def facts(path: str, text: str) -> dict:
    """Nodes, edges and diagnostics of one file."""
    package = path.rsplit("/", 1)[-1].startswith("__init__.")
    module = path.removesuffix(".pyi").removesuffix(".py").removesuffix("/__init__").replace("/", ".")
    nodes, edges, told = [], [], []

    def node(kind: str, name: str, display: str, item: ast.AST | None, attributes: str = "{}") -> str:
        start, end = (item.lineno, item.end_lineno) if item is not None else (1, max(1, text.count("\n") + 1))
        nodes.append({"local_id": f"{kind}:{name}", "kind": kind, "canonical_name": name, "display_name": display, "origin": "ast", "confidence": "certain", "start_line": start, "end_line": end, "attributes": attributes})
        return f"python:{kind}:{name}"

    def edge(kind: str, source: str, target: str, line: int, confidence: str = "certain") -> None:
        edges.append({"kind": kind, "source": source, "target": target, "origin": "ast", "confidence": confidence, "start_line": line})

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return {"owner_key": path, "nodes": [], "edges": [], "diagnostics": [{"severity": "error", "code": "PYTHON_SYNTAX", "message": str(e)[:200]}]}
    guarded = text.startswith("#!") or any(isinstance(x, ast.If) and isinstance(x.test, ast.Compare) and isinstance(x.test.left, ast.Name) and x.test.left.id == "__name__" for x in tree.body)
    here = node("module", module, module.rsplit(".", 1)[-1], None, '{"executable":true}' if guarded else "{}")
    names: dict[str, str] = {}

    def dotted(x: ast.AST) -> str | None:
        if isinstance(x, ast.Name):
            return names.get(x.id, f"{module}.{x.id}" if x.id in own else x.id)
        if isinstance(x, ast.Attribute) and (base := dotted(x.value)):
            return f"{base}.{x.attr}"
        return None

    def statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
        """Statements of one level, and those in its branches, loops and guarded parts."""
        for x in body:
            yield x
            if not isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                for part in ("body", "orelse", "finalbody"):
                    yield from statements(getattr(x, part, []))
                for handler in [*getattr(x, "handlers", []), *getattr(x, "cases", [])]:
                    yield from statements(handler.body)

    own = {n.name for n in statements(tree.body) if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)}
    types = {n.name for n in statements(tree.body) if isinstance(n, ast.ClassDef)}
    for item in ast.walk(tree):
        if isinstance(item, ast.Import):
            for a in item.names:
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                edge("imports", here, f"python:module:{a.name}", item.lineno)
        elif isinstance(item, ast.ImportFrom):
            if (base := imported(module, package, item.level, item.module)) is None:
                told.append({"severity": "warning", "code": "PYTHON_RELATIVE_IMPORT", "message": f"{path}:{item.lineno}: relative import above the top package"})
                continue
            edge("imports", here, f"python:module:{base}", item.lineno)
            names.update({a.asname or a.name: f"{base}.{a.name}" for a in item.names})

    functions = ast.FunctionDef | ast.AsyncFunctionDef

    def own_body(body: ast.AST):
        """Everything below a definition but what lies in nested definitions, which speak for themselves."""
        todo = list(ast.iter_child_nodes(body))
        while todo:
            x = todo.pop()
            yield x
            if not isinstance(x, functions | ast.ClassDef):
                todo += ast.iter_child_nodes(x)

    def receiver_types(item: ast.AST, cls: str | None) -> dict[str, str]:
        """Types of names in a function: annotated arguments, ``x = Type()``, and self."""
        out = {}
        args = getattr(item, "args", ast.arguments([], [], None, [], [], None, []))
        for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]:
            if a.annotation is not None and (name := dotted(a.annotation)):
                out[a.arg] = name
        if cls and args.args and args.args[0].arg in ("self", "cls"):
            out[args.args[0].arg] = cls
        for x in own_body(item):
            if isinstance(x, ast.Assign | ast.AnnAssign) and isinstance(x.value, ast.Call) and (name := dotted(x.value.func)) and name.rsplit(".", 1)[-1][:1].isupper():
                for target in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(target, ast.Name):
                        out[target.id] = name
        return out

    def calls(body: ast.AST, source: str, cls: str | None) -> None:
        known_types = receiver_types(body, cls)
        for x in own_body(body):
            if not isinstance(x, ast.Call):
                continue
            f = x.func
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in known_types:
                edge("calls", source, f"python:method:{known_types[f.value.id]}::{f.attr}", x.lineno, "certain" if f.value.id in ("self", "cls") else "probable")
            elif name := dotted(f):
                known = name.rsplit(".", 1)[-1] in types and name.startswith(module)
                upper = name.rsplit(".", 1)[-1][:1].isupper()
                edge("constructs" if known or upper else "calls", source, f"python:{'class' if known or upper else 'function'}:{name}", x.lineno, "certain" if known else "probable")

    routers = {t.id for x in tree.body if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (dotted(x.value.func) or "").rsplit(".", 1)[-1] in ("FastAPI", "APIRouter") for t in x.targets if isinstance(t, ast.Name)}

    def routes(item: ast.AST, handler: str) -> None:
        """Decorators ``@router.get("/path")`` of the file's own routers."""
        for d in item.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in routers and d.func.attr in ("get", "post", "put", "delete", "patch", "head", "options") and d.args and isinstance(d.args[0], ast.Constant):
                route = node("route", f"{d.func.attr.upper()} {d.args[0].value}", str(d.args[0].value), item)
                edge("routes_to", route, handler, d.lineno)

    def define(item: ast.AST, holder: str, prefix: str, cls: str | None) -> None:
        """A function or method, and those nested in it."""
        name = f"{prefix}{item.name}"
        found = node("method" if cls else "function", name, item.name, item)
        edge("contains", holder, found, item.lineno)
        if item.returns is not None and (returned := dotted(item.returns)) and returned not in ("None", "str", "int", "bool", "float", "bytes"):
            edge("returns", found, f"python:class:{returned}", item.lineno)
        calls(item, found, cls)
        routes(item, found)
        for x in own_body(item):
            if isinstance(x, functions):
                define(x, found, f"{name}.", None)
            elif isinstance(x, ast.ClassDef):
                define_class(x, found, name)

    def define_class(item: ast.ClassDef, holder: str, outer: str) -> None:
        """A class with its methods, and classes nested in it."""
        full = f"{outer}.{item.name}"
        bases = [name for b in item.bases if (name := dotted(b))]
        django = next((role for base, role in DJANGO_BASES.items() if base in bases), None)
        cls = node("class", full, item.name, item, json.dumps({"bases": bases} | ({"python_framework_roles": [django]} if django else {})))
        edge("contains", holder, cls, item.lineno)
        for name in bases:
            edge("extends", cls, f"python:class:{name}", item.lineno)
        for m in statements(item.body):
            if isinstance(m, functions):
                define(m, cls, f"{full}::", full)
            elif isinstance(m, ast.ClassDef):
                define_class(m, cls, full)

    # What runs when the module is loaded.
    calls(tree, here, None)
    for item in statements(tree.body):
        if isinstance(item, ast.ClassDef):
            define_class(item, here, module)
        elif isinstance(item, functions):
            define(item, here, f"{module}.", None)
        elif isinstance(item, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in item.targets) and isinstance(item.value, ast.List | ast.Tuple):
            # Django routes: path("users/", views.users)
            for x in item.value.elts:
                if isinstance(x, ast.Call) and (dotted(x.func) or "").rsplit(".", 1)[-1] in ("path", "re_path") and len(x.args) > 1 and isinstance(x.args[0], ast.Constant) and (view := dotted(x.args[1])):
                    route = node("route", f"ANY /{str(x.args[0].value).lstrip('/^')}", str(x.args[0].value), x)
                    edge("routes_to", route, f"python:function:{view}", x.lineno, "probable")
    return {"owner_key": path, "nodes": nodes, "edges": edges, "diagnostics": told}


def extract(files: DataFrame) -> DataFrame:
    """Contributions of the Python files among ``relative_path, language, text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([facts(p, t) for p, t in zip(f["relative_path"], f["text"], strict=True)], columns=CONTRIBUTION.names)

    return files.where("language = 'python'").select("relative_path", "text").mapInPandas(run, CONTRIBUTION)
