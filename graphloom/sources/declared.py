"""Facts of PHP and TypeScript sources by their declarations, as DataFrame expressions over lines.

There is no parser here: lines are matched by patterns, and what surrounds a line (namespace, type,
function) is the last such declaration before it in its file, by a window.  A brace in the first column ends what
was open.  So code as formatters write it is read well, several declarations on one line are not.  Everything
that isn't declared in the same file is named by reference and resolved, or made external, when contributions are reconciled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import CONTRIBUTION

_NO_EDGES = "array<struct<kind:string,source:string,target:string,line:int,confidence:string>>"
#: Words before a parenthesis that are no calls.
KEYWORDS = ["if", "elseif", "else", "for", "foreach", "while", "switch", "match", "catch", "function", "fn", "return", "array", "list", "isset", "unset", "empty", "echo", "print", "exit", "die", "and", "or", "new", "use", "require", "require_once", "include", "include_once", "declare", "super", "await", "typeof", "import", "constructor", "throw"]
HTTP = "get|post|put|patch|delete|options|any"
TYPE = r"^\s*(?:#\[[^\]]*\]\s*)?(?:export\s+|default\s+|declare\s+|abstract\s+|final\s+|readonly\s+)*(class|interface|trait|enum)\s+(\w+)"


def found(line: str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(F.col(line), pattern, group), F.lit(""))


def every(line: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(group))


def lines(files: DataFrame, language: str) -> DataFrame:
    """``path, number, line``; lines that are comments are blank."""
    rows = files.where(F.col("language") == language).select(F.col("relative_path").alias("path"), F.posexplode(F.split("text", "\r?\n")).alias("number", "line"))
    comment = F.ltrim("line").startswith("//") | F.ltrim("line").startswith("*") | F.ltrim("line").startswith("/*") | (F.ltrim("line").startswith("#") & ~F.ltrim("line").startswith("#["))
    return rows.withColumn("number", F.col("number") + 1).withColumn("line", F.when(comment, "").otherwise(F.col("line")))


def surrounded(rows: DataFrame, function: Column, namespace: Column | None = None) -> DataFrame:
    """Lines with ``namespace``, the type (``type_kind, type``), and the ``function`` that they lie in; empty outside."""
    so_far = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.col("line").rlike(r"^\}")
    ended = F.sum(F.col("line").rlike(r"[;{}]\s*$").cast("int")).over(Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(ended, F.lit(0)))
    out = rows.withColumns({"own_kind": found("line", TYPE), "own_type": found("line", TYPE, 2), "own_function": function, "ns": namespace if namespace is not None else F.lit(None).cast("string")})
    outer = F.col("own_function").isNotNull() & F.col("line").rlike(r"^\S")
    top = closed | F.col("own_type").isNotNull()
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(""))
    return out.withColumns({
        "code": F.when(F.ltrim("line").rlike(r"^(?:@|#\[)"), "").otherwise(F.col("line")), "namespace": last(F.col("ns")),
        "type": last(F.when(closed | outer, "").otherwise(F.col("own_type"))), "type_kind": last(F.when(closed | outer, "").otherwise(F.col("own_kind"))),
        "function": last(F.coalesce(F.col("own_function"), F.when(top, ""))),
        # Attributes and decorators stand on the lines just before what they mark, with no statement or brace between.
        "marks": F.collect_list(found("line", r"^\s*(?:#\[|@)(.+)$")).over(Window.partitionBy("path", "run").orderBy("number").rowsBetween(-4, 0)),
    })


def node(kind: Column | str, name: Column, display: Column, attributes: Column | str = "{}") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("kind"), name.alias("name"), display.alias("display"), F.col("number").alias("line"), lit(attributes).alias("attributes"))


def edge(kind: str, source: Column, target: Column, confidence: str = "probable") -> Column:
    return F.struct(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.col("number").alias("line"), F.lit(confidence).alias("confidence"))


def some(*facts: Column) -> Column:
    """Facts that are there: those whose name or target isn't null."""
    return F.filter(F.array(*facts), lambda x: x.isNotNull())


def gathered(language: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One contribution a file, from rows of a ``path`` and facts."""
    n = nodes.select("path", F.explode("facts").alias("f")).select("path", "f.*").groupBy("path", "kind", "name").agg(F.min_by(F.struct("display", "line", "attributes"), "line").alias("x"))
    node_ = F.struct(F.concat_ws(":", "kind", "name").alias("local_id"), "kind", F.col("name").alias("canonical_name"), F.col("x.display").alias("display_name"), F.lit("ast").alias("origin"), F.lit("certain").alias("confidence"), F.col("x.line").alias("start_line"), F.col("x.line").alias("end_line"), F.col("x.attributes").alias("attributes"))
    e = edges.select("path", F.explode("facts").alias("f")).select("path", "f.*").distinct()
    edge_ = F.struct("kind", "source", "target", F.lit("ast").alias("origin"), "confidence", F.col("line").alias("start_line"))
    left = n.groupBy("path").agg(F.array_sort(F.collect_list(node_)).alias("nodes"))
    right = e.groupBy("path").agg(F.array_sort(F.collect_list(edge_)).alias("edges"))
    out = left.join(right, "path", "left").select(F.lit(language).alias("language"), F.col("path").alias("owner_key"), "nodes", "edges", F.array().cast(CONTRIBUTION["diagnostics"].dataType).alias("diagnostics"))
    return out.select("language", *[F.coalesce(F.col(f.name), F.array()).cast(f.dataType).alias(f.name) if f.name != "owner_key" else F.col("owner_key") for f in CONTRIBUTION.fields])


def php(files: DataFrame) -> DataFrame:
    """Types, methods and functions with what they extend, implement, use, construct, call and return.

    Of Laravel also routes with their group's prefix, container bindings, dispatches, observers and the maps of providers; of Symfony routes with
    their class's prefix, commands, service aliases, injected services, event listeners and subscribers, message handlers.
    """
    function = r"^\s*(?:abstract\s+|final\s+|public\s+|protected\s+|private\s+|static\s+)*function\s+&?(\w+)\s*\("
    rows = surrounded(lines(files, "php"), found("line", function), found("line", r"^\s*namespace\s+([\w\\]+)\s*[;{]"))
    use = r"^use\s+(?:function\s+)?\\?([\w\\]+)(?:\s+as\s+(\w+))?\s*;"
    names = rows.where(F.col("line").rlike(use)).select("path", F.coalesce(found("line", use, 2), F.element_at(F.split(found("line", use), r"\\"), -1)).alias("k"), found("line", use).alias("v"))
    rows = rows.join(names.groupBy("path", "k").agg(F.first("v").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("used")), "path", "left")

    so_far = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    opened, group_ = r"\$(listen|policies)\s*=\s*\[", r"Route::(?:\w+\([^()]*\)->)*prefix\(\s*['\"]([^'\"]*)['\"]\)(?:->\w+\([^()]*\))*->group\("
    rows = rows.withColumns({
        # The provider's map that a line lies in, the prefix of its group of routes, and the attributes of its class.
        "map": F.coalesce(last(F.when(F.col("line").rlike(opened), found("line", opened)).when(F.col("line").rlike(r"\]\s*;\s*$"), F.lit(""))), F.lit("")),
        "group": F.coalesce(last(F.when(F.col("line").rlike(group_), found("line", group_)).when(F.col("line").rlike(r"^\}\)"), F.lit(""))), F.lit("")),
        "class_marks": F.coalesce(last(F.when(F.col("own_type").isNotNull(), F.col("marks"))), F.array().cast("array<string>")),
    })

    def full(name: Column) -> Column:
        """The full name of a type as written in the file."""
        head, rest = F.substring_index(name, "\\", 1), F.regexp_replace(name, r"^[^\\]+", "")
        here = F.when(F.col("namespace") == "", name).otherwise(F.concat("namespace", F.lit("\\"), name))
        owner = F.when(F.col("namespace") == "", F.col("type")).otherwise(F.concat("namespace", F.lit("\\"), F.col("type")))
        return F.when(name.isin("self", "static", "this"), owner).when(name.startswith("\\"), F.ltrim(name, F.lit("\\"))).otherwise(F.coalesce(F.concat(F.col("used")[head], rest), here))

    cls, within = full(F.col("type")), F.col("type") != ""
    member = F.when(within, F.concat(cls, F.lit("::"), "function")).otherwise(F.when(F.col("namespace") == "", F.col("function")).otherwise(F.concat("namespace", F.lit("\\"), "function")))
    member_kind = F.when(within, "method").otherwise("function")
    here = F.when(F.col("function") != "", F.concat(F.lit("php:"), member_kind, F.lit(":"), member)).when(within, F.concat(F.lit("php:"), "type_kind", F.lit(":"), cls)).otherwise(F.concat(F.lit("php:module:"), "path"))
    type_ref = F.concat(F.lit("php:"), "type_kind", F.lit(":"), cls)
    parent, contracts = found("line", r"\bextends\s+([\w\\]+)"), F.split(F.coalesce(found("line", r"\bimplements\s+([\w\\,\s]+)"), F.lit("")), r"\s*,\s*")
    attributes = F.to_json(F.struct(full(parent).alias("extends"), F.transform(F.filter(contracts, lambda x: x != ""), lambda x: full(F.trim(x))).alias("implements"), F.transform(F.col("marks"), lambda m: F.regexp_extract(m, r"^\\?([\w\\]+)", 1)).alias("php_attributes")))
    route = rf"Route::({HTTP})\(\s*['\"]([^'\"]*)['\"]\s*,\s*\[?\s*\\?([\w\\]+)::class(?:\s*,\s*['\"](\w+)['\"])?"
    mark = F.try_element_at(F.filter("marks", lambda m: m.rlike(r"^Route\(\s*['\"]")), F.lit(-1))
    # What an attribute of a short name says first, of those just before a line or before its class.
    said = lambda marks, name, argument: F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(F.filter(marks, lambda m: m.rlike(rf"^\\?(?:\w+\\)*{name}\b")), F.lit(-1)), F.lit("")), rf"{name}\(\s*(?:\w+:\s*)?{argument}", 1), F.lit(""))
    text, class_ = r"['\"]([^'\"]*)['\"]", r"(\\?[A-Z][\w\\]*)::class"
    joined = lambda prefix, path: F.concat(F.lit("/"), F.trim(F.concat(F.trim(prefix, F.lit("/")), F.lit("/"), F.trim(path, F.lit("/"))), F.lit("/")))
    own_path, prefix = F.regexp_extract(mark, text, 1), said(F.col("class_marks"), "Route", text)
    symfony = F.when(F.col("own_function").isNotNull() & within & mark.isNotNull(), F.concat(F.lit("ANY "), F.when(prefix.isNull(), own_path).otherwise(joined(prefix, own_path))))
    laravel = F.when(F.col("line").rlike(route), F.concat(F.upper(found("line", route)), F.lit(" "), joined(F.col("group"), F.coalesce(found("line", route, 2), F.lit("")))))
    declares = F.col("own_type").isNotNull()
    command, alias = F.when(declares, said(F.col("marks"), "AsCommand", text)), F.when(declares, said(F.col("marks"), "AsAlias", text))
    wired = r"#\[\\?(?:\w+\\)*Autowire\(\s*service:\s*['\"]([^'\"]+)['\"]"
    injected = F.when(within & F.col("line").rlike(wired), found("line", wired))
    heard = F.when(declares | (F.col("own_function").isNotNull() & within), said(F.col("marks"), "AsEventListener", class_))
    handler = F.exists("marks", lambda m: m.rlike(r"^\\?(?:\w+\\)*AsMessageHandler\b")) | ((F.col("own_function") == "__invoke") & F.exists("class_marks", lambda m: m.rlike(r"^\\?(?:\w+\\)*AsMessageHandler\b")))
    message = F.when(F.col("own_function").isNotNull() & within & handler, found("line", r"function\s+&?\w+\s*\(\s*\??(\\?[A-Z][\w\\]*)\s+\$"))
    nodes = rows.withColumn("facts", some(
        F.when(F.col("number") == 1, node("module", F.col("path"), F.element_at(F.split("path", "/"), -1))),
        F.when(F.col("own_type").isNotNull(), node(F.col("own_kind"), cls, F.col("own_type"), attributes)),
        F.when(F.col("own_function").isNotNull(), node(member_kind, member, F.col("own_function"))),
        F.when(laravel.isNotNull(), node("route", laravel, laravel)), F.when(symfony.isNotNull(), node("route", symfony, symfony)),
        F.when(command.isNotNull(), node("command", command, command)), F.when(alias.isNotNull(), node("service", alias, alias)), F.when(injected.isNotNull(), node("service", injected, injected)),
    ))
    returns = found("line", r"function\s+&?\w+\s*\(.*\)\s*:\s*\??(\\?[A-Z][\w\\]*)")
    one = some(
        F.when(F.col("own_type").isNotNull() & parent.isNotNull(), edge("extends", type_ref, F.concat(F.lit("php:class:"), full(parent)), "certain")),
        F.when(F.col("own_function").isNotNull() & within, edge("contains", type_ref, here, "certain")),
        F.when(returns.isNotNull(), edge("returns", here, F.concat(F.lit("php:class:"), full(returns)), "certain")),
        F.when(laravel.isNotNull(), edge("routes_to", F.concat(F.lit("php:route:"), laravel), F.concat(F.lit("php:method:"), full(found("line", route, 3)), F.lit("::"), F.coalesce(found("line", route, 4), F.lit("__invoke"))))),
        F.when(symfony.isNotNull(), edge("routes_to", F.concat(F.lit("php:route:"), symfony), here)),
        F.when(command.isNotNull(), edge("handles", F.concat(F.lit("php:command:"), command), type_ref, "certain")),
        F.when(alias.isNotNull(), edge("binds", F.concat(F.lit("php:service:"), alias), type_ref, "certain")),
        F.when(injected.isNotNull(), edge("injects", type_ref, F.concat(F.lit("php:service:"), injected), "certain")),
        F.when(heard.isNotNull(), edge("listens_to", F.when(declares, type_ref).otherwise(here), F.concat(F.lit("php:class:"), full(heard)), "certain")),
        F.when(message.isNotNull(), edge("handles_message", type_ref, F.concat(F.lit("php:class:"), full(message)), "certain")),
    )
    trait = F.when(within & (F.col("function") == ""), found("line", r"^\s+use\s+([\w\\,\s]+);"))
    static = r"\b([A-Z]\w*|self|static|parent)::(\w+)\("
    many = [
        F.when(F.col("own_type").isNotNull(), F.transform(F.filter(contracts, lambda x: x != ""), lambda x: edge("implements", type_ref, F.concat(F.lit("php:interface:"), full(F.trim(x))), "certain"))),
        F.when(trait.isNotNull(), F.transform(F.split(trait, r"\s*,\s*"), lambda x: edge("uses_trait", type_ref, F.concat(F.lit("php:trait:"), full(F.trim(x))), "certain"))),
        F.transform(every("line", r"\bnew\s+(\\?[A-Z][\w\\]*)"), lambda x: edge("constructs", here, F.concat(F.lit("php:class:"), full(x)), "certain")),
        F.when(within, F.transform(every("line", r"\$this->(\w+)\("), lambda x: edge("calls", here, F.concat(F.lit("php:method:"), cls, F.lit("::"), x), "certain"))),
        F.transform(F.filter(F.arrays_zip(every("line", static).alias("t"), every("line", static, 2).alias("m")), lambda z: ~z["t"].isin("parent", "Route")), lambda z: edge("calls", here, F.concat(F.lit("php:method:"), full(z["t"]), F.lit("::"), z["m"]))),
        # What a container gives for a contract, what is dispatched to whom, and who observes what.
        F.transform(every("line", r"->(?:bind|singleton|scoped)\(\s*\\?[\w\\]+::class\s*,\s*(\\?[\w\\]+)::class"), lambda x: edge("binds", here, F.concat(F.lit("php:class:"), full(x)), "certain")),
        F.transform(F.filter(every("line", r"(?<![\w\\])(\\?[A-Z][\w\\]*)::dispatch\("), lambda x: ~x.rlike(r"(?:^|\\)(?:Bus|Event)$")), lambda x: edge("dispatches", here, F.concat(F.lit("php:class:"), full(x)), "certain")),
        F.transform(every("line", r"(?<![\w>:$\\])(?:event|dispatch)\(\s*new\s+(\\?[A-Z][\w\\]*)"), lambda x: edge("dispatches", here, F.concat(F.lit("php:class:"), full(x)), "certain")),
        F.transform(every("line", r"\b[A-Z][\w\\]*::observe\(\s*(\\?[\w\\]+)::class"), lambda x: edge("observes", here, F.concat(F.lit("php:class:"), full(x)), "certain")),
        F.when(F.col("map") == "listen", F.transform(every("line", r"(\\?[\w\\]+)::class\s*=>"), lambda x: edge("listens_to", type_ref, F.concat(F.lit("php:class:"), full(x)), "certain"))),
        F.when(F.col("map") == "policies", F.transform(every("line", r"(\\?[\w\\]+)::class\s*=>"), lambda x: edge("handles", type_ref, F.concat(F.lit("php:class:"), full(x)), "certain"))),
        F.when(F.lower("function") == "getsubscribedevents", F.transform(every("line", r"(\\?[\w\\]+)::class\s*=>"), lambda x: edge("listens_to", type_ref, F.concat(F.lit("php:class:"), full(x)), "certain"))),
        F.when(F.lower("function") == "getsubscribedevents", F.transform(F.filter(F.arrays_zip(every("line", r"([A-Z][\w\\]*)::([A-Z_]+)\s*=>").alias("t"), every("line", r"([A-Z][\w\\]*)::([A-Z_]+)\s*=>", 2).alias("c")), lambda z: z["t"] != ""), lambda z: edge("listens_to", type_ref, F.concat(F.lit("php:event:"), full(z["t"]), F.lit("::"), z["c"]), "certain"))),
        F.when(F.lower("function") == "getsubscribedevents", F.transform(every("line", r"^\s*(?:return\s*\[\s*)?['\"]([^'\"]+)['\"]\s*=>"), lambda x: edge("listens_to", type_ref, F.concat(F.lit("php:event:"), x), "certain"))),
        # What a call on the result of another call reaches is decided when return types are known.
        F.when(within, F.transform(F.arrays_zip(every("line", r"\$this->(\w+)\([^()]*\)->(\w+)\(").alias("f"), every("line", r"\$this->(\w+)\([^()]*\)->(\w+)\(", 2).alias("m")), lambda z: edge("calls", here, F.concat(F.lit("php:method_of_return:"), cls, F.lit("::"), z["f"], F.lit("::"), z["m"])))),
        F.transform(F.filter(every("code", r"(?<!new )(?<![\w>:$\\])([a-z_]\w*)\("), lambda x: ~F.lower(x).isin(KEYWORDS) & ~x.eqNullSafe(F.col("own_function"))), lambda x: edge("calls", here, F.concat(F.lit("php:namespaced_function:"), F.when(F.col("namespace") == "", x).otherwise(F.concat("namespace", F.lit("\\"), x))))),
    ]
    facts = F.concat(one, *[F.coalesce(m, F.array().cast(_NO_EDGES)) for m in many])
    return gathered("php", nodes, rows.withColumn("facts", facts))


def typescript(files: DataFrame) -> DataFrame:
    """Modules, types, functions and methods with imports, re-exports, inheritance, constructions and calls; routes and roles of Nest, pages of Next, components of React and Vue."""
    function = r"^(?:export\s+|default\s+)*(?:async\s+)?function\s*\*?\s*(\w+)|^(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"
    method = r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|override\s+|readonly\s+|async\s+|get\s+|set\s+)*(\w+)\s*(?:<[^>]*>)?\([^;]*\{\s*$"
    named = F.coalesce(found("line", function), found("line", function, 2))
    inner = found("line", method)
    rows = surrounded(lines(files, "typescript"), F.coalesce(named, F.when(~inner.isin(KEYWORDS) | (inner == "constructor"), inner)))
    rows = rows.withColumn("own_function", F.when(named.isNotNull() | (F.col("type") != ""), F.col("own_function"))).withColumn("module", F.regexp_replace("path", r"(\.d)?\.[cm]?[jt]sx?$", ""))
    source = F.coalesce(found("line", r"""\bfrom\s*['"]([^'"]+)['"]"""), found("line", r"""\b(?:require|import)\(\s*['"]([^'"]+)['"]"""), found("line", r"""^import\s+['"]([^'"]+)['"]"""))
    # Relative names are joined to the folder, and "." and ".." folded away.
    folder = F.regexp_replace("module", r"/?[^/]*$", "")
    steps = F.split(F.concat(folder, F.lit("/"), source), "/")
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda out, s: F.when(s.isin("", "."), out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s)))
    target = F.when(source.startswith("."), F.regexp_replace(F.array_join(folded, "/"), r"\.[cm]?[jt]sx?$", "")).otherwise(source)
    rows = rows.withColumn("target", target)
    braces, default = found("line", r"^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}"), found("line", r"^import\s+(?:type\s+)?(\w+)\s*(?:,|from)")
    each = F.transform(F.filter(F.split(F.coalesce(braces, F.lit("")), r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(F.trim(x), r"(\w+)$", 1).alias("k"), F.concat(F.col("target"), F.lit("."), F.regexp_extract(F.trim(x), r"^(?:type\s+)?(\w+)", 1)).alias("v")))
    entries = F.concat(each, F.when(default.isNotNull(), F.array(F.struct(default.alias("k"), F.concat("target", F.lit(".default")).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
    names = rows.where("target is not null").select("path", F.explode(entries).alias("e")).groupBy("path", "e.k").agg(F.first("e.v").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("used"))
    own = rows.where("own_type is not null or own_function is not null and type = ''").select("path", F.coalesce("own_type", "own_function").alias("n")).groupBy("path").agg(F.collect_set("n").alias("own"))
    rows = rows.join(names, "path", "left").join(own, "path", "left")
    full = lambda name: F.coalesce(F.col("used")[name], F.concat("module", F.lit("."), name))
    cls, within = F.concat("module", F.lit("."), "type"), F.col("type") != ""
    member = F.when(within, F.concat(cls, F.lit("::"), "function")).otherwise(F.concat("module", F.lit("."), "function"))
    member_kind = F.when(within, "method").otherwise("function")
    module_ref = F.concat(F.lit("typescript:module:"), "module")
    type_ref = F.concat(F.lit("typescript:"), "type_kind", F.lit(":"), cls)
    here = F.when(F.col("function") != "", F.concat(F.lit("typescript:"), member_kind, F.lit(":"), member)).when(within, type_ref).otherwise(module_ref)
    role = lambda pattern, name: F.when(F.exists("marks", lambda m: m.rlike(pattern)), F.lit(name))
    nest = F.filter(F.array(role(r"^Module\(", "nestjs.module"), role(r"^Controller\(", "nestjs.controller"), role(r"^Injectable\(", "nestjs.provider")), lambda x: x.isNotNull())
    jsx = F.col("path").rlike(r"\.[jt]sx$")
    react = F.filter(F.array(F.when(jsx & F.col("own_function").rlike("^[A-Z]"), "react.component"), F.when(F.col("own_function").rlike("^use[A-Z]"), "react.hook")), lambda x: x.isNotNull())
    page = F.when(F.col("path").rlike(r"(^|/)app/(.*/)?page\.[jt]sx?$"), "nextjs.page").when(F.col("path").rlike(r"(^|/)app/(.*/)?layout\.[jt]sx?$"), "nextjs.layout").when(F.col("path").rlike(r"(^|/)app/(.*/)?route\.[jt]s$"), "nextjs.route_handler")
    listed = lambda field, roles: F.to_json(F.struct(roles.alias(field)))
    verb = F.try_element_at(F.filter("marks", lambda m: m.rlike(r"^(Get|Post|Put|Patch|Delete)\(")), F.lit(-1))
    route = F.when(F.col("own_function").isNotNull() & within & verb.isNotNull(), F.concat(F.upper(F.regexp_extract(verb, r"^(\w+)", 1)), F.lit(" /"), F.ltrim(F.regexp_extract(verb, r"""['"]([^'"]*)['"]""", 1), F.lit("/"))))
    nodes = rows.withColumn("facts", some(
        F.when(F.col("number") == 1, node("module", F.col("module"), F.element_at(F.split("module", "/"), -1), F.when(page.isNotNull(), listed("typescript_framework_roles", F.array(page))).otherwise("{}"))),
        F.when(F.col("own_type").isNotNull(), node(F.col("own_kind"), cls, F.col("own_type"), listed("nestjs_roles", nest))),
        F.when(F.col("own_function").isNotNull(), node(member_kind, member, F.col("own_function"), listed("typescript_framework_roles", react))), F.when(route.isNotNull(), node("route", route, route)),
    ))
    parent, contracts = found("line", r"\bextends\s+(\w+)"), F.split(F.coalesce(found("line", r"\bimplements\s+([\w,\s]+)"), F.lit("")), r"\s*,\s*")
    module_of = F.concat(F.lit("typescript:module:"), "target")
    known = lambda x: F.coalesce(F.array_contains(F.map_keys("used"), x), F.lit(False)) | F.coalesce(F.array_contains("own", x), F.lit(False))
    one = some(
        F.when(F.col("target").isNotNull() & ~F.col("line").rlike(r"^export\b"), edge("imports", module_ref, module_of, "certain")),
        F.when(F.col("target").isNotNull() & F.col("line").rlike(r"^export\b"), edge("re_exports", module_ref, module_of, "certain")),
        F.when(F.col("own_type").isNotNull(), edge("contains", module_ref, type_ref, "certain")),
        F.when(F.col("own_type").isNotNull() & parent.isNotNull(), edge("extends", type_ref, F.concat(F.lit("typescript:class:"), full(parent)), "certain")),
        F.when(F.col("own_function").isNotNull(), edge("contains", F.when(within, type_ref).otherwise(module_ref), here, "certain")),
        F.when(route.isNotNull(), edge("routes_to", F.concat(F.lit("typescript:route:"), route), here)),
    )
    many = [
        F.when(F.col("own_type").isNotNull(), F.transform(F.filter(contracts, lambda x: F.trim(x) != ""), lambda x: edge("implements", type_ref, F.concat(F.lit("typescript:interface:"), full(F.trim(x))), "certain"))),
        F.transform(F.filter(every("line", r"\bnew\s+([A-Z]\w*)"), known), lambda x: edge("constructs", here, F.concat(F.lit("typescript:class:"), full(x)), "certain")),
        F.when(within, F.transform(every("line", r"\bthis\.(\w+)\("), lambda x: edge("calls", here, F.concat(F.lit("typescript:method:"), cls, F.lit("::"), x), "certain"))),
        F.transform(F.filter(every("code", r"(?<!new )(?<![\w.$])([a-zA-Z_]\w*)\("), lambda x: ~x.isin(KEYWORDS) & known(x) & ~x.eqNullSafe(F.col("own_function"))), lambda x: edge("calls", here, F.concat(F.lit("typescript:function:"), full(x)))),
    ]
    facts = F.concat(one, *[F.coalesce(m, F.array().cast(_NO_EDGES)) for m in many])
    return gathered("typescript", nodes, rows.withColumn("facts", facts))


#: How each language is read.
READERS = {"php": php, "typescript": typescript}


def extract(files: DataFrame) -> DataFrame:
    """Contributions of the PHP and TypeScript files among ``relative_path, language, text``; a language without files costs nothing."""
    there = {r["language"] for r in files.select("language").where(F.col("language").isin(list(READERS))).distinct().collect()}
    none = files.sparkSession.createDataFrame([], StructType([StructField("language", StringType()), *CONTRIBUTION.fields]))
    return reduce(DataFrame.unionByName, [read(files) for name, read in READERS.items() if name in there] or [none])
