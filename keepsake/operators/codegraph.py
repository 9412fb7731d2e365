"""Code units and their references, one source file at a time; names are resolved by joins."""

from __future__ import annotations

import ast
import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.scratch import cut
from keepsake.operators.lineage import reachable

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Names and modules whose use makes a unit's reach unknowable.
ESCAPES = {"__import__", "compile", "entry_points", "eval", "exec", "getattr", "globals", "setattr", "vars"}
ESCAPE_MODULES = {"importlib", "pkg_resources"}
#: What reachable code may do that defeats a proof about a change: names, attributes or modules that show it.
HAZARDS = {
    "reads_docs": {"__doc__", "getdoc", "doctest"},
    "reads_source": {"getsource", "getsourcelines", "getsourcefile", "linecache", "tokenize"},
    "spawns": {"threading", "multiprocessing", "subprocess", "concurrent", "Thread", "Process", "Popen", "fork", "ThreadPoolExecutor", "ProcessPoolExecutor"},
    "dispatches": {"getattr", "setattr", "delattr", "hasattr", "globals", "locals", "vars", "eval", "exec", "__import__", "import_module", "importlib", "methodcaller", "attrgetter"},
}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _without_docstrings(node: ast.AST) -> ast.AST:
    for x in ast.walk(node):
        if isinstance(x, (ast.Module, *_DEFINITIONS)) and ast.get_docstring(x, clean=False) is not None:
            x.body = x.body[1:] or [ast.Pass()]
    return node


def _words(nodes: list[ast.stmt]) -> set[str]:
    """All names, attributes and modules that nodes mention."""
    out = set()
    for s in nodes:
        for x in ast.walk(s):
            if isinstance(x, ast.Name):
                out.add(x.id)
            elif isinstance(x, ast.Attribute):
                out.add(x.attr)
            elif isinstance(x, ast.alias):
                out |= {*x.name.split("."), x.asname or ""}
            elif isinstance(x, ast.ImportFrom):
                out |= set((x.module or "").split("."))
    return out


def hazards_of(nodes: list[ast.stmt]) -> list[str]:
    """Sorted names of HAZARDS that nodes show; a text that ends in .py counts as reading source."""
    words = _words(nodes)
    found = {h for h, names in HAZARDS.items() if words & names}
    if any(isinstance(x, ast.Constant) and isinstance(x.value, str) and x.value.endswith(".py") for s in nodes for x in ast.walk(s)):
        found.add("reads_source")
    return sorted(found)


def _chain(x: ast.AST) -> list[str]:
    """The names of an attribute of an attribute of ... a name, else nothing."""
    if isinstance(x, ast.Name):
        return [x.id]
    return [*above, x.attr] if isinstance(x, ast.Attribute) and (above := _chain(x.value)) else []


def units_of(module: str, text: str) -> list[tuple[str, str, str, str, list[str], list[str], list[str]]]:
    """(module, name, code digest, docstring digest, names used, escapes, hazards) of each top-level unit; <module> holds the rest."""
    tree = ast.parse(text)
    # local names of what comes from modules that load others
    loaders = {local for _, local, _, origin, _ in imports_of(module, text) if local and origin.split(".")[0] in ESCAPE_MODULES}
    units: dict[str, list[ast.stmt]] = {"<module>": []}
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        names = [s.name] if isinstance(s, _DEFINITIONS) else [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
        for name in names or ["<module>"]:
            units.setdefault(name, []).append(s)
    out = []
    for name, body in units.items():
        docs = ast.get_docstring(body[0], clean=False) if len(body) == 1 and isinstance(body[0], _DEFINITIONS) else ast.get_docstring(tree, clean=False) if name == "<module>" else None
        used = {x.id for s in body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
        used |= {".".join(chain) for s in body for x in ast.walk(s) if isinstance(x, ast.Attribute) and (chain := _chain(x))}
        code = "\n".join(ast.dump(_without_docstrings(s)) for s in body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)))
        words = _words(body)
        out.append((module, name, _digest(code), _digest(docs or ""), sorted(used), sorted(words & (ESCAPES | ESCAPE_MODULES | loaders)), hazards_of(body)))
    return out


def imports_of(module: str, text: str) -> list[tuple[str, str, int, str, str]]:
    """(unit, local name, level, from module, name there) of each imported name; a module itself has no name there.

    level counts the leading dots of a relative import. `import a.b` binds a, and a.b is imported
    under no local name; a star import has the local name and the name *.
    """
    out = []
    tree = ast.parse(text)
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        names = [s.name] if isinstance(s, _DEFINITIONS) else [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
        for unit in names or ["<module>"]:
            for x in ast.walk(s):
                if isinstance(x, ast.Import):
                    for a in x.names:
                        out.append((unit, a.asname or a.name.split(".")[0], 0, a.name if a.asname else a.name.split(".")[0], ""))
                        if not a.asname and "." in a.name:
                            out.append((unit, "", 0, a.name, ""))
                elif isinstance(x, ast.ImportFrom):
                    out += [(unit, a.asname or a.name, x.level, x.module or "", a.name) for a in x.names]
    return out


def absolute_module(module: Column, is_package: Column, level: Column, origin: Column) -> Column:
    """The full name of the module that an import names; a package's own level is its name, another module's that of its package."""
    parts = F.split(module, r"\.")
    keep = F.greatest(F.lit(0), F.size(parts) - level + is_package.cast("int"))
    near = F.concat_ws(".", F.slice(parts, 1, keep), F.when(origin != "", F.array(origin)))
    return F.when(level == 0, origin).otherwise(near)


def _module_roots(units: DataFrame) -> DataFrame:
    return units.select("module").distinct()


def resolve(refs: DataFrame, units: DataFrame, bindings: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(src, dst) of refs (src, module, path): the unit ids that the dotted names path mean in a module, and the modules passed on the way.

    units: module, name. bindings: module, local, origin, name, all absolute. A name is a unit of the module, else a
    submodule of it, or what it is bound to there, to any depth of re-exports; a star binding stands for every name that the
    module does not have itself. A name that a known module lacks leads to that module's body. A frontier of
    distinct (where it began, module, rest of the path) moves on until nothing new is left, so cycles of imports end.
    """
    keys = refs.select("module", "path").distinct()
    # every round looks these tables up: they are shuffled, for a broadcast would pass through the driver each time
    apart = lambda df: df.hint("merge")
    known = cut(units.select("module", "name").distinct())
    roots = cut(_module_roots(known))
    bound = cut(bindings.where("local <> ''").select(F.col("module").alias("at"), F.col("local").alias("head"), "origin", F.col("name").alias("there")).distinct())
    star = bound.where("head = '*'").select("at", "origin")
    named = bound.where("head <> '*'")
    frontier = cut(keys.select(F.struct("module", "path").alias("key"), F.col("module").alias("at"), F.col("path").alias("rest")))
    seen, found = frontier, []
    for n in range(most_rounds):
        step = frontier.withColumn("head", F.get("rest", 0)).withColumn("tail", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))
        ended, going = step.where("head is null"), step.where("head is not null")
        own = going.join(apart(known.select(F.col("module").alias("at"), F.col("name").alias("head"))), ["at", "head"], "left_semi")
        rest = going.join(apart(known.select(F.col("module").alias("at"), F.col("name").alias("head"))), ["at", "head"], "left_anti")
        inner = rest.join(apart(roots.select(F.col("module").alias("sub"))), F.concat_ws(".", "at", "head") == F.col("sub")).select("key", F.col("sub").alias("at"), F.col("tail").alias("rest"))
        via = rest.join(apart(named), ["at", "head"]).select("key", F.col("origin").alias("at"), F.when(F.col("there") == "", F.col("tail")).otherwise(F.concat(F.array("there"), "tail")).alias("rest"))
        wide = rest.join(apart(named.select("at", "head")), ["at", "head"], "left_anti").join(apart(star), "at").select("key", F.col("origin").alias("at"), "rest")
        # the body of each module that is passed runs; a module without the name is where the search ends
        bodies = ended.select("key", "at").unionByName(rest.select("key", "at")).join(apart(roots.select(F.col("module").alias("at"))), "at", "left_semi")
        found.append(cut(own.select("key", F.concat_ws(":", "at", "head").alias("dst")).unionByName(bodies.select("key", F.concat_ws(":", "at", F.lit("<module>")).alias("dst"))).distinct()))
        moved = inner.unionByName(via).unionByName(wide).distinct()
        frontier = cut(moved.join(apart(seen), ["key", "at", "rest"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"names are not resolved after {most_rounds} rounds")
    targets = reduce(DataFrame.unionByName, found).distinct()
    return refs.join(apart(targets.select("key.module", "key.path", "dst")), ["module", "path"]).select("src", "dst").distinct()


def import_edges(imports: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst): units that import, to the bodies that this runs: of the modules they name, of the submodules they name, and of all packages above.

    imports: src, origin, name, absolute.
    """
    named = imports.select("src", F.explode(F.array("origin", F.when(F.col("name") != "", F.concat_ws(".", "origin", "name")).otherwise(F.col("origin")))).alias("m"))
    runs = named.select("src", F.split("m", r"\.").alias("p")).select("src", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", 1, k), "."))).alias("module")).distinct()
    return runs.join(_module_roots(units), "module", "left_semi").select("src", F.concat_ws(":", "module", F.lit("<module>")).alias("dst"))


def read_imports(files: DataFrame) -> DataFrame:
    """(module, unit, local, origin, name), absolute, of files (module, text, and is_package where it is known)."""
    package = F.col("is_package") if "is_package" in files.columns else F.lit(False)
    source = files.select("module", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(package, F.lit(False)).alias("is_package"))
    rows = source.mapInPandas(_parsed(lambda m, t: imports_of(m, t), ["unit", "local", "level", "origin", "name"], carry=["module", "is_package"]), "module string, is_package boolean, unit string, local string, level int, origin string, name string")
    return rows.select("module", "unit", "local", absolute_module(F.col("module"), F.col("is_package"), F.col("level"), F.col("origin")).alias("origin"), "name")


def _parsed(f, columns: list[str], carry: list[str] = ()):
    """f(module, text) for each row of files, a row for each that it gives, with columns of the file; files that do not parse give none."""

    def in_task(batches):
        for b in batches:
            rows = []
            for at, (m, t) in enumerate(zip(b["module"], b["text"], strict=True)):
                try:
                    rows += [(*(b[c].iloc[at] for c in carry), *r) for r in f(m, t or "")]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[*carry, *columns])

    return in_task


def extract_code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, edges) of files (module, text, and is_package where it is known). A file that does not parse gives no units.

    edges: (src, dst) of unit ids. A unit leads to what its names mean through imports and re-exports, to the bodies
    that its imports run, and to its own module's body; a body leads to those of the packages that hold it.
    """
    source = files.select("module", "text")
    units = source.mapInPandas(_parsed(units_of, ["module", "name", "digest", "doc_digest", "used", "escapes", "hazards"]), "module string, name string, digest string, doc_digest string, used array<string>, escapes array<string>, hazards array<string>").withColumn("unit_id", F.concat_ws(":", "module", "name"))
    ids = cut(units.select("unit_id", "module", "name"))
    imports = cut(read_imports(files))
    refs = units.select(F.col("unit_id").alias("src"), "module", F.explode("used").alias("ref")).select("src", "module", F.split("ref", r"\.").alias("path"))
    across = resolve(refs, ids, imports.select("module", "local", "origin", "name"))
    # a name that means nothing in its own module, a builtin for one, leads to that module's body, as every unit does
    runs = import_edges(imports.select(F.concat_ws(":", "module", "unit").alias("src"), "origin", "name"), ids)
    body = ids.where("name <> '<module>'").select(F.col("unit_id").alias("src"), F.concat_ws(":", "module", F.lit("<module>")).alias("dst"))
    above = import_edges(ids.where("name = '<module>'").select(F.col("unit_id").alias("src"), F.col("module").alias("origin"), F.lit("").alias("name")), ids)
    return units, across.unionByName(runs).unionByName(body).unionByName(above).where("src <> dst").distinct()


def hazards_in(units: DataFrame, reached: DataFrame) -> DataFrame:
    """(hazard): what the units that reached (node) names do; no more rows than there are HAZARDS."""
    inside = units.join(reached.select(F.col("node").alias("unit_id")).distinct(), "unit_id", "left_semi")
    return inside.select(F.explode("hazards").alias("hazard")).distinct()


def _refused(changes: DataFrame, hazards: DataFrame, by: dict[str, str]) -> DataFrame:
    """changes with refused: the hazard that defeats the proof of this change, else null."""
    refusals = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
    defeated = hazards.select("hazard").distinct().withColumn("_refused", F.col("hazard"))
    rows = changes.withColumn("hazard", refusals[F.col("change")]).join(F.broadcast(defeated), "hazard", "left")  # a row for each hazard at most
    return rows.withColumn("refused", F.col("_refused")).drop("hazard", "_refused")


def classify_comment_format(old: DataFrame, new: DataFrame, hazards: DataFrame) -> DataFrame:
    """(unit_id, change, refused) of units: comment_only, formatting_only (nothing but comments and layout can differ), code, added or removed.

    A comment may matter to reachable code that reads docstrings, and layout to code that reads sources; hazards (hazard) says so.
    """
    both = old.select("unit_id", F.col("digest").alias("a"), F.col("doc_digest").alias("da")).join(new.select("unit_id", F.col("digest").alias("b"), F.col("doc_digest").alias("db")), "unit_id", "full")
    changes = both.select("unit_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "code").when(F.col("da") != F.col("db"), "comment_only").otherwise("formatting_only").alias("change"))
    return _refused(changes, hazards, {"comment_only": "reads_docs", "formatting_only": "reads_source"})


def classify_unreachable(old: DataFrame, new: DataFrame, entries: DataFrame, new_units: DataFrame, changed: DataFrame, escapes: DataFrame) -> DataFrame:
    """One row (applies, refused, reason): whether changed units (node) can be reached in neither version of the graph (src, dst).

    Without an entry point in the new graph the class does not apply; with an escape in reach it is refused.
    """
    reached = reachable(old, entries).select("node").unionByName(reachable(new, entries).select("node")).distinct()
    n = lambda rows, among, name: among.select("node").distinct().join(rows.select("node").distinct(), "node", "left_semi").agg(F.count("node").alias(name))
    counts = n(entries, new_units, "entries").join(n(escapes, reached, "escapes")).join(n(changed, reached, "changed"))  # one row each
    reason = F.when(F.col("entries") == 0, "no entry point in the new graph").when(F.col("escapes") > 0, "reach is unsound").when(F.col("changed") > 0, "changed units can be reached").otherwise("ok")
    return counts.select(((F.col("entries") > 0) & ((F.col("escapes") > 0) | (F.col("changed") == 0))).alias("applies"), ((F.col("entries") > 0) & (F.col("escapes") > 0)).alias("refused"), reason.alias("reason"))


#: Methods of a logger that only log.
LOG_METHODS = {"debug", "info", "warning", "error", "exception", "critical", "log"}


def _loggers(tree: ast.Module) -> set[str]:
    """Names that the module binds to a logging.Logger at its top level, and that nothing else binds anywhere."""
    bound = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)]
    bound += [n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)] + [n.name for n in ast.walk(tree) if isinstance(n, _DEFINITIONS)]
    bound += [a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
    if bound.count("logging") != 1 or not any(isinstance(s, ast.Import) and any(a.name == "logging" and not a.asname for a in s.names) for s in tree.body):
        return set()
    made = {s.targets[0].id for s in tree.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call) and ast.dump(s.value.func) == ast.dump(ast.parse("logging.getLogger", mode="eval").body)}
    return {name for name in made if bound.count(name) == 1}


class _NoLogging(ast.NodeTransformer):
    """Drops statements that only log with plain arguments."""

    def __init__(self, loggers: set[str]):
        self.loggers = loggers

    def visit_Expr(self, node: ast.Expr) -> ast.AST | None:
        call = node.value
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in LOG_METHODS and isinstance(call.func.value, ast.Name) and call.func.value.id in self.loggers:
            # arguments that call something, or look into an object, may have effects, so such a statement stays
            plain = (ast.Constant, ast.Name, ast.Load, ast.Tuple, ast.List, ast.JoinedStr, ast.FormattedValue)
            if all(isinstance(x, plain) for a in [*call.args, *(k.value for k in call.keywords)] for x in ast.walk(a)):
                return None
        return node


def _private_names(tree: ast.AST) -> list[str]:
    """Top-level names with one leading underscore, in the order of their definitions."""
    return [s.name for s in getattr(tree, "body", []) if isinstance(s, _DEFINITIONS) and s.name.startswith("_") and not s.name.startswith("__")]


def renames_of(old: str, new: str) -> dict[str, str]:
    """Old and new name of each private definition that stands in the same place under another name."""
    a, b = _private_names(ast.parse(old)), _private_names(ast.parse(new))
    return {x: y for x, y in zip(a, b, strict=True) if x != y} if len(a) == len(b) else {}


def _renamed(tree: ast.Module, own: dict[str, str], there: dict[str, str]) -> ast.Module:
    """tree with its own private names and those that it takes from other modules renamed; names that an `as` gives stay."""
    local = dict(own)
    for x in ast.walk(tree):
        if isinstance(x, ast.ImportFrom):
            for a in x.names:
                if a.name in there:
                    if a.asname is None:
                        local[a.name] = there[a.name]
                    a.name = there[a.name]
    for x in ast.walk(tree):
        if isinstance(x, ast.Name):
            x.id = local.get(x.id, x.id)
        elif isinstance(x, ast.Attribute):
            x.attr = (own | there).get(x.attr, x.attr)
        elif isinstance(x, _DEFINITIONS):
            x.name = own.get(x.name, x.name)
    return tree


def change_of(old: str, new: str, there: dict[str, str] | None = None) -> str:
    """unchanged, logging_only, private_rename or code, for two versions of a source text.

    there: renames of private names of other modules, of which this one takes some.
    """
    a, b = ast.parse(old), ast.parse(new)
    there = there or {}
    if ast.dump(_without_docstrings(a)) == ast.dump(_without_docstrings(b)):
        return "unchanged"
    loggers = _loggers(a) & _loggers(b)
    bare = [ast.dump(_NoLogging(loggers).visit(ast.parse(x))) for x in (old, new)]
    if loggers and bare[0] == bare[1]:
        return "logging_only"
    own = renames_of(old, new)
    if (own or there) and "dispatches" not in {*hazards_of(a.body), *hazards_of(b.body)}:
        # a name that is renamed to one that the text has already, or that stands in a text constant, proves nothing
        taken = _words(a.body) | {x.name for x in ast.walk(a) if isinstance(x, _DEFINITIONS)} | {x.arg for x in ast.walk(a) if isinstance(x, ast.arg)}
        both = {*own.items(), *there.items()}
        if len({x for x, _ in both}) == len(both) and not taken & {y for _, y in both} and not any(isinstance(x, ast.Constant) and x.value in dict(both) for x in ast.walk(a)) and ast.dump(_renamed(a, own, there)) == ast.dump(b):
            return "private_rename"
    return "code"


def private_uses(module: str, text: str) -> list[tuple[str]]:
    """Private names that a text may take from elsewhere: imported, as attributes of what is not its own object, or in text constants."""
    tree = ast.parse(text)
    names = {x.attr for x in ast.walk(tree) if isinstance(x, ast.Attribute) and not (isinstance(x.value, ast.Name) and x.value.id in ("self", "cls"))}
    names |= {a.name for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) for a in x.names}
    names |= {x.value for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, str) and x.value.isidentifier()}
    return [(n,) for n in sorted(names) if n.startswith("_") and not n.startswith("__")]


def settle_renames(verdicts: DataFrame, uses: DataFrame) -> DataFrame:
    """(module, change) of verdicts (module, change), where a private rename counts only if it is proved in all modules that uses (owner, user) bind to it.

    An owner's rename and its users stand or fall together, through chains of uses as well: a user that is unchanged
    still takes the old name. Other classes stay as they are.
    """
    bad = verdicts.where("change <> 'private_rename'").select(F.col("module").alias("node"))
    links = uses.select(F.col("owner").alias("src"), F.col("user").alias("dst")).unionByName(uses.select(F.col("user").alias("src"), F.col("owner").alias("dst")))
    spoiled = reachable(links, bad).select(F.col("node").alias("module"), F.lit(True).alias("_spoiled"))
    rows = verdicts.join(spoiled, "module", "left")
    return rows.select("module", F.when((F.col("change") == "private_rename") & F.col("_spoiled"), "code").otherwise(F.col("change")).alias("change"))


def rename_uses(pairs: DataFrame) -> DataFrame:
    """(owner, user, old_name, new_name): private names of one module whose definition is renamed, and each other module that may take them.

    A user imports the name from any module, or has it as an attribute or in a text constant. Where such a name means
    another thing the rename is refused without need, never proved without ground.
    """
    both = pairs.select("module", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))

    def renamed(batches):
        for b in batches:
            rows = []
            for m, o, n in zip(b["module"], b["old"], b["new"], strict=True):
                try:
                    rows += [(m, x, y) for x, y in renames_of(o, n).items()]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["owner", "old_name", "new_name"])

    renames = cut(both.where("old <> new").mapInPandas(renamed, "owner string, old_name string, new_name string"))
    old = both.select("module", F.col("old").alias("text"))
    # the index of uses by name; only names that are renamed somewhere leave it
    used = old.mapInPandas(_parsed(private_uses, ["name"], carry=["module"]), "module string, name string")
    used = used.join(renames.select(F.col("old_name").alias("name")).distinct(), "name", "left_semi")
    return renames.join(used, (F.col("name") == F.col("old_name")) & (F.col("module") != F.col("owner"))).select("owner", F.col("module").alias("user"), "old_name", "new_name")


def classify_sources(pairs: DataFrame, hazards: DataFrame) -> DataFrame:
    """(module, change, refused) of pairs (module, old, new), one row for each module, unchanged ones too; sources that do not parse count as code.

    A private rename is proved over all modules together: every module that may take the name is verified with the
    rename, and one that is unchanged, or changed in another way, defeats it. Reachable code that spawns threads
    or processes defeats the proof of logging_only, and code that dispatches by name that of private_rename; hazards
    (hazard) says so.
    """

    def in_task(batches):
        for b in batches:
            out = []
            for o, n, there in zip(b["old"], b["new"], b["there"], strict=True):
                try:
                    renames = {r["old_name"]: r["new_name"] for r in there} if there is not None else {}
                    clear = there is None or len(renames) == len({(r["old_name"], r["new_name"]) for r in there})
                    out.append(change_of(o or "", n or "", renames) if clear else "code")
                except (SyntaxError, ValueError):
                    out.append("code")
            yield pd.DataFrame({"module": b["module"], "change": out})

    uses = cut(rename_uses(pairs))
    # no more than the private names that a module mentions
    there = uses.groupBy(F.col("user").alias("module")).agg(F.collect_set(F.struct("old_name", "new_name")).alias("there"))
    rows = pairs.select("module", "old", "new").join(there, "module", "left")
    verdicts = cut(rows.mapInPandas(in_task, "module string, change string"))
    return _refused(settle_renames(verdicts, uses), hazards, {"logging_only": "spawns", "private_rename": "dispatches"})
