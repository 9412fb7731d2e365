"""Names through packages, re-exports and relative imports; renames proved over all modules."""

import pytest
from pyspark.sql import functions as F

from keepsake.operators import codegraph
from keepsake.operators.lineage import reachable

FILES = {
    "demo": (True, "from .api import used as exported\nfrom . import late\n"),
    "demo.api": (False, "from .deep import *\nfrom .deep.core import used\n"),
    "demo.deep": (True, "from ..base import LIMIT\nfrom .core import star_name\n"),
    "demo.deep.core": (False, "from ...outside import gone\nfrom .. import base\nimport plugin\ndef used():\n    return base.LIMIT\ndef unused():\n    return 8\ndef star_name():\n    return 1\ndef far():\n    return gone()\n"),
    "demo.base": (False, "LIMIT = 3\nOTHER = 4\n"),
    "demo.late": (False, "import demo.deep.core\nimport demo.base as b\ndef f():\n    return demo.deep.core.far() + b.OTHER\n"),
    "demo.cycle": (False, "from .loop import x as y\ndef g():\n    return y\n"),
    "demo.loop": (False, "from .cycle import y as x\n"),
    "outside": (False, "def gone():\n    return eval('1')\n"),
    "plugin": (False, "STATE = print('loaded')\n"),
    "stage": (False, "from demo import exported, late\nfrom demo.api import star_name as s\ndef run():\n    return exported()\ndef other():\n    return late.f()\ndef starred():\n    return s()\ndef inner():\n    import plugin\n    return plugin.STATE\ndef missing():\n    import demo\n    return demo.nothing\n"),
    "broken": (False, "def ("),
}


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([(m, t, p) for m, (p, t) in FILES.items()], "module string, text string, is_package boolean")
    units, edges = codegraph.extract_code_graph(files)
    out = {}
    for r in edges.collect():
        out.setdefault(r.src, set()).add(r.dst)
    return units, edges, out


def reach(out, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += out.get(x, ())
    return seen


def test_relative_names_and_reexports(graph):
    _, _, out = graph
    assert "demo.deep.core:used" in out["stage:run"]
    assert "demo.deep.core:used" not in out["stage:other"] and "demo.late:f" in out["stage:other"]
    assert "demo.deep.core:star_name" in out["stage:starred"]
    assert {"demo.deep.core:far", "demo.base:OTHER"} <= out["demo.late:f"]
    assert "demo.base:LIMIT" in out["demo.deep.core:used"]
    assert {"demo.deep.core:unused", "stage:other"} & reach(out, "stage:run") == set()
    assert "outside:gone" in out["demo.deep.core:far"]


def test_imports_run_bodies(graph):
    _, _, out = graph
    assert "plugin:<module>" in out["demo.deep.core:<module>"]
    assert {"plugin:<module>", "plugin:STATE"} <= out["stage:inner"]
    assert {"demo:<module>", "demo.late:<module>"} <= out["stage:<module>"]
    assert {"demo.deep:<module>", "demo:<module>"} <= out["demo.deep.core:<module>"]  # packages above
    assert "demo:<module>" in out["stage:missing"]
    assert "plugin:<module>" in reach(out, "stage:run")


def test_cycles_and_levels(graph, spark):
    _, edges, out = graph
    assert {"demo.loop:<module>", "demo.cycle:<module>"} <= reach(out, "demo.cycle:g")
    made = spark.createDataFrame([("a.b.c", False, 0, "x.y", "x.y"), ("a.b.c", False, 1, "d", "a.b.d"), ("a.b.c", False, 2, "", "a"), ("a.b.c", False, 9, "z", "z"), ("a.b", True, 1, "c", "a.b.c"), ("a.b", True, 2, "c", "a.c"), ("m", False, 1, "n", "n")], "m string, p boolean, l int, o string, want string")
    assert made.where(codegraph.absolute_module(F.col("m"), F.col("p"), F.col("l"), F.col("o")) != F.col("want")).count() == 0
    reached = {r.node for r in reachable(edges, spark.createDataFrame([("stage:run",)], "node string")).collect()}
    assert reached == reach(out, "stage:run")


def test_escapes_through_packages(graph, spark):
    units, edges, _ = graph
    escapes = units.where("size(escapes) > 0").select(F.col("unit_id").alias("node"))
    assert {r.node for r in escapes.collect()} == {"outside:gone"}


def test_empty_graph(spark):
    units, edges = codegraph.extract_code_graph(spark.createDataFrame([], "module string, text string"))
    assert units.count() == edges.count() == 0


# --- private renames over all modules


def classify(spark, *pairs):
    none = spark.createDataFrame([], "hazard string")
    got = codegraph.classify_sources(spark.createDataFrame(list(pairs), "module string, old string, new string"), none)
    return {r.module: r.change for r in got.collect()}


OLD, NEW = "def _a(r):\n    return str(r)\n", "def _b(r):\n    return str(r)\n"


def test_rename_with_its_users(spark):
    user = "from m import _a\ndef run(rows):\n    return [_a(r) for r in rows]\n"
    assert classify(spark, ("m", OLD, NEW), ("n", user, user)) == {"m": "code", "n": "unchanged"}
    assert classify(spark, ("m", OLD, NEW), ("n", user, user.replace("_a", "_b"))) == {"m": "private_rename", "n": "private_rename"}
    assert classify(spark, ("m", OLD, NEW), ("n", user, user.replace("_a", "_b").replace("in rows", "in rows[1:]"))) == {"m": "code", "n": "code"}
    assert classify(spark, ("m", OLD, NEW), ("other", "x = 1\n", "x = 2\n")) == {"m": "private_rename", "other": "code"}


def test_rename_by_attribute_alias_and_text(spark):
    by_module = "import m\ndef run(r):\n    return m._a(r)\n"
    renamed = by_module.replace("_a", "_b")
    assert classify(spark, ("m", OLD, NEW), ("n", by_module, renamed)) == {"m": "private_rename", "n": "private_rename"}
    assert classify(spark, ("m", OLD, NEW), ("n", by_module, by_module))["m"] == "code"
    aliased = "from m import _a as fmt\ndef run(r):\n    return fmt(r)\n"
    assert classify(spark, ("m", OLD, NEW), ("n", aliased, aliased.replace("_a", "_b"))) == {"m": "private_rename", "n": "private_rename"}
    assert classify(spark, ("m", OLD, NEW), ("n", "NAMES = ['_a']\n", "NAMES = ['_a']\n"))["m"] == "code"
    own = "class C:\n    def f(self):\n        return self._a\n"
    assert classify(spark, ("m", OLD, NEW), ("n", own, own)) == {"m": "private_rename", "n": "unchanged"}


def test_renames_stand_or_fall_together(spark):
    middle = "from m import _a\ndef _c(r):\n    return _a(r)\n"
    last = "from k import _c\ndef g(r):\n    return _c(r)\n"
    done = ("k", middle, middle.replace("_a", "_b").replace("_c", "_d"))
    assert classify(spark, ("m", OLD, NEW), done, ("n", last, last.replace("_c", "_d"))) == {"m": "private_rename", "k": "private_rename", "n": "private_rename"}
    assert classify(spark, ("m", OLD, NEW), done, ("n", last, last)) == {"m": "code", "k": "code", "n": "unchanged"}


def test_two_renames_of_one_name(spark):
    user = "from m import _a\nfrom p import x\ndef run(r):\n    return _a(r)\n"
    got = classify(spark, ("m", OLD, NEW), ("p", OLD, OLD.replace("_a", "_z")), ("n", user, user.replace("_a", "_b")))
    assert got == {"m": "code", "p": "code", "n": "code"}  # which one n takes is not told apart, so nothing is proved
    assert classify(spark, ("m", "def (", "x"), ("n", None, None)) == {"m": "code", "n": "unchanged"}


def test_hazard_defeats_a_rename(spark):
    hazard = spark.createDataFrame([("dispatches",)], "hazard string")
    got = codegraph.classify_sources(spark.createDataFrame([("m", OLD, NEW)], "module string, old string, new string"), hazard).first()
    assert (got.change, got.refused) == ("private_rename", "dispatches")
