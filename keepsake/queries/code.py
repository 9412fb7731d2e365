"""Queries of the code graph, over tables of names derived from parts, and of access traces, over logs derived from line items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions.tasks import dealt
from keepsake.operators import codegraph as op
from keepsake.operators import trace
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query("part", sql="""WITH RECURSIVE walk(k, here) AS (SELECT p_partkey, p_partkey FROM {part} WHERE p_partkey % 2 = 1 UNION SELECT k, cast(floor(here / 8) AS bigint) FROM walk WHERE here % 3 <> 0 AND here > 0)
SELECT concat('m', cast(k AS string), ':f') AS src, CASE WHEN here % 3 = 0 THEN concat('m', cast(here AS string), ':x') ELSE concat('m', cast(here AS string), ':<module>') END AS dst FROM walk WHERE here IN (SELECT p_partkey FROM {part})""")
def e12_resolve_names(part):
    """Every other module names x, which a third of the modules defines and the others take from the module of an eighth of their number."""
    k, m = F.col("p_partkey"), lambda c: F.concat(F.lit("m"), c.cast("string"))
    units = part.select(m(k).alias("module"), F.explode(F.when(k % 3 == 0, F.array(F.lit("<module>"), F.lit("x"))).otherwise(F.array(F.lit("<module>")))).alias("name"))
    bindings = part.where(k % 3 != 0).select(m(k).alias("module"), F.lit("x").alias("local"), m(F.floor(k / 8)).alias("origin"), F.lit("x").alias("name"))
    refs = part.where(k % 2 == 1).select(F.concat(m(k), F.lit(":f")).alias("src"), m(k).alias("module"), F.array(F.lit("x")).alias("path"))
    return op.resolve(refs, units, bindings)


@R.query("part", sql="""WITH k AS (SELECT p_partkey AS k FROM {part}),
deep AS (SELECT concat('a.b', cast(k % 9 AS string), '.c', cast(k AS string)) AS src, k FROM k)
SELECT concat(src, ':<module>') AS src, dst FROM (SELECT src, unnest([concat('a.b', cast(k % 9 AS string), ':<module>'), CASE WHEN k % 4 = 0 THEN concat('a.b', cast((k + 1) % 9 AS string), ':<module>') ELSE concat('a.b', cast(k % 9 AS string), ':<module>') END]) AS dst FROM deep) GROUP BY ALL""")
def e12_import_edges(part):
    """Modules of nine packages import from their own package, or every fourth from the next one; a package above all has no body."""
    k = F.col("p_partkey")
    package = lambda n: F.concat(F.lit("a.b"), (n % 9).cast("string"))
    module = F.concat(package(k), F.lit(".c"), k.cast("string"))
    units = part.select(F.explode(F.array(package(k), module)).alias("module")).distinct().withColumn("name", F.lit("<module>"))
    level = F.when(k % 4 == 0, 2).otherwise(1)
    raw = part.select(module.alias("module"), level.alias("level"), F.when(k % 4 == 0, F.concat(F.lit("b"), ((k + 1) % 9).cast("string"))).otherwise("").alias("origin"))
    imports = raw.select(F.concat("module", F.lit(":<module>")).alias("src"), op.absolute_module(F.col("module"), F.lit(False), F.col("level"), F.col("origin")).alias("origin"), F.lit("x").alias("name"))
    above = units.select(F.concat("module", F.lit(":<module>")).alias("src"), F.col("module").alias("origin"), F.lit("").alias("name")).where("contains(origin, 'c')")
    return op.import_edges(imports.unionByName(above), units).where("src <> dst")


@R.query("part", sql="""WITH RECURSIVE v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 'code' WHEN p_partkey % 5 = 0 THEN 'unchanged' ELSE 'private_rename' END AS change FROM {part}),
link AS (SELECT k AS a, k + 10 AS b FROM v WHERE k % 3 = 1 UNION ALL SELECT k + 10, k FROM v WHERE k % 3 = 1),
bad(k) AS (SELECT k FROM v WHERE change <> 'private_rename' UNION SELECT b FROM bad JOIN link ON bad.k = link.a)
SELECT k AS module, CASE WHEN change = 'private_rename' AND k IN (SELECT k FROM bad) THEN 'code' ELSE change END AS change FROM v""")
def j17_settle_renames(part):
    """Modules take a name from the module ten before, for a third of them; a module changed otherwise spoils what hangs together with it."""
    k = F.col("p_partkey")
    verdicts = part.select(k.alias("module"), F.when(k % 17 == 0, "code").when(k % 5 == 0, "unchanged").otherwise("private_rename").alias("change"))
    return op.settle_renames(verdicts, part.where(k % 3 == 1).select(k.alias("owner"), (k + 10).alias("user")))


_LINES = "(SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey % 50 AS d, l_suppkey AS f FROM {lineitem})"


@R.query("lineitem", sql=f"""WITH l AS {_LINES}
SELECT t AS trace_id, kind, ref, mode, count(*) AS n FROM (
  SELECT t, 'directory' AS kind, concat('/d', cast(d AS string)) AS ref, 'enumerate' AS mode FROM l
  UNION ALL SELECT t, 'file', CASE WHEN n % 3 = 0 THEN concat('f', cast(f AS string)) ELSE concat('/d', cast(d AS string), '/f', cast(f AS string)) END, 'read' FROM l
  UNION ALL SELECT t, 'file', CASE WHEN n % 3 = 0 THEN concat('f', cast(f AS string)) ELSE concat('/d', cast(d AS string), '/f', cast(f AS string)) END, 'read' FROM l WHERE n % 2 = 0
  UNION ALL SELECT t, 'file', concat('/d', cast(d AS string), '/up'), 'negative' FROM l
  UNION ALL SELECT t, 'subprocess', '/bin/x', 'execute' FROM l WHERE n % 4 = 0
  UNION ALL SELECT t, 'file', concat('/d', cast(d AS string), '/kept'), 'write' FROM l WHERE n % 4 <> 0) GROUP BY ALL""")
def j5_descriptors(lineitem):
    """A trace for each order: each item opens a directory and a file in it, in every third case in the workspace, forks, and in every fourth execs before it writes beside it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    size = lineitem.count() * 11  # lines of log at most
    rows = dealt(lineitem, "l_orderkey", rows=size).select(F.col("l_orderkey").alias("trace_id"), F.row_number().over(w).alias("n"), (F.col("l_partkey") % 50).cast("string").alias("d"), F.col("l_suppkey").cast("string").alias("f"))
    n = F.col("n")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pid, child = n.cast("string"), (n + 1000).cast("string")
    lines = F.array(
        text(pid, ' openat(AT_FDCWD, "/d', F.col("d"), '", O_RDONLY|O_DIRECTORY|O_CLOEXEC) = 3'),
        text(pid, F.when(n % 3 == 0, " openat(AT_FDCWD, ").otherwise(" openat(3, "), '"f', F.col("f"), '", O_RDONLY) = 4'),
        text(pid, " mmap(NULL, 10, PROT_READ, MAP_PRIVATE, ", F.when(n % 2 == 0, "4").otherwise("9"), ", 0) = 0x7f00"),
        text(pid, " close(4) = 0"),
        text(pid, " mmap(NULL, 10, PROT_READ, MAP_PRIVATE, 4, 0) = 0x7f00"),
        text(pid, " clone(child_stack=NULL, flags=SIGCHLD) = ", child),
        text(child, " fchdir(3) = 0"),
        text(child, ' openat(AT_FDCWD, "x/../up", O_RDONLY) = -1 ENOENT (No such file or directory)'),
        F.when(n % 4 == 0, text(child, ' execve("/bin/x", ["x", "a, b"], 0x7ff /* 3 vars */) = 0')),
        text(child, " dup2(3, 7) = 7"),
        text(child, ' openat(7, "kept", O_WRONLY|O_CREAT, 0644) = 5'),
    )
    logs = rows.select("trace_id", "n", F.posexplode(lines).alias("k", "line")).where("line is not null")
    events, _ = trace.join_resumed(trace.parse_trace(logs.select("trace_id", (F.col("n") * 100 + F.col("k")).alias("line_no"), "line")))
    found = trace.by_trace(trace.trace_accesses(events, "/work", size), size)
    return found.groupBy("trace_id", "kind", "ref", "mode").agg(F.count(F.lit(1)).alias("n"))
