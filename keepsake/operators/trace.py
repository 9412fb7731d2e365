"""Access-trace analytics over tables of log lines (trace_id, line_no, line)."""

from __future__ import annotations

import codecs
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keepsake.functions.tasks import TASK_ROWS

#: System calls after which a trace cannot be complete, and those of sockets.
LOSS_CALLS = ["io_uring_setup", "io_uring_enter", "io_uring_register", "ptrace", "process_vm_readv", "process_vm_writev", "memfd_create"]
SOCKET_CALLS = ["socket", "connect", "bind", "listen", "accept", "accept4", "sendto", "recvfrom", "sendmsg", "recvmsg"]
#: Reasons that mean that part of a trace is lost.
LOSS_REASONS = ["tracer_died", "trace_truncated", "trace_empty_or_missing", "missing_top_level_exit_record", "exit_status_disagreement", "unparseable_exit_status", "orphan_resumed_line", "truncated_unfinished", "unparsed"]
_PID = r"^(\d+)\s+"
_CALL = _PID + r"(\w+)\((.*)\)\s*=\s*(.+)$"
#: The parts of a whole call, one a line; none has a line break, as "." stops there.
_PARTS = "$1\n$2\n$4\n$3\n"


def parse_trace(lines: DataFrame) -> DataFrame:
    """lines with pid, kind (syscall, exit, killed, unfinished, resumed, unparsed), name, args and ret; blank lines go."""
    line, found = F.rtrim(F.col("line")), F.col("_found")
    # one pattern takes a whole call apart; a line that it leaves as it was is no whole call
    whole, call = found != line, F.split(found, "\n", 5)
    # a plain search for a part of each pattern comes first, as most lines are whole calls
    has = lambda part, p: line.contains(part) & line.rlike(_PID + p)
    kind = (
        F.when(has("<unfinished", r".*<unfinished\s+\.\.\.>$"), "unfinished")
        .when(has("resumed>", r"<\.\.\.\s+\S+\s+resumed>"), "resumed")
        .when(whole, "syscall")
        .when(has("killed", r"\+\+\+\s+killed\s+by\s+\S+\s+\+\+\+$"), "killed")
        .when(has("exited", r"\+\+\+\s+exited\s+with\s+-?\d+\s+\+\+\+$"), "exit")
        .otherwise("unparsed")
    )
    part = lambda p, g: F.regexp_extract(line, p, g)
    k, parts = F.col("kind"), F.col("_parts")
    pid = F.when(k == "syscall", parts[0].cast("long")).when(k != "unparsed", part(_PID, 1).cast("long")).otherwise(-1)
    name = F.when(k == "syscall", parts[1]).when(k == "resumed", part(r"<\.\.\.\s+(\S+)\s+resumed>", 1)).otherwise(k)
    args = F.when(k == "syscall", parts[3]).when(k == "killed", part(r"killed\s+by\s+(\S+)", 1)).when(k == "unfinished", part(_PID + r"(.*?)\s*<unfinished\s+\.\.\.>$", 2)).when(k == "resumed", part(r"resumed>(.*)$", 1)).otherwise("")
    ret = F.when(k == "syscall", F.trim(parts[2])).when(k == "exit", part(r"exited\s+with\s+(-?\d+)", 1)).otherwise("")
    rows = lines.where(F.trim("line") != "").withColumn("_found", F.regexp_replace(line, _CALL, _PARTS)).withColumn("kind", kind).withColumn("_parts", F.when(whole, call))
    # exploded, the columns are made once a line: conditions on them would otherwise repeat the patterns before
    made = {"kind": k, "pid": pid, "name": name, "args": args, "ret": ret}
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in made]
    return rows.select(*kept, F.explode(F.array(F.struct(*[v.alias(c) for c, v in made.items()]))).alias("_made")).select(*kept, "_made.*")


def join_resumed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with each resumed call put together, reasons (trace_id, reason)) by looking one line back in each process."""
    w = Window.partitionBy("trace_id", "pid").orderBy("line_no")
    # the plain search spares the patterns of lines that are whole, which are read in the other branch
    halves = parsed.where((F.col("line").contains("<unfinished") | F.col("line").contains("resumed>")) & F.col("kind").isin("unfinished", "resumed"))
    halves = halves.withColumn("_head", F.when(F.lag("kind").over(w) == "unfinished", F.lag("args").over(w))).withColumn("_next", F.lead("kind").over(w))
    body = F.concat(F.col("pid").cast("string"), F.lit("  "), F.col("_head"), F.when(F.col("args").rlike(r"\)\s*="), F.lit("")).otherwise(F.lit(")")), F.col("args"))
    joined = parse_trace(halves.where("kind = 'resumed' and _head is not null").select("trace_id", "line_no", body.alias("line")))
    orphans = halves.where("kind = 'resumed' and _head is null").select("trace_id", F.lit("orphan_resumed_line").alias("reason"))
    cut_off = halves.where("kind = 'unfinished' and coalesce(_next, '') <> 'resumed'").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", F.concat(F.lit("truncated_unfinished:"), F.col("n").cast("string")).alias("reason"))
    bad = parsed.where("kind = 'unparsed'").select("trace_id", F.concat(F.lit("unparsed:"), F.substring("line", 1, 80)).alias("reason"))
    whole = parsed.where(~F.col("kind").isin("unfinished", "resumed")).select("trace_id", "line_no", "line", "kind", "pid", "name", "args", "ret")
    return whole.unionByName(joined.select(*whole.columns)), orphans.unionByName(cut_off).unionByName(bad).distinct()


def reconcile_exit(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """(trace_id, exit_code, reason): the first exit record against the supervisor's status."""
    first = events.where("kind = 'exit'").groupBy("trace_id").agg(F.min_by("ret", "line_no").cast("int").alias("exit_code"))
    killed = events.where("kind = 'killed'").select("trace_id").distinct().withColumn("_killed", F.lit(True))
    rows = statuses.join(first, "trace_id", "left").join(killed, "trace_id", "left")
    reason = F.when(F.col("exit_code").isNull(), F.when(F.col("_killed"), "top_level_killed_without_exit_code").otherwise("missing_top_level_exit_record")).when((F.col("status") >= 0) & (F.col("exit_code") != F.col("status")), "exit_status_disagreement")
    return rows.select("trace_id", "exit_code", reason.alias("reason"))


#: System calls by what they do to descriptors, directories and paths.
FORK_CALLS = ("clone", "clone3", "fork", "vfork")
DUP_CALLS = ("dup", "dup2", "dup3")
OPEN_CALLS = ("open", "openat", "openat2", "creat")
PATH_CALLS = ("stat", "lstat", "access", "readlink", "execve", "rename", "unlink", "mkdir", "rmdir", "truncate", "chdir", "open", "creat")
AT_CALLS = ("openat", "openat2", "newfstatat", "statx", "faccessat", "faccessat2", "readlinkat", "renameat", "renameat2", "unlinkat", "mkdirat", "execveat")
DESCRIPTOR_CALLS = ("fstat", "getdents", "getdents64", "fchdir")
FOLDED_CALLS = sorted({*FORK_CALLS, *DUP_CALLS, *PATH_CALLS, *AT_CALLS, *DESCRIPTOR_CALLS, "mmap", "fcntl", "close", "close_range"})
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:\.\.\.)?|[(\[{]|[)\]}]|,|[^",()\[\]{}]+|.', re.S)
_DESCRIPTOR = re.compile(r"(-?\d+)(?:<([^>]*)>)?$")


#: Fixed value: texts that a worker remembers for each helper, as calls repeat.
KEPT = 1 << 16


@lru_cache(KEPT)
def arguments(text: str) -> tuple[str, ...]:
    """The arguments of a call: split at commas outside quotes and brackets."""
    out, depth = [""], 0
    for token in _TOKEN.findall(text):
        depth += (token in "([{") - (token in ")]}")
        if token == "," and depth <= 0:
            out.append("")
        else:
            out[-1] += token
    return tuple(x.strip() for x in out)


@lru_cache(KEPT)
def quoted(token: str) -> str | None:
    """The text of a quoted argument; null for one that the log cut short, and for others."""
    if len(token) < 2 or token[0] != '"' or token[-1] != '"':
        return None
    return codecs.escape_decode(token[1:-1].encode())[0].decode("utf-8", "replace") if "\\" in token else token[1:-1]


@lru_cache(KEPT)
def descriptor(token: str) -> tuple[int | None, str | None]:
    """Number and noted path of a descriptor; no number for the current directory and for what is none."""
    found = _DESCRIPTOR.match(token)
    return (int(found[1]), found[2] or None) if found else (None, None)


@lru_cache(KEPT)
def _joined(base: str, path: str) -> str:
    return posixpath.normpath(posixpath.join(base, path))


def _inside(path: str, root: str | None) -> str:
    if root is None or not path.startswith(root):
        return path
    above = root.rstrip("/") + "/"
    if path != root and not path.startswith(above):
        return path
    # what is normal already only loses its beginning
    return path[len(above) :] if path != root and "//" not in path and "/." not in path and path[-1] != "/" else posixpath.relpath(path, root)


class Call:
    """What the texts of a call say by themselves; a worker reads equal calls once."""

    __slots__ = ("args", "at", "closes", "does", "name", "noted", "number", "ok", "text", "value")

    def __init__(self, name: str, args: str, ret: str):
        self.name, self.args = name, (*arguments(args), *[""] * 6)
        (self.value, self.noted), self.ok = descriptor(ret.split(" ")[0]), not ret.startswith("-1")
        self.number, self.closes = descriptor(self.args[0])[0], "O_CLOEXEC" in ",".join(self.args[1:])
        self.does, self.at, self.text = Process.DOES.get(name), None, None
        if self.does is Process.named:
            self.at, token = (self.args[0], self.args[1]) if name in AT_CALLS else (None, self.args[0])
            self.text = self.noted if name in OPEN_CALLS and self.noted is not None else quoted(token)
        if name == "fcntl":
            self.does = Process.copy if self.args[1].startswith("F_DUPFD") else Process.mark if self.args[1] == "F_SETFD" else None


@lru_cache(KEPT)
def call_of(name: str, text: str, ret: str) -> Call:
    return Call(name, text, ret)


class Process:
    """What a process has open: path and close-on-exec by number; and where it is, in a list that processes may share.

    What a call does to descriptors and directories is a method, which returns the path or paths that the call is about.
    """

    __slots__ = ("cwd", "files")

    def __init__(self, cwd: list, files: dict):
        self.cwd, self.files = cwd, files

    def child(self, flags: str) -> Process:
        return Process(self.cwd if "CLONE_FS" in flags else list(self.cwd), self.files if "CLONE_FILES" in flags else dict(self.files))

    def path_of(self, token: str) -> str | None:
        """What a descriptor is open on, else what the log notes beside it."""
        number, noted = descriptor(token)
        return self.files.get(number, (noted, False))[0]

    def absolute(self, path: str | None, at: str | None = None) -> str | None:
        """path under the directory of the descriptor `at` or the current one; null if that descriptor is unknown."""
        if path is None or path.startswith("/"):
            return path and _joined("", path)
        base = self.path_of(at) if at is not None and descriptor(at)[0] is not None else self.cwd[0] or ""
        return None if base is None else _joined(base, path)

    def copy(self, call: Call) -> tuple[str | None, str | None]:
        args, source = call.args, self.path_of(call.args[0])
        if call.ok and call.value is not None and source is not None:
            self.files[call.value] = (source, self.files.get(call.number, (None, False))[1] or "CLOEXEC" in args[1] + args[2])
        return None, None

    def mark(self, call: Call) -> tuple[str | None, str | None]:
        if call.ok and call.number in self.files:
            self.files[call.number] = (self.files[call.number][0], "FD_CLOEXEC" in call.args[2])
        return None, None

    def close(self, call: Call) -> tuple[str | None, str | None]:
        self.files.pop(call.number, None)
        return None, None

    def close_range(self, call: Call) -> tuple[str | None, str | None]:
        args = call.args
        if args[0].isdigit() and args[1].lstrip("~").isdigit():
            last = int(args[1]) if args[1].isdigit() else 1 << 32
            for number in [n for n in self.files if int(args[0]) <= n <= last]:
                del self.files[number]
        return None, None

    def described(self, call: Call) -> tuple[str | None, str | None]:
        path = self.path_of(call.args[4 if call.name == "mmap" else 0])
        if call.name == "fchdir" and call.ok and path is not None:
            self.cwd[0] = path
        return path, None

    def rename(self, call: Call) -> tuple[str | None, str | None]:
        args = call.args
        two = ((None, args[0]), (None, args[1])) if call.name == "rename" else ((args[0], args[1]), (args[2], args[3]))
        return tuple(self.absolute(quoted(p), at) for at, p in two)

    def named(self, call: Call) -> tuple[str | None, str | None]:
        name, path = call.name, self.absolute(call.text, call.at)
        if name == "chdir" and call.ok and path is not None:
            self.cwd[0] = path
        elif name in ("execve", "execveat") and call.ok:
            self.files = {n: f for n, f in self.files.items() if not f[1]}
        elif name in OPEN_CALLS and call.ok and call.value is not None and path not in (None, "/dev/urandom", "/dev/random"):
            self.files[call.value] = (path, call.closes)
        return path, None

    DOES = {**dict.fromkeys([*PATH_CALLS, *AT_CALLS], named), **dict.fromkeys(("rename", "renameat", "renameat2"), rename), **dict.fromkeys((*DESCRIPTOR_CALLS, "mmap"), described), **dict.fromkeys(DUP_CALLS, copy), "close": close, "close_range": close_range}


def by_trace(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with each trace in one task; rows: about how many lines the traces have, if known, which says how many tasks."""
    if rows is not None and (n := -(-rows // TASK_ROWS)) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(n, "trace_id")
    return df.repartition("trace_id")


def resolve_calls(events: DataFrame, workspace: str | None = None, beside: tuple[str, ...] = (), rows: int | None = None, silent: bool = True) -> DataFrame:
    """(trace_id, line_no, name, args, ret, path, second): what each call is about, by the descriptors and directories of its process.

    A trace's calls are folded in the order of its lines, in sorted streams: a task holds the descriptors of one
    trace's processes and one batch of lines. A new process shares its parent's descriptors or directory, or has copies, as
    the flags of clone say; exec closes what is marked so. Paths that the log notes beside descriptors count where
    the fold does not know better. workspace: where processes begin; paths inside it are given relative to it.
    Without it, a relative path of a process that has not changed directory stays relative. beside: other calls to pass
    through in the same reading of the events, without a path. rows: about how many events there are, if known, so that
    they are dealt out to as many tasks as they need. silent: whether calls come back that are about no known path and open none.
    """
    root = None if workspace is None else posixpath.normpath(workspace)

    others = set(beside)
    telling = pa.array([*beside, *OPEN_CALLS])

    def in_task(batches: Iterator[pa.RecordBatch]):
        trace, processes = object(), {}
        for batch in batches:
            coded = [batch.column(c).dictionary_encode("encode") for c in ("trace_id", "pid", "name", "args", "ret")]
            (traces, *values), (places, *codes) = zip(*((d.dictionary.to_pylist(), d.indices.to_numpy()) for d in coded), strict=True)
            columns = [map(v.__getitem__, k.tolist()) for v, k in zip(values, codes, strict=True)]
            begins = np.diff(places, prepend=-1) != 0
            if len(begins):
                begins[0], trace = traces[places[0]] != trace, traces[places[-1]]
            paths, seconds = [None] * len(begins), [None] * len(begins)
            for n, (new, pid, name, args, ret) in enumerate(zip(begins.tolist(), *columns, strict=True)):
                if new:
                    processes = {}
                process = processes.get(pid)
                if process is None:
                    process = processes[pid] = Process([root], {})
                if name in others:
                    continue
                if name in FORK_CALLS:
                    child = descriptor(ret)[0]
                    if child is not None and child >= 0:
                        processes[child] = process.child(args)
                elif (call := call_of(name, args, ret)).does is not None:
                    path, second = call.does(process, call)
                    if path is not None:
                        paths[n] = _inside(path, root)
                    if second is not None:
                        seconds[n] = _inside(second, root)
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string()), pa.array(seconds, pa.string())], names=[*batch.schema.names, "path", "second"])
            yield made if silent else made.filter(pc.or_(pc.or_(made.column("path").is_valid(), made.column("second").is_valid()), pc.is_in(made.column("name"), telling)))

    few = events.where((F.col("kind") == "syscall") & F.col("name").isin(*FOLDED_CALLS, *beside))
    few = few.select("trace_id", F.col("line_no").cast("long").alias("line_no"), F.col("pid").cast("long").alias("pid"), "name", "args", "ret")
    ordered = by_trace(few, rows).sortWithinPartitions("trace_id", "line_no")
    kinds = StructType([*few.schema.fields, StructField("path", StringType()), StructField("second", StringType())])
    return ordered.mapInArrow(in_task, kinds).drop("pid")


def trace_accesses(events: DataFrame, workspace: str | None = None, rows: int | None = None) -> DataFrame:
    """(trace_id, line_no, kind, ref, mode): what each call touched, by resolve_calls().

    A call about a descriptor that nobody has opened, or a path that the log cut short, touches nothing that is
    known. An open of random bytes and getrandom are reads of a device; a mapped file is read.
    """
    calls = resolve_calls(events, workspace, (*SOCKET_CALLS, "getrandom"), rows, silent=False)
    ok, name, path = ~F.col("ret").startswith("-1"), F.col("name"), F.col("path")
    entry = lambda kind, ref, mode: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(mode).alias("mode"))
    one = lambda kind, mode: F.array(entry(kind, path, mode))
    says = lambda *parts: reduce(Column.__or__, [F.col("args").contains(p) for p in parts])
    missing = F.col("ret").startswith("-1 ENOENT") | F.col("ret").startswith("-1 ENOTDIR")
    opened = (
        F.when(says("/dev/urandom", "/dev/random"), F.array(entry("device", F.lit("device:urandom"), "read")))
        .when(missing, one("file", "negative"))
        .when(ok & (says("O_WRONLY", "O_RDWR", "O_CREAT", "O_TRUNC", "O_APPEND") | (name == "creat")), one("file", "write"))
        .when(ok & says("O_DIRECTORY"), one("directory", "enumerate"))
        .when(ok, one("file", "read"))
    )
    # a probe that shows another kind of file than a regular one reads none
    probed = F.when(missing, one("file", "negative")).when(ok & (says("S_IFREG") | ~says("S_IF")), one("file", "read"))
    # most lines of a log are opens and maps
    found = (
        F.when(name.isin(*OPEN_CALLS), opened)
        .when(name == "mmap", F.when(ok, one("file", "read")))
        .when(name.isin("stat", "lstat", "newfstatat", "statx", "access", "faccessat", "faccessat2", "fstat"), probed)
        .when(name.isin("readlink", "readlinkat"), F.when(missing | F.col("ret").startswith("-1 EINVAL"), one("file", "negative")).when(ok, one("file", "symlink")))
        .when((name == "execve") & missing, one("file", "negative"))
        .when(name.isin("execve", "execveat"), F.when(ok, one("subprocess", "execute")))
        .when(name.isin("getdents", "getdents64"), F.when(ok, one("directory", "enumerate")))
        .when(name.isin("rename", "renameat", "renameat2"), F.when(ok, F.array(entry("file", path, "write"), entry("file", F.col("second"), "write"))))
        .when(name.isin("unlink", "unlinkat", "mkdir", "mkdirat", "rmdir", "truncate"), F.when(ok, one("file", "write")))
        .when(name.isin(SOCKET_CALLS), F.array(entry("socket", name, "network")))
        .when(name == "getrandom", F.array(entry("device", F.lit("device:getrandom"), "read")))
    )
    return calls.select("trace_id", "line_no", F.explode(found).alias("a")).select("trace_id", "line_no", "a.*").where("ref is not null")


def resolve_versions(accesses: DataFrame, manifest: DataFrame) -> DataFrame:
    """accesses with version: the manifest's sha256 by path, or absent for negative ones."""
    known = manifest.select(F.col("path").alias("ref"), "sha256")
    return accesses.join(known, "ref", "left").withColumn("version", F.when(F.col("mode") == "negative", "absent").otherwise(F.col("sha256"))).drop("sha256")


def dedup_resources(resources: DataFrame) -> DataFrame:
    """One row for each (trace_id, kind, ref, mode): system calls beat the companion, content hashes beat symlinks, else the last."""
    w = Window.partitionBy("trace_id", "kind", "ref", "mode").orderBy(F.when(F.col("source") == "syscall", 0).otherwise(1), F.when(F.col("resolver") == "symlink", 1).otherwise(0), F.desc("line_no"))
    return resources.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def prune_resources(resources: DataFrame, private_root: str) -> DataFrame:
    """Without inputs under the private root, and without negatives of what the trace also read, executed or listed."""
    own = F.col("ref").startswith(private_root.rstrip("/") + "/") & (F.col("mode") != "write")
    positive = resources.where(F.col("mode").isin("read", "execute", "enumerate")).select("trace_id", "ref").distinct()
    negative = resources.where((F.col("mode") == "negative") & ~own).join(positive, ["trace_id", "ref"], "left_anti")
    return resources.where((F.col("mode") != "negative") & ~own).unionByName(negative.select(*resources.columns))


def coverage(traces: DataFrame, events: DataFrame, accesses: DataFrame, reasons: DataFrame, output_root: str) -> DataFrame:
    """(trace_id, state, reasons): the first of trace loss, lost calls, network, outside writes, platform and shadow that fits.

    traces: trace_id, platform_ok, image_pinned, contract.
    """
    lost = F.lit(False)
    for r in LOSS_REASONS:
        lost = lost | F.col("reason").contains(r)
    why = reasons.groupBy("trace_id").agg(F.bool_or(lost).alias("_lost"), F.array_sort(F.collect_set("reason")).alias("_why"))
    calls = events.groupBy("trace_id").agg(F.bool_or(F.col("name").isin(LOSS_CALLS)).alias("_calls"))
    seen = accesses.groupBy("trace_id").agg(F.bool_or(F.col("mode") == "network").alias("_net"), F.bool_or((F.col("mode") == "write") & ~F.col("ref").startswith(output_root)).alias("_out"))
    rows = traces.join(why, "trace_id", "left").join(calls, "trace_id", "left").join(seen, "trace_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad_platform = ~F.col("platform_ok") | (~F.col("image_pinned") & (F.col("contract") != "shadow"))
    state = F.when(yes("_lost") | yes("_calls"), "INCOMPLETE_TRACE_LOSS").when(yes("_net"), "INCOMPLETE_NETWORK").when(yes("_out"), "INCOMPLETE_WRITE").when(bad_platform, "INCOMPLETE_PLATFORM").otherwise("SHADOW_UNQUALIFIED")
    reason = F.when(yes("_lost"), "trace_loss").when(yes("_calls"), "coverage_trigger").when(yes("_net"), "socket_activity").when(yes("_out"), "write_outside_declared_output").when(~F.col("platform_ok"), "unsupported_platform").when(bad_platform, "image_not_pinned").when(F.col("contract") == "shadow", "shadow_contract").otherwise("observation_alone")
    return rows.select("trace_id", state.alias("state"), F.array_distinct(F.concat(F.coalesce("_why", F.array().cast("array<string>")), F.array(reason))).alias("reasons"))


def declared_coverage(contract: Column, observed: Column) -> Column:
    """The state under a named contract: declared ones upgrade what is not incomplete; the shadow contract never does."""
    complete = observed.startswith("COMPLETE")
    kept = observed.startswith("INCOMPLETE") | (observed == "NONDETERMINISTIC")
    return F.when(contract == "shadow", F.when(complete, "SHADOW_UNQUALIFIED").otherwise(observed)).when(kept, observed).when(contract.isin("deterministic-file", "jsonl-map"), "COMPLETE_DECLARED").otherwise(observed)


def semantic_resources(resources: DataFrame) -> DataFrame:
    """Files, directories and subprocesses inside the workspace; no virtual environment and no module labels."""
    ref = F.col("ref")
    outside = ref.startswith("/") | ref.rlike("^.:") | ref.startswith("py-module:") | (ref == ".venv") | ref.startswith(".venv/")
    return resources.where(F.col("kind").isin("file", "directory", "subprocess") & ~outside)


def merge_companion(resources: DataFrame, companion: DataFrame) -> DataFrame:
    """resources and those of the companion log that they lack."""
    key = ["trace_id", "kind", "ref", "mode"]
    return resources.unionByName(companion.join(resources.select(*key), key, "left_anti").select(*resources.columns))


def resolve_inputs(observations: DataFrame, inputs: DataFrame, manifest: DataFrame, newest: int = 8) -> DataFrame:
    """(semantic_key, observation_id): of each key's newest observations the first whose inputs all match the manifest.

    observations: observation_id, semantic_key, created_at. inputs: observation_id, path, version (absent: must not exist).
    """
    w = Window.partitionBy("semantic_key").orderBy(F.desc("created_at"), F.desc("observation_id"))
    few = observations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= newest)
    now = inputs.join(manifest.select("path", "sha256"), "path", "left").groupBy("observation_id").agg(F.bool_and(F.col("version").eqNullSafe(F.coalesce("sha256", F.lit("absent")))).alias("same"))
    good = few.join(now, "observation_id", "left").where("coalesce(same, true)")
    return good.groupBy("semantic_key").agg(F.min_by("observation_id", "place").alias("observation_id"))


def detect_drift(predicted: DataFrame, actual: DataFrame, network: DataFrame) -> DataFrame:
    """(trace_id, drift): network activity, an input that was not predicted, or changed inputs; null if none."""
    both = predicted.select("trace_id", "ref", F.col("version").alias("_p"), F.lit(True).alias("_in_p")).join(actual.select("trace_id", "ref", F.col("version").alias("_a"), F.lit(True).alias("_in_a")), ["trace_id", "ref"], "full")
    per = both.groupBy("trace_id").agg(F.bool_or(F.col("_in_p").isNull()).alias("hidden"), F.bool_or(F.col("_in_a").isNull() | ~F.col("_p").eqNullSafe(F.col("_a"))).alias("changed"))
    rows = per.join(network.select("trace_id").distinct().withColumn("_net", F.lit(True)), "trace_id", "full")
    return rows.select("trace_id", F.when(F.col("_net"), "network").when(F.col("hidden"), "hidden_input").when(F.col("changed"), "changed_inputs").alias("drift"))


def validate_traces(resources: DataFrame) -> DataFrame:
    """(trace_id, ref, problem): negatives that exist, inputs that are absent, and repeated identities."""
    key = ["trace_id", "kind", "ref", "mode"]
    negative = (F.col("mode") == "negative") != F.coalesce(F.col("version") == "absent", F.lit(False))
    twice = resources.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trace_id", "ref", F.lit("repeated").alias("problem"))
    return resources.where(negative).select("trace_id", "ref", F.lit("absence").alias("problem")).unionByName(twice)


def downstream_only_config(changed: DataFrame, reads: DataFrame) -> DataFrame:
    """(stage, verdict, overlap): whether the changed keys are disjoint from what a stage read."""
    hit = reads.join(changed.select("key").distinct(), "key", "left_semi").groupBy("stage").agg(F.array_sort(F.collect_set("key")).alias("overlap"))
    return reads.select("stage").distinct().join(hit, "stage", "left").select("stage", F.when(F.col("overlap").isNull(), "downstream_only").otherwise("affected").alias("verdict"), F.coalesce("overlap", F.array().cast("array<string>")).alias("overlap"))
