"""Snapshots on plain Parquet for several writers: replace, merge by key, upsert by date or name, append-only counters.

A snapshot is a folder with versions of its parts (most have one) and numbered manifests, each of which says which version of each
part holds. A change is written as new versions, then put into effect by the manifest of the next number, which is only made if nobody has
made it meanwhile. Whoever comes second reads the other's manifest, puts the change on top of it and takes the number after it; a
change that was computed from parts that the other has changed is computed anew (Conflict). Readers, and whatever comes after a
crash, see the newest manifest; a snapshot may be computed from itself.

What no manifest names any more goes GRACE after it was last written, so that neither a reader nor a job that is still writing loses a
file: no job may take longer between its first write and its manifest. A manifest becomes visible whole and once: by a hard link on
local disks, elsewhere by a rename that fails where its target exists, which HDFS does in one step. Stores without such a rename can't
have several writers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHOLE, TRIES = "", 200
#: Milliseconds; manifests that are kept in any case.
GRACE, KEPT = 7 * 24 * 3600 * 1000, 2
_MANIFEST = re.compile(r"_manifest-(\d{12})\.json")


class Conflict(Exception):
    """Somebody else has changed what a change was computed from."""


def _at(spark: SparkSession, path: str):
    """The path, qualified, and the file system that Spark uses for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def _listed(spark: SparkSession, path: str) -> list:
    p, fs = _at(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _manifests(found: list) -> dict[int, object]:
    names = {x: _MANIFEST.fullmatch(x.getPath().getName()) for x in found}
    return {int(m[1]): x for x, m in names.items() if m}


def _read(spark: SparkSession, p) -> dict[str, str]:
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The newest manifest's number, and part -> folder; 0 and nothing where there is no snapshot yet."""
    found = _manifests(_listed(spark, path))
    return (top := max(found), _read(spark, found[top].getPath())) if found else (0, {})


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """In one step, and only if there is no target."""
    jvm, (a, fs), (b, _) = spark.sparkContext._jvm, _at(spark, source), _at(spark, target)
    try:
        if a.toUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (b, a)])
            fs.delete(a, False)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, none)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            fs.delete(a, False)
            return False
        raise
    return True


def publish(spark: SparkSession, path: str, change: Callable[[dict[str, str]], dict[str, str]]) -> int:
    """Puts `change` of the newest manifest into effect, whatever number it gets in the end. `change` may raise Conflict."""
    root = path.rstrip("/")
    for _ in range(TRIES):
        number, now = newest(spark, root)
        p, fs = _at(spark, f"{root}/{uuid.uuid4().hex}.tmp")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(change(now)).encode()))
        finally:
            out.close()
        if renamed(spark, p.toString(), f"{root}/_manifest-{number + 1:012d}.json"):
            swept(spark, root)
            return number + 1
    raise Conflict(f"{TRIES} others were faster at {path}")


def swept(spark: SparkSession, path: str) -> None:
    """Removes old manifests, and versions that those left don't name, if nothing was written to them for GRACE."""
    found = _listed(spark, path)
    manifests, before = _manifests(found), spark.sparkContext._jvm.System.currentTimeMillis() - GRACE
    live: set[str] = set()
    for k, x in sorted(manifests.items(), reverse=True):
        successor = manifests.get(k + 1)
        if k > max(manifests) - KEPT or successor is None or successor.getModificationTime() >= before:
            try:
                live |= {v.split("/")[0] for v in _read(spark, x.getPath()).values()}
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileNotFoundException":  # then another writer swept it
                    raise
        else:
            _at(spark, path)[1].delete(x.getPath(), False)
    for x in found:
        name = x.getPath().getName()
        if (x.isDirectory() or name.endswith(".tmp")) and name not in live and x.getModificationTime() < before:
            _at(spark, path)[1].delete(x.getPath(), True)


def current(spark: SparkSession, path: str, schema: str | None = None, parts: list[str] | None = None, base: dict[str, str] | None = None) -> DataFrame | None:
    """The snapshot (`base`: as that manifest has it), or the parts of it that there are, or None where there is none."""
    now = newest(spark, path)[1] if base is None else base
    folders = [f"{path.rstrip('/')}/{f}" for k, f in sorted(now.items()) if parts is None or k in parts]
    if not folders:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def versions(df: DataFrame, path: str, by: str | None = None) -> dict[str, str]:
    """Writes `df` as a version of the whole, or (`by`) of the parts that this column, which is dropped, names: part -> folder. Nobody sees it
    until it is published."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    target = f"{path.rstrip('/')}/{version}"
    if by is None:
        df.write.parquet(target)
        return {WHOLE: version}
    df.write.partitionBy(by).parquet(target)
    names = [x.getPath().getName() for x in _listed(spark, target) if x.isDirectory()]
    return {name: f"{version}/{name}" for name in names if name.startswith(f"{by}=")}


def replace(df: DataFrame, path: str, by: str | None = None, base: dict[str, str] | None = None) -> None:
    """`df` as the snapshot; by: only in place of the parts that this column names, `by=value` each. base: the manifest that `df` was computed
    from; a Conflict if what is replaced has changed since."""
    fresh = versions(df, path, by)

    def change(now: dict[str, str]) -> dict[str, str]:
        if base is not None and (now != base if by is None else any(now.get(k) != base.get(k) for k in fresh)):
            raise Conflict(path)
        return (now if by else {}) | fresh

    publish(df.sparkSession, path, change)


def retried(step: Callable[[], None], times: int = TRIES) -> None:
    """Runs a step that reads a manifest, computes and replaces, anew as long as others are faster."""
    for k in range(times):
        try:
            return step()
        except Conflict:
            if k == times - 1:
                raise


def upserted(existing: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of those with their keys; the others stay."""
    if existing is None:
        return new
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """On top of what holds when it is put into effect: another writer's rows of other keys stay."""

    def step() -> None:
        base = newest(new.sparkSession, path)[1]
        replace(upserted(current(new.sparkSession, path, base=base), new, keys), path, base=base)

    retried(step)


def merge_keys(new: DataFrame, path: str, key: str = "range_key") -> None:
    """Each key is a part of its own: a job replaces those that it brings and leaves the others' alone, also those that are published while
    it runs."""
    replace(new.withColumn("part__", F.col(key)), path, by="part__")


def merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The schema keeps keys such as 1D from being read as numbers."""
    return current(spark, path, schema)


def configs_saved(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, params, saved_at, ord) after saves (params) and deletions (params null): a known name keeps its place, new ones follow
    in order of their change. Of several changes to a name the last counts."""
    last = changes.groupBy("name").agg(F.max_by(F.struct("params", "saved_at", F.col("ord").alias("at")), "ord").alias("c"))
    top = existing.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    rows = existing.join(last, "name", "full").crossJoin(F.broadcast(top))  # one row by construction
    rows = rows.where("c is null or c.params is not null")
    out = rows.select("name", F.coalesce("c.params", "params").alias("params"), F.coalesce("c.saved_at", "saved_at").alias("saved_at"), "ord", F.col("c.at").alias("at"), "top")
    new = F.col("top") + F.row_number().over(Window.orderBy("at"))  # the new ones of one run, no others
    kept, added = out.where("ord is not null"), out.where("ord is null").withColumn("ord", new)
    return kept.unionByName(added).drop("at", "top")


def trimmed(counts: DataFrame, days: int = 90) -> DataFrame:
    """An append-only log of (d, calls), summed by day, the newest days kept."""
    return counts.groupBy("d").agg(F.sum("calls").alias("calls")).orderBy(F.desc("d")).limit(days)


SUMMED = "summed"


def append(calls: DataFrame, path: str) -> None:
    """Adds (d, calls) to a log. Each append is a part of its own, so writers neither read nor wait for each other."""
    (version,) = versions(calls.select(F.col("d").cast("date").alias("d"), F.col("calls").cast("long").alias("calls")), path).values()
    publish(calls.sparkSession, path, lambda now: now | {f"log={version}": version})


def compact(spark: SparkSession, path: str, days: int = 90) -> None:
    """One part with a row a day for the newest days, in place of the parts that there are now; what is appended meanwhile stays beside it."""

    def step() -> None:
        base = newest(spark, path)[1]
        if not base:
            return
        (version,) = versions(trimmed(logged(spark, path, base), days), path).values()

        def change(now: dict[str, str]) -> dict[str, str]:
            if any(now.get(k) != v for k, v in base.items()):  # another compaction was faster
                raise Conflict(path)
            return {k: v for k, v in now.items() if k not in base} | {SUMMED: version}

        publish(spark, path, change)

    retried(step)


def logged(spark: SparkSession, path: str, base: dict[str, str] | None = None) -> DataFrame:
    """The rows of a log, summed or not."""
    found = current(spark, path, "d date, calls long", base=base)
    return spark.createDataFrame([], "d date, calls long") if found is None else found
