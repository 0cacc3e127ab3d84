"""Splits that keep related records together (problem 1).

Records that share a source, in whatever spelling, or are linked by any chain of such sources form a
component; a component goes to one split as a whole.

Method: a component table (node, root, split) is kept as parquet. An increment joins its links to the
roots known so far, contracts the graph of roots by min-hooking and pointer jumping, and writes the
next version. Components that had a split keep it, new ones fill the deficits of the splits, and a
merge of components from different splits is quarantined.

Defined cases: a null or blank spelling is no source; a record without any source is a component of
its own; repeated rows count as rows; an empty table gives empty results.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.runtime import bounded_rows, cut, shared_dir, stored

TARGETS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
QUARANTINE = "quarantine"
#: A size class with more components is cut into rank buckets of about this many.
RANK_BUCKET = 200_000

# The forms in which the sources write kinds of school and levels.
KINDS = {
    "high school": ("high school", "high sch", "hs", "h s"),
    "academy": ("academy", "acad"),
    "university": ("university", "univ", "u"),
    "college": ("college", "coll", "col"),
}
LEVELS = {
    "state": ("state finals", "state final", "states", "state"),
    "national": ("nationals", "national", "natls", "natl", "nats", "nat"),
    "regional": ("regionals", "regional", "regs", "reg"),
    "invitational": ("invitationals", "invitational", "invites", "invite", "invits", "invit", "invs", "inv"),
}


def _finder(forms: dict[str, tuple[str, ...]]) -> tuple[re.Pattern, dict[str, str]]:
    back = {form: name for name, all_forms in forms.items() for form in all_forms}
    longest_first = sorted(back, key=len, reverse=True)
    return re.compile(r"(?<!\w)(" + "|".join(map(re.escape, longest_first)) + r")(?!\w)"), back


_KIND, _KIND_OF = _finder(KINDS)
_LEVEL, _LEVEL_OF = _finder(LEVELS)
_NUMBERED = re.compile(r"(batch|notebook)\W*?0*(\d+)")
_DIVISION = re.compile(r"(?<!\w)(?:division|div)\W*([a-z])(?!\w)|\(\s*([a-z])\s*\)")
_YEAR = re.compile(r"(?<![\w])((?:19|20)\d\d)(?!\w)|['’`](\d\d)(?!\w)")


def source_key(spelling: str) -> str:
    """Canonical key of a source spelling.

    Schools: name, kind, year, level and division. Batches and notebooks: kind and number. Any other
    text: its letters and digits, case disregarded.
    """
    text = re.sub(r"[\s_]+", " ", unicodedata.normalize("NFKC", spelling).casefold()).strip()
    if m := _NUMBERED.fullmatch(text):
        return f"{m[1]}#{int(m[2])}"
    rest = text
    found = {}
    for part, pattern in (("division", _DIVISION), ("year", _YEAR)):
        if m := pattern.search(rest):
            found[part] = m[1] or m[2]
            rest = rest[: m.start()] + " " + rest[m.end() :]
    rest = re.sub(r"[^\w\s]+", " ", rest.replace(".", ""))
    rest = re.sub(r"\s+", " ", rest).strip()
    for part, pattern, back in (("level", _LEVEL, _LEVEL_OF), ("kind", _KIND, _KIND_OF)):
        if m := pattern.search(rest):
            found[part] = back[m[1]]
            rest = re.sub(r"\s+", " ", rest[: m.start()] + " " + rest[m.end() :]).strip()
    if rest and len(found) == 4:
        year = found["year"]
        if len(year) == 2:
            year = ("19" if int(year) >= 50 else "20") + year
        return "|".join(("school", rest, found["kind"], year, found["level"], found["division"]))
    return "text|" + re.sub(r"[\W_]+", " ", text).strip()


def trimmed(value: F.Column) -> F.Column:
    """Outer white space of any kind removed; blank becomes null."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def record_spellings(problems: DataFrame) -> DataFrame:
    """(problem_id, spelling_a, spelling_b): the two spellings a record bears; either may be null."""
    second = F.get(F.split(F.col("problem_source"), r"\|", -1), F.lit(1))
    return problems.select("problem_id", "ingested_at", trimmed(F.col("olympiad_source")).alias("spelling_a"), trimmed(second).alias("spelling_b"))


def spelling_keys(records: DataFrame) -> DataFrame:
    """(spelling, key, node) of every distinct spelling; keys are computed once a spelling, not once a row."""

    def keyed(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(key=[source_key(s) for s in batch["spelling"]])

    spellings = records.select(F.explode(F.array("spelling_a", "spelling_b")).alias("spelling")).where("spelling is not null").distinct()
    return spellings.mapInPandas(keyed, "spelling string, key string").withColumn("node", F.xxhash64("key"))


def contract(links: DataFrame, max_rounds: int = 60) -> DataFrame | None:
    """(node, root) for every linked node whose root is another one; root is the least node of its component.

    Each round hooks every root to its least linked root (an aggregation with map-side combining),
    jumps pointers until that forest is flat, and contracts the links to links of roots.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        if links.isEmpty():
            return labels
        hooks = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # pointer jumping: depth halves each time
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = cut(jumped)
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = cut(moved.unionByName(hooks))
        map_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        map_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = links.join(map_a, "a", "left").join(map_b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        links = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    raise RuntimeError("components did not settle")


def quotas(classes: list[tuple[int, int]], deficits: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For every size class (size, how many), from the largest size, how many components each split gets.

    Equals giving the components one by one to the split with the largest deficit, without the loop
    over components: the level that the deficits sink to is found by bisection.
    """
    left = dict(deficits)
    out: dict[int, list[tuple[str, int]]] = {}
    for size, count in sorted(classes, reverse=True):
        low, high = min(left.values()) - size * (count + 1), max(left.values())
        for _ in range(200):
            level = (low + high) / 2
            if sum(max(0, int(-((level - d) // size))) for d in left.values()) > count:
                low = level
            else:
                high = level
        take = {k: max(0, int(-((high - d) // size))) for k, d in left.items()}
        for k in take:
            left[k] -= take[k] * size
        for _ in range(max(0, count - sum(take.values()))):
            k = max(left, key=lambda x: left[x])
            take[k] += 1
            left[k] -= size
        out[size] = [(k, n) for k, n in take.items() if n]
    return out


def fill_splits(components: DataFrame, targets: Iterable[tuple[str, float]] = TARGETS) -> DataFrame:
    """(root, rows, split): components with a split keep it, the others fill the deficits.

    ``components`` has (root, rows, split). Only the histogram of sizes comes to the driver: n rows
    have at most sqrt(2 n) distinct sizes. Within a size, components are ranked by hash in buckets.
    """
    targets = list(targets)
    spark = components.sparkSession
    held = {r["split"]: r["rows"] for r in bounded_rows(components.where("split is not null").groupBy("split").agg(F.sum("rows").alias("rows")), 100, "splits")}
    new = components.where("split is null")
    classes = [(r["rows"], r["n"]) for r in bounded_rows(new.groupBy("rows").agg(F.count("*").alias("n")), 1_000_000, "sizes of components")]
    total = sum(s * n for s, n in classes) + sum(n for k, n in held.items() if k != QUARANTINE)
    chosen = quotas(classes, {k: share * total - held.get(k, 0) for k, share in targets})
    # bucket sizes give each component a global rank within its size without one task per size
    wide = {s: max(1, -(-n // RANK_BUCKET)) for s, n in classes}
    sizes = spark.createDataFrame([(s, w) for s, w in wide.items()] or [(0, 1)], "rows long, width int")
    ranked = new.drop("split").join(F.broadcast(sizes), "rows").withColumn("bucket", F.pmod(F.xxhash64("root", F.lit(7)), "width").cast("int"))
    per = bounded_rows(ranked.groupBy("rows", "bucket").agg(F.count("*").alias("n")), 2_000_000, "rank buckets")
    starts, at = [], {}
    for r in sorted(per, key=lambda r: (r["rows"], r["bucket"])):
        starts.append((r["rows"], r["bucket"], at.get(r["rows"], 0)))
        at[r["rows"]] = at.get(r["rows"], 0) + r["n"]
    bounds = []
    for size, parts in chosen.items():
        lo = 0
        for k, n in parts:
            bounds.append((size, lo, lo + n, k))
            lo += n
    starts_df = spark.createDataFrame(starts or [(0, 0, 0)], "rows long, bucket int, start long")
    bounds_df = spark.createDataFrame(bounds or [(0, 0, 0, "")], "rows long, lo long, hi long, split string")
    order = Window.partitionBy("rows", "bucket").orderBy(F.xxhash64("root", F.lit(11)), "root")
    placed = ranked.join(F.broadcast(starts_df), ["rows", "bucket"]).withColumn("rank", F.col("start") + F.row_number().over(order) - 1)
    placed = placed.join(F.broadcast(bounds_df), "rows").where("rank >= lo and rank < hi").select("root", "rows", "split")
    return components.where("split is not null").select("root", "rows", "split").unionByName(placed)


class ComponentTable:
    """Persisted (node, root, split) table; ``add`` takes one increment of records.

    ``records`` has (record_id, node_a, node_b), either node may be null. After ``add``, ``members``
    has (record_id, root, split) of that increment and ``table`` all nodes seen so far. With ``path``, a
    folder of the table's versions, a later job goes on from the last whole one; one job at a time may add.
    """

    def __init__(self, spark: SparkSession, targets: Iterable[tuple[str, float]] = TARGETS, path: str | None = None):
        self.spark, self.targets, self.path, self.version = spark, list(targets), path, 0
        schema = "node long, root long, rows long, split string"
        whole = self._versions() if path else []
        if whole:
            self.version = max(whole)
            self.table = spark.read.schema(schema).parquet(self._at(self.version))
        else:
            self.table = spark.createDataFrame([], schema)

    def _at(self, version: int) -> str:
        return f"{self.path.rstrip('/')}/v{version:09d}"

    def _versions(self) -> list[int]:
        """Versions that were written to their end, on any file system."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return [int(n[1:]) for n in names if re.fullmatch(r"v\d{9}", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{n}/_SUCCESS"))]

    def _store(self, table: DataFrame) -> DataFrame:
        """The next version of the table; without ``path`` a folder of this session."""
        if not self.path:
            return stored(table, "components")
        self.version += 1
        table.write.mode("overwrite").parquet(self._at(self.version))  # over a version that was broken off
        return self.spark.read.schema(table.schema).parquet(self._at(self.version))

    def joined(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(record_id, a, b) of an increment, and (node, root, rows, split) of all nodes with it; splits are those held so far."""
        # a record without a source is a node of its own
        records = records.select("record_id", F.coalesce("node_a", "node_b", F.xxhash64(F.lit("record"), "record_id")).alias("a"), F.coalesce("node_b", "node_a", F.xxhash64(F.lit("record"), "record_id")).alias("b"))
        linked = cut(records.groupBy("a", "b").agg(F.count("*").alias("rows")))
        nodes = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = self.table.select("node", F.col("root").alias("old_root"))
        known_a = known.withColumnRenamed("node", "a").withColumnRenamed("old_root", "ra")
        known_b = known.withColumnRenamed("node", "b").withColumnRenamed("old_root", "rb")
        root_links = linked.join(known_a, "a", "left").join(known_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        labels = contract(root_links)
        fresh = nodes.join(known, "node", "left_anti").select("node", F.col("node").alias("old"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("split"))
        everything = self.table.select("node", F.col("root").alias("old"), "rows", "split").unionByName(fresh)
        if labels is not None:
            everything = everything.join(labels.select(F.col("node").alias("old"), F.col("root").alias("new")), "old", "left").withColumn("root", F.coalesce("new", "old"))
        else:
            everything = everything.withColumn("root", F.col("old"))
        # rows are counted at the node that comes first of a record
        counted = linked.groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("more"))
        everything = everything.join(counted, "node", "left").select("node", "root", (F.col("rows") + F.coalesce("more", F.lit(0))).alias("rows"), "split")
        return records, cut(everything)

    def add(self, records: DataFrame) -> DataFrame:
        records, everything = self.joined(records)
        # splits that differ within one component: conflicting merge
        roots = everything.groupBy("root").agg(F.sum("rows").alias("rows"), F.min("split").alias("least"), F.max("split").alias("most"))
        roots = cut(roots.select("root", "rows", F.when(F.col("least") != F.col("most"), QUARANTINE).otherwise(F.col("least")).alias("split")))
        splits = fill_splits(roots, self.targets).select("root", "split")
        self.table = self._store(everything.drop("split").join(splits, "root").select("node", "root", "rows", "split"))
        return records.join(self.table.select(F.col("node").alias("a"), "root", "split"), "a").select("record_id", "root", "split")


def as_records(spelled: DataFrame, keys: DataFrame) -> DataFrame:
    """(record_id, node_a, node_b) of records with their spellings."""
    a = keys.select(F.col("spelling").alias("spelling_a"), F.col("node").alias("node_a"))
    b = keys.select(F.col("spelling").alias("spelling_b"), F.col("node").alias("node_b"))
    return spelled.join(a, "spelling_a", "left").join(b, "spelling_b", "left").select(F.col("problem_id").alias("record_id"), "node_a", "node_b", "ingested_at")


def split_records(problems: DataFrame, increments: int = 1) -> DataFrame:
    """(problem_id, component, split); with more than one increment, rows come in order of ``ingested_at``."""
    spelled = record_spellings(problems)
    records = cut(as_records(spelled, cut(spelling_keys(spelled))))
    store = ComponentTable(problems.sparkSession)
    if increments == 1:
        out = store.add(records)
        return out.select(F.col("record_id").alias("problem_id"), F.format_string("%016x", "root").alias("component"), "split")
    return first_and_now([store.add(part) for part in arrivals(records, increments)], store)


def arrivals(records: DataFrame, increments: int) -> list[DataFrame]:
    """Records in spans of ``ingested_at`` of equal length; those without a time come last."""
    seconds = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    lo, hi = records.agg(F.min(seconds), F.max(seconds)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // increments + 1)
    part = F.coalesce(F.least(((seconds - F.lit(lo or 0)) / width).cast("int"), F.lit(increments - 1)), F.lit(increments - 1))
    return [records.where(part == i) for i in range(increments)]


def first_and_now(out: list[DataFrame], store: ComponentTable) -> DataFrame:
    """(problem_id, component, increment, split_first, split_now): what a record got when it came, and what its component has now."""
    done = None
    for i, o in enumerate(out):
        one = o.withColumn("increment", F.lit(i))
        done = one if done is None else done.unionByName(one)
    nodes = store.table.select(F.col("node").alias("root"), F.col("root").alias("root_now"), F.col("split").alias("split_now"))
    return done.join(nodes, "root").select(F.col("record_id").alias("problem_id"), F.format_string("%016x", "root_now").alias("component"), "increment", F.col("split").alias("split_first"), "split_now")


def split_in_jobs(problems: DataFrame) -> DataFrame:
    """``first_and_now`` of two jobs: the second opens the table that the first left in a folder, and adds the later half."""
    spark = problems.sparkSession
    spelled = record_spellings(problems)
    records = cut(as_records(spelled, cut(spelling_keys(spelled))))
    path = f"{shared_dir(spark).rstrip('/')}/component-table-{uuid.uuid4().hex}"
    early, late = arrivals(records, 2)
    first = cut(ComponentTable(spark, path=path).add(early))
    later = ComponentTable(spark, path=path)
    return first_and_now([first, later.add(late)], later)


def named_sources(problems: DataFrame) -> DataFrame:
    """(source, root): every spelling with the component that denotes its source; splits are not needed for it."""
    spelled = record_spellings(problems)
    keys = cut(spelling_keys(spelled))
    both = spelled.select("spelling_a", "spelling_b").distinct()
    both = both.withColumn("problem_id", F.xxhash64("spelling_a", "spelling_b")).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    _, nodes = ComponentTable(problems.sparkSession).joined(as_records(both, keys).where("node_a is not null or node_b is not null"))
    return cut(keys.join(nodes.select("node", "root"), "node").select(F.col("spelling").alias("source"), "root"))


def source_members(problems: DataFrame) -> DataFrame:
    """(source, component, spellings): one row per spelling, whose class may be of any size."""
    named = named_sources(problems)
    sizes = named.groupBy("root").agg(F.count("*").alias("spellings"))
    return named.join(sizes, "root").select("source", F.format_string("%016x", "root").alias("component"), "spellings")


def same_sources(problems: DataFrame) -> DataFrame:
    """(source_a, source_b): different spellings of one source, the smaller by code point first; all pairs, as the query asks."""
    named = named_sources(problems)
    a, b = named.withColumnRenamed("source", "source_a"), named.withColumnRenamed("source", "source_b")
    return a.join(b, "root").where("source_a < source_b").select("source_a", "source_b")
