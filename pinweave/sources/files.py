"""Hypergraph, fixed, partition, graph and case files.

Files may lie in any store that Hadoop knows. A hypergraph file is a header ``m n [fmt]``, m lines of 1-based vertices (led by the
edge's weight unless fmt is 0 or 10), then up to n vertex weights, whatever fmt says;
blank weight lines are skipped and missing weights are 1. Lines get their numbers from
byte offsets, so files are read in splits like any other input.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from pinweave.model import Hypergraph
from pinweave.operators.ordered import ordered
from pinweave.runtime import Scratch

UNWEIGHTED = ("0", "10")
NO_PARTS = -1


def _store(spark: SparkSession, path: str):
    """The file system and path of a name in any store that Hadoop knows; a bare name is a local one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path if ":/" in path else f"file:{os.path.abspath(path)}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return bool(fs.exists(p))


class _Writer:
    """A text file in any store, written in blocks."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = _store(spark, path)
        self.out, self.held, self.size = fs.create(p, True), [], 0

    def line(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text) + 1
        if self.size > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write(bytearray(("\n".join(self.held) + "\n").encode()))
        self.held, self.size = [], 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.flush()
        self.out.close()


def parse_hypergraph(lines):
    """Rows ``(kind, id, pos, value)``: 'e' an edge's weight, 'p' a pin, 'v' a vertex weight; ids from 0."""
    lines = iter(lines)
    head = next(lines, None)
    if head is None:
        raise ValueError("empty hypergraph file")
    head = head.split()
    if len(head) < 2:
        raise ValueError("a hypergraph file begins with 'edges vertices [format]'")
    m, n = int(head[0]), int(head[1])
    led = (head[2] if len(head) > 2 else "0") not in UNWEIGHTED
    for e in range(m):
        line = next(lines, None)
        if line is None:
            raise ValueError(f"the file ends at edge {e} of {m}")
        numbers = [int(t) for t in line.split()]
        weight = numbers.pop(0) if led and numbers else 1
        yield "e", e, 0, weight
        for pos, v in enumerate(numbers):
            if not 1 <= v <= n:
                raise ValueError(f"edge {e} names vertex {v} of {n}")
            yield "p", e, pos, v - 1
    v = 0
    for line in lines:
        if v == n:
            break
        if line.strip():
            yield "v", v, 0, int(line.split()[0])
            v += 1
    for rest in range(v, n):
        yield "v", rest, 0, 1


class _HgrReader(DataSourceReader):
    def __init__(self, lines: list[str], kind: str):
        self.lines, self.kind = lines, kind

    def read(self, partition):
        if self.kind == "hgr":
            yield from parse_hypergraph(self.lines)
        else:
            for i, x in enumerate(line.split()[0] for line in self.lines if line.strip()):
                yield "v", i, 0, int(x)


class HgrSource(DataSource):
    """``spark.read.format("hgr").option("kind", "hgr" or "labels").load(path)`` for local files; the readers below take any store."""

    @classmethod
    def name(cls):
        return "hgr"

    def schema(self):
        return "kind string, id long, pos int, value long"

    def reader(self, schema):
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        with gzip.open(path, "rt") if path.endswith(".gz") else open(path) as f:
            return _HgrReader([line.rstrip("\r\n") for line in f], self.options.get("kind", "hgr"))


def read_labels(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """``(v, part)`` of a partition, hint or fixed file: one number a line, blank lines skipped."""
    scratch = scratch or Scratch(spark, "labels")
    lines = read_lines(spark, path, scratch).where("trim(line) <> ''")
    return ordered(lines, ["line_no"], scratch, rank="v").select("v", F.split(F.trim("line"), r"\s+")[0].cast("int").alias("part"))


def read_hypergraph(spark: SparkSession, path: str, fixed: str | None = None, keep_repeats: bool = False, scratch: Scratch | None = None) -> Hypergraph:
    """A hypergraph file in any store and, if given, its fixed file; repeated pins of an edge count once unless kept."""
    scratch = scratch or Scratch(spark, "hypergraph")
    h = read_large_hypergraph(spark, path, scratch, keep_repeats)
    if fixed is None:
        return h
    held = read_labels(spark, fixed, scratch).withColumnRenamed("part", "fixed")
    return h.with_(vertices=h.vertices.drop("fixed").join(held, "v", "left").select("v", "vwt", F.coalesce("fixed", F.lit(-1)).alias("fixed")))


def read_lines(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``(line_no, line)`` of a text file in any store that Spark reads, split like any other input: byte offsets order the lines."""
    rows = spark.sparkContext.newAPIHadoopFile(path if ":/" in path else f"file:{os.path.abspath(path)}", "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return ordered(spark.createDataFrame(rows, "at long, line string"), ["at"], scratch, rank="line_no").select("line_no", "line")


def read_large_hypergraph(spark: SparkSession, path: str, scratch: Scratch, keep_repeats: bool = False) -> Hypergraph:
    """Lines are numbered by byte offset and parsed in parallel, so a file may be of any size."""
    lines = scratch.keep(read_lines(spark, path, scratch), "lines")
    head = lines.where("line_no = 0").first()
    if head is None:
        raise ValueError("empty hypergraph file")
    numbers = head["line"].split()
    if len(numbers) < 2:
        raise ValueError("a hypergraph file begins with 'edges vertices [format]'")
    m, n, led = int(numbers[0]), int(numbers[1]), (numbers[2] if len(numbers) > 2 else "0") not in UNWEIGHTED
    if lines.agg(F.max("line_no")).first()[0] < m:
        raise ValueError(f"the file ends before edge {m}")
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")
    edges = lines.where(F.col("line_no").between(1, m)).select((F.col("line_no") - 1).alias("e"), F.transform(tokens, lambda t: t.cast("long")).alias("t"))
    hwt = F.when(F.lit(led) & (F.size("t") > 0), F.try_element_at("t", F.lit(1))).otherwise(1).cast("long")
    pins = edges.select("e", F.posexplode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))) if led else F.col("t")).alias("pos", "v")).select("e", "pos", (F.col("v") - 1).alias("v"))
    if pins.where((F.col("v") < 0) | (F.col("v") >= n)).limit(1).count():
        raise ValueError(f"an edge names a vertex outside 1..{n}")
    pins = pins if keep_repeats else pins.groupBy("e", "v").agg(F.min("pos").alias("pos")).select("e", "pos", "v")
    given = lines.where((F.col("line_no") > m) & (F.trim("line") != "")).select("line_no", F.split(F.trim("line"), r"\s+")[0].cast("long").alias("w"))
    given = ordered(given, ["line_no"], scratch, rank="v").where(F.col("v") < n).select("v", "w")
    vertices = spark.range(n).withColumnRenamed("id", "v").join(given, "v", "left").select("v", F.coalesce("w", F.lit(1)).alias("vwt"), F.lit(-1).alias("fixed"))
    return Hypergraph(vertices, edges.select("e", hwt.alias("hwt")), pins)


def read_partition_if_valid(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """A partition file if it is there and has n rows."""
    if not exists(spark, path):
        return None
    rows = read_labels(spark, path)
    return rows if rows.count() == n else None


def read_method_marker(spark: SparkSession, path: str) -> str:
    """The first line of a marker file, '' if there is none."""
    if not exists(spark, path):
        return ""
    first = spark.read.text(path if ":/" in path else f"file:{os.path.abspath(path)}").first()
    return first["value"].strip() if first else ""


def _in_order(batches):
    """The lines of the only writer's rows ``(_k, _o, line)``; an error where they do not ascend."""
    last = (-1, -1)
    for batch in batches:
        k, o = batch.column("_k").to_numpy(), batch.column("_o").to_numpy()
        if len(k):
            if (int(k[0]), int(o[0])) < last or ((k[1:] < k[:-1]) | ((k[1:] == k[:-1]) & (o[1:] < o[:-1]))).any():
                raise ValueError("lines out of order")
            last = (int(k[-1]), int(o[-1]))
        yield batch.select(["line"])


def _write_lines(df: DataFrame, path: str, head: list[str], order: str, text: str = "line", more: DataFrame | None = None) -> None:
    """A positional file has one writer: Spark sorts the rows and one task writes the sorted ranges one after the other.

    The driver only names the file. ``more(order, line)`` comes after all else. Should
    ranges ever reach the task in another order, the task sorts them itself.
    """
    spark = df.sparkSession
    place = lambda rows, k, o, x: rows.select(F.lit(k).alias("_k"), F.col(o).cast("long").alias("_o"), F.col(x).alias("line"))
    rows = place(df, 1, order, text)
    if head:
        rows = place(spark.createDataFrame(list(enumerate(head)), "o long, line string").coalesce(1), 0, "o", "line").union(rows)
    if more is not None:
        rows = rows.union(place(more, 2, more.columns[0], more.columns[1]))
    fs, p = _store(spark, path)
    jvm, parts = spark.sparkContext._jvm, f"{p.toString()}-{uuid.uuid4().hex}"
    try:
        rows.orderBy("_k", "_o").coalesce(1).mapInArrow(_in_order, "line string").write.text(parts)
    except PythonException as error:
        if "lines out of order" not in str(error):
            raise
        rows.repartition(1).sortWithinPartitions("_k", "_o").select("line").write.mode("overwrite").text(parts)
    made = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if f.getPath().getName().startswith("part-")]
    fs.delete(p, False)
    fs.mkdirs(p.getParent())
    if not (fs.rename(made[0], p) if made else fs.createNewFile(p)):
        raise OSError(f"{path} could not be written")
    fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def write_partition(partition: DataFrame, path: str) -> None:
    _write_lines(partition.select("v", F.coalesce("part", F.lit(NO_PARTS)).cast("string").alias("line")), path, [], "v")


def write_hypergraph(h: Hypergraph, path: str, vwt_plus_one: bool = False) -> None:
    """Always with both kinds of weights (format 11); ``vwt_plus_one`` adds 1 to all vertex weights if any is above 1."""
    n, m = h.vertices.count(), h.hyperedges.count()
    key = F.struct("pos", "v") if "pos" in h.pins.columns else F.struct(F.col("v").alias("pos"), "v")
    pins = h.pins.groupBy("e").agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: (s["v"] + 1).cast("string")).alias("vs"))
    edges = h.hyperedges.join(pins, "e", "left").select("e", F.concat_ws(" ", F.col("hwt").cast("string"), "vs").alias("line"))
    add = int(vwt_plus_one and h.vertices.where("vwt > 1").limit(1).count() > 0)
    _write_lines(edges, path, [f"{m} {n} 11"], "e", more=h.vertices.select("v", (F.col("vwt") + add).cast("string").alias("line")))


def metis_weight(w):
    """floor, within 0 and the largest 32-bit number; 0 for what is not finite."""
    sound = w.isNotNull() & ~F.isnan(w) & (F.abs(w) < F.lit(float("inf")))
    return F.when(sound, F.least(F.greatest(F.floor(w), F.lit(0)), F.lit(2147483647))).otherwise(0).cast("long")


def write_metis_graph(graph: DataFrame, vertices: DataFrame, path: str) -> None:
    """``n m 001``, then each vertex's neighbours with whole weights; loops are left out."""
    links = graph.where("u <> v")
    both = links.select("u", "v", "w").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    near = both.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", metis_weight(F.col("w")).alias("w")))).alias("x"))
    text = F.concat_ws(" ", F.transform("x", lambda s: F.concat_ws(" ", (s["v"] + 1).cast("string"), s["w"].cast("string"))))
    rows = vertices.select("v").join(near.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce(text, F.lit("")).alias("line"))
    _write_lines(rows, path, [f"{vertices.count()} {links.count()} 001"], "v")


# The columns of a case table, the first four mandatory.
CASE_COLUMNS = ("name", "hypergraph", "num_parts", "seed", "imb", "eigvecs", "refine_iters", "solver_iters", "best_solns", "ncycles", "fixed_file", "hint_file", "projection_strategy")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated case table with header; lines that begin with # are comments."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#")
    if missing := [c for c in CASE_COLUMNS[:4] if c not in rows.columns]:
        raise ValueError(f"the case table lacks {', '.join(missing)}")
    return rows.select(*[c for c in CASE_COLUMNS if c in rows.columns])


def write_results(df: DataFrame, path: str, kind: str) -> None:
    """Result tables as ``tsv``, ``json`` or ``md``; a report is small and has one writer."""
    rows = [r.asDict() for r in df.toLocalIterator()]
    if kind == "json":
        lines = json.dumps(rows, indent=1, default=str).split("\n")
    elif kind == "tsv":
        lines = ["\t".join(x) for x in [df.columns, *[[str(r[c]) if r[c] is not None else "" for c in df.columns] for r in rows]]]
    elif kind == "md":
        lines = ["| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *[[str(r[c]) for c in df.columns] for r in rows]]]
    else:
        raise ValueError(f"no such format: {kind}")
    with _Writer(df.sparkSession, path) as f:
        for line in lines:
            f.line(line)
