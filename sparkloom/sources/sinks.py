"""Sinks: N-Triples, JSON, JSON lines, snapshots with history, traces."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rdf
from sparkloom.operators.dedup import first_of, triples_first


def entity_lines(entities: DataFrame) -> DataFrame:
    """(line) type, name and attribute statements of each distinct (name, type); entities: seq, name, type and perhaps attributes."""
    own = first_of(entities, name=F.col("name"), type=F.col("type"))
    node = rdf.node(F.col("type"), F.col("name"))
    kind = rdf.statement(node, F.lit(rdf.RDF_TYPE), F.concat(F.lit("<"), rdf.uri(F.col("type")), F.lit(">")))
    name = rdf.statement(node, F.lit(rdf.NAME), rdf.literal(F.col("name")))
    lines = F.array(kind, name)
    if "attributes" in entities.columns:
        some = F.filter(F.map_entries(F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda x: x["value"].isNotNull())
        lines = F.concat(lines, F.transform(some, lambda x: rdf.statement(node, rdf.uri(x["key"]), rdf.literal(x["value"]))))
    return own.select(F.explode(lines).alias("line"))


def relation_lines(triples: DataFrame) -> DataFrame:
    """(line) one statement for each distinct triple."""
    return triples_first(triples).select(rdf.relation_line(F.col("subj_type"), F.col("subj_name"), F.col("predicate"), F.col("obj_type"), F.col("obj_name")).alias("line"))


def nt_lines(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return entity_lines(entities).unionByName(relation_lines(triples))


def write_nt(entities: DataFrame, triples: DataFrame, path: str) -> None:
    nt_lines(entities, triples).write.mode("overwrite").text(path)


def entity_json(entities: DataFrame) -> DataFrame:
    cols = [c for c in ("name", "type", "attributes", "confidence") if c in entities.columns]
    return entities.select(F.to_json(F.struct(*cols)).alias("value"))


def relation_json(relations: DataFrame) -> DataFrame:
    return relations.select(F.to_json(F.struct("subject", "predicate", "object", "confidence", "evidence")).alias("value"))


def triple_json(triples: DataFrame) -> DataFrame:
    end = lambda p: F.struct(F.col(f"{p}_name").alias("name"), F.col(f"{p}_type").alias("type"))
    return triples.select(F.to_json(F.struct(end("subj").alias("subject"), "predicate", end("obj").alias("object"), "confidence", "evidence")).alias("value"))


def write_json(entities: DataFrame, relations: DataFrame, triples: DataFrame, path: str) -> None:
    """Three folders of JSON lines, so that no graph has to fit in one file."""
    for name, df in (("entities", entity_json(entities)), ("relations", relation_json(relations)), ("triples", triple_json(triples))):
        df.write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


def jsonl_lines(triples: DataFrame) -> DataFrame:
    """(value) {"data": evidence, "triple": [[{name: type}, predicate, {name: type}]]}"""
    end = lambda p: F.to_json(F.create_map(f"{p}_name", f"{p}_type"))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return triples.select(F.concat(F.lit('{"data": '), text("evidence"), F.lit(', "triple": [['), end("subj"), F.lit(", "), text("predicate"), F.lit(", "), end("obj"), F.lit("]]}")).alias("value"))


def write_jsonl(triples: DataFrame, path: str) -> None:
    jsonl_lines(triples).write.mode("overwrite").text(path)


def write_ontology(spark: SparkSession, ontology, path: str) -> None:
    """The schema as one JSON object and as text."""
    import dataclasses

    shown = json.dumps(dataclasses.asdict(ontology), ensure_ascii=False)
    for name, text in (("json", shown), ("markdown", ontology.raw or ontology.guide())):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Writer:
    """A version that is being written: nobody sees its tables before ``commit``."""

    def __init__(self, log: Snapshots, build_id: str, base: int, tables: dict[str, str]):
        self.log, self.build_id, self.base, self.tables = log, build_id, base, dict(tables)
        self.folder = f"build_id={build_id}-{uuid.uuid4().hex[:12]}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The table, read back from where it was written."""
        self.tables[name] = f"{self.folder}/{name}"
        df.write.parquet(f"{self.log.path}/{self.tables[name]}")
        return self.log.spark.read.schema(df.schema).parquet(f"{self.log.path}/{self.tables[name]}")

    def leave_out(self, *names: str) -> None:
        """Tables that were a help in writing and are no part of the version."""
        for n in names:
            self.tables.pop(n, None)

    def commit(self, summary: str = "") -> str:
        self.log._put(self.base + 1, {"build_id": self.build_id, "at": time.time(), "summary": summary, "tables": self.tables})
        return self.build_id


class Snapshots:
    """Versions of a graph under a commit log.

    Each commit is one small file of the log, named by its number and put there only if no such
    file exists, with the folder of each table in it. Tables are written before, to folders of their
    own that are never written again; so a reader sees the last commit whole or the one before it, there is no
    pointer that could be missing, and of two writers that began at one number the second gets a
    ``Conflict`` and nothing else of it is seen. A rollback is a commit of an earlier one's tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        return jvm, place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last commit, 0 where there is none: what a writer begins from."""
        _, place, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _entry(self, number: int) -> dict:
        jvm, place, fs = self._files()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(place, f"{number:020d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, number: int, entry: dict) -> None:
        """Writes a file under another name and renames it; a rename never replaces what is there."""
        from py4j.protocol import Py4JJavaError

        jvm, place, fs = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        draft, final = path(place, f".{uuid.uuid4().hex}"), path(place, f"{number:020d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"commit {number} is there already") from None
            raise

    def begin(self, build_id: str, keep: bool = False) -> Writer:
        """A writer of the next version; with ``keep`` the last version's other tables stay in it."""
        base = self.last()
        return Writer(self, build_id, base, self._entry(base)["tables"] if keep and base else {})

    def commit(self, build_id: str, summary: str = "", **tables: DataFrame) -> str:
        """The tables as a new version of their own."""
        w = self.begin(build_id)
        for name, df in tables.items():
            w.write(name, df)
        return w.commit(summary)

    def upsert(self, build_id: str, summary: str = "", **phases: DataFrame) -> str:
        """The last version with these tables (a build's phases) in place of those of their names, the others as they are."""
        w = self.begin(build_id, keep=True)
        for name, df in phases.items():
            w.write(name, df)
        return w.commit(summary)

    def history(self, n: int = 10) -> DataFrame:
        """(number, at, build_id, summary) of the last commits."""
        numbers = range(self.last(), max(0, self.last() - n), -1)
        rows = [(k, float(e["at"]), e["build_id"], e["summary"]) for k in numbers for e in [self._entry(k)]]
        return self.spark.createDataFrame(rows, "number long, at double, build_id string, summary string").withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).orderBy(F.col("number").desc())

    def current(self) -> str:
        return self._entry(self.last())["build_id"]

    def _of(self, build_id: str) -> dict:
        for k in range(self.last(), 0, -1):
            if (e := self._entry(k))["build_id"] == build_id:
                return e
        raise KeyError(build_id)

    def rollback(self, build_id: str) -> None:
        e = self._of(build_id)
        self._put(self.last() + 1, e | {"summary": f"rollback: {e['summary']}"})

    def names(self, build_id: str | None = None) -> list[str]:
        """The tables of a version."""
        return sorted((self._of(build_id) if build_id else self._entry(self.last()))["tables"]) if self.last() else []

    def read(self, name: str, build_id: str | None = None) -> DataFrame:
        e = self._of(build_id) if build_id else self._entry(self.last())
        return self.spark.read.parquet(f"{self.path}/{e['tables'][name]}")


def write_trace(events: DataFrame, path: str, most: int = 50_000) -> None:
    """Appends events as JSON lines; long strings are cut."""
    cut = [F.substring(c, 1, most).alias(c) if t == "string" else F.col(c) for c, t in events.dtypes]
    events.select(*cut).write.mode("append").json(path)
