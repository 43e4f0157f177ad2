"""A collection: a named table of (id, embedding, metadata, document), made by one embedder.

It is a log. Each write puts Parquet files into a folder of their own, numbered by step: rows, or sources that are deleted
from all earlier steps. Nothing that is stored is written again, so a write costs its own size.

A step counts once its manifest is there, a small file that names what is new. It is written under a name of its own and
then put in its place by a move that fails if the place is taken; so of two writers at once one goes first and the other
follows, a writer that dies leaves nothing that counts, and a manifest is whole or absent. One that can't be read, by
whatever wrote it, is passed over: the next step goes after it.

A manifest also names the one that it goes on from, and takes over the entries of those before it that hold no more than
itself; so of n writes each has been copied log n times at most, and a reader opens log n manifests. compact() folds the
log into one step while others write; vacuum() removes what has been out of use for long enough that no reader can hold it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.operators import inverted_file, vectors
from sedra.sources.shared import drop, exists, file_system, new_table, put_new, read_bytes

METADATA = "struct<source_file:string,file_name:string,length:int,token:int,created_at:string>"
SCHEMA = f"id string, embedding array<double>, metadata {METADATA}, document string"
TRIES = 100  # of publishing a step, while other writers are first


@dataclass
class Collection:
    """A collection in a folder, made if it isn't there; without a path, one of the session's own in the shared folder."""

    spark: SparkSession
    path: str | None = None
    name: str = "documents"
    embedder: str = "hashing-64"

    def __post_init__(self) -> None:
        self.path = f"{(self.path or new_table(self.spark)).rstrip('/')}/{self.name}"
        self._last = self._listed()  # a manifest that is known to be there; -1 for none
        if self._last < 0:
            self._create(0, {"embedder": self.embedder, "before": None, "entries": []})
        made_by = self._log()[0][1]["embedder"]
        if made_by != self.embedder:
            raise ValueError(f"collection {self.name} was made with embedder {made_by}, not {self.embedder}")

    def _file(self, n: int) -> str:
        return f"{self.path}/manifest-{n:08d}.json"

    def _listed(self) -> int:
        fs, target = file_system(self.spark, self.path)
        names = (s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else ()
        return max((int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("manifest-")), default=-1)

    def _newest(self) -> int:
        """The number of the last manifest, readable or not."""
        if not exists(self.spark, self._file(self._last)):  # it was vacuumed
            self._last = self._listed()
        while exists(self.spark, self._file(self._last + 1)):
            self._last += 1
        return self._last

    def _create(self, n: int, content: dict) -> bool:
        """Whether manifest n is ours now; False if there is one."""
        return put_new(self.spark, self._file(n), json.dumps(content).encode())

    def _read_manifest(self, n: int) -> dict | None:
        """Manifest n; None if it can't be read as one."""
        try:
            found = json.loads(read_bytes(self.spark, self._file(n)))
        except ValueError:
            return None
        return found if isinstance(found, dict) and "entries" in found else None

    def _log(self, newest: int | None = None) -> list[tuple[int, dict]]:
        """The manifests that hold what counts, from the newest back, each with its number."""
        n = self._newest() if newest is None else newest
        while (now := self._read_manifest(n)) is None:
            n -= 1
            if n < 0 or not exists(self.spark, self._file(n)):
                raise ValueError(f"{self.path} has no manifest that can be read")
        out = [(n, now)]
        while (n := out[-1][1]["before"]) is not None:
            out.append((n, self._read_manifest(n)))
        return out

    @staticmethod
    def _entries(log: list[tuple[int, dict]]) -> list[list]:
        """[step, kind, path] of all that counts, in order."""
        return [e for _, m in reversed(log) for e in m["entries"]]

    def _publish(self, kinds: dict[str, str]) -> int:
        """Names written folders (kind: path) as the next step; returns its number."""
        for _ in range(TRIES):
            step = self._newest() + 1
            log = self._log(step - 1)
            own = [[step, kind, path] for kind, path in kinds.items()]
            embedder, before = log[0][1]["embedder"], log[0][0]
            for _, m in log:
                if len(m["entries"]) > len(own):
                    break
                own, before = m["entries"] + own, m["before"]
            if self._create(step, {"embedder": embedder, "before": before, "entries": own}):
                return step
        raise RuntimeError(f"{TRIES} other writers were first")

    def _write(self, df: DataFrame) -> str:
        path = f"{self.path}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _read(self, entries: list[list], schema: str, numbered: bool) -> DataFrame:
        """The tables of entries, with their step if `numbered`."""
        if not entries:
            return self.spark.createDataFrame([], f"{schema}, step int" if numbered else schema)
        # One scan of all folders: the file's folder tells the step, by a join of a row a step.
        rows = self.spark.read.schema(schema).parquet(*[path for _, _, path in entries])
        if not numbered:
            return rows
        steps = self.spark.createDataFrame([(path.rsplit("/", 1)[1], step) for step, _, path in entries], "_folder string, step int")
        return rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"/(step-[0-9a-f]+)/", 1)).join(steps, "_folder").drop("_folder")

    def rows(self) -> DataFrame:
        """The rows that are there now; later writes don't change the result."""
        return self._live(self._entries(self._log()))

    def _live(self, entries: list[list]) -> DataFrame:
        of = lambda kind: [e for e in entries if e[1] == kind]
        rows = self._read(of("rows"), SCHEMA, bool(of("gone")))
        if of("gone"):
            gone = self._read(of("gone"), "source_file string", True).groupBy("source_file").agg(F.max("step").alias("until"))
            rows = rows.join(gone, (F.col("metadata.source_file") == F.col("source_file")) & (F.col("step") < F.col("until")), "left_anti")
        return rows.select("id", "embedding", "metadata", "document")

    def append(self, rows: DataFrame) -> DataFrame:
        """Add rows; returns them as they are stored."""
        return self._stored(self._store({"rows": rows}))

    def replace_sources(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """Put rows in place of all that is stored of the sources (source_file), which may have no rows any more; returns them as they are stored. One step, so no reader sees half of it."""
        return self._stored(self._store({"gone": sources, "rows": rows}))

    def delete_sources(self, sources: DataFrame) -> None:
        """Delete the rows of the given sources (source_file)."""
        self._store({"gone": sources})

    def _store(self, what: dict[str, DataFrame]) -> str | None:
        paths = {}
        if "gone" in what:
            paths["gone"] = self._write(what["gone"].select(F.col("source_file").cast("string").alias("source_file")).where("source_file is not null").distinct())
        if "rows" in what:
            paths["rows"] = self._write(what["rows"].select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("metadata").cast(METADATA).alias("metadata"), "document"))
        self._publish(paths)
        return paths.get("rows")

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(path)

    def compact(self) -> int:
        """Fold the log: the live rows are written once, as one step; returns the manifest's number. What other writers add meanwhile follows it. What is folded stays until vacuum(). An index goes, as it knows nothing of what is folded: index() makes a new one."""
        log = self._log()
        until, folded = log[0][0], self._entries(log)
        path = self._write(self._live(folded))
        for _ in range(TRIES):
            step = self._newest() + 1
            now = self._log(step - 1)
            entries = self._entries(now)
            if entries[: len(folded)] != folded:
                break  # another compact() was first
            if self._create(step, {"embedder": now[0][1]["embedder"], "before": None, "entries": [[until, "rows", path], *entries[len(folded) :]]}):
                return step
        drop(self.spark, path)
        raise RuntimeError("other writers were first")

    def vacuum(self, seconds: float = 86_400) -> int:
        """Remove folders that no manifest in use names, and manifests out of use, if both they and the newest manifest are `seconds` old: longer than any reader or writer takes. Returns how many went."""
        log = self._log()
        used = {self._file(n) for n, _ in log} | {path for _, _, path in self._entries(log)}
        fs, target = file_system(self.spark, self.path)
        least = min(n for n, _ in log)
        used |= {self._file(n) for n in range(least, self._newest() + 1)}  # so that numbers stay without a gap
        found = {f"{self.path}/{s.getPath().getName()}": s.getModificationTime() / 1000 for s in fs.listStatus(target)}
        before = time.time() - seconds
        if found[self._file(log[0][0])] > before:
            return 0
        old = [p for p, at in found.items() if p not in used and at <= before]
        for p in old:
            drop(self.spark, p)
        return len(old)

    def index(self, config: inverted_file.Config | None = None) -> bool:
        """Store an inverted file of the live rows with the collection, in place of an earlier one; False if there is no vector. Later writes don't change it: nearest() reads what they added beside it."""
        log = self._log()
        path = f"{self.path}/step-{uuid.uuid4().hex}"
        rows = self._live(self._entries(log)).select("id", "embedding", F.col("metadata.source_file").alias("source_file"))
        if inverted_file.build(rows, path, config, more=("source_file",)) is None:
            return False
        put_new(self.spark, f"{path}/until.json", json.dumps(log[0][0]).encode())
        self._publish({"index": path})
        return True

    def nearest(self, queries: DataFrame, k: int = 10, query: str = "query_id", vector: str = "embedding") -> DataFrame:
        """vectors.nearest() over the rows, by squared Euclidean distance, with doc_id for a row's id. With an index it is approximate: of what is indexed, cells near a query are read. Rows that came later are tried one by one, and rows whose source was deleted later are left out; many of both call for a new index(). Queries of another length than the index's vectors find nothing."""
        entries = self._entries(self._log())
        path = next((p for _, kind, p in reversed(entries) if kind == "index"), None)
        until = None if path is None else json.loads(read_bytes(self.spark, f"{path}/until.json"))
        plain = lambda rows: rows.select(F.col("id").alias("doc_id"), "embedding")
        if path is None or entries[0][0] > until:  # none, or one from before what was folded since
            return vectors.nearest(queries, plain(self._live(entries)), k, query=query, vector=vector)
        later = [e for e in entries if e[0] > until]
        found = inverted_file.search(queries, path, k, query, vector, ("source_file",))
        gone = [e for e in later if e[1] == "gone"]
        if gone:
            found = found.join(self._read(gone, "source_file string", False).distinct(), "source_file", "left_anti")
        found = found.drop("source_file")
        if any(e[1] == "rows" for e in later):
            own = lambda df, v: df.where(F.size(v) == inverted_file.load(self.spark, path).dim)
            found = found.unionByName(vectors.nearest(own(queries, vector), own(plain(self._live(later)), "embedding"), k, query=query, vector=vector).drop("retrieval_rank"))
        return vectors.ranked(found, k, query, "doc_id")

    def stats(self) -> DataFrame:
        """(collection, n): one row."""
        return stats(self.rows(), self.name)


def stats(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")


def without_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose metadata.source_file is none of sources (source_file); rows without a source stay."""
    gone = sources.select(F.col("source_file").alias("_gone")).where("_gone is not null").distinct()
    return rows.join(gone, F.col("metadata.source_file") == F.col("_gone"), "left_anti")


def vectorized_status(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, url, vectorized, n_chunks) for every file (name, url): whether the collection has rows of its url."""
    have = rows.groupBy(F.col("metadata.source_file").alias("url")).agg(F.count("*").alias("n"))
    return files.join(have, "url", "left").select("name", "url", F.col("n").isNotNull().alias("vectorized"), F.coalesce("n", F.lit(0)).alias("n_chunks"))
