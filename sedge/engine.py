"""One object for callers: an index directory with records, blobs and jobs, and every operation on it.

Writers state which version of a table they changed; where another one came first, they get ``Conflict``.
Records are kept in buckets of their ids, so that a change rewrites the buckets that it touches.
"""

from __future__ import annotations

import secrets
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge import storage
from sedge.errors import Duplicate, InvalidParameter, NotFound
from sedge.operators import filters, jobs, projection, search, store
from sedge.operators.cells import Cells, scan
from sedge.operators.fielded import Index, bm25f, field_tokens, places
from sedge.schema import TYPEAHEAD_FIELDS, IndexSpec

Embed = Callable[[str], Sequence[float]]


class Engine:
    """Operations over ``root``: ``records/``, ``blobs/`` and ``jobs/`` Parquet tables of one silo.

    Records have at least id, doc_type, doc_id; the fields that the spec calls searchable are searched, as far as there are any, and
    ``embedding`` holds vectors.  Search methods return plans; only what prunes them (a few rows of an index) is read before.
    """

    CACHE_S, CACHE_KEYS = 2.0, 10_000
    TABLES = ("records", "jobs", "blobs")

    def __init__(self, spark: SparkSession, root: str, spec: IndexSpec | None = None, embed: Embed | None = None, clock: Callable[[], float] = time.time, silo: str | None = None, buckets: int = 64):
        self.spark, self.root, self.embed, self.clock, self.silo, self.buckets = spark, root.rstrip("/"), embed, clock, silo, buckets
        self.spec = spec or IndexSpec()
        self._cache: dict[tuple, tuple[float, list]] = {}
        self._flights: dict[tuple, Future] = {}
        self._lock = threading.Lock()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str) -> DataFrame:
        if not storage.exists(self.spark, self.path(name)):
            raise NotFound(f"{name} in {self.root}")
        return storage.read_table(self.spark, self.path(name))

    def _replace(self, name: str, df: DataFrame, expected: str | None = storage.ANY) -> None:
        key, buckets = ("id", self.buckets) if name == "records" else (None, 0)
        storage.replace_table(df, self.path(name), expected, key, buckets)

    def _version(self, name: str) -> str | None:
        return storage.current(self.spark, self.path(name))

    def create(self, records: DataFrame, force: bool = False) -> None:
        if storage.exists(self.spark, self.path("records")) and not force:
            raise Duplicate(self.root)
        self._replace("records", records)

    def records(self) -> DataFrame:
        return self._table("records")

    # Search

    def index(self) -> None:
        """Store places, impacts and spellings of the searchable fields, and the vectors by cell, so that searches read a part.

        They belong to one version of the records; after a change searches read the records until the next call.
        """
        version, docs = self._version("records"), self.records()
        self._words(version).build(docs, self.spec.searchable, self.spec.weights)
        if "embedding" in docs.columns:
            self._cells(version).build(docs, "embedding", self.spec.dim)
        for name in ("postings", "vectors"):
            fs, at = storage.file_system(self.spark, self.path(name))
            for old in fs.listStatus(at) if fs.exists(at) else ():
                if old.getPath().getName() not in (version, str(int(version) - 1)):
                    fs.delete(old.getPath(), True)

    def _words(self, version: str | None) -> Index:
        return Index(self.spark, f"{self.path('postings')}/{version}", "id")

    def _cells(self, version: str | None) -> Cells:
        return Cells(self.spark, f"{self.path('vectors')}/{version}", "id")

    def _scores(self, df: DataFrame, q: str, filter: str | None, prefix_last: bool = False, k: int | None = None, typos: bool = False, close: bool = False) -> DataFrame:
        """BM25F scores of ``df``, the filtered records: from the stored index where it is up to date."""
        stored = self._words(self._version("records"))
        if not stored.ready():
            if typos or close:
                raise InvalidParameter("typos" if typos else "close", "needs the stored index")
            return bm25f(places(df, "id", self.spec.searchable), q, "id", self.spec.weights, prefix_last)
        narrowed = bool(filter and filter.strip())
        if typos or close or not (narrowed or prefix_last):
            return stored.search(q, None if narrowed else k, typos, close)
        placed = stored.table("places")
        return bm25f(placed.join(df.select("id"), "id", "left_semi") if narrowed else placed, q, "id", self.spec.weights, prefix_last)

    def keyword(self, q: str, *, filter: str | None = None, sort: Sequence[str] = (), fields: Sequence[str] = (), limit: int = 20, offset: int = 0, typos: bool = False, close: bool = False) -> DataFrame:
        """Records by BM25F over the searchable fields.  ``typos`` lets words stand for terms a few edits away, ``close`` lifts records
        whose words stand together; both need the stored index."""
        filters.ensure_range("limit", limit, 1, 100)
        q = filters.ensure_text("q", q, 1)
        fields, sort = filters.ensure_list("fields", fields, 64), filters.ensure_list("sort", sort, 8)
        df = filters.apply_filter(self.records(), filter, self.spec.filterable)
        scored = df.join(self._scores(df, q, filter, k=None if sort else limit + offset, typos=typos, close=close), "id")
        ordered = search.top(scored, "id", limit, offset, filters.parse_sort(sort, df, self.spec.sortable))
        return projection.rows(ordered, fields)

    def _near(self, df: DataFrame, query: Sequence[float], filter: str | None, k: int, probes: int, exact: bool) -> DataFrame:
        """(id, score) of the nearest: from the stored cells where they are up to date and nothing is filtered."""
        stored = self._cells(self._version("records"))
        if filter and filter.strip() or not stored.ready():
            return scan(df, query, "id", "embedding", k)
        return stored.search(query, k, probes, exact)

    def vector(self, q: str | Sequence[float], *, filter: str | None = None, fields: Sequence[str] = (), k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """The ``k`` nearest records; of a stored index the ``probes`` nearest cells are read, or with ``exact`` all that can matter."""
        filters.ensure_range("k", k, 1, 100)
        query = self._embed(q)
        df = filters.apply_filter(self.records(), filter, self.spec.filterable)
        scored = df.join(self._near(df, query, filter, k, probes, exact), "id")
        return projection.rows(search.top(scored, "id", k), fields)

    def _embed(self, q: str | Sequence[float]) -> list[float]:
        if isinstance(q, str):
            if not q.strip():
                return [0.0] * self.spec.dim
            if self.embed is None:
                raise InvalidParameter("embedder", "no embedder is configured")
            q = self.embed(q)
        q = list(q)
        if len(q) != self.spec.dim:
            raise InvalidParameter("q", f"needs {self.spec.dim} dimensions")
        return q

    def hybrid(self, q: str, *, vector: Sequence[float] | None = None, filter: str | None = None, limit: int = 20, fusion: str = "rrf", keyword_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
        filters.ensure_range("limit", limit, 1, 100)
        weights = filters.normalize_weights(keyword_weight, vector_weight)
        most = min(limit, search.BRANCH_LIMIT)
        df = filters.apply_filter(self.records(), filter, self.spec.filterable)
        names = df.select("id", F.coalesce("doc_id", "id").alias("doc_id"))
        order = [F.desc("score"), F.asc("id")]
        kw = search.ranked(self._scores(df, filters.ensure_text("q", q, 1), filter, k=most).join(names, "id"), order, most)
        near = self._near(df, self._embed(q if vector is None else vector), filter, most, 8, False)
        vec = search.ranked(near.join(names, "id"), order, most)
        if fusion == "rrf":
            return search.fuse_rrf(kw, vec, "doc_id", limit)
        if fusion != "weighted":
            raise InvalidParameter("fusion", "rrf or weighted")
        return search.fuse_weighted(kw.withColumn("score", search.squash(F.col("score"))), vec, "doc_id", limit, weights)

    def typeahead(self, q: str, *, filter: str | None = None, limit: int = 10) -> tuple[list, bool]:
        """(rows, whether they came from the cache); rows are kept for two seconds, and of equal requests at
        the same time one runs and the others wait for it."""
        filters.ensure_range("limit", limit, 1, 10)
        q = filters.ensure_text("q", q, 2)
        key = (" ".join(q.lower().split()), (filter or "").strip(), limit)
        with self._lock:
            hit = self._cache.get(key)
            if hit and self.clock() - hit[0] < self.CACHE_S:
                return hit[1], True
            flight = self._flights.get(key)
            mine = flight is None
            if mine:
                flight = self._flights[key] = Future()
        if not mine:
            return flight.result(), True
        try:
            rows = self._suggest(q, filter, limit)
        except BaseException as problem:
            flight.set_exception(problem)
            raise
        else:
            with self._lock:
                if len(self._cache) >= self.CACHE_KEYS:
                    self._cache.pop(next(iter(self._cache)))
                self._cache[key] = (self.clock(), rows)
            flight.set_result(rows)
            return rows, False
        finally:
            with self._lock:
                self._flights.pop(key, None)

    def _suggest(self, q: str, filter: str | None, limit: int) -> list:
        df = filters.apply_filter(self.records(), filter, self.spec.filterable)
        found = df.join(self._scores(df, q, filter, prefix_last=True), "id")
        return projection.rows(search.top(found, "id", limit), [f for f in TYPEAHEAD_FIELDS if f in df.columns]).collect()

    # Records

    def get(self, key: str) -> DataFrame:
        return store.get(self.records(), "id", key)

    def find(self, *, filter: str | None = None, fields: Sequence[str] = (), sort: Sequence[str] = (), limit: int = 20, offset: int = 0) -> DataFrame:
        df = filters.apply_filter(self.records(), filter, self.spec.filterable)
        found = df.orderBy(*filters.parse_sort(sort, df, self.spec.sortable), "id").offset(offset).limit(filters.ensure_range("limit", limit, 1, 100))
        return projection.rows(found, fields, score=None, base=())

    def stats(self) -> DataFrame:
        """One row: records, vectors, documents with vectors, bytes on disk, the embedder, the searchable fields that there are."""
        records = self.records()
        fs, at = storage.file_system(self.spark, self.path("records"))
        there = [f for f in self.spec.searchable if field_tokens(records, f) is not None]
        found = store.index_stats(records, "doc_id", "embedding").withColumn("size_bytes", F.lit(fs.getContentSummary(at).getLength()))
        embedder = store.describe_embedder(self.spec.embedder_key, "userProvided", self.spec.dim)
        return found.withColumn("embedder", F.lit(embedder)).withColumn("searchable", F.array(*map(F.lit, there)).cast("array<string>"))

    def breakdown(self) -> DataFrame:
        return store.breakdown(self.records())

    def upsert(self, new: DataFrame, replace_by: str | None = None) -> None:
        """Put rows in, each in place of the one with its id; only the buckets of these ids are rewritten.  ``replace_by`` also
        removes other rows of the same document."""
        version, old = self._version("records"), self.records()
        new = storage.stage(store.last_of(new, "id"), "upsert")
        touched = new.select("id")
        if replace_by:
            touched = touched.unionByName(old.join(new.select(replace_by).distinct(), replace_by, "left_semi").select("id"))
        storage.change_buckets(self.spark, self.path("records"), touched, lambda part: store.upsert(part, new, "id", replace_by=replace_by), version)

    def delete(self, doc_id: str, dry_run: bool = False, blobs: bool = False) -> DataFrame | None:
        """The plan of deleting a document, carried out unless ``dry_run``; None where nothing is found.

        The plan counts what is deleted, however much that is.  With ``blobs`` the document's blobs go too, in its own silo and
        unless records that stay refer to them.
        """
        version, held_version = self._version("records"), self._version("blobs")
        old = self.records()
        mine = old.where(F.col("doc_id") == doc_id)
        plan = store.delete_plan(mine, "doc_id", limit=None)
        plan = self.spark.createDataFrame(plan.collect(), plan.schema)  # one row
        if plan.isEmpty():
            return None
        if dry_run:
            return plan
        kept = None
        if blobs and storage.exists(self.spark, self.path("blobs")):
            held = storage.read_table(self.spark, self.path("blobs"))
            silo = self._silo_of(old, held)
            left = old.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))).withColumn("_silo", silo)
            used = left.select("_silo", F.explode("blob_cids").alias("cid")).unionByName(left.select("_silo", F.col("doc_id").alias("cid")))
            gone = mine.select(silo.alias("_silo")).distinct().crossJoin(plan.select(F.explode("cids").alias("cid"))).join(used.distinct(), ["_silo", "cid"], "left_anti")  # one document's
            gone = gone.withColumnRenamed("_silo", "silo")
            kept = storage.stage(held.join(gone, ["silo", "cid"], "left_anti").select(*held.columns), "blobs")
        storage.change_buckets(self.spark, self.path("records"), mine.select("id"), lambda part: part.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))), version)
        if kept is not None:
            self._replace("blobs", kept, held_version)
        return plan

    def _silo_of(self, records: DataFrame, blobs: DataFrame) -> Column:
        """The silo whose blobs a record means: its own, else the engine's, else the only one that there is."""
        if "silo" in records.columns:
            return F.col("silo")
        if self.silo is not None:
            return F.lit(self.silo)
        known = blobs.select("silo").distinct().limit(2).collect()
        if len(known) > 1:
            raise InvalidParameter("silo", "the blobs are of several silos")
        return F.lit(known[0].silo if known else None).cast("string")

    def purge(self, token: str, expected: str) -> None:
        """Remove the index; ``token`` must repeat the confirmation token shown before."""
        if token != expected:
            raise InvalidParameter("confirm", "wrong token")
        fs, at = storage.file_system(self.spark, self.root)
        fs.delete(at, True)

    @staticmethod
    def confirmation_token() -> str:
        return secrets.token_hex(4)

    def backup(self, target: str) -> str:
        """Add a backup of all tables that there are below ``target``; returns its name, made of index and time.

        Only data that no earlier backup there holds are copied.
        """
        name = f"{self.root.rsplit('/', 1)[-1]}-{time.strftime('%Y%m%dT%H%M%S', time.gmtime(self.clock()))}"
        tables = {t: self.path(t) for t in self.TABLES if storage.exists(self.spark, self.path(t))}
        store.back_up(self.spark, tables, target.rstrip("/"), name)
        return name

    def backups(self, target: str) -> DataFrame:
        return store.snapshots(self.spark, target)

    def retain(self, target: str, daily: int = 7, weekly: int = 4, monthly: int = 6) -> int:
        """Forget the backups that the rule does not keep; returns their number."""
        known = self.backups(target)
        kept = {r.name for r in store.retention(known, "ts", "name", daily, weekly, monthly).collect()}
        gone = [r.name for r in known.collect() if r.name not in kept]
        store.forget(self.spark, target.rstrip("/"), gone)
        return len(gone)

    def verify(self, target: str, backup: str) -> dict[str, tuple[int, int]]:
        """(missing, extra) rows of each table of a backup against the index; OSError where the backup itself is damaged."""
        bad = store.check_backup(self.spark, target, backup).where("problem is not null").first()
        if bad is not None:
            raise OSError(f"{bad['at']} is {bad.problem}")
        checked = {}
        for table in store.manifest(self.spark, target, backup)["tables"]:
            found = store.verify_snapshot(self._table(table), store.backed_up(self.spark, target, backup, table)).first()
            checked[table] = (found.missing, found.extra)
        return checked

    def recover(self, target: str, backup: str, force: bool = False, dry_run: bool = False) -> DataFrame | None:
        """Bring all tables of a backup back; ``dry_run`` tells what that would do to the records, and how many bytes it reads."""
        tables = store.manifest(self.spark, target, backup)["tables"]
        if dry_run:
            plan = store.restore_plan(self.records(), store.backed_up(self.spark, target, backup, "records"))
            return plan.withColumn("bytes", F.lit(sum(u["bytes"] for u in store.manifest(self.spark, target, backup)["units"])))
        if storage.exists(self.spark, self.path("records")) and not force:
            raise FileExistsError(self.path("records"))
        for table in tables:
            self._replace(table, store.backed_up(self.spark, target, backup, table))
        return None

    # Jobs

    def enqueue(self, new: DataFrame) -> None:
        if not storage.exists(self.spark, self.path("jobs")):
            self._replace("jobs", new)
            return
        version, old = self._version("jobs"), self._table("jobs")
        self._replace("jobs", old.unionByName(jobs.enqueue_strict(old, new)), version)

    def reap(self, now_ms: int | None = None, action: str = "both", dry_run: bool = False) -> DataFrame:
        """Outcome per stale job; the job table is updated unless ``dry_run``."""
        version, table = self._version("jobs"), self._table("jobs")
        done = storage.stage(jobs.reap(table, now_ms or int(self.clock() * 1000), action), "reaped")
        if not dry_run:
            new = done.where("outcome <> 'skipped'").drop("outcome").select(*table.columns)
            self._replace("jobs", store.upsert(table, new, "job_id").select(*table.columns), version)
        return done.select("job_id", "outcome", "status")
