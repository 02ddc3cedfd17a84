"""A persisted index: immutable generations of tables named by a versioned manifest.

    root/manifest-000000000007.json    the highest number is the index; written once, never changed
    root/gen-<seq>-<id>/documents      doc_id, ext_id, doc_len, terms, gen
    root/gen-<seq>-<id>/postings       term, doc_id, tf, doc_len, gen; range-partitioned and sorted by (term, doc_id)
    root/gen-<seq>-<id>/lexicon        term, df
    root/tombstones-<id>               doc_id, below: hides that document in generations before ``below``
    root/readers/<version>-<id>        a search that still reads that version

Data is written first; the commit is the creation of the next manifest, which fails if another writer made it. A reader
keeps the manifest it opened, so it sees one state whatever is committed meanwhile. A term's filter reaches the scan,
where sorting lets it skip all row groups but those of the term.

Adding reads the texts once: documents are written as they are analysed, without a shuffle, and postings are made of them
in one shuffle. An id that the index has is replaced: its older version is hidden. Counts are kept in the manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.analysis import ANALYZERS, TERMS, Analyzer, counted, inverted
from ..functions.scoring import MEASURES, Measure, okapi_of
from ..metrics import Metrics, Reporter, Reporting, log
from ..operators.postings import blocks, hidden, lexicon, live, segments, tombstone_segments
from ..operators.search import Searcher
from .tables import Files, Store

DOCUMENTS = f"doc_id bigint, ext_id string, doc_len int, terms {TERMS}, gen int"
POSTINGS = "term string, doc_id bigint, tf int, doc_len int, gen int"
LEXICON = "term string, df bigint"
TOMBSTONES = "doc_id bigint, below int"
#: Seconds after which a reader is taken for dead.
LEASE = 86_400
#: Hidden documents up to which tombstones are broadcast in a merge.
BROADCAST = 2_000_000


class IndexError_(RuntimeError):
    """The index isn't there, is read-only or closed, or doesn't suit."""


class Conflict(IndexError_):
    """Another writer committed first; open again and repeat."""


@dataclass(frozen=True)
class Manifest:
    version: int
    analyzer: str
    measure: str
    stop_words: tuple[str, ...] = ()
    generations: tuple[dict, ...] = ()
    tombstones: tuple[str, ...] = ()
    #: Documents of the generations that tombstones hide.
    deleted: int = 0
    next_id: int = 1
    next_gen: int = 1
    #: Number of the last batch of each stream.
    streams: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    @property
    def documents(self) -> int:
        return sum(g["docs"] for g in self.generations) - self.deleted


class Index:
    """An open index. Commits return nothing and move this object to the new state."""

    def __init__(self, store: Store, manifest: Manifest, analyzer: Analyzer, read_only: bool, config: Config, metrics: Metrics | None = None):
        self.store, self.spark, self.manifest, self.analyzer, self.read_only, self.config = store, store.spark, manifest, analyzer, read_only, config
        self.metrics, self.closed = metrics or Metrics(), False
        s = manifest.settings
        self.measure: Measure = okapi_of(s["k1"], s["b"], s["average_length"]) if manifest.measure == "okapi" and s else MEASURES[manifest.measure]

    @staticmethod
    def _store(spark: SparkSession, root: str | Store, config: Config) -> Store:
        return Files(spark, root, config.format) if isinstance(root, str) else root

    @classmethod
    def create(cls, spark: SparkSession, root: str | Store, analyzer: str = "simple", measure: str = "okapi", stop_words: Iterable[str] | None = None, overwrite: bool = False, config: Config | None = None, metrics: Metrics | None = None) -> Index:
        """A new, empty index. One that is there is replaced with ``overwrite``, else it is an error. ``root``: a folder, or a store of another kind."""
        config = config or Config.from_session(spark)
        store = cls._store(spark, root, config)
        if cls._last(store) is not None:
            if not overwrite:
                raise IndexError_(f"there is an index in {root}")
            store.delete()
        own = ANALYZERS[analyzer]() if stop_words is None else ANALYZERS[analyzer](stop_words)
        MEASURES[measure]
        m = Manifest(1, analyzer, measure, own.stop_words, settings={k: getattr(config, k) for k in ("k1", "b", "average_length")})
        cls._write(store, m)
        return cls(store, m, own, False, config, metrics)

    @classmethod
    def open(cls, spark: SparkSession, root: str | Store, analyzer: str | None = None, measure: str | None = None, read_only: bool = False, create: bool = False, config: Config | None = None, metrics: Metrics | None = None) -> Index:
        """The last committed state. An analyzer or measure other than the index was made with is an error."""
        config = config or Config.from_session(spark)
        store = cls._store(spark, root, config)
        last = cls._last(store)
        if last is None:
            if create and not read_only:
                return cls.create(spark, store, analyzer or "simple", measure or "okapi", config=config, metrics=metrics)
            raise IndexError_(f"no index in {root}")
        m = cls._manifest(store, last)
        for what, given, has in (("analyzer", analyzer, m.analyzer), ("measure", measure, m.measure)):
            if given is not None and given != has:
                raise IndexError_(f"the index was made with {what} {has}, not {given}")
        return cls(store, m, ANALYZERS[m.analyzer](m.stop_words), read_only, config, metrics)

    @staticmethod
    def _last(store: Store) -> str | None:
        return max((n for n in store.names() if n.startswith("manifest-") and n.endswith(".json")), default=None)

    @staticmethod
    def _manifest(store: Store, name: str) -> Manifest:
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(store.text(name)).items()})

    @staticmethod
    def _write(store: Store, m: Manifest) -> None:
        if not store.create(f"manifest-{m.version:012d}.json", json.dumps(asdict(m))):
            raise Conflict(f"version {m.version} is there already")

    def _open(self, write: bool = False) -> None:
        if self.closed:
            raise IndexError_("the index is closed")
        if write and self.read_only:
            raise IndexError_("opened read-only")

    def _commit(self, **changes) -> None:
        self._open(write=True)
        m = replace(self.manifest, version=self.manifest.version + 1, **changes)
        self._write(self.store, m)
        self.manifest = m

    # ------------------------------------------------------------------ reading

    def _read(self, table: str, schema: str, generations: Iterable[dict] | None = None) -> DataFrame:
        self._open()
        own = self.manifest.generations if generations is None else generations
        return self.store.read([f"{g['id']}/{table}" for g in own], schema)

    def postings(self) -> DataFrame:
        """(term, doc_id, tf, doc_len, gen), deleted documents included."""
        return self._read("postings", POSTINGS)

    def documents(self) -> DataFrame:
        """(doc_id, ext_id, doc_len, terms, gen), deleted ones included."""
        return self._read("documents", DOCUMENTS)

    def lexicon(self) -> DataFrame:
        """(term, df), deleted documents included."""
        return self._read("lexicon", LEXICON).groupBy("term").agg(F.sum("df").alias("df"))

    def tombstones(self) -> DataFrame | None:
        """(doc_id, below), or None."""
        self._open()
        if not self.manifest.tombstones:
            return None
        return self.store.read(list(self.manifest.tombstones), TOMBSTONES).groupBy("doc_id").agg(F.max("below").alias("below"))

    def searcher(self) -> Searcher:
        """A snapshot; its number of documents is that of the manifest."""
        return Searcher(self.postings(), self.documents().select("doc_id", "gen"), self.tombstones(), self.measure, self.lexicon(), self.manifest.documents)

    def search(self, clause, k: int = 10, **how) -> DataFrame:
        with self.metrics.timed("compile_query"):
            return self.searcher().search(clause, k, **how)

    def execute(self, clause, k: int = 10, **how) -> list:
        """The rows of ``search``, timed, under a lease that keeps the version from being vacuumed."""
        with self.reading(), self.metrics.timed("execute_query"):
            rows = self.search(clause, k, **how).collect()
        self.metrics.count("queries")
        return rows

    @contextmanager
    def reading(self) -> Iterator[Index]:
        """While this is open, ``vacuum`` keeps this version, and ``close`` waits for it."""
        self._open()
        name = f"readers/{self.manifest.version}-{uuid.uuid4().hex}"
        self.store.create(name, "")
        try:
            yield self
        finally:
            self.store.delete(name)

    def _readers(self) -> set[int]:
        names = [n for n in self.store.names("readers") if not n.startswith(".") and not n.endswith(".tmp")]
        out = set()
        for n in names:
            try:
                if self.store.age(f"readers/{n}") < LEASE:
                    out.add(int(n.split("-")[0]))
            except Exception as e:  # noqa: BLE001 - ended meanwhile
                if "FileNotFound" not in str(e):
                    raise
        return out

    def close(self) -> bool:
        """Waits up to ``wait_on_close`` seconds for searches of this version; then this object refuses all work. Whether none was left."""
        until = time.monotonic() + self.config.wait_on_close
        while busy := self.manifest.version in self._readers():
            if time.monotonic() >= until:
                break
            time.sleep(0.05)
        self.closed = True
        return not busy

    def get_document(self, doc_id: int, include_deleted: bool = False) -> DataFrame:
        """(doc_id, ext_id, doc_len, terms) of the document, no row if there is none; with ``include_deleted`` all its versions."""
        out = self.documents().filter(F.col("doc_id") == doc_id)
        return (out if include_deleted else live(out, self.tombstones())).drop("gen")

    def statistics(self) -> dict:
        m = self.manifest
        return {"docs": m.documents, "deleted": m.deleted, "postings": sum(g["postings"] for g in m.generations), "generations": len(m.generations), "next_id": m.next_id}

    def blocks(self, size: int | None = None) -> DataFrame:
        return blocks(self.postings(), self.measure, size or self.config.block, self.tombstones())

    def segments(self) -> DataFrame:
        return segments(self.postings(), self.measure, self.config.segment)

    def tombstone_segments(self) -> DataFrame | None:
        gone = self.tombstones()
        return None if gone is None else tombstone_segments(gone, self.config.bitmap)

    def reporting(self, *reporters: Reporter) -> Reporting:
        """Reports the metrics as the settings say until it is stopped, to the log too unless they turn that off."""
        own = [*([log] if self.config.metrics_log else []), *reporters]
        return Reporting(self.metrics, own, self.config.metrics_interval, self.config.metrics_per_second)

    # ------------------------------------------------------------------ writing

    def _laid(self, documents: DataFrame, where: str, gen: int, postings: DataFrame | None = None) -> dict:
        """Writes a generation: (doc_id, ext_id, doc_len, terms) as they come, then their postings and lexicon. Returns its numbers.

        ``postings``: those of the documents, where they are there already. They are in order by pieces, which sorting takes over.
        """
        seen = Observation()
        rows = documents.select("doc_id", "ext_id", "doc_len", "terms", F.lit(gen).alias("gen"))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("docs"), F.sum(F.size("terms")).alias("postings"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.sum("doc_len").alias("tokens"))
        with self.metrics.timed("write_documents"):
            self.store.write(rows, f"{where}/documents")
        n = {k: v or 0 for k, v in seen.get.items()}
        if not n["docs"] or n["nulls"]:
            return n
        width = self.config.width or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if postings is None:
            postings = inverted(self.store.read([f"{where}/documents"], DOCUMENTS))
        p = postings.select("term", "doc_id", "tf", "doc_len", F.lit(gen).alias("gen"))
        with self.metrics.timed("write_postings"):
            self.store.write(p.repartitionByRange(width, "term", "doc_id").sortWithinPartitions("term", "doc_id"), f"{where}/postings")
        with self.metrics.timed("write_lexicon"):
            p = self.store.read([f"{where}/postings"], POSTINGS)
            self.store.write(lexicon(p).repartitionByRange(max(1, width // 4), "term").sortWithinPartitions("term"), f"{where}/lexicon")
        return n

    def add(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds ``docs`` (text, and doc_id or ext_id or both) as a generation. ``batch``: (stream, number); one that was added before is passed over: False.

        A doc_id that the index has is replaced. One that is null, or that ``docs`` has twice, is an error, and nothing is
        added. Documents without a doc_id are numbered after all that there are; the numbers have gaps.
        """
        self._open(write=True)
        m = self.manifest
        if batch is not None and batch[1] <= m.streams.get(batch[0], -1):
            return False
        streams = m.streams if batch is None else {**m.streams, batch[0]: int(batch[1])}
        gen = m.next_gen
        where = f"gen-{gen:08d}-{uuid.uuid4().hex}"
        given = "doc_id" in docs.columns
        ext = F.col("ext_id").cast("string") if "ext_id" in docs.columns else F.col("doc_id").cast("string")
        id_ = F.col("doc_id").cast("bigint") if given else F.monotonically_increasing_id() + m.next_id
        rows = docs.select(id_.alias("doc_id"), ext.alias("ext_id"), F.col("text").cast("string").alias("text"))
        with self.metrics.timed("add"):
            n = self._laid(counted(rows, self.analyzer, "ext_id"), where, gen)
            if not n["docs"]:
                self.store.delete(where)
                if batch is not None:
                    self._commit(streams=streams)
                return True
            own = self.store.read([f"{where}/documents"], DOCUMENTS).select("doc_id")
            if n["nulls"] or (given and not own.groupBy("doc_id").count().filter("count > 1").isEmpty()):
                self.store.delete(where)
                raise IndexError_(f"{n['nulls']} documents without a doc_id" if n["nulls"] else "a doc_id comes twice")
            tombstones, replaced = m.tombstones, 0
            if given:
                name, replaced = self._hide(own, gen, n["low"], n["high"])
                tombstones = (*tombstones, name) if replaced else tombstones
            size = {"id": where, "gen": gen, "docs": n["docs"], "postings": n["postings"], "low": n["low"], "high": n["high"]}
            self._commit(generations=(*m.generations, size), tombstones=tombstones, deleted=m.deleted + replaced, next_id=max(m.next_id, n["high"] + 1), next_gen=gen + 1, streams=streams)
        for k in ("docs", "postings", "tokens"):
            self.metrics.count(f"added_{k}", n[k])
        self.metrics.count("replaced_docs", replaced)
        return True

    def _hide(self, ids: DataFrame, below: int, low: int | None = None, high: int | None = None) -> tuple[str, int]:
        """Tombstones for those of ``ids`` that are live; only generations whose ids reach into the range are read."""
        near = [g for g in self.manifest.generations if low is None or (g["low"] <= high and g["high"] >= low)]
        if not near:
            return "", 0
        known = live(self._read("documents", DOCUMENTS, near).select("doc_id", "gen"), self.tombstones())
        if low is not None:
            known = known.filter(F.col("doc_id").between(low, high))
        name, seen = f"tombstones-{uuid.uuid4().hex}", Observation()
        new = known.select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(below).alias("below"))
        self.store.write(new.observe(seen, F.count(F.lit(1)).alias("n")), name)
        n = seen.get["n"] or 0
        if not n:
            self.store.delete(name)
        return name, n

    def remove(self, ids: DataFrame | Iterable[int], strict: bool = False) -> int:
        """Marks documents deleted; those deleted before don't count. ``strict`` raises for an id that isn't there. Returns how many were marked."""
        self._open(write=True)
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
        ids = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        if strict and not ids.join(self.documents().select("doc_id"), "doc_id", "left_anti").isEmpty():
            raise IndexError_("some ids are not in the index")
        with self.metrics.timed("remove"):
            name, n = self._hide(ids, self.manifest.next_gen)
            if n:
                self._commit(tombstones=(*self.manifest.tombstones, name), deleted=self.manifest.deleted + n, next_gen=self.manifest.next_gen + 1)
        self.metrics.count("removed_docs", n)
        return n

    def _hiding(self, generations: list[dict]) -> DataFrame | None:
        """The tombstones, or None where nothing of ``generations`` is hidden."""
        gone = self.tombstones()
        if gone is None or not self.manifest.deleted:
            return None
        return None if hidden(self._read("documents", DOCUMENTS, generations).select("doc_id", "gen"), gone).isEmpty() else gone

    def candidates(self) -> list[str]:
        """Generations to merge: those of which too few documents are live, and the small ones once there are enough; the smallest first, up to ``merge_most`` postings."""
        c, m = self.config, self.manifest
        dead: dict[int, int] = {}
        if m.deleted:
            dead = {r["gen"]: r["n"] for r in hidden(self.documents().select("doc_id", "gen"), self.tombstones()).groupBy("gen").agg(F.count("*").alias("n")).collect()}
        emptied = [g for g in m.generations if (g["docs"] - dead.get(g["gen"], 0)) * c.compaction_factor < g["docs"]]
        small = [g for g in m.generations if g["postings"] < c.merge_small]
        own = emptied + [g for g in small if g not in emptied] if len(small) >= c.merge_count else emptied
        out, total = [], 0
        for g in sorted(own, key=lambda g: g["postings"]):
            if out and total + g["postings"] > c.merge_most:
                break
            out.append(g["id"])
            total += g["postings"]
        return out

    def worth_compacting(self) -> bool:
        return bool(self.candidates())

    def compact(self, only: Iterable[str] | None = None) -> None:
        """Writes generations, ``only`` those named or all, without deleted documents as one. Readers of older manifests are not disturbed.

        Tombstones go when all generations were written; else they stay for the others.
        """
        self._open(write=True)
        m = self.manifest
        names = {g["id"] for g in m.generations} if only is None else set(only)
        own, rest = [g for g in m.generations if g["id"] in names], [g for g in m.generations if g["id"] not in names]
        if not own:
            return
        where = f"gen-{m.next_gen:08d}-{uuid.uuid4().hex}"
        with self.metrics.timed("compact"):
            gone = self._hiding(own)
            postings = self._read("postings", POSTINGS, own)
            if gone is not None:
                # Without a broadcast all postings would be shuffled by document, which costs more than deriving them.
                postings = live(postings, F.broadcast(gone)) if m.deleted <= BROADCAST else None
            n = self._laid(live(self._read("documents", DOCUMENTS, own), gone), where, m.next_gen, postings)
            size = {"id": where, "gen": m.next_gen, "docs": n["docs"], "postings": n["postings"], "low": n["low"], "high": n["high"]}
            gone = sum(g["docs"] for g in own) - n["docs"]
            self._commit(generations=(*rest, size) if n["docs"] else tuple(rest), tombstones=m.tombstones if rest else (), deleted=m.deleted - gone, next_gen=m.next_gen + 1)
        self.metrics.count("compacted_generations", len(own))
        self.metrics.count("dropped_docs", gone)

    def vacuum(self) -> list[str]:
        """Deletes what no manifest needs: the current one, those that a reader holds, and those younger than ``keep_old`` seconds do."""
        self._open(write=True)
        keep = {f"manifest-{v:012d}.json" for v in {self.manifest.version, *self._readers()}}
        names = self.store.names()
        if self.config.keep_old:
            # A manifest is old from the time of the next one.
            every = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
            keep |= {a for a, b in zip(every, every[1:]) if self.store.age(b) < self.config.keep_old}
        needed = set(keep)
        for n in keep & set(names):
            m = self._manifest(self.store, n)
            needed |= {g["id"] for g in m.generations} | set(m.tombstones)
        gone = [n for n in names if n not in needed and n.startswith(("gen-", "tombstones-", "manifest-"))]
        for n in gone:
            self.store.delete(n)
        return gone
