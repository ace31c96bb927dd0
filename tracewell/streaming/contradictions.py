"""Contradictions between relations, told when an edge arrives."""

import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that a task packs at a time, and links in a row of output.
PACK_ROWS, PACK_LINKS = 200_000, 10_000


class OpenRelations(StatefulProcessor):
    """State of a bucket of pairs: its open edges with pair and relation type, in numbered parts of the state store."""

    def __init__(self, part_edges: int) -> None:
        self.part_edges = part_edges

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "part int", "pair array<string>, edge_key array<long>, relation_type array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        links = self._links(_by_pair((event for r in rows for event in pickle.loads(r["events"])), key[1]))
        while block := [*islice(links, PACK_LINKS)]:
            edges, others = zip(*block)
            yield Row(edge_key=[*edges], contradicts=[*others])

    def _links(self, pairs: dict[str, tuple[list, dict, dict]]) -> Iterator[tuple]:
        """Links of the batch's inserts to edges that are open then; each part of the state is read once a batch."""
        numbers = sorted(n for n, in self.open.keys())
        loose, free = [], []
        for number in numbers:
            stored = [*zip(*self.open.getValue((number,)))]
            left = []
            for entry in stored:
                pair, edge, kind = entry
                inserts, closed, fresh = pairs.get(pair, _NOTHING)
                end = closed.get(edge)
                for at, arrived, its_kind, _ in inserts:
                    if end is not None and end <= at:
                        break
                    if its_kind != kind:
                        yield arrived, edge
                if edge not in closed and edge not in fresh:
                    left.append(entry)
            if 2 * len(left) < self.part_edges:
                loose += left
                free.append(number)
            elif len(left) < len(stored):
                self._store(number, left)
            if len(loose) >= self.part_edges:
                self._store(free.pop(), loose[:self.part_edges])
                del loose[:self.part_edges]
        for inserts, closed, _ in pairs.values():
            for i, (at, edge, kind, stored) in enumerate(inserts):
                if stored:
                    end = closed.get(edge)
                    for later, arrived, its_kind, _ in islice(inserts, i + 1, None):
                        if end is not None and end <= later:
                            break
                        if later > at and its_kind != kind:
                            yield arrived, edge
        unused = count(numbers[-1] + 1 if numbers else 0)
        entries = chain(loose, ((pair, edge, kind) for pair, (_, _, fresh) in pairs.items() for edge, kind in fresh.items()))
        while part := [*islice(entries, self.part_edges)]:
            self._store(free.pop() if free else next(unused), part)
        for number in free:
            self.open.removeKey((number,))

    def _store(self, number: int, entries: list[tuple]) -> None:
        self.open.updateValue((number,), tuple(map(list, zip(*entries))))

    def close(self) -> None:
        pass


_NOTHING: tuple = ((), {}, {})


def _by_pair(events: Iterator[tuple], salt: int) -> dict[str, tuple[list, dict, dict]]:
    """For each pair of a batch its inserts in order (at, edge, kind, stored), when its edges are closed, and the kinds
    of the edges that stay open and are stored under this salt."""
    pairs: dict = {}
    for pair, edge, kind, at, opens, home in sorted(events, key=itemgetter(3, 4)):
        if (own := pairs.get(pair)) is None:
            own = pairs[pair] = ([], {}, {})
        if opens:
            own[0].append((at, edge, kind, home == salt))
        elif home == salt:
            own[1].setdefault(edge, at)
    for inserts, closed, fresh in pairs.values():
        fresh.update((edge, kind) for _, edge, kind, stored in inserts if stored and edge not in closed)
    return pairs


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of a task by bucket, as a row for each bucket: every row and column that Spark hands to a stateful
    processor costs it some microseconds."""
    own, rows = defaultdict(list), 0
    for batch in chain(batches, [None]):
        if batch is not None:
            *events, buckets = (c.to_pylist() for c in batch.columns)
            for bucket, event in zip(buckets, zip(*events)):
                own[bucket].append(event)
            rows += batch.num_rows
        if own and (batch is None or rows >= PACK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([*own], pa.int32()), pa.array(map(pickle.dumps, own.values()), pa.binary())], names=["bucket", "events"])
            own, rows = defaultdict(list), 0


def contradictions(log: DataFrame, salts: int = 4, buckets: int = 1024, part_edges: int = 10_000) -> DataFrame:
    """Stream of edge_key, contradicts: the open edges of the same pair, of other relation types, at the time of each insert.

    `log` is a stream of source_id, target_id, edge_key, relation_type (NULL for a closure), at (its place in the
    order of inserts and closures) and opens (true for an insert, false for a closure). Inside a batch rows may
    come in any order; batches follow one another. A closure at the place of an insert comes first. Edges and
    closures come once each.

    Pairs are dealt into `buckets` by a hash, and the open edges of a bucket over `salts` keys by a hash of the edge, so
    a pair that holds a large part of the edges is no single key; an insert asks all of them and is stored in one.
    Calls to the state store are what takes time, so a key keeps its open edges in entries of up to `part_edges`, and a
    batch reads each of them and writes those that change. A batch thus reads the open edges of the buckets it touches:
    take more buckets where small batches meet many pairs. All three are part of the query's checkpoint, as is the
    state, which lives in RocksDB.
    """
    if log.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        log.sparkSession.conf.set(PROVIDER, ROCKSDB)
    pair = F.to_json(F.array(F.col("source_id").cast("string"), F.col("target_id").cast("string")))
    home = F.pmod(F.xxhash64("edge_key"), F.lit(salts)).cast("int")
    bucket = F.pmod(F.xxhash64("source_id", "target_id"), F.lit(buckets)).cast("int")
    events = log.select(pair.alias("pair"), "edge_key", "relation_type", "at", "opens", home.alias("home"), bucket.alias("bucket"))
    dealt = events.mapInArrow(_packed, "bucket int, events binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    links = dealt.groupBy("bucket", "salt").transformWithState(OpenRelations(part_edges), "edge_key array<long>, contradicts array<long>", "Append", "None")
    return links.select(F.inline(F.arrays_zip("edge_key", "contradicts")))
