"""Identity by arrival: evidence is folded into journeys in the order of its time.

A record brings nodes (keys of some kind).  In this order it meets the journeys that its nodes are in:
none makes a journey; one takes the record; of several, the one whose authority is the record's customer, else the one
with the strongest active edge, then the latest.  A shared hash that would join the journeys of two
customers is quarantined from that moment on.  Two authorities that remain stop the record.  Nodes that were elsewhere
are rehomed, and a journey without active edges is merged into the winner.  So the outcome depends on the order.

Only records that share a live node, or whose nodes are in one journey, act upon each other.  They form a part;
Spark brings parts together, sorts each by (time, record), and a task folds it row by row, with the part's nodes
and journeys as its state.  Where a part has more than PART_ROWS records, time is cut in two and the later half starts from
the state of the earlier one: nodes that were quarantined connect nothing any more, so parts shrink.

Defined results: a record without nodes isn't folded; of records that repeat a record_id the first by time counts;
equal times go by record_id, and times that are null come first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.operators.graph import components
from tidemark.session import ship
from tidemark.storage import stage

#: Records of a part that one task folds, at most, unless they share one moment.
PART_ROWS = 1_000_000
#: Kinds of keys that are quarantined rather than shared by customers.
SHARED = ("email_hash", "phone_hash")
EDGES = "node_type string, node_key string, precedence int, journey string, kind string, first_at timestamp_ntz, last_at timestamp_ntz, record_id long"
JOURNEYS = "journey string, customer string, merged_into string, version int"
LOG = "record_id long, at timestamp_ntz, outcome string, reason string, journey string, processed int, attached int, rehomed array<struct<node_type:string,node_key:string,from_journey:string>>, quarantined array<struct<node_type:string,node_key:string,from_journey:string>>, merged array<string>, customers array<string>"
OUT = f"part long, log struct<{LOG}>, edge struct<{EDGES}>, owner struct<{JOURNEYS}>"


@dataclass
class Edge:
    """The active edge of a node."""

    precedence: int
    journey: str
    kind: str
    first_at: object
    last_at: object
    record_id: int


@dataclass
class Fold:
    """The journeys and active edges of one part."""

    edges: dict[tuple[str, str], Edge] = field(default_factory=dict)
    customer: dict[str, str | None] = field(default_factory=dict)
    merged_into: dict[str, str] = field(default_factory=dict)
    version: dict[str, int] = field(default_factory=dict)
    ranks: dict[str, dict[int, int]] = field(default_factory=dict)
    latest: dict[str, list] = field(default_factory=dict)

    def put(self, node: tuple[str, str], edge: Edge) -> None:
        """The node's active edge becomes this one."""
        self.leave(node)
        self.edges[node] = edge
        ranks = self.ranks.setdefault(edge.journey, {})
        ranks[edge.precedence] = ranks.get(edge.precedence, 0) + 1
        self.seen(node, edge)

    def leave(self, node: tuple[str, str]) -> None:
        old = self.edges.pop(node, None)
        if old:
            ranks = self.ranks[old.journey]
            ranks[old.precedence] -= 1
            if not ranks[old.precedence]:
                del ranks[old.precedence]

    def seen(self, node: tuple[str, str], edge: Edge) -> None:
        heapq.heappush(self.latest.setdefault(edge.journey, []), (-_micros(edge.last_at), node))

    def score(self, journey: str) -> tuple[int, int, str]:
        """Smaller is better: the strongest active edge, then the latest, then the name."""
        heap = self.latest.get(journey, [])
        while heap:
            edge = self.edges.get(heap[0][1])
            if edge and edge.journey == journey and -_micros(edge.last_at) == heap[0][0]:
                break
            heapq.heappop(heap)
        return -max(self.ranks.get(journey, {0: 1})), heap[0][0] if heap else 0, journey

    def take(self, record_id: int, at: object, nodes: list[tuple[str, str, int]]) -> dict:
        """Fold one record; returns its row of the log."""
        customer = next((k for t, k, _ in nodes if t == "customer_id"), None)
        met = [(n[:2], self.edges[n[:2]]) for n in nodes if n[:2] in self.edges]
        live = [(node, e) for node, e in met if e.kind != "quarantined"]
        log = {"record_id": record_id, "at": at, "processed": len(nodes), "attached": 0, "rehomed": [], "quarantined": [], "merged": [], "customers": None}
        journeys = sorted({e.journey for _, e in live})
        authority = next((j for j in journeys if customer is not None and self.customer[j] == customer), None)
        owners = {self.customer[j] for j in journeys} - {None}
        if len(owners) > 1 and authority:
            for node, e in live:
                if node[0] in SHARED and self.customer[e.journey] not in (None, customer):
                    log["quarantined"].append({"node_type": node[0], "node_key": node[1], "from_journey": e.journey})
                    self.put(node, Edge(e.precedence, e.journey, "quarantined", at, at, record_id))
            live = [(node, e) for node, e in live if self.edges[node].kind != "quarantined"]
            owners = {self.customer[e.journey] for _, e in live} - {None}
        if len(owners) > 1:
            return log | {"outcome": "conflict", "reason": "several_authorities", "journey": None, "customers": sorted(owners)}
        if not journeys:
            winner, reason = f"j{record_id}", "created_new_journey"
            self.customer[winner], self.version[winner] = customer, 1
        elif authority:
            winner, reason = authority, "authority"
        elif len(journeys) == 1:
            winner, reason = journeys[0], "reused_journey"
        else:
            winner, reason = min((e.journey for _, e in live), key=self.score), "precedence" if customer is None else "authority"
        for kind, key, precedence in nodes:
            node = (kind, key)
            old = self.edges.get(node)
            if old is None:
                log["attached"] += 1
                self.put(node, Edge(precedence, winner, "authoritative" if kind == "customer_id" else "deterministic", at, at, record_id))
            elif old.kind == "quarantined":
                continue
            elif old.journey == winner:
                old.first_at, old.last_at = min(old.first_at, at, key=_micros), max(old.last_at, at, key=_micros)
                self.seen(node, old)
            else:
                log["rehomed"].append({"node_type": kind, "node_key": key, "from_journey": old.journey})
                self.put(node, Edge(precedence, winner, "promoted", at, at, record_id))
        if customer is not None:
            self.customer[winner] = customer
        if log["attached"] or log["rehomed"] or log["quarantined"] or reason == "created_new_journey":
            self.version[winner] += 1
        for j in journeys:
            if j != winner and not self.ranks.get(j) and j not in self.merged_into:
                self.merged_into[j] = winner
                log["merged"].append(j)
        return log | {"outcome": "linked", "reason": reason, "journey": winner}

    def rows(self) -> tuple[Iterable[dict], Iterable[dict]]:
        edges = ({"node_type": n[0], "node_key": n[1], "precedence": e.precedence, "journey": e.journey, "kind": e.kind, "first_at": e.first_at, "last_at": e.last_at, "record_id": e.record_id} for n, e in self.edges.items())
        owners = ({"journey": j, "customer": c, "merged_into": self.merged_into.get(j), "version": self.version[j]} for j, c in self.customer.items())
        return edges, owners


def _micros(at: datetime | None) -> int:
    return -(1 << 62) if at is None else (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def fold_sorted(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, state first, at, record_id) to OUT: the log, and each part's edges and journeys at its end."""
    fold, here, out = Fold(), None, []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[1 + i] for r in rows], k) for i, k in enumerate(kinds)]], names=["part", "log", "edge", "owner"])

    def ended() -> Iterator[tuple]:
        edges, owners = fold.rows()
        yield from ((here, None, e, None) for e in edges)
        yield from ((here, None, None, o) for o in owners)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != here:
                if here is not None:
                    out += ended()
                fold, here = Fold(), row["part"]
            if row["owner"]:
                o = row["owner"]
                fold.customer[o["journey"]], fold.version[o["journey"]] = o["customer"], o["version"]
                if o["merged_into"] is not None:
                    fold.merged_into[o["journey"]] = o["merged_into"]
            elif row["edge"]:
                e = row["edge"]
                fold.put((e["node_type"], e["node_key"]), Edge(e["precedence"], e["journey"], e["kind"], e["first_at"], e["last_at"], e["record_id"]))
            else:
                out.append((here, fold.take(row["record_id"], row["at"], [(n["node_type"], n["node_key"], n["precedence"]) for n in row["nodes"]]), None, None))
            while len(out) >= 4096:
                yield flush(out[:4096])
                out = out[4096:]
    if here is not None:
        out += ended()
    for lo in range(0, len(out), 4096):
        yield flush(out[lo : lo + 4096])


def gathered(found: DataFrame) -> DataFrame:
    """record_id, at, nodes of every record of evidence, each once, with the nodes of its first time."""
    rows = found.withColumn("at", F.col("at").cast("timestamp_ntz"))
    per = rows.groupBy("record_id", "at").agg(F.array_sort(F.collect_set(F.struct("node_type", "node_key", F.col("precedence").cast("int").alias("precedence")))).alias("nodes"))
    return per.groupBy("record_id").agg(F.min_by(F.struct("at", "nodes"), F.struct(F.col("at").isNotNull(), "at")).alias("first")).select("record_id", "first.*")


@dataclass
class State:
    """Active edges and journeys, as tables."""

    edges: DataFrame
    journeys: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], EDGES), spark.createDataFrame([], JOURNEYS))


def parts_of(records: DataFrame, state: State) -> tuple[DataFrame, DataFrame]:
    """(record_id, part) of every record, and (journey, part) of every journey that they meet."""
    node = ["node_type", "node_key"]
    keyed = records.select("record_id", F.explode("nodes").alias("n")).select("record_id", "n.node_type", "n.node_key")
    known = state.edges.select(*node, "journey", F.col("kind").alias("edge_kind"))
    met = stage(keyed.join(known, node, "left").where("edge_kind is null or edge_kind <> 'quarantined'"), "met")
    by_node = met.select("record_id", F.concat("node_type", F.lit(":"), "node_key").alias("hub"))
    by_journey = met.where("journey is not null").select("record_id", F.concat(F.lit("journey="), "journey").alias("hub"))
    hubs = stage(by_node.union(by_journey).distinct(), "hubs")
    heads = hubs.groupBy("hub").agg(F.min("record_id").alias("a"))
    joined = components(hubs.join(heads, "hub").select("a", F.col("record_id").alias("b")))
    part = records.select("record_id").join(joined.withColumnRenamed("id", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("part"))
    journeys = met.where("journey is not null").select("journey", "record_id").groupBy("journey").agg(F.min("record_id").alias("record_id")).join(part, "record_id").select("journey", "part")
    return stage(part, "parts"), stage(journeys, "journeys_met")


def fold_once(records: DataFrame, part: DataFrame, met: DataFrame, state: State) -> tuple[DataFrame, State]:
    """The log of records whose parts are known, and the state after them.

    A part starts from its journeys, their edges, and the quarantined nodes that its records show, wherever these are.
    """
    rows = stage(records.join(part, "record_id"), "rows")
    shown = rows.select("part", F.explode("nodes").alias("n")).select("part", "n.node_type", "n.node_key").distinct()
    locked = state.edges.where("kind = 'quarantined'").join(shown, ["node_type", "node_key"])
    edges = state.edges.join(met, "journey").unionByName(locked).distinct()
    kinds = {"at": "timestamp_ntz", "record_id": "long", "nodes": rows.schema["nodes"].dataType.simpleString(), "edge": f"struct<{EDGES}>", "owner": f"struct<{JOURNEYS}>"}

    def step(df: DataFrame, number: int, **given) -> DataFrame:
        return df.select("part", F.lit(number).alias("step"), *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])

    owners = step(state.journeys.join(met, "journey"), 0, owner=F.struct(*state.journeys.columns))
    known = step(edges, 1, edge=F.struct(*state.edges.columns))
    new = step(rows, 2, **{name: F.col(name) for name in ("at", "record_id", "nodes")})
    every = owners.unionByName(known).unionByName(new)
    arrow = [to_arrow_type(f.dataType) for f in StructType.fromDDL(OUT).fields[1:]]
    ordered = every.repartition("part").sortWithinPartitions("part", "step", "at", "record_id")
    out = stage(ordered.mapInArrow(lambda batches: fold_sorted(batches, arrow), OUT), "folded")
    after = out.where("edge is not null").select("edge.*").distinct()  # a quarantined node comes back from all parts that know it, as it was
    rest = state.edges.join(after.select("node_type", "node_key"), ["node_type", "node_key"], "left_anti")
    journeys = out.where("owner is not null").select("owner.*")
    others = state.journeys.join(journeys.select("journey"), "journey", "left_anti")
    return out.where("log is not null").select("log.*"), State(stage(after.unionByName(rest), "edges"), stage(journeys.unionByName(others), "owners"))


def folded(found: DataFrame, state: State | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, State]:
    """The log of all evidence (nodes as of identity.nodes), one row a record, and the state after it."""
    ship(found.sparkSession)
    records = stage(gathered(found), "records")
    state = state or empty_state(found.sparkSession)
    logs, ahead = [], [records]
    while ahead:
        now = ahead.pop()
        part, met = parts_of(now, state)
        largest = part.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        if largest > part_rows:
            least, middle, most = now.select(F.min("at"), F.percentile_approx("at", F.lit(0.5)), F.max("at")).first()
            if least is not None and most > least:
                late = F.col("at") >= F.lit(str(middle if middle > least else most)).cast("timestamp_ntz")
                ahead += [now.where(late), now.where(~late | F.col("at").isNull())]
                continue
        log, state = fold_once(now, part, met, state)
        logs.append(log)
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out, state


def merges(log: DataFrame) -> DataFrame:
    """record_id, at, journey, into, reason of every journey that was merged into another."""
    return log.select("record_id", "at", F.explode("merged").alias("journey"), F.col("journey").alias("into"), "reason")


def rehomed(log: DataFrame) -> DataFrame:
    """record_id, at, node_type, node_key, from_journey, to_journey of every node that changed its journey."""
    return log.select("record_id", "at", F.col("journey").alias("to_journey"), F.explode("rehomed").alias("n")).select("record_id", "at", "n.node_type", "n.node_key", "n.from_journey", "to_journey")


def hard_stops(log: DataFrame) -> DataFrame:
    """record_id, at, customers of the records that two authorities stopped."""
    return log.where("outcome = 'conflict'").select("record_id", "at", "customers")
