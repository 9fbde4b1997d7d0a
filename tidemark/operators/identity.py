"""Identity: nodes of evidence, ownership of keys, journeys as connected parts, edges, conflicts and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.order import positions
from tidemark.storage import stage

# Kinds of keys and their precedence.
PRECEDENCE = {"customer_id": 100, "email_hash": 70, "phone_hash": 60, "checkout_token": 40, "cart_token": 30, "session_id": 20}


def nodes(evidence: DataFrame) -> DataFrame:
    """record_id, at, node_type, node_key, precedence for every key that a record of evidence has."""
    kinds = [k for k in PRECEDENCE if k in evidence.columns]
    parts = F.array(*[F.struct(F.lit(k).alias("node_type"), F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias("node_key"), F.lit(PRECEDENCE[k]).alias("precedence")) for k in kinds])
    return evidence.select("record_id", "at", F.explode(F.filter(parts, lambda x: x["node_key"].isNotNull())).alias("n")).select("record_id", "at", "n.*")


def quarantined(found: DataFrame) -> DataFrame:
    """node_type, node_key, owners: shared keys that more than one customer id has shown."""
    owner = found.where("node_type = 'customer_id'").select("record_id", F.col("node_key").alias("customer"))
    shared = found.where(F.col("node_type").isin("email_hash", "phone_hash")).join(owner, "record_id")
    return shared.groupBy("node_type", "node_key").agg(F.countDistinct("customer").alias("owners")).where("owners > 1")


def shown_keys(found: DataFrame) -> DataFrame:
    """node_type, node_key, owner, several of every key but customer ids that a customer has shown."""
    customer = customers(found)
    return found.where("node_type <> 'customer_id'").join(customer, "record_id").groupBy("node_type", "node_key").agg(F.min("customer").alias("owner"), (F.min("customer") != F.max("customer")).alias("several"))


def customers(found: DataFrame) -> DataFrame:
    return found.where("node_type = 'customer_id'").groupBy("record_id").agg(F.min("node_key").alias("customer"))


def assigned(found: DataFrame) -> DataFrame:
    """record_id, journey, by: the journey of every record.

    Records that share a key are connected, over any number of records, but for keys that several customers
    have shown: these are quarantined and connect nothing.  A record of a customer is in that customer's
    journey.  The others of a connected part follow its only customer; a part of no customer is a
    journey that its strongest key names.  Where a chain of keys connects several customers, a record
    follows the owner of its own strongest owned key, and without one the part is a conflict of its own.  The
    result doesn't depend on the order of arrival.
    """
    customer, keys = customers(found), found.where("node_type <> 'customer_id'")
    usable = stage(keys.join(shown_keys(found), ["node_type", "node_key"], "left").where("not coalesce(several, false)"), "keys")
    roots = usable.groupBy("node_type", "node_key").agg(F.min("record_id").alias("a"))
    joined = components(usable.join(roots, ["node_type", "node_key"]).select("a", F.col("record_id").alias("b")))
    part = found.select("record_id").distinct().join(joined.withColumnRenamed("id", "record_id"), "record_id", "left")
    part = part.join(customer, "record_id", "left").select("record_id", "customer", F.coalesce("component", "record_id").alias("component"))
    owners = part.groupBy("component").agg(F.min("customer").alias("least"), F.max("customer").alias("most"))
    own = usable.groupBy("record_id").agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.struct("precedence", "node_key"))).alias("owner"), F.max(F.struct("precedence", "node_key", "node_type")).alias("best"))
    known = part.join(own, "record_id", "left")
    named = known.groupBy("component").agg(F.max("best").alias("named"))
    out = known.join(owners, "component").join(named, "component")
    one, several = F.col("least") == F.col("most"), F.col("least") != F.col("most")
    by = (
        F.when(F.col("customer").isNotNull(), "customer_id").when(F.col("owner").isNotNull(), "owned_key").when(one, "chain").when(several, "conflict")
        .when(F.col("named").isNotNull(), "founded").otherwise("none")
    )
    journey = F.coalesce(
        F.concat(F.lit("customer:"), F.coalesce("customer", "owner", F.when(one, F.col("least")))),
        F.when(several, F.concat(F.lit("conflict:"), F.col("component").cast("string"))), F.concat("named.node_type", F.lit(":"), "named.node_key"),
    )
    return out.select("record_id", journey.alias("journey"), by.alias("by"))


def edges(found: DataFrame, journeys: DataFrame) -> DataFrame:
    """One row per journey and node: precedence, first_at, last_at, is_active, conflict_code.

    An edge is active when its journey is the node's best; a quarantined node's edges are never.
    """
    both = found.join(journeys.where("journey is not null"), "record_id")
    rows = both.groupBy("journey", "node_type", "node_key").agg(F.max("precedence").alias("precedence"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("seen"))
    best = best_journeys(found, journeys).select("node_type", "node_key", F.col("journey").alias("best"))
    bad = shown_keys(found).where("several").select("node_type", "node_key", F.lit(True).alias("bad"))
    rows = rows.join(best, ["node_type", "node_key"], "left").join(bad, ["node_type", "node_key"], "left")
    code = F.when(F.col("bad"), "quarantined").when(F.col("best") != F.col("journey"), "other_journey")
    return rows.withColumns({"conflict_code": code, "is_active": code.isNull()}).drop("best", "bad")


def edge_order() -> list[Column]:
    """Active edges first, the strongest first, then by kind and key."""
    return [F.desc("is_active"), F.desc("precedence"), F.asc("node_type"), F.asc("node_key"), F.asc("first_at")]


def find_journey(edged: DataFrame, node_type: str, node_key: str) -> DataFrame:
    """The journey that a key belongs to: none or one row."""
    return edged.where((F.col("node_type") == node_type) & (F.col("node_key") == node_key) & F.col("is_active")).select("journey", "node_type", "node_key").orderBy("journey").limit(1)


def node_candidates(found: DataFrame, edged: DataFrame) -> DataFrame:
    """node_type, node_key, journey, rank, last_at of all nodes with their active journeys, null where a node has none."""
    active = edged.where("is_active").select("node_type", "node_key", "journey", F.col("precedence").alias("rank"), "last_at")
    return found.select("node_type", "node_key").distinct().join(active, ["node_type", "node_key"], "left")


def conflicts(edged: DataFrame, first: Column, before: Column, limit: int) -> DataFrame:
    """The latest edges in conflict that were seen in the range."""
    rows = edged.where(F.col("conflict_code").isNotNull() & (F.col("last_at") >= first) & (F.col("last_at") < before))
    return rows.orderBy(F.desc("last_at"), "journey", "node_type", "node_key").limit(limit)


def runs(found: DataFrame, records: DataFrame, journeys: DataFrame, edged: DataFrame) -> DataFrame:
    """record_id, at, source, status, outcome_reason, rehomed, quarantined of every record's ingestion.

    Nodes that went to another journey are rehomed.  A record without any key is completed as
    missing_identifiers; one whose journey is a conflict is conflicted.
    """
    state = edged.select("journey", "node_type", "node_key", "conflict_code")
    met = found.join(journeys, "record_id").join(state, ["journey", "node_type", "node_key"], "left")
    per = met.groupBy("record_id").agg(F.count_if(F.col("conflict_code") == "other_journey").alias("rehomed"), F.count_if(F.col("conflict_code") == "quarantined").alias("quarantined"))
    out = records.select("record_id", "at", "source").join(per, "record_id", "left").join(journeys.select("record_id", "by"), "record_id", "left")
    zero = F.lit(0).cast("long")
    missing = F.col("rehomed").isNull()
    status = F.when(F.col("by") == "conflict", "conflicted").otherwise("completed")
    return out.select("record_id", "at", "source", status.alias("status"), F.when(missing, "missing_identifiers").when(F.col("by") == "conflict", "several_customers").otherwise("linked").alias("outcome_reason"), F.coalesce("rehomed", zero).alias("rehomed"), F.coalesce("quarantined", zero).alias("quarantined"))


def health(rows: DataFrame, *keys: Column) -> DataFrame:
    """Counts of runs: total, linked, skipped, conflicted, with rehomed nodes, and the sums of rehomed and quarantined nodes."""
    done = (F.col("status") == "completed") & (F.coalesce("outcome_reason", F.lit("linked")) != "missing_identifiers")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(done).alias("linked"), F.count_if(F.col("outcome_reason") == "missing_identifiers").alias("skipped"),
        F.count_if(F.col("status") == "conflicted").alias("conflicted"), F.count_if(F.col("rehomed") > 0).alias("merges"), total("rehomed").alias("rehomed"), total("quarantined").alias("quarantined"),
    )


def journey_documents(edged: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """journey, edges, sessions, orders: a journey's nodes in their order, and its sessions and orders by time.

    ``sessions`` and ``orders`` have journey and the columns (at, id).
    """
    less = F.struct((~F.col("is_active")).alias("inactive"), (-F.col("precedence")).alias("less"), "node_type", "node_key")
    nodes_of = edged.groupBy("journey").agg(F.array_sort(F.collect_list(less)).alias("edges"))
    listed = lambda df, name: df.groupBy("journey").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias(name))
    out = nodes_of.join(listed(sessions, "sessions"), "journey", "left").join(listed(orders, "orders"), "journey", "left")
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<at:timestamp_ntz,id:string>>")), lambda x: x["id"])
    return out.select("journey", F.transform("edges", lambda e: F.concat(e["node_type"], F.lit(":"), e["node_key"])).alias("edges"), ids(F.col("sessions")).alias("sessions"), ids(F.col("orders")).alias("orders"))


def journey_pages(edged: DataFrame, sessions: DataFrame, orders: DataFrame, page_rows: int = 500) -> DataFrame:
    """journey, section, page, pages, entries: a journey's nodes, sessions and orders in their order, in pages of ``page_rows``.

    A journey of any size comes out in rows of bounded length: its entries get their places from sorted ranges, and only a page is
    gathered.  ``sessions`` and ``orders`` have journey and the columns (at, id); times that are null come first.
    """
    node = edged.select("journey", F.lit("edges").alias("section"), ((~F.col("is_active")).cast("long") * 1_000 - F.col("precedence")).alias("rank"), F.concat("node_type", F.lit(":"), "node_key").alias("entry"))
    timed = lambda df, name: df.select("journey", F.lit(name).alias("section"), F.unix_micros(F.col("at").cast("timestamp")).alias("rank"), F.col("id").alias("entry"))
    entries = node.unionByName(timed(sessions, "sessions")).unionByName(timed(orders, "orders"))
    entries = stage(entries.withColumn("__grp", F.concat("section", F.lit("="), "journey")), "entries")
    placed = positions(entries, "__grp", ["rank", "entry"], "placed")
    page = placed.groupBy("journey", "section", F.expr(f"pos div {page_rows}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("list"), F.ceil(F.max("n") / page_rows).cast("long").alias("pages"))
    return page.select("journey", "section", "page", "pages", F.transform("list", lambda x: x["entry"]).alias("entries"))


def evidence_hubs(records: DataFrame) -> DataFrame:
    """hub, kind, member: the records and the sessions of every token and of every named session, each once.

    A record and a session belong together when they share a hub.  Rows grow with the records, however many share a token,
    where pairs would grow with their product.
    """
    token = lambda member, kind: records.where("checkout_token is not null").select(F.concat(F.lit("checkout_token:"), "checkout_token").alias("hub"), F.lit(kind).alias("kind"), F.col(member).cast("string").alias("member"))
    named = lambda member, kind: records.where("session_id is not null").select(F.concat(F.lit("session:"), "session_id").alias("hub"), F.lit(kind).alias("kind"), F.col(member).cast("string").alias("member"))
    rows = token("record_id", "record").unionByName(token("visit", "session")).unionByName(named("record_id", "record")).unionByName(named("session_id", "session"))
    return rows.where("member is not null").distinct()


def evidence_sessions(records: DataFrame) -> DataFrame:
    """record_id, session_id: the session a record names and those that showed its checkout token.

    A token's sessions are made distinct before they meet its records.
    """
    shown = records.where("checkout_token is not null").select("checkout_token", F.col("visit").alias("session_id")).distinct()
    by_token = records.where("checkout_token is not null").select("record_id", "checkout_token").join(shown, "checkout_token").select("record_id", "session_id")
    return records.where("session_id is not null").select("record_id", "session_id").union(by_token).distinct()


def node_ranges(found: DataFrame) -> DataFrame:
    """First and last observation of every node, whatever the order of arrival."""
    return found.groupBy("node_type", "node_key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("seen"))


def best_journeys(found: DataFrame, journeys: DataFrame) -> DataFrame:
    """Per node the journey of the highest precedence, then the latest, then the smallest name."""
    scored = found.join(journeys.where("journey is not null"), "record_id").groupBy("node_type", "node_key", "journey").agg(F.max("precedence").alias("rank"), F.max("at").alias("at"))
    order = Window.partitionBy("node_type", "node_key").orderBy(F.desc("rank"), F.desc("at"), "journey")
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def met_by(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Left join by a key that many rows lack: these meet nothing, and are dealt out by record_id, as one task would get all nulls."""
    known = lambda: F.concat(F.lit("key:"), F.col(key).cast("string"))
    at = F.coalesce(known(), F.concat(F.lit("none:"), F.col("record_id").cast("string")))
    keyed = others.select(known().alias("__at"), *[c for c in others.columns if c != key])
    return rows.withColumn("__at", at).join(keyed, "__at", "left").drop("__at")


def stitch(identities: DataFrame, incoming: DataFrame) -> DataFrame:
    """record_id, decision: how an e-mail hash and a customer id fit the known identities.

    skipped without either; conflict when both are known of different identities, or the identity of
    one holds another value of the other; reuse when one is known; create when none is.
    """
    by_email = identities.where("email_hash is not null").select("email_hash", F.col("identity_id").alias("e_id"), F.col("customer_id").alias("e_customer"))
    by_customer = identities.where("customer_id is not null").select("customer_id", F.col("identity_id").alias("c_id"), F.col("email_hash").alias("c_email"))
    out = met_by(met_by(incoming, by_email, "email_hash"), by_customer, "customer_id")
    none: Column = F.col("email_hash").isNull() & F.col("customer_id").isNull()
    decision = (
        F.when(none, "skipped").when(F.col("e_id").isNotNull() & F.col("c_id").isNotNull() & (F.col("e_id") != F.col("c_id")), "conflict_two_identities")
        .when(F.col("e_customer").isNotNull() & F.col("customer_id").isNotNull() & (F.col("e_customer") != F.col("customer_id")), "conflict_customer")
        .when(F.col("c_email").isNotNull() & F.col("email_hash").isNotNull() & (F.col("c_email") != F.col("email_hash")), "conflict_email")
        .when(F.col("e_id").isNotNull() | F.col("c_id").isNotNull(), "reuse").otherwise("create")
    )
    return out.select("record_id", decision.alias("decision"), F.coalesce("c_id", "e_id").alias("identity_id"))


def upserted(identities: DataFrame, incoming: DataFrame) -> DataFrame:
    """identity_id, email_hash, customer_id after incoming records (record_id, email_hash, customer_id).

    A record goes to the identity that stitch() gives it; conflicts and records without a key change nothing.
    Records that found an identity share it by their e-mail hash, else their customer id, under minus the
    smallest record_id.  A value that is known stays; a missing one is the first record's that has it, unless
    another identity owns it.
    """
    rows = incoming.join(stitch(identities, incoming).where("decision in ('reuse', 'create')"), "record_id")
    key = F.when(F.col("identity_id").isNull(), F.coalesce(F.concat(F.lit("e"), "email_hash"), F.concat(F.lit("c"), "customer_id")))
    new = rows.where("identity_id is null").groupBy(key.alias("__key")).agg((-F.min("record_id")).alias("__new"))
    rows = met_by(rows.withColumn("__key", key), new, "__key").withColumn("identity_id", F.coalesce("identity_id", "__new"))
    fields = ("email_hash", "customer_id")
    for f in fields:
        owners = identities.where(F.col(f).isNotNull()).select(f, F.col("identity_id").alias("__owner"))
        rows = met_by(rows, owners, f).withColumn(f"__{f}", F.when(F.coalesce(F.col("__owner") == F.col("identity_id"), F.lit(True)), F.col(f))).drop("__owner")
    found = rows.groupBy("identity_id").agg(*[F.min_by(f"__{f}", F.when(F.col(f"__{f}").isNotNull(), F.col("record_id"))).alias(f"__{f}") for f in fields])
    out = identities.join(found, "identity_id", "full_outer")
    return out.select("identity_id", *[F.coalesce(f, f"__{f}").alias(f) for f in fields])
