"""Evidence graphs and the four operators that compress them.

A `Representation` holds three tables. `nodes`: id, kind (mention, state, revision_state), fact_id,
patient_id, concept_type, value, day, confidence, note_id, ord_group, ord, approx_relation,
approx_anchor_day. `edges`: type, source, target and nullable attributes. `history`: the entries of
collapsed revision chains, one row each (node_id, pos from oldest to newest), so that a long chain
never has to fit into one row.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.hashing import draw_key, draw_normal
from tracewell.functions.scalars import allen_relation
from tracewell.session import cut_counted, cut_lineage

KEY = ["patient_id", "concept_type"]
NODE = ["id", "kind", "fact_id", *KEY, "value", "day", "confidence", "note_id", "ord_group", "ord",
        "approx_relation", "approx_anchor_day"]
HISTORY = ["node_id", "pos", "fact_id", *KEY, "value", "day", "confidence", "ord_group", "ord",
           "approx_relation", "approx_anchor_day"]


class Representation(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    history: DataFrame | None = None


def mention_confidence(style, key: Column, table=K.STYLE_CONFIDENCE) -> Column:
    """Simulated extraction confidence of a mention: style mean plus seeded normal noise, clipped."""
    base = F.coalesce(*[F.when(style == s, F.lit(c)) for s, c in table.items()], F.lit(K.DEFAULT_CONFIDENCE))
    low, high = K.CONFIDENCE_RANGE
    noisy = base + F.lit(K.CONFIDENCE_SPREAD) * draw_normal(key)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(noisy, 6)))


def build_evidence_graph(facts: DataFrame, edges: DataFrame, notes: DataFrame, seed: int = 11) -> Representation:
    """One mention node per note and mentioned fact that exists, plus the revision edges.

    `notes` needs note_id, day, style, ord and the array mentioned_fact_ids. A mention carries the
    day of its note. List order becomes `ord`, the note's order and the position in the note.
    """
    mentions = notes.select(
        "note_id", F.col("day").alias("_day"), "style",
        F.col("ord").alias("_base"), F.posexplode("mentioned_fact_ids").alias("_pos", "fact_id"))
    nodes = mentions.join(facts.select("fact_id", *KEY, "value"), "fact_id").select(
        F.concat_ws("__", F.col("note_id").cast("string"), F.col("fact_id").cast("string")).alias("id"),
        F.lit("mention").alias("kind"), "fact_id", *KEY, "value", F.col("_day").cast("int").alias("day"),
        mention_confidence(F.col("style"), draw_key(seed, "note_id", "fact_id")).alias("confidence"), "note_id",
        F.lit(0).alias("ord_group"), F.struct(F.col("_base").alias("note"), F.col("_pos").alias("pos")).alias("ord"),
        F.lit(None).cast("string").alias("approx_relation"), F.lit(None).cast("int").alias("approx_anchor_day"))
    text = lambda c: F.col(c).cast("string")
    derived = nodes.select(F.lit("derived_from").alias("type"), F.col("id").alias("source"), text("note_id").alias("target"))
    revises = edges.select(F.lit("revises").alias("type"), text("to_fact_id").alias("source"),
                           text("from_fact_id").alias("target"), "day")
    return Representation(nodes, derived.unionByName(revises, allowMissingColumns=True))


def representation_size(rep: Representation) -> DataFrame:
    """n_nodes, n_edges, total and serialised bytes, each as one partial aggregate."""
    def measured(df, nodes, edges):
        return df.agg(F.lit(nodes).alias("_n"), F.lit(edges).alias("_e"), F.count("*").alias("_rows"),
                      F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("_bytes"))
    parts = measured(rep.nodes, 1, 0).unionByName(measured(rep.edges, 0, 1))
    if rep.history is not None:
        parts = parts.unionByName(measured(rep.history, 0, 0))
    return parts.agg(
        F.sum(F.col("_n") * F.col("_rows")).alias("n_nodes"), F.sum(F.col("_e") * F.col("_rows")).alias("n_edges"),
        F.sum((F.col("_n") + F.col("_e")) * F.col("_rows")).alias("total"), F.sum("_bytes").alias("bytes"))


def provenance_recall(rep: Representation, base: Representation) -> DataFrame:
    """Share of the base mentions still reachable, as a node or through a membership edge."""
    reachable = rep.nodes.where("kind = 'mention'").select("id")
    if "orig_mention_id" in rep.edges.columns:
        reachable = reachable.unionByName(
            rep.edges.where("type = 'membership'").select(F.col("orig_mention_id").alias("id")))
    marked = base.nodes.where("kind = 'mention'").select("id").distinct().join(
        reachable.distinct().withColumn("_hit", F.lit(1)), "id", "left")
    return marked.agg(F.coalesce(F.try_divide(F.count("_hit"), F.count("*")), F.lit(1.0)).alias("provenance_recall"))


def aggregate_mentions(rep: Representation) -> Representation:
    """Merge the mentions of a fact into one state; membership edges keep every mention."""
    mentions = rep.nodes.where("kind = 'mention'")
    first = F.min_by(F.struct(*KEY, "value"), F.col("ord"))
    states = mentions.groupBy("fact_id").agg(
        first.alias("_f"), F.min("day").alias("day"), F.max("confidence").alias("confidence"),
        F.min("ord").alias("ord"), F.first("ord_group").alias("ord_group"))
    nodes = states.select(
        F.concat(F.lit("state__"), F.col("fact_id").cast("string")).alias("id"), F.lit("state").alias("kind"),
        "fact_id", "_f.*", "day", "confidence", "ord_group", "ord")
    membership = mentions.select(
        F.lit("membership").alias("type"), F.concat(F.lit("state__"), F.col("fact_id").cast("string")).alias("source"),
        F.col("note_id").cast("string").alias("target"), F.col("id").alias("orig_mention_id"),
        F.col("day").alias("mention_day"), F.col("confidence").alias("mention_confidence"), "fact_id")
    others = rep.nodes.where("kind <> 'mention'")
    return Representation(
        nodes.unionByName(others, allowMissingColumns=True).select(*_present(NODE, rep.nodes, nodes)),
        rep.edges.where("type <> 'derived_from'").unionByName(membership, allowMissingColumns=True), rep.history)


def _present(wanted, *frames):
    return [c for c in wanted if any(c in f.columns for f in frames)]


def ancestors(edges: DataFrame, known: DataFrame | None = None, max_levels: int = 40) -> DataFrame:
    """Ancestor table of revisions: fact_id, level, ancestor, the fact 2 ** level revisions before.

    `edges` is (new, old) with one parent per new fact. With `known`, the table of earlier batches, only rows of the
    new facts are made and returned: their pointers lead into the old chains, which are not walked again. Append
    them to the table. A fact that the table has, or that others already revise, gets no other parent.

    Each level is one join, written and counted, about log2 of the longest chain in all; levels that run out are an
    error, as in a chain that runs into a cycle without `max_levels` of 2 ** level facts.
    """
    level = edges.select(F.col("new").alias("fact_id"), F.lit(0).alias("level"), F.col("old").alias("ancestor"))
    if known is not None:
        taken = known.where("level = 0").select(F.col("fact_id").alias("_taken")).unionByName(known.where("level = 0").select(F.col("ancestor").alias("_taken")))
        if not level.join(taken, F.col("fact_id") == F.col("_taken"), "left_semi").isEmpty():
            raise ValueError("a fact of the table cannot get another parent")
    level, n = cut_counted(level)
    rows, n_facts = level, n + (known.where("level = 0").count() if known is not None else 0)
    for i in range(max_levels):
        # A chain without a cycle is shorter than the number of facts; the level beyond shows a cycle.
        if not n or 2 ** i > n_facts:
            return rows
        same = level if known is None else level.unionByName(known.where(F.col("level") == i))
        above = same.select(F.col("fact_id").alias("ancestor"), F.col("ancestor").alias("_above"))
        level, n = cut_counted(level.join(above, "ancestor").select("fact_id", F.lit(i + 1).alias("level"), F.col("_above").alias("ancestor")))
        rows = rows.unionByName(level)
    if n:
        raise ValueError(f"a revision chain goes on after {max_levels} doublings")
    return rows


def chains_from(table: DataFrame, heads: DataFrame) -> DataFrame:
    """Every ancestor of each head by the ancestor table: head, fact_id, depth (0 for the head itself).

    Depths are put together from the highest level down, each once, so one plan with a join for each level does. A cycle's
    facts come at their least depth.
    """
    top = table.agg(F.max("level")).first()[0]
    facts = table.where("level = 0").count()
    ring = top is not None and 2 ** top > facts
    reach = heads.select("head", F.col("head").alias("fact_id"), F.lit(0).alias("depth"))
    for i in reversed(range(0 if top is None else top + 1)):
        step = table.where(F.col("level") == i).select(F.col("fact_id").alias("_from"), "ancestor")
        further = reach.join(step, F.col("fact_id") == F.col("_from")).select("head", F.col("ancestor").alias("fact_id"), (F.col("depth") + (1 << i)).alias("depth"))
        reach = reach.unionByName(further)
        if ring:
            reach = reach.groupBy("head", "fact_id").agg(F.min("depth").alias("depth"))
    return reach


def revision_chains(edges: DataFrame, heads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Every ancestor of each head: head, fact_id, depth (0 for the head itself).

    `edges` is (new, old) with one parent per new fact; `heads` is (head). A chain of d facts needs about log2(d)
    jobs. Chains that run into a cycle have each member once; rounds that run out are an error.
    """
    return chains_from(ancestors(edges, max_levels=max_rounds), heads)


def chain_heads(rep: Representation) -> tuple[DataFrame, DataFrame]:
    """Parent pointers (last edge per new fact) and the newest fact of every chain that has a state."""
    fact_type = rep.nodes.schema["fact_id"].dataType
    revises = rep.edges.where("type = 'revises'").select(
        F.col("source").cast(fact_type).alias("new"), F.col("target").cast(fact_type).alias("old"), "day")
    parents = revises.groupBy("new").agg(F.max_by("old", F.struct("day", "old")).alias("old"))
    states = rep.nodes.where("kind = 'state'").select(F.col("fact_id").alias("head"))
    heads = (states.join(parents.select(F.col("new").alias("head")), "head", "left_semi")
             .join(parents.select(F.col("old").alias("head")), "head", "left_anti"))
    return parents, heads


def collapse_revisions(rep: Representation) -> Representation:
    """Turn each revision chain of states into one node with an ordered history.

    Value, day and confidence come from the newest fact, patient and concept from the oldest with a
    state. Chain members without a state are left out and counted in `n_missing`. Two facts that
    revise the same fact give two nodes sharing the older part.
    """
    parents, heads = chain_heads(rep)
    chains = revision_chains(parents, heads)
    states = rep.nodes.where("kind = 'state'")
    placed = chains.join(
        states.select("fact_id", *KEY, "value", "day", "confidence", "ord"), "fact_id", "left")
    node_id = F.concat(F.lit("revstate__"), F.col("head").cast("string"))
    has_state = F.col("ord").isNotNull()
    per_chain = placed.groupBy("head").agg(
        F.max("depth").alias("_oldest"), F.count("*").alias("n_facts"),
        F.count(F.when(~has_state, F.lit(1))).alias("n_missing"),
        F.max_by(F.struct(*KEY), F.when(has_state, F.col("depth"))).alias("_k"),
        F.min_by(F.struct("value", "day", "confidence", "ord"), F.when(has_state, F.col("depth"))).alias("_n"))
    collapsed = per_chain.select(
        node_id.alias("id"), F.lit("revision_state").alias("kind"), F.col("head").alias("fact_id"), "_k.*", "_n.*",
        F.lit(1).alias("ord_group"), "n_facts", "n_missing")
    # A chain entry belongs to the key of its node and to the place of the chain's newest fact.
    chain_info = per_chain.select("head", "_oldest", F.col("_k.patient_id").alias("_p"),
                                  F.col("_k.concept_type").alias("_c"), F.col("_n.ord").alias("_head_ord"))
    history = placed.where(has_state).join(chain_info, "head").select(
        node_id.alias("node_id"), (F.col("_oldest") - F.col("depth")).alias("pos"), "fact_id",
        F.col("_p").alias("patient_id"), F.col("_c").alias("concept_type"), "value", "day", "confidence",
        F.lit(1).alias("ord_group"), F.col("_head_ord").alias("ord"))
    members = chains.select(F.col("fact_id"), node_id.alias("_node"))
    used = members.select("fact_id").distinct()
    kept = rep.nodes.where("kind <> 'state'").unionByName(states.join(used, "fact_id", "left_anti"))
    membership = rep.edges.where("type = 'membership'")
    moved = membership.join(members, "fact_id").withColumn("source", F.col("_node")).drop("_node")
    edges = (rep.edges.where("type NOT IN ('revises', 'membership')")
             .unionByName(membership.join(used, "fact_id", "left_anti"))
             .unionByName(moved))
    return Representation(kept.unionByName(collapsed, allowMissingColumns=True), edges, history)


def nested_history(rep: Representation) -> DataFrame:
    """Export form of the collapsed nodes: history as an ordered array and the id naming the chain."""
    entry = F.struct("pos", "fact_id", "value", "day", "confidence")
    nested = rep.history.groupBy("node_id").agg(F.array_sort(F.collect_list(entry)).alias("revision_history"))
    named = F.array_join(F.transform("revision_history", lambda h: h["fact_id"].cast("string")), "_")
    return nested.select(F.col("node_id").alias("id"), F.concat(F.lit("revstate__"), named).alias("chain_id"),
                         "revision_history")


def approximate_time(rep: Representation, threshold: float) -> Representation:
    """Replace the day of low-confidence entries by their relation to an anchor day.

    The anchor of a patient and concept is the earliest day among its confident entries; without an
    anchor entries stay as they are. A collapsed node takes the day of its newest entry, which may
    be NULL afterwards.
    """
    sure = F.coalesce(F.col("confidence"), F.lit(1.0)) >= threshold
    dated = rep.nodes.where("kind IN ('state', 'mention')").select(*KEY, "day", "confidence")
    if rep.history is not None:
        dated = dated.unionByName(rep.history.select(*KEY, "day", "confidence"))
    anchors = dated.where(sure).groupBy(*KEY).agg(F.min("day").alias("_anchor"))
    vague = ~sure & F.col("_anchor").isNotNull()

    def blur(df, eligible):
        lossy = vague & eligible
        kept = [c for c in df.columns if c not in ("day", "approx_relation", "approx_anchor_day")]
        return df.join(anchors, KEY, "left").select(
            *kept, F.when(~lossy, F.col("day")).alias("day"),
            F.when(lossy, allen_relation("day", "_anchor")).alias("approx_relation"),
            F.when(lossy, F.col("_anchor")).alias("approx_anchor_day"))

    def related(df, source, extra):
        return df.where(F.col("approx_relation").isNotNull()).select(
            F.lit("temporally_related").alias("type"), F.col(source).alias("source"),
            F.col("approx_relation").alias("relation"), F.col("approx_anchor_day").alias("anchor_day"), *extra)

    nodes = blur(rep.nodes, F.col("kind").isin("state", "mention"))
    edges = rep.edges.unionByName(related(nodes, "id", []), allowMissingColumns=True)
    history = None
    if rep.history is not None:
        history = blur(rep.history, F.lit(True))
        edges = edges.unionByName(
            related(history, "node_id", [F.col("fact_id").alias("history_fact_id")]), allowMissingColumns=True)
        newest = history.groupBy(F.col("node_id").alias("id")).agg(F.max_by("day", "pos").alias("_day"))
        nodes = nodes.join(newest, "id", "left").withColumn(
            "day", F.when(F.col("kind") == "revision_state", F.col("_day")).otherwise(F.col("day"))).drop("_day")
    return Representation(nodes, edges, history)


def fixed_window(rep: Representation, k: int) -> Representation:
    """Keep the k latest mentions per patient and concept, the earlier listed ones on equal days.

    Spark trims each task's rows to k per key before the shuffle (window group limit).
    """
    mentions = rep.nodes.where("kind = 'mention'")
    recent = Window.partitionBy(*KEY).orderBy(F.col("day").desc(), F.col("ord"))
    kept = mentions.withColumn("_rank", F.row_number().over(recent)).where(F.col("_rank") <= k).drop("_rank")
    orphan = F.col("type") == "derived_from"
    edges = rep.edges.where(~orphan).unionByName(
        rep.edges.where(orphan).join(kept.select(F.col("id").alias("source")), "source", "left_semi"))
    return Representation(rep.nodes.where("kind <> 'mention'").unionByName(kept), edges, rep.history)
