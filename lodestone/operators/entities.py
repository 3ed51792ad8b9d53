"""Entity names: lookup of known names, nearest candidates, and sequential resolution.

Resolution follows the order in which names first occur.  A name that is
neither a known key nor a known alias is compared with the entities created
before it; a selector may merge it into one of the nearest, otherwise it
becomes an entity itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import choice_index, norm_name
from lodestone.operators.blocks import best_of, near_pairs
from lodestone.operators.partners import USED_UP, WIDTH, partner_lists
from lodestone.operators.ranking import top_k
from lodestone.operators.semantic_dedup import semantic_dedup
from lodestone.operators.simjoin import block_join, place
from lodestone.session import checkpoint, checkpoint_counting

_PAIRS = "id long, cand long, sim double"
_OPEN, _ENTITY = 0, 1

# (candidate name, names of the candidates in rank order) -> reply text, or a struct with a field ``reply``
Selector = Callable[[Column, Column], Column]


def alias_map(entities: DataFrame) -> DataFrame:
    """``(alias_key, entity_key)`` of entities ``(entity_id, entity_key, aliases)``.

    An alias several entities claim belongs to the one created last.
    """
    exploded = entities.select("entity_id", "entity_key", F.explode("aliases").alias("alias"))
    keyed = exploded.select(norm_name(F.col("alias")).alias("alias_key"), "entity_id", "entity_key")
    return keyed.groupBy("alias_key").agg(F.max_by("entity_key", "entity_id").alias("entity_key"))


def resolve_names(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``entity_key`` to rows with a ``name``: known key, else alias, else the name's own key.

    ``entities`` holds ``entity_key``; ``aliases`` is ``(alias_key, entity_key)``.
    Joins are left to the optimizer, which sees the real sizes at run time.
    """
    keyed = names.withColumn("__norm", norm_name(F.col("name")))
    known = entities.select(F.col("entity_key").alias("__known")).distinct()
    other = aliases.select(F.col("alias_key").alias("__alias"), F.col("entity_key").alias("__owner"))
    joined = keyed.join(known, F.col("__norm") == F.col("__known"), "left").join(
        other, F.col("__norm") == F.col("__alias"), "left"
    )
    key = F.coalesce("__known", "__owner", "__norm")
    return joined.withColumn("entity_key", key).drop("__norm", "__known", "__alias", "__owner")


def _nearest(k: int, gate: float):
    def kernel(t_ids, v_ids, marks, slices):
        out_id, out_cand, out_sim = [], [], []
        for start, sims in slices:
            rows, cols, values = near_pairs(sims, gate)
            me, them = t_ids[start + rows], v_ids[cols]
            fits = (values >= gate) & (them != me)
            rows, cols, values = rows[fits], cols[fits], values[fits]
            # Row by row; entries of a row follow each other.
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
                best, sim = best_of(values[part], v_ids[cols[part]], k)
                at = cols[part][best]
                out_id.append(t_ids[start + rows[part][best]])
                out_cand.append(v_ids[at])
                out_sim.append(sim)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {
            "id": join(out_id, np.int64),
            "cand": join(out_cand, np.int64),
            "sim": join(out_sim, np.float64),
        }

    return kernel


def entity_candidates(names: DataFrame, k: int, gate: float) -> DataFrame:
    """``(id, rank, cand, sim)``: for every vector of ``(id, embedding)`` the other vectors of
    similarity ≥ ``gate``, at most ``k``, nearest first.  A gate of zero or below turns it off.
    """
    rows = names.select("id", F.col("embedding").alias("vec"))
    placed = place(rows if gate > 0 else rows.limit(0), gate)
    pairs = block_join(placed.rows, placed.rows, placed.cells, _nearest(k, gate), _PAIRS)
    best = top_k(pairs, ["id"], [F.desc("sim"), F.asc("cand")], k)
    return best.select("id", "rank", "cand", "sim")


@dataclass(frozen=True)
class FixedReply:
    """Selector that gives the same number for every name, whatever its candidates."""

    choice: int

    def __call__(self, name: Column, candidates: Column) -> Column:
        return F.lit(str(self.choice))


# Take the first candidate; find no match.
always_nearest = FixedReply(1)
never_merge = FixedReply(0)


def _shown(waiting: DataFrame, news: DataFrame, k: int) -> DataFrame:
    """Lists after the latest decisions: merged candidates go, entities are marked, and rows get a state.

    A row is decided (``_ENTITY`` here) once none of its ``k`` nearest candidates is open; with fewer
    than ``k`` left of a cut list it has used up what it knows.
    """
    fate = news.select(F.col("id").alias("cand"), (F.col("owner") == F.col("id")).alias("stands"))
    met = waiting.select("id", "name", "more", F.explode("cands").alias("c")).select("id", "name", "more", "c", F.col("c.cand").alias("cand"))
    stands = F.coalesce(F.col("stands"), F.col("c.stands"))
    entry = F.struct(F.col("c.rank").alias("rank"), "cand", F.col("c.cand_name").alias("cand_name"), stands.alias("stands"))
    left = met.join(fate, "cand", "left").groupBy("id", "name").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("stands", F.lit(True)), entry))).alias("cands"), F.max("more").alias("more")
    )
    near = F.slice("cands", 1, k)
    state = (
        F.when(F.exists(near, lambda c: c["stands"].isNull()), _OPEN)
        .when((F.size("cands") < k) & F.col("more"), USED_UP).otherwise(_ENTITY)
    )
    return left.select("id", "name", "cands", "more", state.alias("state"))


def _resolve_alike(
    rows: DataFrame, selector: FixedReply, gate: float, width: int, on_replies: Callable[[DataFrame], None] | None
) -> DataFrame:
    """``resolve_entities`` for a reply known beforehand: the first candidate of every name, or none.

    Names then stand or fall by whether any earlier entity is near, which is the rule of ``semantic_dedup``:
    a name falls with the first entity known among its partners and need not wait for the others.  Once it
    is known which names stand, one join finds the nearest of every other name.
    """
    nearest = selector.choice == 1
    standing = rows.select("id")
    if nearest:
        kept = semantic_dedup(rows.withColumnRenamed("vec", "embedding"), gate, width, strict=False).where("kept")
        standing = checkpoint(kept.select("id").unionByName(rows.where("settled").select("id")).distinct())
    placed = place(rows.join(standing.distinct().withColumn("stands", F.lit(True)), "id", "left"), gate)
    stands = F.col("stands").isNotNull()
    asked = placed.rows.where(~stands if nearest else ~F.col("settled"))
    own, merged = rows.select("id"), None
    if nearest or on_replies:
        found = checkpoint(partner_lists(placed, asked, placed.rows.where(stands), gate, 1, nearest=True))
        if on_replies:
            on_replies(found.select(F.lit(str(selector.choice)).alias("reply")))
    if nearest:
        merged = found.select("id", F.col("cands")[0]["cand"].alias("owner"))
        own = own.join(merged, "id", "left_anti")
    # Rows that repeat an id are one if they have earlier names near, as in the rounds.
    repeated = checkpoint(own.groupBy("id").count().where("count > 1").select("id"))
    if not repeated.isEmpty():
        again = placed.rows.where(~F.col("settled")).join(repeated, "id", "left_semi")
        met = checkpoint(partner_lists(placed, again, placed.rows, gate, 1).select("id"))
        own = own.join(met, "id", "left_anti").unionByName(met)
    owners = own.select("id", F.col("id").alias("owner"))
    return owners if merged is None else owners.unionByName(merged)


def resolve_entities(
    names: DataFrame, selector: Selector, k: int, gate: float, width: int = WIDTH, on_replies: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """``(id, owner)`` for distinct names ``(id, name, embedding)`` in order of ``id``.

    ``owner`` is the id of the entity a name stands for, its own id if it is one.
    An optional boolean column ``settled`` marks existing entities, which precede
    all new names.

    One similarity join lists the nearest earlier names of each, ``width`` of them
    (``k`` at least).  Rounds over these lists then decide every name of which none
    of the ``k`` nearest candidates is still open.  The earliest open name always is
    one, so every round makes progress, and independent names are decided together.
    Only a name whose listed candidates were nearly all merged into others is joined
    once more, against names that were not.  The number of rounds is the longest chain
    of dependent names; a ``FixedReply`` that takes the first candidate or none needs
    no such rounds.

    ``on_replies`` is told of the replies of every round, as written rows with a column ``reply``.
    """
    if "settled" not in names.columns:
        names = names.withColumn("settled", F.lit(False))
    rows = names.select("id", "name", F.col("embedding").alias("vec"), "settled")
    if gate <= 0:
        return rows.select("id", F.col("id").alias("owner"))
    if isinstance(selector, FixedReply) and not 2 <= selector.choice <= k and k > 0:
        return _resolve_alike(rows, selector, gate, width, on_replies)
    placed = place(rows, gate)
    called = placed.rows.select(F.col("id").alias("cand"), F.col("name").alias("cand_name"))

    def listed(targets: DataFrame, visitors: DataFrame) -> DataFrame:
        found = partner_lists(placed, targets, visitors, gate, max(k, width), nearest=True)
        each = found.select("id", "more", F.explode("cands").alias("c")).select("id", "more", F.col("c.rank").alias("rank"), F.col("c.cand").alias("cand"))
        entry = F.struct("rank", "cand", "cand_name", F.lit(None).cast("boolean").alias("stands"))
        held = each.join(called, "cand").groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("cands"), F.max("more").alias("more"))
        return held.join(targets.select("id", "name"), "id").select("id", "name", "cands", "more")

    waiting = checkpoint(listed(placed.rows.where(~F.col("settled")), placed.rows))
    # Settled entities and names with no earlier neighbour stand for themselves.
    news = checkpoint(placed.rows.join(waiting, "id", "left_anti").select("id", F.col("id").alias("owner")))
    owners, used_up = [news], []
    while True:
        told = _shown(waiting, news, k)
        ready = told.where(F.col("state") == _ENTITY).withColumn("cands", F.slice("cands", 1, k))
        # Only names with candidates are put before the selector.
        reply = selector(F.col("name"), F.col("cands.cand_name"))
        chosen = ready.where(F.size("cands") > 0).withColumn("reply", reply)
        kind = chosen.schema["reply"].dataType
        said = F.col("reply.reply") if isinstance(kind, StructType) else F.col("reply")
        chosen, none = chosen.withColumn("choice", choice_index(said, F.size("cands"))), F.lit(None).cast(kind)
        merged_into = F.when(F.col("choice").isNotNull(), F.element_at(F.col("cands.cand"), F.col("choice")))
        parts = [
            chosen.withColumn("owner", F.coalesce(merged_into, F.col("id"))), ready.where(F.size("cands") == 0).withColumn("owner", F.col("id")).withColumn("reply", none),
            told.where(F.col("state") != _ENTITY).withColumn("owner", F.lit(None).cast("long")).withColumn("reply", none),
        ]
        columns = ["id", "name", "cands", "more", "state", "owner", "reply"]
        told, counts = checkpoint_counting(
            reduce(DataFrame.unionByName, [p.select(columns) for p in parts]), "state", (_OPEN, _ENTITY, USED_UP)
        )
        waiting = told.where(F.col("state") == _OPEN).drop("state", "owner", "reply")
        if on_replies:
            on_replies(told.where(F.col("reply").isNotNull()).select("reply"))
        news = told.where(F.col("state") == _ENTITY).select("id", "owner")
        owners.append(news)
        if counts[USED_UP]:
            used_up.append(told.where(F.col("state") == USED_UP).select("id"))
        if counts[_ENTITY] and counts[_OPEN]:
            continue
        if not used_up:
            break
        again = reduce(DataFrame.unionByName, used_up)
        known = reduce(DataFrame.unionByName, owners)
        standing = placed.rows.join(known.where(F.col("owner") != F.col("id")), "id", "left_anti")
        longer = checkpoint(listed(placed.rows.join(again, "id", "left_semi"), standing))
        free = checkpoint(again.join(longer, "id", "left_anti").select("id", F.col("id").alias("owner")))
        owners.append(free)
        waiting, used_up = waiting.unionByName(longer), []
        news = known.unionByName(free)
    return reduce(DataFrame.unionByName, owners)
