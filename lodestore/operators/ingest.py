"""Order-dependent ingest with duplicate detection, resolved in parallel rounds.

New memories come one after another: each looks for the nearest key that is there at its turn, and is dropped
(REMAIN), merged into it (MERGE: the key goes, the mean of both comes) or added (ADD).  So a decision depends on those of
the memories before it, and only on those.

A round decides all memories at once against the keys that the decisions of the round before make, each with the time
at which it comes and goes.  The first memory is right in the first round, and one that depends on a chain of d others
after d more: when a round changes nothing, all decisions are those of the loop over the memories, for no other set of
decisions agrees with itself.  A round looks at keys that changed alone, for memories after them, and again at all keys
only for memories whose nearest key changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.operators.retrieval import TILE_BYTES, TILE_KEYS, _matrix
from lodestore.session import shared_folder

#: Memories or keys of a block.
BLOCK = 4096
#: Places of new memories come after those of the bank.
NEW = 1 << 62
NEVER = (1 << 63) - 1
BEST = pa.schema([("ord", pa.int64()), ("pos", pa.int64()), ("sim", pa.float64())])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def _alive_best(items: pa.Table, keys: pa.Table) -> pa.Table:
    """For each item of the block the nearest of the block's keys that are there at its turn; ties go to the smaller place."""
    if not items.num_rows or not keys.num_rows:
        return BEST.empty_table()
    keys = keys.sort_by("pos")
    at, pos, born, died = items.column("ord").to_numpy(), *(keys.column(c).to_numpy() for c in ("pos", "born", "died"))
    x, v = (_unit(_matrix(t.column("vec").combine_chunks())) for t in (items, keys))
    rows, out = max(1, TILE_BYTES // (8 * TILE_KEYS)), []
    for i in range(0, len(at), rows):
        turn, best, where = at[i : i + rows], np.full(len(at[i : i + rows]), -np.inf), np.zeros(len(at[i : i + rows]), np.int64)
        for j in range(0, len(pos), TILE_KEYS):
            s = np.round(x[i : i + rows] @ v[j : j + TILE_KEYS].T, 9)
            s[(born[None, j : j + TILE_KEYS] >= turn[:, None]) | (died[None, j : j + TILE_KEYS] < turn[:, None])] = -np.inf
            k = s.argmax(axis=1)
            top = s[np.arange(len(k)), k]
            better = top > best
            best[better], where[better] = top[better], pos[j + k[better]]
        there = best > -np.inf
        out.append(pa.table([turn[there], where[there], best[there]], schema=BEST))
    return pa.concat_tables(out)


def _nearest(items: DataFrame, keys: DataFrame, n_items: int, n_keys: int) -> DataFrame:
    """ord, pos, sim: the nearest key at each item's turn.  Item blocks meet key blocks, and a pair gives a row per item."""
    item_blocks, key_blocks = (-(-max(n, 1) // BLOCK) for n in (n_items, n_keys))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    a = items.select("ord", "vec", block("ord", item_blocks).alias("ib"), every(key_blocks).alias("kb"))
    b = keys.select("pos", "born", "died", "vec", block("pos", key_blocks).alias("kb"), every(item_blocks).alias("ib"))
    found = a.groupBy("ib", "kb").cogroup(b.groupBy("ib", "kb")).applyInArrow(_alive_best, "ord long, pos long, sim double")
    return _first(found)


def _first(found: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("sim")).alias("less"), "pos")).alias("b")
    return found.groupBy("ord").agg(best).select("ord", F.col("b.pos").alias("pos"), (-F.col("b.less")).alias("sim"))


def _mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def _keys_made(bank: DataFrame, items: DataFrame, decided: DataFrame, before: DataFrame) -> DataFrame:
    """pos, born, died, vec of all keys that these decisions make; merged keys take their target as it was before."""
    by = decided.where("action <> 'REMAIN'").join(items, "ord")
    target = before.select("pos", F.col("vec").alias("_old"))
    # each key is the target of few memories at a time: a key that is merged goes
    made = by.join(target, "pos", "left").select((F.col("ord") + NEW).alias("pos"), F.col("ord").alias("born"), F.when((F.col("action") == "MERGE") & F.col("_old").isNotNull(), _mean(F.col("_old"), F.col("vec"))).otherwise(F.col("vec")).alias("vec"))
    gone = decided.where("action = 'MERGE'").groupBy("pos").agg(F.min("ord").alias("died"))
    return bank.select("pos", F.lit(-1).cast("long").alias("born"), "vec").unionByName(made).join(gone, "pos", "left").select("pos", "born", F.coalesce("died", F.lit(NEVER)).alias("died"), "vec")


def ingest(bank: DataFrame, new: DataFrame, remain: float = 0.85, merge: float = 0.70, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame, int]:
    """Decisions(ord, action, target, sim), keys(pos, born, vec) that are left, and the number of rounds.

    bank(ord, vec) in its order, new(ord, vec) in the order of coming; both ords count from 0 or more and are distinct.
    target and pos are the ord of a bank's key, or NEW + the ord of the memory that made the key; target is null for ADD, sim
    that of the nearest key, null if it is below 0 or there is none.  Vectors are kept as they are and compared by
    cosine, rounded to nine digits, ties to the older place; a merged key is the mean of both and takes the last place.
    More rounds than most_rounds are an error.
    """
    spark = bank.sparkSession
    shared_folder(spark)
    double = lambda d, name: d.select(F.col("ord").cast("long").alias(name), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    bank, items = double(bank, "pos").checkpoint(), double(new, "ord").checkpoint()
    keys = bank.select("pos", F.lit(-1).cast("long").alias("born"), F.lit(NEVER).alias("died"), "vec").checkpoint()
    n_items, n_keys = items.count(), keys.count()
    near = _nearest(items, keys, n_items, n_keys).checkpoint()
    rounds = 1
    while True:
        sim = F.when(F.col("sim") >= 0, F.col("sim"))
        action = F.when(sim >= remain, "REMAIN").when(sim >= merge, "MERGE").otherwise("ADD")
        decided = items.select("ord").join(near, "ord", "left").select("ord", action.alias("action"), F.when(action != "ADD", F.col("pos")).alias("pos"), sim.alias("sim"))
        after = _keys_made(bank, items, decided, keys).checkpoint()
        was = keys.select("pos", F.col("born").alias("_b"), F.col("died").alias("_d"), F.xxhash64("vec").alias("_h"))
        both = after.join(was, "pos", "full")
        same = F.col("born").eqNullSafe(F.col("_b")) & F.col("died").eqNullSafe(F.col("_d")) & F.col("_h").eqNullSafe(F.xxhash64("vec")) & F.col("vec").isNotNull()
        changed = both.where(~same).select("pos", "born", "died", "vec").checkpoint()
        keys = after
        n_changed = changed.count()
        if not n_changed:
            return decided.select("ord", "action", F.col("pos").alias("target"), F.round("sim", 6).alias("sim")), keys.where(F.col("died") == NEVER).select("pos", "born", "vec"), rounds
        if rounds == most_rounds:
            raise RuntimeError(f"still changing after {rounds} rounds")
        # a nearest key that changed is looked for again among all; for the others only changed keys can be nearer
        lost = near.join(changed.select("pos"), "pos", "left_semi").select("ord")
        kept = near.join(lost, "ord", "left_anti")
        again = items.join(lost, "ord", "left_semi")
        others = items.join(lost, "ord", "left_anti")
        near = _first(kept.unionByName(_nearest(others, changed.where("vec is not null"), n_items, n_changed)).unionByName(_nearest(again, keys, n_items, n_keys + n_items))).checkpoint()
        rounds += 1


def lineage(decided: DataFrame) -> DataFrame:
    """pos, members: the key of each chain of merges that is left, with the places merged into it, in order.

    A key that no memory merged into is its only member.  Only chains of new memories are followed: decided as ingest() gives it.
    """
    shared_folder(decided.sparkSession)
    # next: the key that a key has become; a key is merged once at most
    steps = decided.where("action = 'MERGE'").select(F.col("target").alias("pos"), (F.col("ord") + NEW).alias("next"))
    made = decided.where("action <> 'REMAIN'").select((F.col("ord") + NEW).alias("pos"))
    now = made.union(steps.select("pos")).distinct().join(steps, "pos", "left").select("pos", F.coalesce("next", "pos").alias("end")).checkpoint()
    while True:
        ahead = now.select(F.col("pos").alias("end"), F.col("end").alias("_e"))
        step = now.join(ahead, "end").select("pos", F.col("_e").alias("end"), (F.col("_e") != F.col("end")).alias("moved")).checkpoint()
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.groupBy("end").agg(F.sort_array(F.collect_list("pos")).alias("members")).select(F.col("end").alias("pos"), "members")
