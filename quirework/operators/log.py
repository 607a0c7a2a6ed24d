"""MUT-1 to MUT-10 as one ordered log: a bibliography's adds, edits, deletes and moves, replayed at once.

Fields do not need the order of operations, only the latest of each: they are one aggregation over the log. Places do: they
follow from the places before, where no record was moved, by a window, and else by walking ids and operations,
bibliography by bibliography, without their fields: what is held at once are the ids of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.shipping import ship
from quirework.storage import durable

LOG = "bibliography_id long, seq long, op string, id string, fields map<string,string>, step int"
ROW = ["bibliography_id", "id"]


class Chain:
    """Ids in an order in which any can be added at the end, taken out, or swapped with a neighbour, each in one step."""

    def __init__(self, ids):
        self.after, self.before = {None: None}, {None: None}
        for i in ids:
            self.add(i)

    def _link(self, a, b):
        self.after[a], self.before[b] = b, a

    def add(self, i):
        if i not in self.after:
            self._link(self.before[None], i)
            self._link(i, None)

    def remove(self, i):
        if i in self.after and i is not None:
            self._link(self.before.pop(i), self.after.pop(i))

    def move(self, i, step):
        if i not in self.after or i is None or step not in (-1, 1):
            return
        first, second = (self.before[i], i) if step < 0 else (i, self.after[i])
        if first is None or second is None:
            return
        left, right = self.before[first], self.after[second]
        self._link(left, second)
        self._link(second, first)
        self._link(first, right)

    def __iter__(self):
        i = self.after[None]
        while i is not None:
            yield i
            i = self.after[i]


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of ids. Rows come bibliography by bibliography, in order: stored ids (op 'have'), then operations."""
    of, chain = None, Chain([])
    for batch in batches:
        places = []
        for b, i, op, step in zip(batch["bibliography_id"], batch["id"], batch["op"], batch["step"], strict=True):
            if b != of:
                places += [(of, i_, k) for k, i_ in enumerate(chain)]
                of, chain = b, Chain([])
            if op in ("have", "add"):
                chain.add(i)
            elif op == "delete":
                chain.remove(i)
            else:
                chain.move(i, step)
        yield pd.DataFrame(places, columns=[*ROW, "pos"])
    yield pd.DataFrame([(of, i, k) for k, i in enumerate(chain)], columns=[*ROW, "pos"])


def replay(citations: DataFrame, log: DataFrame) -> DataFrame:
    """citations after all operations of log (LOG), in the order of seq within each bibliography.

    add: a record with its fields, at the end; one that is there is left alone. edit: its fields, by column name; null clears
    one. delete: positions close up. move: by a step of 1 or -1, over no end. What names no record does nothing, and a record that is
    added again after its deletion has its new fields only. Fields are columns of text; others stay as they were stored.
    Operations without bibliography_id, seq or id are ignored; of two with one seq the one that sorts first by op and id comes first.
    """
    ship(citations.sparkSession)
    texts = [f.name for f in citations.schema.fields if f.dataType.simpleString() == "string" and f.name != "id"]
    log = log.where("bibliography_id IS NOT NULL AND seq IS NOT NULL AND id IS NOT NULL AND op IN ('add', 'edit', 'delete', 'move')")
    ops = durable(log.select("bibliography_id", "op", "id", "fields", "step", F.struct("seq", "op").alias("at"), "seq"))
    stored = citations.select(*ROW).where("id IS NOT NULL").distinct().withColumn("_stored", F.lit(True))
    # The life that a record is in at the end: since its storing, or since the first add after its last delete.
    ended = ops.where("op = 'delete'").groupBy(*ROW).agg(F.max("at").alias("_ended"))
    adds = ops.where("op = 'add'").join(ended, ROW, "left").where("_ended IS NULL OR at > _ended").groupBy(*ROW).agg(F.min("at").alias("_added"))
    lives = stored.join(ended, ROW, "left").join(adds, ROW, "full")
    old = F.col("_stored").isNotNull() & F.col("_ended").isNull()
    lives = durable(lives.where(old | F.col("_added").isNotNull()).select(*ROW, old.alias("_old"), F.when(~old, F.col("_added")).alias("_born")))
    writes = ops.where("op IN ('add', 'edit')").join(lives, ROW)
    writes = writes.where((F.col("_born").isNull() & (F.col("op") == "edit")) | (F.col("at") == F.col("_born")) | ((F.col("at") > F.col("_born")) & (F.col("op") == "edit")))
    cells = writes.select(*ROW, "at", F.explode("fields").alias("name", "value")).where(F.col("name").isin(*texts))
    latest = cells.groupBy(*ROW, "name").agg(F.max_by(F.struct("value"), "at")["value"].alias("value"))
    patch = latest.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_patch"))
    kept = citations.join(lives.where("_old").select(*ROW), ROW, "left_semi")
    born = lives.where("NOT _old").select(*ROW)
    rows = kept.unionByName(born, allowMissingColumns=True).drop("pos").join(patch, ROW, "left").join(_places(citations, ops, lives), ROW)
    given = lambda c: F.coalesce(F.map_contains_key("_patch", F.lit(c)), F.lit(False))
    columns = {c: F.when(given(c), F.element_at("_patch", F.lit(c))).otherwise(F.col(c)) for c in texts}
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in citations.columns])


def _places(citations: DataFrame, ops: DataFrame, lives: DataFrame) -> DataFrame:
    """(bibliography_id, id, pos) of all records that are there at the end."""
    moved = ops.where("op = 'move'").select("bibliography_id").distinct()
    have = citations.select(*ROW, "pos").where("id IS NOT NULL")
    still = lives.join(moved, "bibliography_id", "left_anti").join(have, ROW, "left")
    order = Window.partitionBy("bibliography_id").orderBy(F.col("_born").asc_nulls_first(), F.when(F.col("_old"), F.col("pos")))
    by_window = still.select(*ROW, (F.row_number().over(order) - 1).cast("long").alias("pos"))
    narrow = have.select(*ROW, F.lit("have").alias("op"), F.col("pos").alias("seq"), F.lit(0).alias("step"), F.lit(False).alias("late"))
    walks = ops.where("op <> 'edit'").select(*ROW, "op", "seq", F.coalesce("step", F.lit(0)).alias("step"), F.lit(True).alias("late"))
    # A window, unlike repartition() and a sort, has each bibliography in one partition and in order however the join before it is run.
    turn = F.row_number().over(Window.partitionBy("bibliography_id").orderBy("late", "seq", "op"))
    ordered = narrow.unionByName(walks).join(moved, "bibliography_id", "left_semi").select(*ROW, "op", "step", turn.alias("turn"))
    return by_window.unionByName(ordered.mapInPandas(_walked, "bibliography_id long, id string, pos long"))
