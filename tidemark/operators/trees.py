"""Reply trees: the root and the depth of every reply by pointer doubling.

Each row points to its parent. A round replaces the pointer by the pointer of what it points to and adds the distances, so a
chain of n replies is done after log2 n rounds, each one equi-join. Rows that have reached their root leave the rounds. A hot
parent (a post that a third of all replies answer) is one row of the looked-up side; AQE splits the other one. Lineage is cut by a
table in the shared folder in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Rounds of doubling: enough for chains of 2^ROUNDS replies; what is open then lies on a cycle or behind one.
ROUNDS = 40


def reply_trees(replies: DataFrame, key: str = "id", parent: str = "in_reply_to_id", rounds: int = ROUNDS) -> DataFrame:
    """id, root, depth, state of each reply.

    state 'rooted': the chain ends at a row without parent, root is that row and depth the number of steps. 'orphan': it ends at a parent that is not
    there; root is the missing id. 'cycle': it never ends; root and depth are null. Of rows with one id the least parent counts
    (null first); rows without id are left out, and a row that names itself is a cycle.
    """
    rows = replies.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("up"))
    rows = rows.groupBy("id").agg(F.when(F.count("up") < F.count("*"), None).otherwise(F.min("up")).alias("up"))
    rows = written(rows, "trees-rows")
    done = [rows.where("up is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("rooted").alias("state"))]
    parents = rows.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    linked = rows.where("up is not null").join(parents, "up", "left")
    done.append(linked.where("there is null").select("id", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit("orphan").alias("state")))
    # What a row points to, how far that is, and how many rows the round before left open.
    ends = written(done[0].unionByName(done[1]), "trees-ends")
    open_ = written(linked.where("there").select("id", "up", F.lit(1).cast("long").alias("steps")), "trees-open")
    out, left = [ends], open_.count()
    for _ in range(rounds):
        if not left:
            break
        ended = ends.select(F.col("id").alias("up"), "root", F.col("depth").alias("rest"), "state")
        found = open_.join(ended, "up").select("id", "root", (F.col("steps") + F.col("rest")).alias("depth"), "state")
        further = open_.select(F.col("id").alias("up"), F.col("up").alias("above"), F.col("steps").alias("more"))
        still = open_.join(further, "up").select("id", F.col("above").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        # A row's target is ended or open, never both: what it finds is one row.
        ends = written(found, "trees-ends")
        open_ = written(still, "trees-open")
        out.append(ends)
        ends, before, left = _all(out), left, open_.count()
        if left == before:  # rows before an end are found in each round until there are none: what is left goes in circles
            break
    lost = open_.select("id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("state"))
    return _all(out).unionByName(lost)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
