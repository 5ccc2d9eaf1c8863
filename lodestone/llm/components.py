"""Connected components of an edge table by alternating large-star and small-star.

Both steps take a minimum a node and hand it to the node's neighbours. Neighbours are first cut into
``SALTS`` shares by a hash: each share finds its own minimum, the minima of a node's shares meet, and the
result goes back to the shares, so a node with any number of edges is dealt to as many tasks. Every
round is saved to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import save


#: Shares of a node's neighbours.
SALTS = 64
#: Edges in a file of a round.
ROUND_ROWS = 50_000


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with ``m``, the least v of each u; and the table (u, m)."""
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    shares = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = shares.groupBy("u").agg(F.min("m").alias("m"))
    back = shares.select("u", "s").join(least, "u")
    return dealt.join(back, ["u", "s"]).select("u", "v", "m"), least


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v), u > v. Large: each node hooks its larger neighbours to its least; small: its smaller ones and itself."""
    if large:
        hooked, _ = _with_least(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # u's larger neighbours hang on the least of u and its neighbours.
        out = hooked.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        hooked, least = _with_least(edges)
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Of edges (a, b): node and component (the least node of its component) of every node that is not the least."""
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    parts = None
    for _ in range(max_rounds):
        # A small table needs few files.
        stepped = _star(_star(now, large=True), large=False)
        now = save(stepped.coalesce(parts) if parts else stepped)
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == (row["n"], row["x"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, parts = (row["n"], row["x"]), row["n"] // ROUND_ROWS + 1
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
