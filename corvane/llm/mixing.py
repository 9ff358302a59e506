"""Mixing sources to target weights, by hierarchical budgeting.

The token budget flows down a tree (domain, language, source): each node's budget goes to its children by weight. A
child can take at most its tokens times `max_epochs`; what it can't take goes to its siblings, by their weights, and only
what a whole family can't take reaches the family of its parent. A leaf that gets b tokens and holds t is taken whole for
each full epoch in b, and then as a prefix: its documents in the seeded order of the next epoch, as long as their tokens
fit.

The prefix of a leaf needs no sort of the leaf. The order is a 64-bit hash; token sums by its leading bits find the
bucket in which the budget ends, sums by the next bits narrow it down again, and only what is left there is put in order.
All that reaches the rows is one cut-off for each leaf, so texts are never shuffled while cut-offs can be broadcast. Trees
of more than MAX_LEAVES leaves are budgeted as tables, level by level, and their cut-offs are joined.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import free_name, settle, without

#: Up to so many leaves, the tree is budgeted on the driver and its cut-offs are broadcast.
MAX_LEAVES = 20_000
#: Bits of the order that one step of the search takes.
STEP_BITS = 10

#: The values of a row's levels, from the root down; None for null.
Path = tuple[str | None, ...]


@dataclass(frozen=True)
class Mix:
    """levels: columns from the root down. weights: path from the root (a tuple) to weight; others weigh `default`.
    The budget is `budget` tokens or, if that is None, `share` of all tokens."""

    levels: tuple[str, ...]
    weights: dict[Path, float] = field(default_factory=dict)
    default: float = 1.0
    budget: int | None = None
    share: float = 0.5
    max_epochs: int = 2
    seed: int = 23

    def weight(self, path: Path) -> float:
        return self.weights.get(path, self.default)


def fill(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """The budget by weight, none above its room; what is cut off goes to the others by weight, while they have room."""
    got = [0.0] * len(weights)
    open_ = [i for i, (w, r) in enumerate(zip(weights, room)) if w > 0 and r > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= room[i] - got[i]]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - got[i]
            got[i] = room[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def leaf_budgets(leaves: dict[Path, int], mix: Mix) -> dict[Path, int]:
    """Tokens for each leaf, rounded down. A weight of zero shuts a branch."""

    def room(paths: list[Path], depth: int) -> float:
        """What the branch that these leaves share can take."""
        if depth == len(mix.levels):
            return float(leaves[paths[0]] * mix.max_epochs)
        return sum(room(own, depth + 1) for path, own in children(paths, depth).items() if mix.weight(path) > 0)

    def children(paths: list[Path], depth: int) -> dict[Path, list]:
        found: dict[Path, list] = {}
        for p in paths:
            found.setdefault(p[: depth + 1], []).append(p)
        return found

    def share(paths: list[Path], depth: int, budget: float) -> dict[Path, int]:
        if depth == len(mix.levels):
            return {paths[0]: int(budget + 1e-6)}
        kids = children(paths, depth)
        got = fill(budget, [mix.weight(k) for k in kids], [room(own, depth + 1) for own in kids.values()])
        out: dict[Path, int] = {}
        for own, tokens in zip(kids.values(), got):
            out |= share(own, depth + 1, tokens)
        return out

    if not leaves:
        return {}
    total = mix.budget if mix.budget is not None else mix.share * sum(leaves.values())
    return share(sorted(leaves, key=lambda p: [(x is not None, x or "") for x in p]), 0, float(total))


def _filled(children: DataFrame, budgets: DataFrame) -> DataFrame:
    """As `fill`, for all families at once. children: (parent, path, weight, room); budgets: (parent, budget). Gives (path,
    budget). Each round sums over families and finds children that are full then; a family of any size is fine."""
    open_ = children.where("weight > 0 and room > 0")
    most = open_.groupBy("parent").agg(F.sum("room").alias("most"))
    left = settle(budgets.join(most, "parent").select("parent", F.least("budget", "most").alias("budget")), "family-budgets")
    state = settle(open_.withColumn("full", F.lit(False)), "children")
    while True:
        sums = state.groupBy("parent").agg(F.sum(F.when(~F.col("full"), F.col("weight"))).alias("total"), F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))), F.lit(0.0)).alias("taken"))
        rate = settle(left.join(sums, "parent").select("parent", F.when(F.col("total") > 0, (F.col("budget") - F.col("taken")) / F.col("total")).otherwise(0.0).alias("rate")), "family-rates")
        now = state.join(rate, "parent").withColumn("now", ~F.col("full") & (F.col("rate") * F.col("weight") >= F.col("room")))
        if not now.where("now").limit(1).count():
            return now.select("path", F.when(F.col("full"), F.col("room")).otherwise(F.greatest(F.col("rate"), F.lit(0.0)) * F.col("weight")).alias("budget"))
        state = settle(now.select("parent", "path", "weight", "room", (F.col("full") | F.col("now")).alias("full")), "children")


def budget_table(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(leaf, budget) as leaf_budgets gives them, for (leaf, tokens) tables of any size; leaves are paths as JSON arrays.
    Only the mix's own weights are held by the driver."""
    depth = len(mix.levels)
    parts = F.from_json("leaf", "array<string>")
    at = lambda d: F.to_json(F.slice(parts, 1, d))
    given = leaves.sparkSession.createDataFrame([(json.dumps(list(p), ensure_ascii=False, separators=(",", ":")), float(w)) for p, w in mix.weights.items()], "path string, weight double")
    given = given.withColumn("path", F.to_json(F.from_json("path", "array<string>")))  # escapes as Spark writes them
    weighed = lambda rows: rows.join(F.broadcast(given), "path", "left").fillna({"weight": mix.default})  # noqa: E731  as many as the mix names
    every = settle(leaves.select("leaf", "tokens", *(at(d).alias(f"p{d}") for d in range(depth + 1))), "tree")
    levels = {depth: settle(weighed(every.select(F.col(f"p{depth - 1}").alias("parent"), F.col(f"p{depth}").alias("path"), (F.col("tokens") * float(mix.max_epochs)).alias("room"))), "level")}
    for d in range(depth - 1, 0, -1):
        room = levels[d + 1].where("weight > 0").groupBy("parent").agg(F.sum("room").alias("room")).withColumnRenamed("parent", "path")
        above = every.select(F.col(f"p{d - 1}").alias("parent"), F.col(f"p{d}").alias("path")).distinct()
        levels[d] = settle(weighed(above.join(room, "path").select("parent", "path", "room")), "level")
    total = F.lit(float(mix.budget)) if mix.budget is not None else F.coalesce(F.sum("tokens"), F.lit(0)) * mix.share
    budgets = leaves.agg(total.cast("double").alias("budget")).select(F.lit("[]").alias("parent"), "budget")
    for d in range(1, depth + 1):
        budgets = settle(_filled(levels[d], budgets).withColumnRenamed("path", "parent"), "budgets")
    return budgets.select(F.col("parent").alias("leaf"), F.floor(F.col("budget") + 1e-6).alias("budget"))


def _bits(order: Column, step: int) -> Column:
    """The step's bits of an order, as a number; orders count as unsigned from the lowest signed value up."""
    return F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(1 << 63))), 64 - STEP_BITS * (step + 1)).bitwiseAND(F.lit((1 << STEP_BITS) - 1))


def _cuts(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """(leaf, cut): the largest order in each leaf up to which all tokens fit into `rest`; no row if nothing fits."""
    near = F.broadcast if few else lambda table: table  # few: at most MAX_LEAVES
    at = rows.join(near(plan.select("leaf", "full", "rest", "seed").where("rest > 0")), "leaf")
    at = at.withColumn("o", F.xxhash64("key", "full", "seed")).select("leaf", "o", "tokens", "rest")
    running = Window.partitionBy("leaf").orderBy("b")
    found = None
    for step in range(2):
        sums = at.groupBy("leaf", "rest", _bits(F.col("o"), step).alias("b")).agg(F.sum("tokens").alias("t"), F.max("o").alias("top"))
        sums = settle(sums.withColumn("upto", F.sum("t").over(running)), "mix-sums")
        inside = sums.where("upto <= rest").groupBy("leaf").agg(F.max("top").alias("cut"))
        found = inside if found is None else found.unionByName(inside)
        edge = sums.where("upto > rest").groupBy("leaf").agg(F.min_by(F.struct("b", (F.col("rest") - F.col("upto") + F.col("t")).alias("left")), "b").alias("e")).select("leaf", "e.b", "e.left")
        at = at.join(near(edge if few else settle(edge, "mix-edges")), "leaf").where(_bits(F.col("o"), step) == F.col("b")).select("leaf", "o", "tokens", F.col("left").alias("rest"))
    at = at.groupBy("leaf", "o", "rest").agg(F.sum("tokens").alias("tokens"))  # equal ids are one place in the order
    last = at.withColumn("upto", F.sum("tokens").over(Window.partitionBy("leaf").orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.unionByName(last.where("upto <= rest").groupBy("leaf").agg(F.max("o").alias("cut")))
    return found.groupBy("leaf").agg(F.max("cut").alias("cut"))


def mix_sources(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", level_columns: dict[str, Column] | None = None) -> DataFrame:
    """The selected rows of `docs`, one for each epoch that takes them, with columns n_tokens and epoch (from 0), which
    replace columns of the same names.

    Tokens are the words of the text; null and empty texts have none and go with the epochs of their leaf. A null level
    is a branch of its own, None in the mix's paths. The order of an epoch is a seeded hash of the id: rows with equal ids
    stand at one place in it and are taken or left together, and a null id is an id like others. An empty table, or a
    budget of zero, gives an empty result. Other columns are kept. Texts and trees may be of any size.
    """
    level_columns = level_columns or {}
    names = {n: free_name(docs, f"_{n}") for n in ("leaf", "tokens", "full", "seed", "cut", "times")}
    leaf = F.to_json(F.array(*(level_columns.get(c, F.col(c)).cast("string") for c in mix.levels)))
    words = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    marked = docs.withColumns({names["leaf"]: leaf, names["tokens"]: words})
    rows = settle(marked.select(F.col(names["leaf"]).alias("leaf"), F.col(id_col).alias("key"), F.col(names["tokens"]).alias("tokens")), "mix-rows")
    sums = settle(rows.groupBy("leaf").agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    totals = sums.limit(MAX_LEAVES + 1).collect()
    few = len(totals) <= MAX_LEAVES
    if few:
        budgets = leaf_budgets({tuple(json.loads(r.leaf)): r.tokens for r in totals}, mix)
        of = {r.leaf: budgets[tuple(json.loads(r.leaf))] for r in totals}
        budgets = docs.sparkSession.createDataFrame(list(of.items()), "leaf string, budget long")
    else:
        budgets = budget_table(sums, mix)
    plan = sums.join(budgets, "leaf").withColumn("full", F.when(F.col("tokens") > 0, F.least(F.expr("budget div tokens"), F.lit(mix.max_epochs))).otherwise(0).cast("long"))
    rest = F.when(F.col("full") < mix.max_epochs, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(0)
    plan = settle(plan.select("leaf", "full", rest.cast("long").alias("rest"), F.lit(mix.seed).cast("long").alias("seed")), "mix-plan")
    cuts = settle(plan.join(_cuts(rows, plan, few), "leaf", "left").select("leaf", "full", "seed", "cut"), "mix-cuts").toDF(*(names[n] for n in ("leaf", "full", "seed", "cut")))
    own = F.xxhash64(F.col(id_col), F.col(names["full"]), F.col(names["seed"]))
    times = F.col(names["full"]) + F.when(own <= F.col(names["cut"]), 1).otherwise(0)
    chosen = marked.join(F.broadcast(cuts) if few else cuts, names["leaf"]).withColumn(names["times"], times).where(F.col(names["times"]) > 0)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(names["times"]) - 1)).alias("epoch")
    return chosen.select(*without(docs.columns, "n_tokens", "epoch"), F.col(names["tokens"]).alias("n_tokens"), epochs)
