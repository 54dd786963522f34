"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows in a tree domain - language - source. A budget of tokens is
passed down: each node splits its budget among its children by their weights; a child
that can't use its share (the tokens of its leaves that have a weight, times max_epochs) takes what it can,
and the rest goes to its siblings by their weights, and only what all siblings together can't use
comes back to the ancestors' siblings. Each leaf then selects its token budget from seeded
epochs: whole epochs first, then a prefix of the next one, whose order is a hash of (seed,
epoch, doc_id).

The tree is a table, a row a leaf, and is summed up and split level by level with windows over siblings:
neither its leaves nor their sums come to the driver. A prefix is found without sorting the leaf:
tokens are summed by leaf and by 2^BITS ranges of the hash, then, within the range where the budget ends, by
2^BITS ranges of that; only the rows of the range where it ends then are looked at one by one. The selection
is a filter by leaf and hash, so texts are never shuffled while the leaves are at most LEAF_BROADCAST
(counted); beyond that rows meet their leaf by shared.meet.

Nulls: null texts have no tokens; null languages or sources are leaves of their own; null
doc_ids hash alike. Rows of a leaf with one hash (repeated rows) are taken together or not at
all. Rows without tokens cost nothing and are in every epoch. Very long texts are taken whole. An empty
table gives no rows. Extra columns are kept by select_rows, whatever their names. Weights not given are 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Hashes are the first 60 bits of an MD5 sum; a range of them is named by its first BITS bits, and a range within it by as many more.
HASH_BITS, BITS = 60, 8
LEAF_BROADCAST = 20_000
LEVELS = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Recipe:
    """Weights by level and name; budget as a share of all tokens there are."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    budget: float = 0.9
    max_epochs: int = 4
    seed: int = 17
    domains: int = 4

    def weight(self, level: str, name: str | None) -> float:
        return self.weights.get(level, {}).get(name, 1.0)


#: The production mix: English at 45 %, the others after it; four domains of sources alike.
RECIPE = Recipe({"lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}})


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def hashed(text: Column) -> Column:
    """The first HASH_BITS bits of a text's MD5 sum."""
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def domain_of(source: Column, recipe: Recipe) -> Column:
    """A source belongs to one of recipe.domains domains by its hash; none to the first."""
    return F.concat(F.lit("domain"), F.coalesce(hashed(source.cast("string")), F.lit(0)) % recipe.domains)


def leaf_key(recipe: Recipe) -> Column:
    """One value a leaf, never null."""
    return F.struct(domain_of(F.col("source"), recipe).alias("domain"), F.col("lang").alias("lang"), F.col("source").cast("string").alias("source"))


def water_fill(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Splits budget among (weight, capacity): by weight, no child above its capacity, and
    what is short goes to the others by weight. Whole tokens; the sum is min(budget, sum of capacities)."""
    budget = min(budget, sum(c for _, c in children))
    out = [0] * len(children)
    open_ = [k for k, (w, c) in enumerate(children) if c > 0 and w > 0]
    left = budget
    while open_ and left > 0:
        total = sum(children[k][0] for k in open_)
        full = [k for k in open_ if children[k][1] <= left * children[k][0] / total]
        if not full:
            shares = {k: int(left * children[k][0] / total) for k in open_}
            spare = left - sum(shares.values())
            for k in open_:
                more = min(spare, children[k][1] - shares[k])
                out[k], spare = shares[k] + more, spare - more
            return out
        for k in full:
            out[k] = children[k][1]
        left -= sum(children[k][1] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def leaf_budgets(leaves: dict[tuple, int], recipe: Recipe, budget: int | None = None) -> dict[tuple, int]:
    """{(domain, lang, source): tokens there are} -> {leaf: tokens to take}: the rule for a tree in memory, which budgets() follows."""
    budget = int(recipe.budget * sum(leaves.values())) if budget is None else budget

    def weight(node: tuple) -> float:
        return recipe.weight(LEVELS[len(node) - 1], node[-1])

    def capacity(node: tuple, below: dict[tuple, int]) -> int:
        """Of a node's leaves that have a weight on every level below it."""
        return recipe.max_epochs * sum(n for k, n in below.items() if all(weight(k[:d]) > 0 for d in range(len(node) + 1, len(LEVELS) + 1)))

    def split(nodes: dict[tuple, int], depth: int, share: int) -> dict[tuple, int]:
        if depth == len(LEVELS):
            return {k: min(share, n * recipe.max_epochs) for k, n in nodes.items()}
        names = sorted({k[: depth + 1] for k in nodes}, key=lambda k: (k[-1] is not None, str(k[-1])))
        below = [{k: n for k, n in nodes.items() if k[: depth + 1] == x} for x in names]
        shares = water_fill(share, [(weight(x), capacity(x, b)) for x, b in zip(names, below, strict=True)])
        out: dict[tuple, int] = {}
        for b, s in zip(below, shares, strict=True):
            out |= split(b, depth + 1, s)
        return out

    return split(leaves, 0, budget)


def _weight(level: str, recipe: Recipe) -> Column:
    out = F.lit(1.0)
    for name, w in recipe.weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """leaves(leaf, n) with target: the tokens to take."""
    # p0 .. p3: the root and the nodes on the way to a leaf, as structs, which are equal where their nulls are.
    path = [F.struct(F.lit(0)), *(F.struct(*(F.col(f"leaf.{c}") for c in LEVELS[: d + 1])) for d in range(len(LEVELS)))]
    tree = leaves.select("leaf", "n", *(p.alias(f"p{d}") for d, p in enumerate(path)), *(_weight(level, recipe).alias(f"w{d}") for d, level in enumerate(LEVELS)))
    usable = F.col("n") * recipe.max_epochs
    for d in reversed(range(len(LEVELS))):
        tree = tree.withColumn(f"c{d}", usable)
        usable = F.when(F.col(f"w{d}") > 0, F.col(f"c{d}")).otherwise(F.lit(0))
    given = tree.groupBy("p0").agg(F.least(F.floor(F.sum("n") * F.lit(recipe.budget)), F.sum(usable)).cast("long").alias("given"))
    for d in range(len(LEVELS)):
        nodes = tree.groupBy(f"p{d}", f"p{d + 1}").agg(F.first(f"w{d}").alias("w"), F.sum(f"c{d}").alias("c"))
        given = _filled(nodes.join(given, f"p{d}"), f"p{d}", f"p{d + 1}")
    return leaves.join(given.select(F.col(f"p{len(LEVELS)}").alias("leaf"), F.col("given").alias("target")), "leaf")


def _weight(level: str, recipe: Recipe) -> Column:
    out = F.lit(1.0)
    for name, w in recipe.weights.get(level, {}).items():
        out = F.when(F.col(f"leaf.{level}").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def _filled(nodes: DataFrame, up: str, name: str) -> DataFrame:
    """(name, given): splits each parent's given among its children (w, c) as water_fill does. Sorted by capacity per
    weight, the children that are filled up are the first ones, so sums over those before and after tell which they are."""
    usable = (F.col("w") > 0) & (F.col("c") > 0)
    rows = nodes.withColumn("usable", usable).withColumn("w", F.when(usable, F.col("w")).otherwise(F.lit(1.0)))
    whole, w = Window.partitionBy(up), Window.partitionBy(up).orderBy(F.col("usable").desc(), F.col("c") / F.col("w"), F.col(name))
    before = F.coalesce(F.sum(F.when(F.col("usable"), F.col("c"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.when(F.col("usable"), F.col("w"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after})
    rows = rows.withColumn("full", F.col("usable") & (F.col("c") <= (F.col("given") - F.col("before")) * F.col("w") / F.col("after")))
    rows = rows.withColumn("open", F.col("usable") & ~F.col("full"))
    left = F.col("given") - F.sum(F.when(F.col("full"), F.col("c")).otherwise(F.lit(0))).over(whole)
    rows = rows.withColumns({"left": left, "weights": F.sum(F.when(F.col("open"), F.col("w"))).over(whole)})
    rows = rows.withColumn("share", F.when(F.col("open"), F.floor(F.col("left") * F.col("w") / F.col("weights"))).otherwise(F.lit(0)).cast("long"))
    # What rounding down leaves over, less than a token for each open child, goes to the first of them.
    nth = F.sum(F.col("open").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"spare": F.col("left") - F.sum("share").over(whole), "nth": nth})
    share = F.when(F.col("full"), F.col("c")).when(F.col("open"), F.col("share") + (F.col("nth") <= F.col("spare")).cast("int")).otherwise(F.lit(0))
    return rows.select(name, share.cast("long").alias("given"))


def plan(docs: DataFrame, recipe: Recipe = RECIPE) -> DataFrame:
    """A row a leaf: _domain, lang, source, leaf (the three as a struct), rows, available, target, epochs (whole ones), rest, cut (the
    largest hash of the last epoch that is taken; null: none). A written table."""
    rows = docs.select(leaf_key(recipe).alias("leaf"), F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("tokens"))
    rows = shared.materialise(rows, "tokens")
    sums = shared.materialise(rows.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum("tokens").alias("n")), "leaves")
    share = F.when(F.col("n") > 0, F.col("n"))
    leaves = budgets(sums, recipe).select(
        "leaf", "rows", F.col("n").alias("available"), "target",
        F.coalesce(F.floor(F.col("target") / share), F.lit(1)).cast("int").alias("epochs"), F.coalesce(F.col("target") % share, F.lit(0)).alias("rest"),
    )
    leaves = shared.materialise(leaves, "budgets")

    known = with_leaf(rows, leaves.where("rest > 0").select("leaf", "rows", "epochs", "rest"))
    known = known.select("leaf", "rest", "tokens", order_hash(F.col("doc_id"), F.col("epochs"), recipe).alias("h"))
    known = shared.materialise(known, "hashes")
    wide = _end(known.withColumn("before", F.lit(0).cast("long")), HASH_BITS - BITS)
    inside = known.join(wide, "leaf").where(F.col("h").between(F.col("from"), F.col("to")))
    narrow = _end(inside, HASH_BITS - 2 * BITS)
    last = known.join(narrow, "leaf").where(F.col("h").between(F.col("from"), F.col("to")))
    last = last.groupBy("leaf", "rest", "before", "h").agg(F.sum("tokens").alias("n"))
    taken = F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("h"))
    cut = last.withColumn("upto", taken).where("upto <= rest").groupBy("leaf").agg(F.max("h").alias("h"))
    cuts = narrow.join(cut, "leaf", "left").select("leaf", F.coalesce("h", F.col("from") - 1).alias("cut"))
    done = shared.materialise(leaves.join(cuts, "leaf", "left").select(F.col("leaf.domain").alias("_domain"), "leaf.lang", "leaf.source", "*"), "cuts")
    shared.discard(rows, sums, leaves, known, narrow)
    return done


def _end(rows: DataFrame, low: int) -> DataFrame:
    """leaf, from, to, before: the hashes, alike but for their `low` last bits, among which a leaf's rest ends, and
    the tokens before them; rows(leaf, rest, before, tokens, h). A leaf has at most 2^BITS such ranges here."""
    ranges = rows.groupBy("leaf", "rest", "before", F.shiftright("h", low).alias("r")).agg(F.sum("tokens").alias("n"))
    ranges = ranges.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("r")))
    ends = ranges.where("upto > rest").groupBy("leaf").agg(F.min(F.struct("r", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    first = F.shiftleft("e.r", low)
    return shared.materialise(ends.select("leaf", first.alias("from"), (first + ((1 << low) - 1)).alias("to"), "e.before"), "ends")


def with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows(leaf, ...) joined with leaves(leaf, rows, ...)."""
    count = leaves.count()
    if count <= LEAF_BROADCAST:
        return rows.join(F.broadcast(leaves.drop("rows")), "leaf")
    return shared.meet(rows, leaves.withColumnRenamed("rows", "n"), "leaf", leaves.agg(F.sum("rows")).first()[0])


def order_hash(doc_id: Column, epoch: Column, recipe: Recipe) -> Column:
    """0 .. 2^HASH_BITS - 1."""
    return hashed(F.concat_ws(":", F.lit(str(recipe.seed)), epoch.cast("string"), doc_id.cast("string")))


def select_rows(docs: DataFrame, recipe: Recipe = RECIPE, leaves: DataFrame | None = None, domain: str = "_domain", epoch: str = "_epoch") -> DataFrame:
    """docs' columns, and last the domain and the epoch, under the names given unless docs has these: a row
    for each epoch that takes the document."""
    leaves = plan(docs, recipe) if leaves is None else leaves
    domain, epoch, key, epochs, cut = shared.free_names(docs.columns, domain, epoch, "_leaf", "_epochs", "_cut")
    named = leaves.select("leaf", "rows", F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), leaf_key(recipe).alias("leaf"))
    met = with_leaf(held, named)
    last = F.coalesce(order_hash(F.col("row.doc_id").cast("long"), F.col(epochs), recipe) <= F.col(cut), F.lit(False))
    count = F.col(epochs) + last.cast("int")
    return met.select("row.*", F.col("leaf.domain").alias(domain), F.explode(F.filter(F.sequence(F.lit(-1), count - 1), lambda e: e >= 0)).alias(epoch))
