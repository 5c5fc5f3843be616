"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Leaves are the combinations of the tree's levels (domain, language, source). A node can take the
tokens of its documents times the number of epochs allowed. From the root down, a node's budget is
split among its children by weight; a child that can't take its share gets what it can, and its
siblings share the rest by weight. As a node never gets more than its subtree can take, a shortage
goes to siblings first and to the ancestors' siblings only when a whole subtree is full.

A leaf's budget is spent on the documents in a seeded order of each epoch, epoch after epoch: whole
epochs, then the prefix of the next one whose tokens fit. Documents with the same place in the order
(equal doc_ids) go together. The cut of that prefix is found without collecting a leaf anywhere: the
order's key is uniform, so leaves are cut into ranges of it, ranges are summed, and only the range in
which the budget ends is ordered by row.

Defined results: null levels count as "(none)"; null and empty texts have no tokens and are never
chosen; a null doc_id has an order key of its own; an empty table gives an empty mix; other columns
of the table are kept by `mix`, whatever their names. A node of weight 0 takes
nothing, so its siblings share its part, and where all siblings have weight 0 their parent takes
nothing either; the budget still counts their tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import drop, shared_dir, small, written

#: About as many rows of a leaf as are ordered by row.
RANGE_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"
DOMAIN = "CASE WHEN source IS NULL THEN '(none)' WHEN regexp_extract(source, '([0-9]*)$', 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 'web' ELSE 'reference' END"


@dataclass(frozen=True)
class Mix:
    """levels: name and SQL expression, from the root down; weights: whole numbers by level and node name, others have `weight`.

    budget is in hundredths of all tokens there are; epochs: as often a document can be chosen. Negative numbers are an error.
    """

    levels: tuple = (("domain", DOMAIN), ("lang", "coalesce(lang, '(none)')"), ("source", "coalesce(source, '(none)')"))
    weights: dict = field(default_factory=lambda: {"domain": {"web": 60, "reference": 40}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}, "source": {}})
    weight: int = 10
    budget: int = 60
    epochs: int = 2
    seed: int = 17

    def __post_init__(self):
        every = [self.weight, *(w for level in self.weights.values() for w in level.values())]
        if not all(isinstance(w, int) and w >= 0 for w in every):
            raise ValueError("weights must be whole numbers of 0 or more")
        if not (isinstance(self.budget, int) and self.budget >= 0 and isinstance(self.epochs, int) and self.epochs >= 1):
            raise ValueError("budget must be 0 or more, epochs 1 or more")
        if unknown := set(self.weights) - {name for name, _ in self.levels}:
            raise ValueError(f"weights name no level: {', '.join(sorted(unknown))}")

    def weight_of(self, level: str) -> Column:
        out = F.lit(self.weight)
        for name, w in self.weights.get(level, {}).items():
            out = F.when(F.col(f"mix_{level}") == name, F.lit(w)).otherwise(out)
        return out.cast("double")


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded place of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, doc_id.cast("string")).cast("binary"))


def split(nodes: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Each row's share of its parent's budget (column budget) under its own cap, which is 0 where its weight is; the result has the share as budget."""
    group, by_ratio = W.partitionBy(*parents), W.partitionBy(*parents).orderBy("ratio", name)
    n = nodes.withColumn("w", weight).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.nullif(F.col("w"), F.lit(0.0))).otherwise(0.0))
    n = n.withColumn("place", F.row_number().over(by_ratio)).withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    n = n.withColumn("rest_w", F.sum("w").over(group) - F.sum("w").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) + F.col("w"))
    n = n.withColumn("rate", (F.col("budget") - F.col("before")) / F.nullif(F.col("rest_w"), F.lit(0.0))).withColumn("full", F.coalesce(F.col("ratio") <= F.col("rate"), F.lit(True)))
    n = n.withColumn("open", F.min(F.when(~F.col("full"), F.col("place"))).over(group)).withColumn("level", F.max(F.when(F.col("place") == F.col("open"), F.col("rate"))).over(group))
    n = n.withColumn("share", F.when(F.col("open").isNull() | (F.col("place") < F.col("open")), F.col("cap")).otherwise(F.floor(F.col("level") * F.col("w"))).cast("long"))
    n = n.withColumn("left", F.least(F.col("budget"), F.sum("cap").over(group)) - F.sum("share").over(group))
    extra = (F.col("share") < F.col("cap")) & (F.row_number().over(W.partitionBy(*parents).orderBy((F.col("share") >= F.col("cap")).cast("int"), name)) <= F.col("left"))
    n = n.withColumn("budget", F.col("share") + extra.cast("long"))
    return n.drop("w", "ratio", "place", "before", "rest_w", "rate", "full", "open", "level", "share", "left")


def budgets(slim: DataFrame, mix: Mix) -> DataFrame:
    """A row per leaf: its levels, tokens, rows and budget. slim: the levels (mix_*), doc_id and n_tokens, a row a document."""
    names = [f"mix_{k}" for k, _ in mix.levels]
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    weighted = F.lit(True)
    for level, _ in mix.levels:
        weighted &= mix.weight_of(level) > 0
    leaves = leaves.withColumn("cap", F.when(weighted, F.col("tokens") * mix.epochs).otherwise(0))
    out = leaves.withColumn("root", F.lit(0))
    root = out.groupBy("root").agg(F.floor(F.sum("tokens") * mix.budget / F.lit(100)).cast("long").alias("budget"))
    given = root
    for depth, name in enumerate(names):
        parents, path = ["root", *names[:depth]], ["root", *names[: depth + 1]]
        level = out.groupBy(*path).agg(F.sum("cap").alias("cap"))
        given = split(level.join(given, parents), parents, name, mix.weight_of(mix.levels[depth][0])).drop("cap")
    return leaves.join(given.drop("root"), names)


def attach(rows: DataFrame, leaves: DataFrame, on) -> DataFrame:
    """Rows with their leaf's columns. A written table of few bytes goes to every task, so a hot leaf's rows stay where they are; a larger one is joined by key."""
    return rows.join(small(leaves), on)


def cuts(slim: DataFrame, leaves: DataFrame, mix: Mix, folder: str) -> DataFrame:
    """Per leaf: whole epochs (whole) and the last key (cut) of the epoch that follows; cut is null if nothing of it fits."""
    names = [f"mix_{k}" for k, _ in mix.levels]
    leaves = leaves.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.greatest(F.lit(1), F.floor(F.col("rows") / RANGE_ROWS)).cast("long"))
    leaves = written(leaves, f"{folder}/budgets")
    rows = attach(slim, leaves.select(*names, "whole", "rest", "ranges"), names).where("n_tokens > 0").withColumn("key", key(mix.seed, F.col("whole"), F.col("doc_id")))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32))
    sums = rows.groupBy(*names, "rest", "range").agg(F.sum("n_tokens").alias("n"))
    after = F.sum("n").over(W.partitionBy(*names).orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.withColumn("after", after).withColumn("over", F.col("after") > F.col("rest"))
    ends = sums.groupBy(*names).agg(F.min(F.when(F.col("over"), F.col("range"))).alias("end_range"), F.coalesce(F.max(F.when(~F.col("over"), F.col("after"))), F.lit(0)).alias("spent"))
    last = attach(rows, written(ends, f"{folder}/ends"), names).where(F.col("end_range").isNull() | (F.col("range") <= F.col("end_range")))
    within = last.where(F.col("range") == F.col("end_range")).withColumn("sum", F.col("spent") + F.sum("n_tokens").over(W.partitionBy(*names, "range").orderBy("key"))).where("sum <= rest")
    before = last.where(F.col("end_range").isNull() | (F.col("range") < F.col("end_range")))
    cut = before.select(*names, "key").unionByName(within.select(*names, "key")).groupBy(*names).agg(F.max("key").alias("cut"))
    return leaves.join(cut, names, "left").select(*names, "whole", "cut")


def mix(df: DataFrame, plan: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """The table's rows as often as they are chosen, with the columns mix_<level>, mix_epoch and mix_tokens (instead of the table's own of these names), or without them."""
    plan = plan or Mix()
    names = [f"mix_{k}" for k, _ in plan.levels]
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")  # no column of the table can clash with those made here
    rows = df.select(own, *[F.expr(e).alias(n) for n, (_, e) in zip(names, plan.levels)], F.col(id_col).cast("long").alias("mix_id"), F.col(text_col).alias("mix_text"))
    folder = shared_dir(df.sparkSession, "mix")
    slim = written(rows.select(*names, F.col("mix_id").alias("doc_id"), tokens("mix_text").alias("n_tokens")), f"{folder}/slim")
    leaves = written(budgets(slim, plan), f"{folder}/leaves")
    ends = written(cuts(slim, leaves, plan, folder), f"{folder}/cuts")
    drop(df.sparkSession, *(f"{folder}/{t}" for t in ("slim", "leaves", "budgets", "ends")))
    ends = ends.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("whole").alias("mix_whole"), F.col("cut").alias("mix_cut"))
    picked = attach(rows, ends, [F.col(n) == F.col(f"{n}_") for n in names])
    part = key(plan.seed, F.col("mix_whole"), F.col("mix_id")) <= F.col("mix_cut")
    picked = picked.withColumn("mix_epochs", F.col("mix_whole") + F.coalesce(part, F.lit(False)).cast("int"))
    # a text with a word, which its first letter tells; the words of those that stay are counted where they are asked for
    picked = picked.where((F.col("mix_epochs") > 0) & F.col("mix_text").rlike(WORD)).withColumn("mix_tokens", tokens("mix_text"))
    picked = picked.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_epochs") - 1)))
    made = [*names, "mix_epoch", "mix_tokens"] if added else []
    return picked.select(*[F.col(f"own.`{c}`") for c in df.columns if c not in made], *made)


def mix_sql(plan: Mix, table: str = "documents") -> str:
    """DuckDB SQL for doc_id, the levels, epoch and n_tokens of the chosen rows."""
    names = [k for k, _ in plan.levels]
    cols = ", ".join(f"m_{k}" for k in names)
    ctes = [f"slim AS (SELECT doc_id, {', '.join(f'{e} AS m_{k}' for k, e in plan.levels)}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM {table})"]
    case = lambda k: "".join(f" WHEN m_{k} = '{n}' THEN {w}" for n, w in plan.weights.get(k, {}).items())
    weight_of = lambda k: f"(CASE{case(k)} ELSE {plan.weight} END)::DOUBLE" if case(k) else f"{plan.weight}::DOUBLE"
    weighted = " AND ".join(f"{weight_of(k)} > 0" for k in names)
    ctes.append(f"leaves AS (SELECT *, CASE WHEN {weighted} THEN tokens * {plan.epochs} ELSE 0 END AS cap FROM (SELECT {cols}, sum(n_tokens)::BIGINT AS tokens, 0 AS root FROM slim GROUP BY {cols}))")
    ctes.append(f"g0 AS (SELECT root, floor(sum(tokens) * {plan.budget} / 100.0::DOUBLE)::BIGINT AS budget FROM leaves GROUP BY root)")
    for d, k in enumerate(names):
        parents, path = ", ".join(["root", *(f"m_{x}" for x in names[:d])]), ", ".join(["root", *(f"m_{x}" for x in names[: d + 1])])
        weight = weight_of(k)
        using = f"USING ({parents})"
        ctes.append(f"a{d} AS (SELECT c.*, {weight} AS w, CASE WHEN {weight} > 0 THEN cap / {weight} ELSE 0 END AS ratio, g.budget FROM (SELECT {path}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY {path}) c JOIN g{d} g {using})")
        ctes.append(f"b{d} AS (SELECT *, row_number() OVER o AS place, budget - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap) AS room, sum(w) OVER p - sum(w) OVER (o ROWS UNBOUNDED PRECEDING) + w AS rest_w FROM a{d} WINDOW p AS (PARTITION BY {parents}), o AS (PARTITION BY {parents} ORDER BY ratio, m_{k}))")
        ctes.append(f"c{d} AS (SELECT *, room::DOUBLE / nullif(rest_w, 0) AS rate, coalesce(ratio <= room::DOUBLE / nullif(rest_w, 0), TRUE) AS full_ FROM b{d})")
        ctes.append(f"d{d} AS (SELECT *, min(CASE WHEN NOT full_ THEN place END) OVER (PARTITION BY {parents}) AS open_ FROM c{d})")
        ctes.append(f"e{d} AS (SELECT *, max(CASE WHEN place = open_ THEN rate END) OVER (PARTITION BY {parents}) AS level FROM d{d})")
        ctes.append(f"f{d} AS (SELECT *, CASE WHEN open_ IS NULL OR place < open_ THEN cap ELSE floor(level * w)::BIGINT END AS share FROM e{d})")
        ctes.append(f"h{d} AS (SELECT *, least(budget, sum(cap) OVER (PARTITION BY {parents})) - sum(share) OVER (PARTITION BY {parents}) AS left_, row_number() OVER (PARTITION BY {parents} ORDER BY (share >= cap)::INT, m_{k}) AS turn FROM f{d})")
        ctes.append(f"g{d + 1} AS (SELECT {path}, (share + CASE WHEN share < cap AND turn <= left_ THEN 1 ELSE 0 END)::BIGINT AS budget FROM h{d})")
    ctes.append(f"ends AS (SELECT l.*, g.budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM leaves l JOIN g{len(names)} g USING (root, {cols}))")
    ctes.append(f"ordered AS (SELECT s.*, e.whole, e.budget - e.whole * e.tokens AS rest, md5(concat_ws(':', '{plan.seed}', e.whole::VARCHAR, s.doc_id::VARCHAR)) AS k FROM slim s JOIN ends e USING ({cols}) WHERE n_tokens > 0)")
    ctes.append(f"summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {cols} ORDER BY k) AS so_far FROM ordered)")
    ctes.append("chosen AS (SELECT *, whole + CASE WHEN so_far <= rest THEN 1 ELSE 0 END AS n FROM summed)")
    out = ", ".join(f"m_{k} AS {k}" for k in names)
    return f"WITH {', '.join(ctes)} SELECT doc_id, {out}, e::INT AS epoch, n_tokens::BIGINT AS n_tokens FROM (SELECT *, unnest(range(0, n)) AS e FROM chosen)"
