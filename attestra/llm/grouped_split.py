"""Problem 3: splits with given proportions that keep the rows of one group together."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import group_id, language_label, rank_in_group, split_label, spread, table, written

CLASSES = ("en", "hi", "ta", "other")  # of the label profile; the last one takes every other label
HOT_ROWS = 100_000  # groups of so many rows reach their rows by broadcast: a way to join, the result is the same
PIECE = 20_000  # bundles that one task deals out
OVER_SPLIT, OVER_PART = 8, 1  # cost of a row beyond the quota of its split, beyond that of its part in a split


def keyed(questions: DataFrame) -> DataFrame:
    """The rows with `group_key`: the parallel_id in one spelling, or the row itself where neither parallel_id nor qid names one."""
    own = F.concat(F.lit("row "), F.col("row_id").cast("string"))
    return questions.withColumn("group_key", F.coalesce(group_id(F.col("parallel_id"), F.col("qid")), own))


def components(questions: DataFrame, label: Column | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(group_key, n_rows, n_<class>.., present_splits): one row per group, counted map-side first so that a hot group is no hot task. The label is the language unless another column is given."""
    lang = F.coalesce(language_label(F.col("language")) if label is None else label, F.lit(classes[-1]))
    lang = F.when(lang.isin(*classes), lang).otherwise(classes[-1])
    rows = keyed(questions).select("group_key", lang.alias("_class"), split_label(F.col("split")).alias("_split"))
    return rows.groupBy("group_key").agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col("_class") == c).alias(f"n_{c}") for c in classes], F.sort_array(F.collect_set("_split")).alias("present_splits")
    )


def class_columns(comps: DataFrame) -> list[str]:
    return [c for c in comps.columns if c.startswith("n_") and c != "n_rows"]


def bundled(comps: DataFrame) -> DataFrame:
    """comps with `bundle`, equal for components of identical size and label profile, and nothing else."""
    return comps.withColumn("bundle", F.concat_ws("-", *class_columns(comps)))


class Flow:
    """Min-cost flow by potentials: in each phase the distances from the source are found, then all room on cheapest paths is filled. Arcs are [to, room, cost]."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.arcs: list[list] = []

    def add(self, a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def distances(self, source: object) -> dict[object, int]:
        cost, todo, queued = {source: 0}, deque([source]), {source}
        while todo:
            x = todo.popleft()
            queued.discard(x)
            for k in self.out[x]:
                y, room, c = self.arcs[k]
                if room > 0 and cost[x] + c < cost.get(y, 1 << 62):
                    cost[y] = cost[x] + c
                    if y not in queued:
                        todo.append(y)
                        queued.add(y)
        return cost

    def send(self, source: object, sink: object) -> None:
        while True:
            cost = self.distances(source)
            if sink not in cost:
                return
            next_arc, spent = dict.fromkeys(self.out, 0), set()
            while self._path(source, sink, cost, next_arc, spent):
                pass

    def _path(self, source: object, sink: object, cost: dict, next_arc: dict, spent: set) -> bool:
        """Fills one more cheapest path; nodes that lead nowhere are not tried again in this phase."""
        path, on, x = [], {source}, source
        while x != sink:
            arcs = self.out[x]
            while next_arc[x] < len(arcs):
                k = arcs[next_arc[x]]
                y, room, c = self.arcs[k]
                if room > 0 and y not in on and y not in spent and cost.get(y, 1 << 62) == cost[x] + c:
                    break
                next_arc[x] += 1
            else:
                if x == source:
                    return False
                spent.add(x)
                on.discard(x)
                x = self.arcs[path.pop() ^ 1][0]
                continue
            path.append(k)
            on.add(y)
            x = y
        most = min(self.arcs[k][1] for k in path)
        for k in path:
            self.arcs[k][1] -= most
            self.arcs[k ^ 1][1] += most
        return True

    def on(self, k: int) -> int:
        return self.arcs[k ^ 1][1]


def whole(shares: list[float], total: int) -> list[int]:
    """total in whole parts by shares, largest remainders first."""
    exact = [s * total for s in shares]
    parts = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: parts[i] - exact[i])[: total - sum(parts)]:
        parts[i] += 1
    return parts


def flows(parts: list[tuple[str, int, list[float]]], splits: list[str], quota: list[int]) -> dict[tuple[str, str], int]:
    """Rows of each (part, split); parts are (name, rows, shares of the splits). A row beyond a part's share of a split costs OVER_PART, one beyond the quota of the split OVER_SPLIT."""
    net, at = Flow(), {}
    for name, rows, shares in parts:
        net.add("source", ("part", name), rows, 0)
        for s, own in zip(splits, whole(shares, rows)):
            at[name, s] = net.add(("part", name), ("split", s), own, 0), net.add(("part", name), ("split", s), rows, OVER_PART)
    for s, n in zip(splits, quota):
        net.add(("split", s), "sink", max(0, n), 0)
        net.add(("split", s), "sink", 1 << 60, OVER_SPLIT)
    net.send("source", "sink")
    return {k: net.on(a) + net.on(b) for k, (a, b) in at.items()}


def solve_parts(parts: pd.DataFrame, state: pd.DataFrame, classes: list[str]) -> pd.DataFrame:
    """(part, split_name, quota): the flow over all parts at once. A part holds the bundles of one make-up and size class, so there are few of them.

    The splits' quotas are what state leaves of the plan; a part's own shares follow from what is left of its classes.
    """
    state, parts = state.sort_values("split_name"), parts.sort_values("part")
    splits = list(state["split_name"])
    room = np.stack([np.maximum(state[f"want_{c}"].to_numpy(float) - state[f"have_{c}"].to_numpy(float), 0) for c in ("rows", *classes)])
    sums = room.sum(1, keepdims=True)
    by_class = np.where(sums > 0, room / np.maximum(sums, 1e-12), 1 / len(splits))
    mix = parts[[f"n_{c}" for c in classes]].to_numpy(float)
    rows = parts["rows"].to_numpy(np.int64)
    own = mix @ by_class[1:] / np.maximum(mix.sum(1, keepdims=True), 1)
    own = own / own.sum(1, keepdims=True)
    got = flows([(p, int(n), list(x)) for p, n, x in zip(parts["part"], rows, own)], splits, whole(list(by_class[0]), int(rows.sum())))
    return pd.DataFrame([(p, s, n) for (p, s), n in got.items()], columns=["part", "split_name", "quota"])


def deal(bundles: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
    """(bundle, split_name, first_place, past_place) of the bundles of one part; split_name is NULL for components that stay open.

    Of its n equal components a bundle gives each split its share of the part's flow, rounded down. The few left over
    are laid along what the splits still lack, the largest first; one that would cross from a split to the next stays open.
    """
    quotas = quotas.sort_values("split_name")
    splits, quota = list(quotas["split_name"]), quotas["quota"].to_numpy(np.int64)
    bundles = bundles.sort_values(["n_rows", "bundle"], ascending=[False, True])
    size, n = bundles["n_rows"].to_numpy(np.int64), bundles["n"].to_numpy(np.int64)
    base = np.floor(n[:, None] * (quota / max(1, quota.sum()))[None, :] + 1e-9).astype(np.int64)
    lack = quota - (base * size[:, None]).sum(0)
    left = n - base.sum(1)
    rows, s, open_ = [], 0, np.zeros(len(n), np.int64)
    for i in range(len(n)):
        for _ in range(int(left[i])):
            while s < len(splits) - 1 and lack[s] <= 0:
                s += 1
            if lack[s] >= size[i]:
                base[i, s] += 1
                lack[s] -= size[i]
            else:
                fits = [t for t in range(len(splits)) if lack[t] >= size[i]]
                if fits:
                    base[i, fits[0]] += 1
                    lack[fits[0]] -= size[i]
                else:
                    open_[i] += 1
    for i, b in enumerate(bundles["bundle"]):
        ends = np.concatenate([[0], base[i].cumsum()])
        rows += [(b, t, int(ends[k]), int(ends[k + 1])) for k, t in enumerate(splits) if base[i, k]]
        if open_[i]:
            rows.append((b, None, int(ends[-1]), int(n[i])))
    return pd.DataFrame(rows, columns=["bundle", "split_name", "first_place", "past_place"])


def settle(open_: pd.DataFrame, state: pd.DataFrame, classes: list[str]) -> pd.DataFrame:
    """(bundle, split_name, first_place, past_place) of the components left open, few for each part: the largest first, each to the split where it costs least, and moved on while a move or an exchange costs less.

    state: by split the rows that it should get and has, in all and by class. The costs are those of the flow.
    """
    splits = list(state["split_name"])
    lack = np.stack([state[f"want_{c}"].to_numpy(float) - state[f"have_{c}"].to_numpy(float) for c in ("rows", *classes)], 1)
    weight = np.array([OVER_SPLIT] + [OVER_PART] * len(classes), dtype=float)
    each = [(r.bundle, r.first_place + i, np.array([getattr(r, f"n_{c}") for c in ("rows", *classes)], dtype=float)) for r in open_.itertuples() for i in range(int(r.past_place - r.first_place))]
    each.sort(key=lambda x: (-x[2][0], x[0], x[1]))
    cost = lambda m: (np.abs(m) * weight).sum(-1)
    to = []
    for _, _, v in each:
        s = int(np.argmin(cost(lack - v) - cost(lack) - 1e-6 * lack[:, 0]))  # of equal costs, where most rows are lacking
        lack[s] -= v
        to.append(s)
    for _ in range(20):
        moved = False
        for i, (_, _, v) in enumerate(each):
            a = to[i]
            gain = cost(lack - v) - cost(lack) + cost(lack[a] + v) - cost(lack[a])
            gain[a] = 0
            s = int(np.argmin(gain))
            if gain[s] < -1e-9:
                lack[a] += v
                lack[s] -= v
                to[i], moved = s, True
        if not moved:
            break
    return pd.DataFrame([(b, splits[s], p, p + 1) for (b, p, _), s in zip(each, to)], columns=["bundle", "split_name", "first_place", "past_place"])


SPANS = "bundle string, split_name string, first_place long, past_place long"


def _cogrouped(left: DataFrame, right: DataFrame, fn, schema: str, key: str | None = None) -> DataFrame:
    """fn over the rows of both sides of each key, or over all of both small tables; nothing where a side has no rows."""
    none = {n: np.zeros(0, object if t == "string" else np.int64) for n, t in (x.split() for x in schema.split(", "))}
    run = lambda a, b: fn(a, b) if len(a) and len(b) else pd.DataFrame(none)
    if key is None:
        return left.groupBy(F.lit(0).alias("k")).cogroup(right.groupBy(F.lit(0).alias("k"))).applyInPandas(run, schema)
    return spread(left, key).groupBy(key).cogroup(spread(right, key).groupBy(key)).applyInPandas(run, schema)


def assign_components(comps: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """comps with `assigned_split`.

    Components of more than a 200th of all rows, 200 at most, are settled first. The bundles of one make-up (label shares in
    quarters) and size class form a part: one small task solves the flow of the parts, a task for each part and PIECE of
    bundles deals its bundles out along it, and one small task settles the components that no whole number fits, fewer than
    there are splits in each part. Members follow by their place in a hashed order.
    """
    names = class_columns(comps)
    classes = [c[2:] for c in names]
    measures = ("rows", *classes)
    comps = bundled(comps)
    shape = F.concat_ws("-", F.floor(F.log2("n_rows")).cast("string"), *[F.rint(4 * F.col(c) / F.col("n_rows")).cast("int").cast("string") for c in names])
    bundles = comps.groupBy("bundle").agg(F.count("*").alias("n"), F.first("n_rows").alias("n_rows"), *[F.first(c).alias(c) for c in names]).withColumn("shape", shape)
    bundles = written(bundles)
    total = bundles.agg(*[F.sum(F.col("n") * F.col(f"n_{c}")).alias(f"all_{c}") for c in measures])
    pieces = bundles.groupBy("shape").agg(F.ceil(F.count("*") / PIECE).alias("_n"))
    marked = bundles.join(F.broadcast(total.select("all_rows"))).join(F.broadcast(pieces), "shape")
    marked = marked.withColumn("part", F.when(F.col("n_rows") * 200 <= F.col("all_rows"), F.concat_ws("/", "shape", F.pmod(F.xxhash64("bundle"), F.col("_n")).cast("string")))).drop("all_rows", "_n", "shape")
    bundles = written(marked)
    shares = plan.where("target_share > 0").select("split_name", F.col("target_share").cast("double").alias("share"))
    shares = shares.join(F.broadcast(shares.agg(F.sum("share").alias("_sum")))).join(F.broadcast(total))
    wanted = shares.select("split_name", *[(F.col("share") / F.col("_sum") * F.col(f"all_{c}")).alias(f"want_{c}") for c in measures])

    def state(places: DataFrame | None) -> DataFrame:
        if places is None:
            return wanted.withColumns({f"have_{c}": F.lit(0).cast("long") for c in measures})
        m = places.where("split_name IS NOT NULL").select("bundle", "split_name", (F.col("past_place") - F.col("first_place")).alias("_m")).join(bundles, "bundle")
        have = m.groupBy("split_name").agg(*[F.sum(F.col("_m") * F.col(f"n_{c}")).alias(f"have_{c}") for c in measures])
        return wanted.join(have, "split_name", "left").fillna(0, [f"have_{c}" for c in measures])

    last = lambda o, t: settle(o, t, classes)
    large = bundles.where("part IS NULL").withColumns({"first_place": F.lit(0).cast("long"), "past_place": F.col("n")})
    large = written(_cogrouped(large, state(None), last, SPANS))
    parts = bundles.where("part IS NOT NULL").groupBy("part").agg(F.sum(F.col("n") * F.col("n_rows")).alias("rows"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in names])
    quotas = written(_cogrouped(parts, state(large), lambda a, b: solve_parts(a, b, classes), "part string, split_name string, quota long"))
    dealt = written(_cogrouped(bundles.where("part IS NOT NULL").select("part", "bundle", "n", "n_rows"), quotas, deal, SPANS, "part"))
    left = dealt.where("split_name IS NULL").join(bundles.drop("part", "n"), "bundle")
    settled = _cogrouped(left, state(large.unionByName(dealt)), last, SPANS)
    places = large.unionByName(dealt.where("split_name IS NOT NULL")).unionByName(settled)
    ranked = rank_in_group(comps, ["bundle"], F.xxhash64(F.lit(seed), "group_key"), "place", ["group_key"])
    ends = places.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("past_place", F.col("split_name")))).alias("spans"))
    hit = F.element_at(F.filter("spans", lambda x: F.col("place") < x["past_place"]), 1)["split_name"]
    return ranked.join(ends, "bundle").withColumn("assigned_split", hit).drop("spans", "place", "bundle")


def assign(questions: DataFrame, plan: DataFrame) -> DataFrame:
    """(row_id, group_key, assigned_split) of every row. Groups of HOT_ROWS rows and more (at most one in HOT_ROWS rows) reach their rows by broadcast.

    Rows without any group are groups of one. NULL or unknown languages count as `other`. An empty plan or table gives no row.
    """
    done = assign_components(components(questions), plan).select("group_key", "n_rows", "assigned_split")
    rows = keyed(questions).select("row_id", "group_key")
    hot = done.where(F.col("n_rows") >= HOT_ROWS).select("group_key", F.col("assigned_split").alias("_hot"))
    marked = rows.join(F.broadcast(hot), "group_key", "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(done.where(F.col("n_rows") < HOT_ROWS).drop("n_rows"), "group_key")
    return cold.select("row_id", "group_key", "assigned_split").unionByName(marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", "assigned_split"))


def torn(questions: DataFrame) -> DataFrame:
    """Groups whose rows lie in more than one split at present; rows without a split do not count."""
    return components(questions).where(F.size("present_splits") > 1)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assign_components(components(table(spark, sf_dir, "questions")), table(spark, sf_dir, "split_plan"))
    return done.where(F.size("present_splits") > 1).select(F.col("group_key").alias("parallel_id"))


def p3_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "questions"), table(spark, sf_dir, "split_plan"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by assigned split and language class, all classes together included, against what the plan asks for."""
    plan = table(spark, sf_dir, "split_plan")
    done = assign_components(components(table(spark, sf_dir, "questions")), plan)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("language_class"), F.col(f"n_{c}").alias("n")) for c in ("rows", *CLASSES)]))
    got = done.select("assigned_split", long.alias("x")).select("assigned_split", "x.*").groupBy("assigned_split", "language_class").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_groups"))
    sums = got.groupBy("language_class").agg(F.sum("n_rows").alias("_all"))
    shares = plan.select(F.col("split_name").alias("assigned_split"), (F.col("target_share") / F.sum("target_share").over(W.partitionBy())).alias("share"))  # three rows
    out = got.join(sums, "language_class").join(shares, "assigned_split").withColumn("planned_rows", F.round(F.col("share") * F.col("_all"), 3))
    return out.select("assigned_split", F.when(F.col("language_class") == "rows", "all").otherwise(F.col("language_class")).alias("language_class"), "n_groups", "n_rows", "planned_rows", F.round(F.col("n_rows") - F.col("planned_rows"), 3).alias("deviation"))


QUERIES = {"p3_found": p3_found, "p3_assign": p3_assign, "p3_report": p3_report}
SQL = {
    "p3_found": """
WITH n AS (SELECT CASE WHEN trim(coalesce(parallel_id, '')) = '' THEN regexp_extract(lower(qid), '^[a-z]+-([a-z]+-[0-9]+)', 1) ELSE replace(lower(trim(parallel_id)), '_', '-') END g,
  CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('dev', 'valid', 'validation', 'val') THEN 'dev' WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END s FROM questions)
SELECT g AS parallel_id FROM n GROUP BY g HAVING count(DISTINCT s) > 1""",
}
