import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from attestra.llm import grouped_split as G
from attestra.llm import sampling as S

Q = "row_id long, qid string, parallel_id string, language string, answerability string, question_type string, dataset_version string, split string, plan_id long, place string"
T = "plan_id long, dataset_version string, sample_size long, field_name string, category string, target_share double, min_rows long"


def make(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, ans, kind = rng.choice(["en", " EN", "hi-IN", "ta", None, ""]), rng.choice(["A", "class A", "Ｂ", "c", None]), rng.choice(["multi-hop", "Multi Hop", "factual", None])
        rows.append((i, f"en-ins-{i % 250:06d}", rng.choice([f"ins-{i % 90:06d}", f"INS_{i % 90:06d}", None]), lang, ans, kind, rng.choice(["v1", "v2", None]), rng.choice(["train", "Test ", "valid", None]), 7, "clash"))
    return rows


def targets():
    out = []
    for p, v in ((1, "v1"), (2, "v2")):
        for f, cats in (("answerability", {"A": 0.5, "B": 0.3, "C": 0.2}), ("question_type", {"multi_hop": 0.7, "factual": 0.3}), ("language", {"en": 0.3, "hi": 0.3, "ta": 0.4})):
            out += [(p, v, 40, f, c, s, 200 if c == "C" and p == 1 else 3) for c, s in cats.items()]
    return out


def test_report_supply_equals_a_plain_count(spark):
    rows, plan = make(), targets()
    label = {"answerability": lambda x: {"A": "A", "class A": "A", "Ｂ": "B", "c": "C"}.get(x), "question_type": lambda x: {"multi-hop": "multi_hop", "Multi Hop": "multi_hop"}.get(x, x), "language": lambda x: {" EN": "en", "hi-IN": "hi", "": None}.get(x, x)}
    col = {"answerability": 4, "question_type": 5, "language": 3}
    got = S.report(spark.createDataFrame(rows, Q), spark.createDataFrame(plan, T)).collect()
    assert len(got) == len(plan)
    for r in got:
        v = next(t[1] for t in plan if t[0] == r.plan_id)
        supply = len({q[1] for q in rows if q[6] == v and label[r.field_name](q[col[r.field_name]]) == r.category})
        assert r.supply == supply and r.target_can_be_met == (supply + 1e-6 >= r.target_share * 40) and r.minimum_can_be_met == (supply >= r.min_rows)


def test_draw_follows_the_allocation_and_is_distinct(spark):
    q, t = spark.createDataFrame(make(), Q), spark.createDataFrame(targets(), T)
    for n in (1, 6):
        got = sorted(map(tuple, S.draw(q.repartition(n), t).collect()))
        assert len(got) == len(set(got)) and {p: sum(g[0] == p for g in got) for p in (1, 2)} == {1: 40, 2: 40}
        first = got if n == 1 else first
        assert got == first
    assert S.draw(q.where("false"), t).count() == 0 and S.report(q, t.where("false")).count() == 0
    assert {r.supply for r in S.report(q.where("false"), t).collect()} == {0}


def draws(available, size):
    """Every way to take `size` records."""
    if len(available) == 1:
        if size <= available[0]:
            yield (size,)
        return
    for n in range(min(size, available[0]) + 1):
        for rest in draws(available[1:], size - n):
            yield (n, *rest)


@pytest.mark.parametrize("seed", range(6))
def test_no_swap_improves_and_floors_hold(seed):
    rng = np.random.default_rng(seed)
    member = rng.integers(0, 2, (9, 5))
    available = rng.integers(0, 30, 9)
    want, floor = rng.integers(0, 20, 5).astype(float), rng.integers(0, 3, 5)
    size = int(min(40, available.sum()))
    taken = S.swap_repair(available.copy(), member, want, floor, 40, seed)
    assert taken.sum() == size and (taken >= 0).all() and (taken <= available).all()
    have = taken @ member
    gap = np.abs(have - want).sum()
    reach = np.minimum(floor, available @ member)
    for a, b in itertools.permutations(range(9), 2):
        if taken[a] and taken[b] < available[b]:
            new = have - member[a] + member[b]
            worse = np.maximum(reach - new, 0).sum() > np.maximum(reach - have, 0).sum()
            assert worse or np.abs(new - want).sum() >= gap - 1e-9


@pytest.mark.parametrize("seed", range(120))
def test_floors_are_met_where_any_draw_meets_them(seed):
    rng = np.random.default_rng(seed)
    member, available = rng.integers(0, 2, (5, 4)), rng.integers(0, 5, 5)
    want, floor, size = rng.integers(0, 6, 4).astype(float), rng.integers(0, 5, 4), int(min(rng.integers(2, 8), available.sum()))
    all_ = np.array(list(draws(available.tolist(), size))).reshape(-1, 5)
    have = all_ @ member
    reach = np.minimum(floor, available @ member)
    missed, gap = np.maximum(reach - have, 0).sum(1), np.abs(have - want).sum(1)
    mine = S.swap_repair(available, member, want, floor, size, seed) @ member
    assert np.maximum(reach - mine, 0).sum() == missed.min()
    assert np.abs(mine - want).sum() <= gap[missed == missed.min()].min() + 2  # one exchange from the best at most


def test_floors_of_a_plan_that_greedy_filling_misses():
    member = np.array([[1, 1, 1], [1, 0, 1], [0, 0, 0], [0, 1, 0]])
    for seed in range(20):
        assert (S.swap_repair(np.array([1, 2, 2, 2]), member, np.zeros(3), np.array([1, 1, 2]), 2, seed) @ member >= [1, 1, 2]).all()


def test_more_records_than_hypergeometric_numbers_allow():
    available = np.array([3 * 10**9, 2 * 10**9, 5])
    taken = S.swap_repair(available, np.eye(3, dtype=np.int64), np.array([500.0, 480.0, 20.0]), np.array([0, 0, 5]), 1000, 1)
    assert taken.sum() == 1000 and taken[2] == 5 and abs(taken[0] - 500) <= 15


def test_report_tells_what_the_draw_meets(spark):
    plan = [(1, "v1", 4, "answerability", c, x, m) for c, x, m in (("A", 0.5, 3), ("B", 0.5, 3))]
    rows = [(i, f"q{i}", None, "en", "A" if i % 2 else "B", None, "v1", None, 0, "") for i in range(20)]
    got = {r.category: r for r in S.report(spark.createDataFrame(rows, Q), spark.createDataFrame(plan, T)).collect()}
    assert all(r.minimum_can_be_met and r.target_can_be_met for r in got.values()) and not any(r.minimum_met for r in got.values())
    assert sum(r.drawn for r in got.values()) == 4


def test_groups_stay_whole_and_shares_hold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(400):
        for k in range(rng.choice([1, 2, 3, 6])):
            rows.append((len(rows), f"en-ins-{g:06d}-v{k}", f"ins-{g:06d}", rng.choice(["en", "hi", "ta"]), "A", "factual", "v", rng.choice(["train", "dev"]), 1, "x"))
    hot = len(rows) // 3
    rows += [(len(rows) + i, "xx-ins-000999", None, "en", "A", "factual", "v", "train", 1, "x") for i in range(hot)]
    rows += [(len(rows), None, None, None, None, None, None, None, 1, "x")]
    q, plan = spark.createDataFrame(rows, Q), spark.createDataFrame([("train", 0.7), ("dev", 0.1), ("test", 0.2)], "split_name string, target_share double")
    got = G.assign(q, plan).collect()
    assert len(got) == len(rows) and len({r.row_id for r in got}) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.group_key, set()).add(r.assigned_split)
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r.assigned_split == s for r in got) / len(got) for s in ("train", "dev", "test")}
    assert share == {"train": pytest.approx(0.7, abs=0.01), "dev": pytest.approx(0.1, abs=0.01), "test": pytest.approx(0.2, abs=0.01)}
    assert sorted(map(tuple, G.assign(q.repartition(7), plan).collect())) == sorted(map(tuple, got))
    assert G.assign(q.where("false"), plan).count() == 0


def test_torn_groups_equal_a_plain_scan(spark):
    rows = make(200, 9)
    split = {"train": "train", "Test ": "test", "valid": "dev", None: None}
    by = {}
    for r in rows:
        key = r[2].lower().replace("_", "-") if r[2] else r[1][3:13]
        by.setdefault(key, set()).add(split[r[7]])
    assert {r.group_key for r in G.torn(spark.createDataFrame(rows, Q)).collect()} == {k for k, s in by.items() if len(s - {None}) > 1}


def test_flow_costs_least():
    """Against every way to share out the rows of two parts among two splits."""
    rng = random.Random(5)
    for _ in range(40):
        rows = [rng.randint(0, 9), rng.randint(0, 9)]
        first = rng.randint(0, sum(rows))
        quota, shares = [first, sum(rows) - first], [[x, 1 - x] for x in (rng.random(), rng.random())]
        own = [G.whole(s, n) for s, n in zip(shares, rows)]
        cost = lambda a, b: sum(max(0, x[k] - o[k]) for x, o in zip((a, b), own) for k in (0, 1)) + 8 * sum(max(0, a[k] + b[k] - quota[k]) for k in (0, 1))
        best = min(cost((i, rows[0] - i), (j, rows[1] - j)) for i in range(rows[0] + 1) for j in range(rows[1] + 1))
        got = G.flows([("p", rows[0], shares[0]), ("q", rows[1], shares[1])], ["a", "b"], quota)
        mine = [(got[p, "a"], got[p, "b"]) for p in "pq"]
        assert [sum(m) for m in mine] == rows and cost(*mine) == best


def test_flow_ends_soon_with_very_many_parts():
    began, rows = time.time(), [i % 97 + 1 for i in range(100_000)]
    got = G.flows([(str(i), n, [0.8, 0.1, 0.1]) for i, n in enumerate(rows)], ["a", "b", "c"], G.whole([0.8, 0.1, 0.1], sum(rows)))
    sums = [sum(n for (_, s), n in got.items() if s == x) for x in "abc"]
    assert time.time() - began < 60 and sums == G.whole([0.8, 0.1, 0.1], sum(rows))


def test_a_part_is_dealt_along_its_quotas():
    rng = random.Random(2)
    bundles = pd.DataFrame([(f"b{i}", rng.randint(1, 9), rng.randint(8, 15)) for i in range(3000)], columns=["bundle", "n", "n_rows"])
    total = int((bundles.n * bundles.n_rows).sum())
    quota = G.whole([0.8, 0.1, 0.1], total)
    out = G.deal(bundles, pd.DataFrame({"split_name": ["a", "b", "c"], "quota": quota}))
    out["m"] = out.past_place - out.first_place
    assert out.groupby("bundle").m.sum().to_dict() == bundles.set_index("bundle").n.to_dict()
    size = bundles.set_index("bundle").n_rows
    rows = {s: int((x.m * size.loc[x.bundle].to_numpy()).sum()) for s, x in out[out.split_name.notna()].groupby("split_name")}
    assert all(q - 15 < rows[s] <= q for s, q in zip("abc", quota)) and out[out.split_name.isna()].m.sum() <= 2


def test_shares_hold_by_language_beside_a_hot_group(spark):
    """One group has a third of all rows and one language to itself; what the others get makes up for it."""
    rng = random.Random(4)
    keys = [f"en-ins-{0 if i % 3 == 0 else rng.randrange(1, 1500):06d}" for i in range(12_000)]
    q = spark.createDataFrame([(i, k, k[3:], "hi" if k.endswith("000000") else rng.choice(["en", "ta"]), None, None, None, None, 0, "") for i, k in enumerate(keys)], Q)
    plan = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split_name string, target_share double")
    done = G.assign_components(G.components(q), plan).toPandas()
    assert len(done) == len(set(keys)) and done.assigned_split.notna().all()
    by = done.groupby("assigned_split")[["n_rows", "n_en", "n_ta"]].sum()
    for s, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(by.n_rows[s] - share * 12_000) <= 12


def test_a_hot_group_leaves_every_split_its_languages(spark):
    """A group with a tenth of all rows, more English than the rest, fits into two splits; it goes where it leaves the languages in proportion."""
    rng = random.Random(8)
    rows = [(i, f"en-ins-{0 if i % 10 == 0 else rng.randrange(1, 3000):06d}") for i in range(12_000)]
    q = spark.createDataFrame([(i, k, k[3:], rng.choice(["en", "en", "hi"] if k.endswith("000000") else ["en", "hi", "ta"]), None, None, None, None, 0, "") for i, k in rows], Q)
    plan = spark.createDataFrame([("train", 0.7), ("dev", 0.1), ("test", 0.2)], "split_name string, target_share double")
    done = G.assign_components(G.components(q), plan).toPandas()
    by = done.groupby("assigned_split")[["n_rows", "n_en", "n_hi", "n_ta"]].sum()
    for s, share in (("train", 0.7), ("dev", 0.1), ("test", 0.2)):
        assert abs(by.n_rows[s] - share * 12_000) <= 6
        assert all(abs(by[c][s] - share * done[c].sum()) <= 0.02 * done[c].sum() for c in ("n_en", "n_hi", "n_ta")), by
