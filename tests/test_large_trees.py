"""Trees as arrays and as tables against a plain walk; exact fits against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from cohorta.operators import scoring as M
from cohorta.operators.trees import TreeArrays, score_tree_table
from cohorta.plans.fit_trees import fit_tree_exact
from cohorta.sources import models as S

NODES = "node feature threshold left right prediction".split()


def random_tree(seed, nodes, features="abc"):
    """Rows of a lopsided tree with scattered node numbers."""
    rng = random.Random(seed)
    numbers = [0, *rng.sample(range(1, 10 * nodes), nodes)]
    rows, free, leaves = {}, iter(numbers[1:]), [0]
    while len(rows) + len(leaves) + 2 <= nodes:
        node = leaves.pop(rng.randrange(len(leaves)))
        left, right = next(free), next(free)
        rows[node] = (node, rng.choice(features), round(rng.random(), 2), left, right, None)
        leaves += [left, right]
    rows |= {n: (n, None, None, None, None, i % 7) for i, n in enumerate(leaves)}
    out = [dict(zip(NODES, r)) for r in rows.values()]
    rng.shuffle(out)
    return out


def walk(rows, values):
    by, node = {r["node"]: r for r in rows}, 0
    while by[node]["feature"] is not None:
        value = values[by[node]["feature"]]
        if value is None or value != value:
            return None
        node = by[node]["left"] if value <= by[node]["threshold"] else by[node]["right"]
    return by[node]["prediction"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    odd = [None, float("nan"), 0.0, float("inf"), float("-inf"), 0.25]
    rows = [(i, *[rng.choice(odd) if rng.random() < 0.1 else round(rng.random(), 2) for _ in range(3)]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


@pytest.mark.parametrize("nodes", [1, 3, 301, 9_001])
def test_arrays_and_table(spark, points, nodes):
    rows = random_tree(nodes, nodes)
    tree = TreeArrays.from_nodes(rows)
    want = {r["id"]: walk(rows, r) for r in points.collect()}
    got = points.select("id", tree.decision().alias("p"))
    assert {r["id"]: r["p"] for r in got.collect()} == want
    if nodes < 1000:
        table = spark.createDataFrame([("t", *r.values()) for r in rows], S.TREE_TABLE_SCHEMA)
        by_join = score_tree_table(points, table, "t", "abc", "p", max_depth=tree.depth)
        assert by_join.columns == ["id", "a", "b", "c", "p"]
        assert {r["id"]: r["p"] for r in by_join.collect()} == want


def test_plan_does_not_grow_with_nodes(points):
    small, large = (points.select(TreeArrays.from_nodes(random_tree(1, n)).decision().alias("p")) for n in (301, 9_001))
    count = [str(df._jdf.queryExecution().optimizedPlan()).count("CASE WHEN") for df in (small, large)]
    assert count[0] == count[1]
    assert "split(" not in str(large._jdf.queryExecution().optimizedPlan())


def test_table_of_large_and_small_trees(spark):
    big, small = random_tree(3, 6_001), random_tree(4, 5)
    rows = [("big", *r.values()) for r in big] + [("small", *r.values()) for r in small]
    trees = S.trees_from_table(spark.createDataFrame(rows, S.TREE_TABLE_SCHEMA))
    assert isinstance(trees["big"], TreeArrays) and isinstance(trees["small"], M.Split)
    again = S.trees_from_table(S.tree_table(spark, trees))
    assert again == trees
    assert M.split_features(trees["big"]) == {"a", "b", "c"}
    assert M.split_features(M.prefix_tree(trees["big"], "t_")) == {"t_a", "t_b", "t_c"}


def test_unsound_trees():
    leaf = dict(zip(NODES, (1, None, None, None, None, 0)))
    root = dict(zip(NODES, (0, "a", 1.0, 1, 1, None)))
    for rows in ([leaf], [root], [root, leaf]):
        with pytest.raises(ValueError, match="root|not a tree"):
            TreeArrays.from_nodes(rows)


def test_table_walk_keys_and_circles(spark, points):
    rows = [("x", 0, "a", 0.5, 1, 2, None), ("x", 1, None, None, None, None, 0), ("x", 2, None, None, None, None, 1), ("y", 0, None, None, None, None, 9)]
    table = spark.createDataFrame(rows, S.TREE_TABLE_SCHEMA)
    keyed = points.withColumn("k", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y"))
    got = {r["id"]: r["p"] for r in score_tree_table(keyed, table, "", "a", "p", key="k").collect()}
    for r in points.collect():
        want = {0: walk([dict(zip(NODES, x[1:])) for x in rows[:3]], r), 1: 9, 2: None}[r["id"] % 3]
        assert got[r["id"]] == want
    circle = spark.createDataFrame([("x", 0, "a", 0.5, 0, 0, None)], S.TREE_TABLE_SCHEMA)
    with pytest.raises(ValueError, match="circle"):
        score_tree_table(points, circle, "x", "a", "p", max_depth=3)


def plain_fit(rows, features, depth, min_rows=1):
    """(feature, threshold, left, right) or the answer, by trying every split."""
    n, p = len(rows), sum(r["y"] for r in rows)

    def purity(part):
        q = sum(r["y"] for r in part)
        return (q * q + (len(part) - q) ** 2) / len(part)

    best = None
    for f, name in enumerate(features) if depth and 0 < p < n else ():
        values = sorted({r[name] for r in rows})
        for low, high in zip(values, values[1:]):
            left, right = [r for r in rows if r[name] <= low], [r for r in rows if r[name] > low]
            gain = purity(left) + purity(right)
            if min(len(left), len(right)) >= min_rows and gain - purity(rows) > 1e-9:
                key = (-gain, f, (low + high) / 2)
                best = min(best, key) if best else key
    if best is None:
        return int(2 * p > n)
    name, cut = features[best[1]], best[2]
    sides = ([r for r in rows if r[name] <= cut], [r for r in rows if r[name] > cut])
    return (name, cut, *(plain_fit(s, features, depth - 1, min_rows) for s in sides))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.prediction[node]
    return (tree.features[tree.feature[node]], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


@pytest.mark.parametrize(("depth", "min_rows", "slices"), [(0, 1, 4), (1, 1, 2), (3, 1, 5), (4, 6, 64)])
def test_exact_fit(spark, depth, min_rows, slices):
    rng = random.Random(depth)
    rows = [{"a": float(rng.randrange(12)), "b": round(rng.random(), 2), "c": 1.0} for _ in range(160)]
    for r in rows:
        r["y"] = int((r["a"] > 5) ^ (r["b"] > 0.6) ^ (rng.random() < 0.1))
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], r["y"]) for r in rows], "a double, b double, c double, y int")
    tree = fit_tree_exact(df, "abc", F.col("y"), max_depth=depth, min_rows=min_rows, slices=slices)
    assert nested(tree) == plain_fit(rows, "abc", depth, min_rows)


def test_exact_fit_of_little(spark):
    schema = "a double, y int"
    for rows, want in (([], 0), ([(1.0, None)], 0), ([(1.0, 1), (2.0, 1)], 1), ([(None, 0), (float("nan"), 1)], 0)):
        assert nested(fit_tree_exact(spark.createDataFrame(rows, schema), ["a"], F.col("y"))) == want
    near = spark.createDataFrame([(1.0, 0), (1.0000000000000002, 1)], schema)
    assert nested(fit_tree_exact(near, ["a"], F.col("y"))) == ("a", 1.0, 0, 1)
