"""Forests against a plain one, blocks and partitions; chained imputation with out-of-bag errors; exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import forest, impute, profile


def blocks_of(spark, codes, target, known, size):
    rows = [(list(range(i, min(i + size, len(codes)))), codes[i:i + size].tobytes(), target[i:i + size].tobytes(), known[i:i + size].tobytes())
            for i in range(0, len(codes), size)]
    return spark.createDataFrame(rows, "at array<long>, codes binary, target binary, known binary")


def plain_tree(codes, target, weight, seed, t, depth, smallest, tried):
    """Splits by trying every cut of every offered column, node by node in order of levels."""
    out, queue = {}, [(0, np.arange(len(codes)), 0)]
    fresh = 1
    while queue:
        node, rows, level = queue.pop(0)
        w, y = weight[rows], target[rows, 0]
        best = (w @ y) ** 2 / max(w.sum(), 1) * (1 + 1e-12), None
        for f in forest._offered(seed, t, np.array([node]), codes.shape[1], tried)[0]:
            for b in range(63):
                left = codes[rows, f] <= b
                n1, n0 = w[left].sum(), w[~left].sum()
                if n1 >= smallest and n0 >= smallest:
                    score = (w[left] @ y[left]) ** 2 / n1 + (w[~left] @ y[~left]) ** 2 / n0
                    if score > best[0]:
                        best = score, (f, b)
        out[node] = (best[1] if level < depth else None, (w @ y) / max(w.sum(), 1))
        if best[1] and level < depth:
            left = codes[rows, best[1][0]] <= best[1][1]
            queue += [(fresh, rows[left], level + 1), (fresh + 1, rows[~left], level + 1)]
            fresh += 2
    return out


@pytest.mark.parametrize("size", [1000, 37])
def test_trees_equal_plain_ones_in_one_block_and_in_many(spark, size):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 8, (200, 3)).astype(np.uint8)
    target = (codes[:, :1].astype(np.int64) * 100 + rng.integers(0, 50, (200, 1)))
    known = rng.random(200) < 0.9
    made = forest.grow(blocks_of(spark, codes, target, known, size), 3, 6, 5, 4, 5, 2)
    for t in range(6):
        weight = forest.bag(5, t, np.arange(200))[known]
        plain = plain_tree(codes[known], target[known], weight, 5, t, 4, 5, 2)
        assert len(plain) == len(made.feature[t])
        for node, (split, mean) in plain.items():
            assert (made.feature[t][node], made.cut[t][node]) == (split or (-1, made.cut[t][node]))
            assert made.value[t][node][0] == pytest.approx(mean)


def test_bags_are_poisson_and_out_of_bag_rows_are_a_third():
    drawn = np.array([forest.bag(3, t, np.arange(2000)) for t in range(50)])
    assert drawn.mean() == pytest.approx(1, abs=0.02) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


@pytest.fixture(scope="module")
def gaps(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        a = rng.uniform(0, 1)
        rows.append((f"p{i}", a, 10 * a if i % 7 else None, ("low" if a < 0.4 else "high") if i % 5 else None, rng.randint(0, 3), None))
    return spark.createDataFrame(rows, "id string, a double, b double, c string, d int, e double").cache()


def filled(df, **options):
    out = impute.forest_impute(df, "id", ["a", "b", "e"], ["c", "d"], max_iter=3, trees=12, seed=4, **options)
    return sorted(map(tuple, out.collect()))


def test_imputation_does_not_depend_on_partitions_or_blocks(spark, gaps):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in ("2", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(filled(gaps.repartition(int(partitions))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == filled(gaps, block=50)
    assert all(r[2] is not None and r[3] in ("low", "high") and r[5] is None for r in found[0])
    assert np.mean([abs(r[2] - 10 * r[1]) for r in found[0]]) < 0.5
    assert np.mean([(r[3] == "low") == (r[1] < 0.4) for r in found[0]]) > 0.97


def test_errors_are_out_of_bag_and_stop_the_sweeps(gaps):
    history = []
    impute.forest_impute(gaps, "id", ["a", "b"], ["c", "d"], max_iter=6, trees=12, seed=4, history=history)
    means = [sum(h.values()) / len(h) for h in history]
    assert all(a > b for a, b in zip(means[:-2], means[1:-1])) and (len(means) == 6 or means[-1] >= means[-2])
    assert 0 < history[0]["b"] < 0.2 and 0 <= history[0]["c"] < 0.2


def test_whole_and_empty_columns_are_left_alone(spark, gaps):
    whole = gaps.select("id", "a", "d")
    assert impute.forest_impute(whole, "id", ["a"], ["d"]).exceptAll(whole).count() == 0
    alone = gaps.select("id", "b", "e")
    assert impute.forest_impute(alone, "id", ["b", "e"], []).exceptAll(alone).count() == 0
    empty = gaps.limit(0)
    assert impute.forest_impute(empty, "id", ["a", "b"], ["c"]).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(3)
    columns = {
        "x": [rng.gauss(0, 1) for _ in range(3000)], "t": [float(rng.randint(0, 3)) for _ in range(3000)],
        "big": [rng.choice([1e300, -1e300, 5e-324, 0.0, 1.0]) for _ in range(3000)], "one": [2.5] * 3000,
        "near": [1 + rng.randint(0, 5) * 2 ** -52 for _ in range(3000)], "none": [None] * 3000,
        "gap": [rng.random() if rng.random() < 0.5 else None for _ in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = profile.exact_quantiles(df, list(columns), shares)
    for c, values in columns.items():
        known = [v for v in values if v is not None]
        if not known:
            assert got[c] == [None] * len(shares)
        else:
            ordered = sorted(known)
            places = [(len(known) - 1) * s for s in shares]
            assert got[c] == [ordered[int(p)] + (ordered[int(np.ceil(p))] - ordered[int(p)]) * (p - int(p)) for p in places]
    assert df.select(F.col("x")).count() == 3000 and profile.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_whole_trees_equal_those_of_level_rounds_without_their_jobs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    codes, known = rng.integers(0, 64, (300, 4)).astype(np.uint8), rng.random(300) < 0.9
    target = (rng.integers(0, 3, 300)[:, None] == np.arange(3)).astype(np.int64)
    made = []
    for most in (16, 1):
        monkeypatch.setattr(forest, "WHOLE_BLOCKS", most)
        blocks = blocks_of(spark, codes, target, known, 70)
        spark.sparkContext.setJobGroup(f"forest-{most}", "")
        made.append(forest.grow(blocks, 4, 5, 3, 6, 1, 2))
        made[-1].jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{most}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for name in ("feature", "cut", "left", "value"):
        assert all(np.array_equal(a, b) for a, b in zip(getattr(made[0], name), getattr(made[1], name)))
    assert made[0].jobs < 6 < made[1].jobs


def test_an_imputer_of_many_runs_gives_what_single_runs_give_and_reads_its_table_once(spark, gaps, tmp_path):
    options = {"max_iter": 2, "trees": 6}
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    one = impute.forest_imputer(gaps.mapInArrow(counted, gaps.schema), "id", ["a", "b", "e"], ["c", "d"], **options)
    many = impute.multiple_impute(one, runs=3)
    assert reads.value == 240
    for imp, seed in ((1, 100), (3, 300)):
        alone = impute.forest_impute(gaps, "id", ["a", "b", "e"], ["c", "d"], seed=seed, **options)
        assert sorted(map(tuple, many.where(f"imp = {imp}").drop("imp").collect())) == sorted(map(tuple, alone.collect()))


def test_rows_of_the_same_bins_share_an_entry_and_give_the_same_tree():
    rng = np.random.default_rng(4)
    codes, known, at = rng.integers(0, 3, (4000, 4)).astype(np.uint8), rng.random(4000) < 0.9, np.arange(4000)
    for target, smallest in ((rng.integers(0, 1000, (4000, 1)), 5), ((rng.integers(0, 3, 4000)[:, None] == np.arange(3)).astype(np.int64), 1)):
        rows = forest.gathered([forest.packed((at[i:i + 900], codes[i:i + 900], target[i:i + 900], known[i:i + 900])) for i in range(0, 4000, 900)])
        assert len(rows.codes) <= 81 * (rows.classes or 1) and rows.at.dtype == np.uint32
        made = []
        for table in (rows, forest.Whole(at[known], None, codes[known], None, 0, target[known])):
            tree = forest.Growing(1, 0, 4, 2, 5, smallest)
            forest.whole_tree(tree, table, 64)
            made.append(tree)
        assert all(np.array_equal(x, y) for x, y in zip(made[0].arrays(), made[1].arrays())) and len(made[0].left) > 9
        assert np.array_equal(np.array(made[0].value), np.array(made[1].value))
