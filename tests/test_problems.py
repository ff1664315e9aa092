import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators import changes, hierarchy
from notegraph.operators.current import latest
from notegraph.operators.heavy import heavy_keys, spread_join
from notegraph.session import Stored, stored

EDGES = "src string, dst string, field string, resolved boolean, id string"
FILES = "path string, listed_at int, mtime_ns bigint, size bigint, state string"
NODES = "path string, indexed_at int, source_hash string, was_size int"
STATE = "run_id int, path string, mtime_ns bigint, size bigint, source_hash string"
RUNS = "run_id int, status string"


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w"), (None, 9, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", "at", "v").collect()} == {("a", "z"), ("b", "w")}


def test_heavy_keys_and_spread_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(500)] + [(None, 1)], "k string, i int")
    heavy = heavy_keys(big, "k", 0.1)
    assert [(r.key, r.weight) for r in heavy.collect()] == [("hot", 500)] and heavy_keys(big.where("false"), "k").count() == 0
    small = spark.createDataFrame([("hot", 1.0), ("k3", 2.0)], "k string, v double")
    got = spread_join(big, small, "k", heavy, F.col("i"), ["v"])
    assert got.count() == 1001 and got.agg(F.sum("v")).first()[0] == 502.0 and got.columns == ["k", "i", "v"]
    # null equals null, and its rows aren't gathered
    got = spread_join(big, small.unionByName(spark.createDataFrame([(None, 3.0)], "k string, v double")), "k", heavy, F.col("i"), ["v"])
    assert got.count() == 1001 and got.where("k is null").first().v == 3.0


def brute(edges):
    parent = {}
    for s, d, f, r, _ in edges:
        if r and s is not None and d is not None and f in ("parent", "children"):
            c, p = (s, d) if f == "parent" else (d, s)
            parent.setdefault(c, set()).add(p)
            parent.setdefault(p, set())
    up = {k: min(v) if v else None for k, v in parent.items()}
    out = {}
    for x in up:
        way, at = [x], x
        while up[at] is not None and up[at] not in way:
            at = up[at]
            way.append(at)
        out[x] = ("(cycle)", -1, None) if up[at] is not None else (at, len(way) - 1, " > ".join(reversed(way)))
    return out


def test_hierarchy(spark):
    rng = random.Random(5)
    edges = []
    for t in range(12):
        n = rng.randint(1, 30)
        for i in range(1, n):
            p = rng.randrange(i)
            edges.append((f"t{t}-{i}", f"t{t}-{p}", "parent", True, "x") if rng.random() < 0.5 else (f"t{t}-{p}", f"t{t}-{i}", "children", True, "x"))
    edges += [(f"c{i}", f"c{i + 1}", "parent", True, None) for i in range(40)]
    edges += [("l1", "l2", "parent", True, None), ("l2", "l1", "parent", True, None), ("below", "l1", "parent", True, None), ("self", "self", "parent", True, None)]
    edges += [(f"kid{i}", "hub", "parent", True, None) for i in range(300)] + [("hub", "kid1", "children", True, None)] * 3
    edges += [("u", "v", "parent", False, None), ("u", None, "parent", True, None), (None, "v", "children", True, None), ("u", "v", None, True, None), ("u", "v", "link", True, None), ("q", "z1", "parent", True, None), ("q", "a1", "parent", True, None)]
    rng.shuffle(edges)
    tree = Stored(hierarchy.hierarchy(spark.createDataFrame(edges, EDGES), with_path=True)).df
    rows = {r.id: r for r in tree.collect()}
    want = brute(edges)
    assert {k: (r.root, r.depth, r.path) for k, r in rows.items()} == want
    under = {}
    for k, (root, _, path) in want.items():
        if root != "(cycle)":
            for a in path.split(" > ")[:-1]:
                under.setdefault(a, set()).add(k)
    got = {}
    for r in hierarchy.descendants(tree, tree, cell=2, most_cells=3).collect():
        got.setdefault(r.ancestor, set()).add(r.id)
        assert r.distance == rows[r.id].depth - rows[r.ancestor].depth
    assert got == under and rows["hub"].size == 301
    assert hierarchy.descendants(tree, tree).count() == sum(map(len, under.values())) and hierarchy.descendants(tree, tree.where("id = 'l1'")).count() == 0
    for r in rows.values():
        if r.first is not None:
            assert r.last - r.first + 1 == r.size == len(under.get(r.id, ())) + 1
    firsts = sorted(r.first for r in rows.values() if r.first is not None)
    assert firsts == list(range(len(firsts)))  # one preorder over all trees
    above = {r.ancestor for r in hierarchy.ancestors(tree, spark.createDataFrame([("kid7",), ("c0",), ("hub",)], "id string"), cell=5).collect()}
    assert above == {"hub", *(f"c{i}" for i in range(1, 41))}
    df = spark.createDataFrame(edges, EDGES)
    assert [tuple(r) for r in hierarchy.several_parents(df).collect()] == [("q", "a1")]
    assert hierarchy.hierarchy(df.where("false")).count() == 0
    assert {(r.id, r.depth) for r in hierarchy.hierarchy(df.where("id is null and src in ('l1', 'l2', 'self')")).collect()} == {("l1", -1), ("l2", -1), ("self", -1)}


def test_ranges_over_several_cells(spark):
    """A chain, a star and single trees, cut into cells of 4096 places."""
    edges = [("r", "top", "parent", True, None)] + [(f"s{i}", "r", "parent", True, None) for i in range(9000)] + [(f"m{i}", f"n{i}", "parent", True, None) for i in range(500)]
    tree = hierarchy.hierarchy(spark.createDataFrame(edges, EDGES)).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.sum("depth").alias("sum")).collect()
    assert {tuple(r) for r in tree if r.root == "top"} == {("top", 9002, 2, 18001)}
    assert {tuple(r)[1:] for r in tree if r.root != "top"} == {(2, 1, 1)} and len(tree) == 501


def tables(spark):
    files = [("a", 1, 10, 1, "clash"), ("a", 2, 11, 1, None), ("a", 2, 11, 1, None), ("b", 1, 20, 2, None), ("c", 1, 30, 3, None), ("d", 1, 40, 4, None), ("e", 1, None, 5, None), ("g", 1, 70, 7, None), (None, 1, 1, 1, None)]
    nodes = [("a", 1, "h1", 0), ("a", 2, "h2", 0), ("b", 1, "hb", 0), ("d", 1, None, 0), ("g", 1, "hg", 0)]
    state = [(1, "a", 11, 1, "h1"), (3, "a", 11, 1, "h2"), (1, "b", 99, 9, "hb"), (1, "d", 41, 4, "hd"), (1, "e", None, 5, "he"), (2, "g", 70, 7, "hg"), (1, "gone", 1, 1, "x"), (None, "c", 30, 3, None)]
    runs = [(1, "ok"), (1, "ok"), (2, "ok"), (3, "failed"), (4, None), (None, "ok")]
    return [spark.createDataFrame(r, s) for r, s in ((files, FILES), (nodes, NODES), (state, STATE), (runs, RUNS))]


def test_changes(spark):
    got = {(r.path, r.state) for r in changes.detect_changes(*tables(spark)).collect()}
    # a: its last row of a failed run doesn't count; b: same hash; e: no hash, null equals null
    assert got == {("a", "changed"), ("c", "added"), ("d", "changed")}
    empty = [t.where("false") for t in tables(spark)]
    assert changes.detect_changes(*empty).count() == 0
    assert {r.state for r in changes.detect_changes(*tables(spark)[:2], *empty[2:]).collect()} == {"added"}


def test_change_log_survives_failures(spark, tmp_path):
    log = changes.ChangeLog(spark, str(tmp_path / "log"), partitions=4)
    rows = spark.createDataFrame([(f"p{i}", "added", i, i, None) for i in range(20)], changes.RECORD)
    calls = []

    def listing(df):
        def give(captured):
            calls.append(captured)
            return df

        return give

    def fail(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(listing(rows), fail)
    assert log.pending() == 0 and log.results() is None
    # the plan is replayed although the listing now says something else
    assert log.run(listing(rows.where("false"))) == 0 and len(calls) == 1
    assert log.results().count() == 20 and log.pending() is None
    # a failure after the sink, before the commit: the replay doesn't repeat a record
    log._write = lambda path, value, keep=log._write: (_ for _ in ()).throw(OSError("disk")) if "/commits/" in path else keep(path, value)
    with pytest.raises(OSError):
        log.run(listing(rows.limit(5)))
    again = changes.ChangeLog(spark, str(tmp_path / "log"), partitions=4)
    # a result that comes twice counts once
    assert again.pending() == 1 and again.run(listing(rows), lambda df: df.unionByName(df)) == 1
    assert again.results().count() == 25 and again.clean() == 1 and again.results().count() == 25
    offsets = again.results().groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n and r.a == 1 for r in offsets)
    # the first driver has been fenced off
    with pytest.raises(changes.Fenced):
        log.run(listing(rows))


def test_change_log_repeats_nothing(spark, tmp_path):
    """Runs over unchanged tables are empty; after an edit only that path comes, also over a snapshot."""
    log = changes.ChangeLog(spark, str(tmp_path / "log"), partitions=3, snapshot_every=2)
    files, nodes, state, runs = tables(spark)
    detect = lambda f=files, n=nodes: lambda captured: changes.detect_changes(f, n, state, runs, captured)
    assert log.run(detect()) == 0 and log.results().count() == 3
    assert log.run(detect()) is None and log.results().count() == 3
    edited = nodes.unionByName(spark.createDataFrame([("b", 2, "hb2", 0)], NODES))
    assert log.run(detect(n=edited)) == 1
    assert {(r.path, r.state) for r in log.results().where("batch = 1").collect()} == {("b", "changed")}
    assert log._numbers("snapshots") == [1] and log.run(detect(n=edited)) is None
    listed = files.unionByName(spark.createDataFrame([("z", 5, 1, 1, None), ("e", 5, 51, 5, None)], FILES))
    assert log.run(detect(listed, edited)) == 2
    assert {(r.path, r.state) for r in log.results().where("batch = 2").collect()} == {("z", "added"), ("e", "changed")}
    # captured, but the run died before it planned: the next one processes it
    log.capture(detect(listed, edited.unionByName(spark.createDataFrame([("a", 9, "h9", 0)], NODES))))
    assert log.run(detect(listed, edited.unionByName(spark.createDataFrame([("a", 9, "h9", 0)], NODES)))) == 3
    assert log.results().count() == 7 and log.results().where("batch = 3").first().path == "a"


def test_stored(spark):
    assert stored(spark.range(5)).count() == 5
