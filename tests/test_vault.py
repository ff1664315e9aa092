import datetime
import json
import os

import pytest

from notegraph import cli
from notegraph.errors import IndexStoreError, MergeError, MutationError, QueryError
from notegraph.manifest import load_manifest
from notegraph.operators import context, filters, graph, merge, mutate, search
from notegraph.scan import scan
from notegraph.sources import store
from notegraph.sources.vault import list_notes, read_files
from notegraph.streaming import refresh


def codes(result):
    return sorted((r.code, r.path) for r in result.issues.collect())


def edge_set(result):
    return {(r.source, r.relation, r.target, r.provenance, r.resolved) for r in result.edges.collect()}


def test_links_and_issues(spark, make_vault, tmp_path):
    outside = tmp_path / "outside.md"
    outside.write_text("secret")
    root = make_vault(
        {
            "notes/a.md": "---\nrelated: ['[[b]]', other/c]\ntags: [x, '#y']\n---\n# Head\n[[b|alias]] ![[d]] [l](sub/e.md) `[[code]]` [up](../../no.md) ![img](b.md) #inline\n\n```\n[[fenced]]\n```\n",
            "notes/b.md": "no links <!-- [[hidden]] -->",
            "notes/sub/e.md": "[[../a]] [[missing]]",
            "notes/broken.md": "---\na: [\n---\n",
            "notes/wrong.md": "---\nrelated: b\ntags: x\n---\n",
            "notes/nullrel.md": "---\nrelated: [1]\n---\n",
            "other/c.md": "not of kind notes",
            ".git/x.md": "ignored", ".hidden/y.md": "a note in a dot-folder",
        },
        relations={"related": {"field": "related", "cardinality": "0..*", "targetKinds": ["document"]}},
    )
    os.symlink(outside, root / "notes" / "escaped.md")
    result = scan(spark, root)
    nodes = {r.path: r for r in result.nodes.collect()}
    assert set(nodes) == {"notes/a.md", "notes/b.md", "notes/sub/e.md", "notes/wrong.md", "notes/nullrel.md", "other/c.md", ".hidden/y.md"}
    assert list(nodes["notes/a.md"].tags) == ["x", "y", "inline"] and nodes["notes/a.md"].title == "Head" and nodes["notes/b.md"].title == "b"
    assert edge_set(result) == {
        ("notes/a", "related", "notes/b", "frontmatter:related:wikilink", True), ("notes/a", "related", "other/c", "frontmatter:related:frontmatter", True),
        ("notes/a", "link", "notes/b", "wikilink", True), ("notes/a", "link", "d", "wikilink", False), ("notes/a", "link", "notes/sub/e", "markdown", True),
        ("notes/sub/e", "link", "notes/a", "wikilink", True), ("notes/sub/e", "link", "missing", "wikilink", False),
    }
    assert codes(result) == [
        ("field.type", "notes/wrong.md"), ("link.unresolved", "notes/a.md"), ("link.unresolved", "notes/sub/e.md"), ("markdown.parse", "notes/broken.md"),
        ("path.escape", "notes/escaped.md"), ("relation.cardinality", "notes/wrong.md"), ("relation.target-type", "notes/nullrel.md"),
    ]
    summary = result.summary().first()
    assert (summary.nodes, summary.edges, summary.errors, summary.warnings, summary.valid) == (7, 7, 5, 2, False)


def test_classification(spark, make_vault):
    kinds = {"a": {"selectors": [{"path": "notes/**"}]}, "b": {"selectors": [{"tag": "t"}, {"type": "bee"}, {"hasField": "f", "path": "x/*"}]}}
    notes = {"notes/1.md": "plain", "notes/2.md": "#t", "x/3.md": "---\nf: null\n---\n", "x/4.md": "---\ntype: bee\n---\n", "y/5.md": "---\nf: 1\n---\n"}
    root = make_vault(notes, nodeKinds=kinds, relations={})
    raw = json.loads((root / ".notegraph/manifest.json").read_text())
    del raw["defaultKind"]
    (root / ".notegraph/manifest.json").write_text(json.dumps(raw))
    result = scan(spark, root)
    assert {r.path: r.kind for r in result.nodes.collect()} == {"notes/1.md": "a", "notes/2.md": "__invalid__", "x/3.md": "b", "x/4.md": "b", "y/5.md": "__invalid__"}
    assert codes(result) == [("node.ambiguous-kind", "notes/2.md"), ("node.unclassified", "y/5.md")]


def test_cycle_and_deep_chain(spark, make_vault):
    notes = {f"notes/n{i:03}.md": f"---\nparent: n{i + 1:03}\n---\n" for i in range(24)} | {"notes/n024.md": "end"}
    relations = {"parent": {"field": "parent", "cardinality": "0..1", "targetKinds": ["document"], "acyclic": True}}
    root = make_vault(notes, relations=relations)
    assert codes(scan(spark, root)) == []
    (root / "notes/n024.md").write_text("---\nparent: n022\n---\n")
    assert codes(scan(spark, root)) == [("relation.cycle", "notes/n000.md")]


def test_cycles_agree_with_peeling(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        n = rng.randint(2, 9)
        edges = {(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))}
        rows += [(f"r{g}", a, b) for a, b in edges]
        left = set(x for e in edges for x in e)
        while sinks := [x for x in left if not any(a == x and b in left for a, b in edges)]:
            left -= set(sinks)
        if left:
            want[f"r{g}"] = min(left)
    rows += [("chain", f"c{i:04}", f"c{i + 1:04}") for i in range(200)]
    got = graph.cycles(spark.createDataFrame(rows, "relation string, source string, target string"))
    assert {r.relation: r.id for r in got.collect()} == want


def test_query_filters(spark, make_vault):
    notes = {
        "notes/a.md": "---\nstatus: open\npriority: 1\ntags: [x, y]\nlist: [1, 2]\n---\n[[b]]", "notes/b.md": "---\nstatus: null\npriority: 1.0\ntags: [x]\n---\n[[b]]", "notes/c.md": "---\npriority: true\n---\n",
    }
    result = scan(spark, make_vault(notes))
    ask = lambda **q: [r.id for r in filters.query_nodes(result.nodes, result.edges, **q).collect()]
    assert ask(properties=[("priority", 1)]) == ["notes/a", "notes/b", "notes/c"]
    assert ask(properties=[("status", None)]) == ["notes/b"] and ask(has_fields=["status"]) == ["notes/a", "notes/b"]
    assert ask(tags=["#x", "y"]) == ["notes/a"] and ask(paths=["notes/?.md"], limit=2) == ["notes/a", "notes/b"]
    assert ask(properties=[("list", [2, 1])]) == [] and ask(without_incoming=True) == ["notes/a", "notes/c"] and ask(kinds=["none"]) == []
    for bad in ({"limit": 0}, {"paths": ["../x"]}, {"properties": [("a", 1), ("a", 2)]}, {"kinds": ["none"], "declared_kinds": ["document"]}):
        with pytest.raises(QueryError):
            ask(**bad)


def test_scores(spark, make_vault):
    zones = [{"source": "stem", "weight": 20, "phraseWeight": 20}, {"source": "property", "field": "description", "weight": 8, "phraseWeight": 16}, {"source": "body", "weight": 1, "phraseWeight": 2, "countCap": 2}]
    result = scan(spark, make_vault({"notes/plan.md": "---\ndescription: The Plan\n---\nplan plan plan", "notes/x.md": "plan", "notes/y.md": "other"}, search={"zones": zones, "boosts": [{"path": "notes/x.md", "weight": 5}, {"kind": "document", "weight": 3}]}))
    rows = {r.id: (r.score, list(r.matched_zones)) for r in search.search(result.nodes, "plan", manifest=result.manifest).collect()}
    assert rows == {"notes/plan": (20 + 20 + 8 + 16 + 2 + 2 + 3, ["stem", "property:description", "body"]), "notes/x": (1 + 2 + 5 + 3, ["body"])}
    assert search.search(result.nodes, "the a", manifest=result.manifest).count() == 0
    with pytest.raises(QueryError):
        result.manifest.limit("search", 1000)


def test_index_refresh(spark, make_vault):
    root = make_vault({"notes/one.md": "# Созвоны\nпланы релиза", "notes/two.md": "planning the release [[one]]", "notes/old.md": "---\nupdated: 2020-01-01\n---\nrelease planning", "notes/new.md": "---\nupdated: 2026-01-01\n---\nrelease planning", "notes/bad.md": "---\n[\n---\n"})
    manifest = load_manifest(root)
    first = store.open_index(spark, manifest)
    assert first.parsed == 4 and not str(first.folder).startswith(str(root))
    assert store.open_index(spark, manifest).version == first.version
    day = datetime.date(2026, 1, 1)
    hits = {r.id: r.score for r in first.search("plans release", 10, day).collect()}
    assert hits["notes/new"] > hits["notes/old"] and "notes/two" in hits
    assert [r.id for r in first.search("созвон", 10, day).collect()] == ["notes/one"]
    (root / "notes/two.md").write_text("changed entirely")
    (root / "notes/old.md").unlink()
    assert first.pending() == {"changed": 1, "removed": 1}
    second = store.open_index(spark, manifest)
    assert second.parsed == 1 and second.version == first.version + 1
    full = scan(spark, root)
    fields = ("id", "path", "kind", "title", "source_hash", "body")
    assert {tuple(r[f] for f in fields) for r in second.table("nodes").collect()} == {tuple(r[f] for f in fields) for r in full.nodes.collect()}
    assert edge_set(second.scan_result()) == edge_set(full) and codes(second.scan_result()) == codes(full)
    postings = lambda df: {tuple(r) for r in df.select("term", "path", "zone", "count").collect()}
    assert postings(second.table("postings")) == postings(search.build_postings(full.nodes))
    (second.folder / "current.json").write_text("{broken")
    assert store.open_index(spark, manifest).parsed == 3
    (root / ".notegraph/manifest.json").write_text(json.dumps(manifest.raw | {"vaultId": "other-vault"}))
    assert store.open_index(spark, load_manifest(root)).parsed == 3


def test_index_rewrites_only_touched_buckets(spark, make_vault, monkeypatch):
    monkeypatch.setattr(store, "FILES_PER_BUCKET", 3)
    root = make_vault({f"notes/n{i}.md": f"# N{i}\n\nwords {i} [[n{(i + 1) % 12}]]" for i in range(12)})
    manifest = load_manifest(root)
    first = store.open_index(spark, manifest)
    assert first.pointer["buckets"] == 4
    (root / "notes/n3.md").write_text("# Changed\n\nother words")
    second = store.open_index(spark, manifest)
    moved = [b for b, v in second.pointer["at"]["nodes"].items() if v == second.version]
    assert len(moved) == 1 and second.parsed == 1 and set(second.pointer["at"]["nodes"]) == set(first.pointer["at"]["nodes"])
    assert {(r.id, r.source_hash) for r in second.table("nodes").collect()} == {(r.id, r.source_hash) for r in scan(spark, root).nodes.collect()}
    assert first.table("nodes").count() == 12  # readers of the version before still can read it
    # all notes of a bucket gone
    for r in second.table("nodes").select("path").collect():
        (root / r.path).unlink()
    third = store.open_index(spark, manifest)
    assert third.table("nodes").count() == 0 and third.pointer["at"]["nodes"] == {} and third.counts().first().files == 0
    (root / "notes/again.md").write_text("again")
    assert store.open_index(spark, manifest).table("postings").count() > 0


def test_index_lock_and_damage(spark, make_vault):
    root = make_vault({"notes/a.md": "words"})
    manifest = load_manifest(root)
    first = store.open_index(spark, manifest)
    with store._locked(first.folder):
        with pytest.raises(IndexStoreError):
            store.open_index(spark, manifest, wait=0.1)
    part = next((first.folder / f"v{first.version}" / "edges").glob("*.parquet"))
    part.write_bytes(b"x" * part.stat().st_size)
    assert store.open_index(spark, manifest).version == first.version + 1
    found, result = store.open_or_scan(spark, manifest)
    assert found is not None and result.nodes.count() == 1
    (found.folder / "lock").unlink()
    (found.folder / "lock").mkdir()  # it can't be opened any more
    found, result = store.open_or_scan(spark, manifest)
    assert found is None and result.nodes.count() == 1


def test_texts_of_reports():
    hit = {"score": 3, "path": "a.md", "title": "A", "snippets": ["line"]}
    budget = {"usedCharacters": 5, "maxCharacters": 9, "truncated": True}
    text = lambda name, **p: cli.emit({"schemaVersion": f"notegraph.{name}/v1", **p}, "text")
    assert text("search", hits=[hit], mode="exact") == "3\ta.md\tA\n    line\n1 hits (exact)"
    assert text("context", hits=[hit], groups=[], budget=budget).splitlines()[-1] == "5 of 9 characters, cut"
    assert text("context", hits=[hit], groups=[{"key": "K", "count": 2, "score": 3, "hits": [hit]}], budget=budget).startswith("[K] 2 notes, score 3\n3\ta.md")
    summary = {"nodes": 1, "edges": 0, "errors": 1, "warnings": 0, "valid": False}
    assert text("validate", issues=[{"level": "error", "code": "c", "message": "m", "path": None}], summary=summary) == "error: -: c: m\n1 nodes, 0 edges, 1 errors, 0 warnings: not valid"
    assert text("error", error={"code": "query", "message": "m"}) == "error: query: m"
    assert text("neighbors", neighbors=[{"distance": 1, "path": "a.md", "edges": [{"field": "f", "direction": "in"}]}], truncated=False) == "1\ta.md\tf in"
    assert text("doctor", root="x", kinds=["k"]) == "schemaVersion: notegraph.doctor/v1\nroot: x\nkinds:\n  - k"


def test_tasks_walk_the_lower_folders(spark, make_vault):
    """The same files whether the driver walks all folders or only the uppermost."""
    notes = {f"notes/a{i}/b{j}/n{k}.md": "x" for i in range(3) for j in range(2) for k in range(2)} | {"notes/top.md": "x", "out/x/gone.md": "x"}
    manifest = load_manifest(make_vault(notes, ignore=["out/**", "notes/a0/b1/*1.md"]))
    want = sorted(p for p in notes if not p.startswith("out/") and p != "notes/a0/b1/n1.md")
    assert list_notes(str(manifest.root), manifest.ignores) == want
    read_files(spark, manifest)  # registers the source
    for folders in (1, 2, 4, 256):
        df = spark.read.format("notes").option("root", str(manifest.root)).option("ignore", json.dumps(manifest.ignores)).option("folders", folders).load()
        assert sorted(r.path for r in df.select("path").collect()) == want


def test_postings_stream(spark, tmp_path):
    """Batches in turn; the result is that of the last state, before and after compaction."""
    kind = "path string, indexed_at int, deleted boolean, body string"
    batches = [[("a.md", 1, None, "one two two"), ("b.md", 1, False, "three")], [("a.md", 2, None, "four"), ("a.md", 1, None, "late")], [("b.md", 3, True, ""), ("c.md", 3, None, "five five")], [("c.md", 4, None, "six")]]
    source, folder = tmp_path / "source", f"{tmp_path}/postings"
    zones = [{"source": "body", "weight": 1}]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(source))
        refresh.postings_stream(stream, folder, f"{tmp_path}/checkpoint", zones, compact_every=2).trigger(availableNow=True).start().awaitTermination()
        got = {(r.term, r.path, r["count"]) for r in refresh.current_postings(spark, folder).where("term not like 's:%'").collect()}
        assert got == [{("one", "a.md", 1), ("two", "a.md", 2), ("three", "b.md", 1)}, {("four", "a.md", 1), ("three", "b.md", 1)}, {("four", "a.md", 1), ("five", "c.md", 2)}, {("four", "a.md", 1), ("six", "c.md", 1)}][i]
    assert refresh._numbers(spark, f"{folder}/base") == [1, 3] and refresh._numbers(spark, f"{folder}/postings") == [2, 3]
    assert refresh.current_postings(spark, f"{folder}/none").count() == 0


def test_exact_and_indexed_agree(spark, make_vault):
    result = scan(spark, make_vault({f"notes/n{i}.md": f"release plan {'plan ' * (i % 4)} topic{i % 7}" for i in range(12)}))
    exact = [(r.id, r.score) for r in search.search(result.nodes, "release plan").collect()]
    postings = search.build_postings(result.nodes)
    indexed = [(r.id, r.score) for r in search.search_indexed(result.nodes, postings, "release plan", stemming=False, weight=0.0).collect()]
    assert exact == indexed


def test_context(spark, make_vault):
    notes = {
        "notes/ABC-12-one.md": "---\nstatus: archived\nupdated: 2025-05-01\n---\nplan plan\n\n  second plan line", "notes/ABC-12-two.md": "---\nupdated: 2024-01-01\n---\nplan", "notes/abc-1-x.md": "plan", "notes/z.md": "---\ntopic: ' abc-12 '\n---\nplan",
    }
    policy = {"grouping": {"fields": ["topic"], "pathToken": "ticket", "keyCase": "upper", "notesPerGroup": 2}, "snippetLines": 1, "snippetCharacters": 32}
    result = scan(spark, make_vault(notes, search={"zones": [{"source": "body", "weight": 1, "countCap": 6}]}, context=policy))
    hits = search.search(result.nodes, "plan", manifest=result.manifest)
    rows = context.context(hits, ["plan"], policy).collect()
    assert [(r.key, r.path, r.place) for r in rows] == [("ABC-12", "notes/ABC-12-two.md", 1), ("ABC-12", "notes/z.md", 2), ("notes/abc-1-x.md", "notes/abc-1-x.md", 1)]
    assert rows[0].representative == "notes/ABC-12-two.md" and rows[0].top_match == "notes/ABC-12-one.md" and rows[0]["count"] == 3
    assert list(rows[0].snippets) == ["plan"]
    tight = context.context(hits, ["plan"], {"maxCharacters": 45, "snippetLines": 1}).collect()
    assert [r.path for r in tight] == ["notes/ABC-12-one.md"] and tight[0].cost == 19 + 10 + 9


def test_neighbors(spark, make_vault):
    result = scan(spark, make_vault({"notes/hub.md": "[[a]] [[b]] [[gone]]", "notes/a.md": "[[leaf]] [[hub]]", "notes/b.md": "[[b]]", "notes/leaf.md": "x"}))
    near = lambda **k: [(r.id, r.distance, [(e.field, e.direction) for e in r.edges]) for r in graph.neighbors(result.nodes, result.edges, "notes/hub.md", **k).collect()]
    assert near() == [("notes/a", 1, [("link", "in"), ("link", "out")]), ("notes/b", 1, [("link", "out")])]
    assert near(depth=2, direction="out") == [("notes/a", 1, [("link", "out")]), ("notes/b", 1, [("link", "out")]), ("notes/leaf", 2, [("link", "out")])]
    assert len(near(limit=1)) == 1
    for bad in ({"depth": 4}, {"direction": "x"}, {"limit": 0}):
        with pytest.raises(QueryError):
            near(**bad)


REVISIONS = {s: c * 40 for s, c in zip(merge.SIDES, "abc")}


@pytest.mark.parametrize(
    "base, ours, theirs, strategy, want",
    [
        ({"f": 1}, {"f": 1}, {"f": 2}, "scalar", {"f": 2}), ({"f": 1}, {"f": 3}, {"f": 2}, "scalar", None), ({"f": 1}, {}, {"f": 1}, "scalar", {}), ({}, {"f": None}, {}, "scalar", {"f": None}),
        ({"f": None}, {"f": None}, {}, "scalar", {}), ({"f": True}, {"f": 1}, {"f": True}, "scalar", {"f": 1}), ({"f": [1, 2]}, {"f": [2, 3]}, {"f": [1, 2, 4]}, "set", {"f": [2, 3, 4]}),
        ({"f": [1]}, {"f": "x"}, {"f": [1]}, "set", None), ({}, {"f": ["b", "a"]}, {"f": ["c"]}, "set", {"f": ["a", "b", "c"]}), ({"f": ["a", "a"]}, {"f": ["a", "a"]}, {"f": ["a", "a"]}, "set", {"f": ["a"]}),
        ({"f": [{"k": 1}]}, {"f": [{"k": 1}, {"k": 2}]}, {"f": []}, "set", {"f": [{"k": 2}]}),
    ],
)
def test_merge_rules(spark, make_vault, base, ours, theirs, strategy, want):
    manifest = load_manifest(make_vault({}, merge={"fields": {"f": {"strategy": strategy}}}))
    note = lambda p: mutate.render(None, p, "body\n")
    plan = merge.plan_merge(spark, manifest, "notes/x.md", dict(zip(merge.SIDES, map(note, (base, ours, theirs)))), REVISIONS)
    assert (plan["candidate"]["properties"] if plan["candidate"] else None) == want and plan["state"] == ("conflict" if want is None else "clean")
    assert merge.verify_plan(plan) is plan
    with pytest.raises(MergeError):
        merge.verify_plan(plan | {"path": "notes/y.md"})


def test_merge_validate_and_apply(spark, make_vault):
    root = make_vault({"notes/x.md": "---\n# why\nstatus: 'open'\nowner: me\n---\nours\n"}, merge={"defaultFieldStrategy": "scalar"}, capabilities=["semantic-merge-apply"])
    manifest = load_manifest(root)
    ours = (root / "notes/x.md").read_bytes()
    plan = merge.plan_merge(spark, manifest, "notes/x.md", {"base": ours, "ours": ours, "theirs": b"---\nstatus: done\nowner: me\n---\nours\n"}, REVISIONS)
    assert mutate.validate_merge_plan(spark, manifest, plan)["valid"]
    receipt = mutate.apply_merge_plan(spark, manifest, plan)
    assert receipt["state"] == "applied" and (root / "notes/x.md").read_text() == "---\n# why\nstatus: done\nowner: me\n---\nours\n"
    with pytest.raises(MergeError):
        mutate.validate_merge_plan(spark, manifest, plan)


def update(path, expected, **changes):
    return {"schemaVersion": mutate.REQUEST_SCHEMA, "operation": "update", "path": path, "kind": "document", "expectedSourceHash": expected, "changes": changes}


def test_mutations(spark, make_vault):
    text = "---\na: 1 # keep\nb: [x,  y]\n---\nbody"
    root = make_vault({"notes/x.md": text}, capabilities=["node-mutation-apply"])
    manifest, at = load_manifest(root), root / "notes/x.md"
    from notegraph.functions.canonical import text_hash

    now = text_hash(at.read_bytes())
    plan = mutate.plan_node_mutation(spark, manifest, update("notes/x.md", now, setProperties={"b": "z", "c": None}))
    assert plan["candidate"]["content"] == "---\na: 1 # keep\nb: z\nc: null\n---\nbody" and plan["valid"] and "No newline at end of file" in plan["diff"]
    with pytest.raises(MutationError):
        mutate.check_plan(plan | {"valid": False})

    def failing(path, data, create):
        mutate.write_note(path, data + b"!", create)

    broken = mutate.apply_node_mutation_plan(spark, manifest, plan, write=failing)
    assert broken["state"] == "failed" and at.read_text().endswith("body!")  # not ours any more, so it stays
    at.write_text(text)
    assert mutate.apply_node_mutation_plan(spark, manifest, plan)["state"] == "applied" and at.read_text() == plan["candidate"]["content"]
    for bad in (update("notes/x.md", "0" * 64, body="x"), update("notes/x.md", text_hash(at.read_bytes()), removeProperties=["none"]), update("notes/none.md", now, body="x"), update("../x.md", now, body="x"), {"operation": "create"}):
        with pytest.raises(MutationError):
            mutate.plan_node_mutation(spark, manifest, bad)
    create = {"schemaVersion": mutate.REQUEST_SCHEMA, "operation": "create", "path": "notes/new.md", "kind": "document", "document": {"properties": {"related": ["missing"]}, "body": "x"}}
    plan = mutate.plan_node_mutation(spark, manifest, create)
    assert not plan["valid"] and plan["diff"].startswith("--- /dev/null")


def test_command_line(spark, make_vault, tmp_path, capsys):
    root = make_vault({"notes/a.md": "---\nstatus: open\n---\n# Release plan\n[[b]]", "notes/b.md": "plan [[gone]]"})

    def run(*args):
        code = cli.main(["--vault", str(root), *args], spark)
        got = capsys.readouterr()
        return code, json.loads(got.out or got.err)

    assert run("validate")[0] == 0 and run("scan")[1]["summary"]["warnings"] == 1
    assert [n["id"] for n in run("query", "--where", "status=open")[1]["nodes"]] == ["notes/a"]
    warm, cold = run("search", "plan")[1], run("--no-cache", "search", "plan")[1]
    assert (warm["mode"], cold["mode"]) == ("indexed", "exact") and {h["id"] for h in warm["hits"]} == {h["id"] for h in cold["hits"]} == {"notes/a", "notes/b"}
    assert run("context", "plan")[1]["budget"]["truncated"] is False and run("neighbors", "notes/a")[1]["neighbors"][0]["id"] == "notes/b"
    assert run("read", "notes/b.md")[1]["node"]["incomingEdges"][0]["source"] == "notes/a" and len(run("graph", "export")[1]["edges"]) == 2
    assert run("index", "status")[1]["pending"] == {"changed": 0, "removed": 0} and run("doctor")[1]["index"]["exists"]
    code, error = run("read", "nothing")
    assert code == 2 and error["schemaVersion"] == "notegraph.error/v1"


def test_a_folder_for_each_note_is_not_a_task_for_each(spark, make_vault):
    """Partitions are bounded by the number of files, not of folders."""
    manifest = load_manifest(make_vault({f"tickets/t{i:04}/n.md": f"text {i}" for i in range(600)}))
    assert read_files(spark, manifest, content=False).rdd.getNumPartitions() <= 40
    got = read_files(spark, manifest)
    assert got.rdd.getNumPartitions() == 2 and {r.path: bytes(r.content) for r in got.collect()} == {f"tickets/t{i:04}/n.md": b"text %d" % i for i in range(600)}


def test_contents_with_exact_times_in_small_batches(spark, make_vault, monkeypatch):
    """A file without a time doesn't round those of others, and a batch holds a bounded part of the contents."""
    monkeypatch.setattr("notegraph.sources.vault.BATCH_BYTES", 5)
    root = make_vault({f"notes/{i}.md": "x" * i for i in range(9)})
    for i in range(9):
        os.utime(root / f"notes/{i}.md", ns=(0, 1_700_000_000_123_456_780 + i))
    os.symlink("nowhere", root / "notes" / "lost.md")
    rows = {r.path: r for r in read_files(spark, load_manifest(root)).collect()}
    assert rows["notes/lost.md"].mtime_ns is None and rows["notes/lost.md"].content is None
    assert [(rows[f"notes/{i}.md"].mtime_ns, bytes(rows[f"notes/{i}.md"].content)) for i in range(9)] == [(1_700_000_000_123_456_780 + i, b"x" * i) for i in range(9)]


def test_scan_makes_only_what_is_asked_for(spark, make_vault, monkeypatch):
    """Nodes need no links, edges no search for loops; both are found from one lookup of all links."""
    calls = []
    for name in ("cycles", "resolve"):
        monkeypatch.setattr(graph, name, lambda *a, name=name, real=getattr(graph, name): (calls.append(name), real(*a))[1])
    relations = {"parent": {"field": "parent", "cardinality": "0..1", "targetKinds": ["document"], "acyclic": True}}
    result = scan(spark, make_vault({"notes/a.md": "---\nparent: a\ntags: t\n---\n[[b]]", "notes/b.md": "---\nparent: [a]\n---\n"}, relations=relations))
    assert result.nodes.count() == 2 and {r.code for r in result.note_issues.collect()} == {"field.type", "relation.cardinality"} and calls == []
    assert edge_set(result) == {("notes/a", "parent", "notes/a", "frontmatter:parent:frontmatter", True), ("notes/a", "link", "notes/b", "wikilink", True)} and calls == ["resolve"]
    assert codes(result) == [("field.type", "notes/a.md"), ("relation.cardinality", "notes/b.md"), ("relation.cycle", "notes/a.md")] and calls == ["resolve", "cycles"]


def test_cycles_end_in_one_task(spark, monkeypatch):
    """Rounds over the whole graph end when the rest fits in a task, with the same result as rounds to the end."""
    rows = [("a", f"c{i:03}", f"c{i + 1:03}") for i in range(50)] + [("a", "c050", "c048"), ("b", "x", "y"), ("c", "z", "z"), ("c", "a", "z"), ("c", "z", "q"), ("a", None, "c000")]
    df = spark.createDataFrame(rows, "relation string, source string, target string")
    rounds = []
    monkeypatch.setattr(graph, "Observation", lambda real=graph.Observation: (rounds.append(1), real())[1])
    for room, least in ((10**6, 0), (20, 1), (0, 2)):
        rounds.clear()
        assert {(r.relation, r.id) for r in graph.cycles(df, room=room).collect()} == {("a", "c000"), ("c", "a")}
        assert len(rounds) >= least and (room < 10**6 or not rounds)


def test_listing_looks_at_links_once_a_folder(spark, make_vault, tmp_path, monkeypatch):
    """Files behind a linked root or a link to a note are judged as before; links on the way aren't looked up again for each file."""
    from notegraph.sources.vault import _Chunk, _Reader

    root = make_vault({f"a/{i}.md": "x" for i in range(50)} | {"b.md": "y"})
    (tmp_path / "out.md").write_text("z")
    os.symlink(tmp_path / "out.md", root / "a" / "out.md")
    os.symlink(root / "b.md", root / "a" / "in.md")
    os.symlink(root, tmp_path / "alias")
    reader, calls = _Reader({"root": str(tmp_path / "alias")}), []
    monkeypatch.setattr(os.path, "realpath", lambda p, real=os.path.realpath: (calls.append(p), real(p))[1])
    rows = {path: (escaped, data) for path, _, _, escaped, data in reader.read(_Chunk([], [""]))}
    assert len(rows) == 53 and rows["a/out.md"] == (True, None) and rows["a/in.md"] == (False, b"y") and rows["a/7.md"] == (False, b"x")
    assert len(calls) <= 5


def test_issues_are_read_off_the_stored_edges(spark, make_vault):
    """Issues join what was found with nodes; they don't look links up again."""
    relations = {"parent": {"field": "parent", "cardinality": "0..1", "targetKinds": ["task"]}}
    result = scan(spark, make_vault({"notes/a.md": "---\nparent: a\n---\n[[b]] [[c]]", "notes/b.md": "---\nparent: x\n---\n"}, nodeKinds={"document": {"selectors": [{"path": "notes/**"}]}, "task": {"selectors": [{"path": "tasks/**"}]}}, relations=relations))
    plan = result.issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "MapIn" not in plan and "Window" not in plan
    assert codes(result) == [("link.unresolved", "notes/a.md"), ("relation.target-kind", "notes/a.md"), ("relation.unresolved", "notes/b.md")]


def test_field_issues_look_up_no_links(spark, tmp_path, monkeypatch):
    """Issues that a note has by itself are found without the links of any."""
    from notegraph.plans import vaults

    monkeypatch.setattr(graph, "resolve", None)
    shared = {"id": "notes/a", "path": "notes/a.md", "source_hash": "h", "body": "[[b]]", "properties_json": '{"priority": "high"}', "indexed_at": datetime.datetime(2024, 1, 1)}
    spark.createDataFrame([shared], "id string, path string, source_hash string, body string, properties_json string, indexed_at timestamp").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([], "src string, dst string, field string, provenance string").write.parquet(f"{tmp_path}/edges.parquet")
    assert sorted((r.code, r.path) for r in vaults.scan_field_issues(spark, str(tmp_path)).collect()) == [("field.required", "notes/a.md"), ("field.type", "notes/a.md")]
