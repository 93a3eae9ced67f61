import json
import os
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest

from pyspark.sql import functions as F

from evidentia.functions.identity import with_sequence
from evidentia.operators import ingest, vault
from evidentia.operators.jobs import ATTEMPTS, Slot, advance
from evidentia.operators.models import SentenceExtractor
from evidentia.scratch import materialise, shared_dir, size_of
from evidentia.sources import readers
from evidentia.sources.store import Conflict, SnapshotStore, all_leaves, append_leaves, apply_patches, apply_split, index_insert, mark_dirty, rebuild_index, set_trust, split_problems, upsert
from evidentia.streaming.ingest import publish_stream
from evidentia.streaming.jobs import job_stream, rate_stream


def test_snapshots_are_whole_and_refuse_stale_writers(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    first = store.publish({"a": a, "b": a}, None)
    pinned = store.read("a", first)
    second = store.publish({"a": a.union(a)}, first)
    assert pinned.count() == 1 and store.read("a").count() == 2 and store.read("b").count() == 1
    assert store.current() == second and store.tables() == ["a", "b"]
    with pytest.raises(Conflict):
        store.publish({"a": a}, first)
    assert store.read("a").count() == 2
    third = store.publish({"c": a}, second)
    # Unchanged tables keep their files.
    assert store._tables(third)["b"] == store._tables(first)["b"]


def test_writes(spark):
    old = spark.createDataFrame([("a", "t", 1), ("b", "u", 2)], "id string, title string, seq int")
    new = spark.createDataFrame([("b", "U", 0), ("c", "w", 0)], "id string, title string, seq int")
    assert {tuple(r) for r in upsert(old, new, "id").collect()} == {("a", "t", 1), ("b", "U", 2), ("c", "w", 3)}
    leaf = "id string, source_id string, idea_id string, text_hash string"
    leaves = spark.createDataFrame([("l1", "a", "i", "h1")], leaf)
    ideas = spark.createDataFrame([("i", False, 0.0), ("j", True, 0.2)], "id string, dirty boolean, trust_score double")
    good = spark.createDataFrame([("l2", "b", "i", "h1")], leaf)
    assert append_leaves(leaves, good, old, ideas).count() == 2
    for bad in (("l2", "zz", "i", "h"), ("l2", "a", "zz", "h"), ("l2", "a", "i", "h1")):
        with pytest.raises(Conflict):
            append_leaves(leaves, spark.createDataFrame([bad], leaf), old, ideas)
    assert {(r.id, r.dirty) for r in mark_dirty(ideas, good).collect()} == {("i", True), ("j", True)}
    scores = spark.createDataFrame([("j", 0.7)], "id string, trust double")
    assert {tuple(r) for r in set_trust(ideas, scores).collect()} == {("i", False, 0.0), ("j", False, 0.7)}
    with pytest.raises(Conflict):
        set_trust(ideas, spark.createDataFrame([("j", 1.5)], "id string, trust double"))
    assert apply_split(leaves, spark.createDataFrame([("l1", "k")], "id string, new_idea string")).first().idea_id == "k"
    index = spark.createDataFrame([("l1", "i", "t")], "thesis_id string, idea_id string, text string")
    assert index_insert(index, index).count() == 1
    with pytest.raises(Conflict):
        index_insert(index, spark.createDataFrame([("l1", "i", "other")], "thesis_id string, idea_id string, text string"))


def test_refused_writes(spark):
    leaves = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, idea_id string")
    moves = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "id string, new_idea string")
    kids = spark.createDataFrame([("x",), ("y",), ("z",)], "new_idea string")
    assert {tuple(r) for r in split_problems(leaves, moves, "p", kids).collect()} == {("a", "twice"), ("c", "stolen"), ("z", "empty child"), ("p", "emptied parent")}
    ideas = spark.createDataFrame([("i", "t", ["x"], None)], "id string, text string, failure_modes array<string>, differentiation string")
    patch = lambda f: spark.createDataFrame([("i", f)], "id string, fields map<string,string>")
    assert tuple(apply_patches(ideas, patch({"text": "u", "failure_modes": '["y"]', "differentiation": None})).first()) == ("i", "u", ["y"], None)
    for bad in ({}, {"origin": "x"}, {"text": None}, {"rederived_at_leaf_count": "-1"}):
        with pytest.raises(Conflict):
            apply_patches(ideas, patch(bad))
    rows = spark.createDataFrame([("a", "i", "t", [1.0, 0.0]), ("b", "i", "t", [1.0, 1.0])], "id string, idea_id string, text string, vec array<float>")
    assert rebuild_index(rows.where("id = 'a'"), 2).count() == 1
    with pytest.raises(Conflict):
        rebuild_index(rows, 2)


def test_extraction_is_made_once(spark):
    docs = spark.createDataFrame([(1, "up 3 points. nothing"), (2, "up 3 points. nothing"), (3, "seen 9"), (4, None)], "k int, text string")
    seen = ingest.cache_keys(docs.where("k = 3"), "text", "p").withColumn("drafts", F.array(F.lit("old")))
    got = ingest.extract(docs, "text", "p", seen, SentenceExtractor()).collect()
    assert sorted(r.drafts for r in got) == [["old"], ["up 3 points"]]


def test_numbered_lines_and_prompts(spark, tmp_path):
    line = '{"source": {"id": "%s"}, "section_id": "S"}'
    (tmp_path / "s.jsonl").write_text("\n".join(line % i if i % 3 else "" for i in range(1, 8)) + "\n")
    got = {(r.line_no, r.row.source.id) for r in readers.read_numbered(spark, str(tmp_path / "s.jsonl")).collect()}
    assert got == {(i, str(i)) for i in (1, 2, 4, 5, 7)}
    assert readers.full_scan(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        readers.full_scan(spark.range(4), 3)
    (tmp_path / "prompts" / "parse").mkdir(parents=True)
    (tmp_path / "prompts" / "parse" / "system.txt").write_text("do\n")
    assert readers.read_prompts(str(tmp_path / "prompts")) == {"parse/system": "do"}
    (tmp_path / "prompts" / "parse" / "empty.txt").write_text(" ")
    with pytest.raises(ValueError):
        readers.read_prompts(str(tmp_path / "prompts"))


def test_sequences_go_on(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("v")).repartition(5)
    assert {(r.v, r.seq) for r in with_sequence(rows, 10, "v").collect()} == {(v, v + 11) for v in range(100)}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Fake

    far = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="yarn"))
    with pytest.raises(RuntimeError):
        shared_dir(far)


def test_scratch(spark):
    df = materialise(spark.range(10), "t")
    assert df.count() == 10 and shared_dir(spark) == shared_dir(spark)
    assert size_of(spark, df.inputFiles()[0]) > 0 and size_of(spark, shared_dir(spark) + "/none") == 0


def test_readers(spark, tmp_path):
    log = tmp_path / "log.csv"
    pd.DataFrame({"program_id": ["p1", "p2"], "parent_ids": ["[]", '["p1"]'], "generation": ["0", ""], "iteration": ["", ""], "state": ["done", "running"], "metric_fitness": ["0.5", ""], "mutation_model": ["m", "m"], "mutation_output": ['{"a": "x, y"}', ""]}).to_csv(log, index=False)
    rows = {r.program_id: r for r in readers.read_runlog(spark, str(log)).collect()}
    assert rows["p1"].fitness == 0.5 and rows["p1"].parent_ids == [] and json.loads(rows["p1"].mutation_output) == {"a": "x, y"}
    assert rows["p2"].fitness is None and rows["p2"].parent_ids == ["p1"] and rows["p2"].mutation_output is None
    (tmp_path / "m.json").write_text('{"id": "a", "kind": "paper", "url": "10.1000/xyz", "group": "g"}\n{"id": "b", "kind": "doc", "url": "https://x.org", "group": "g"}\n')
    manifest = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r.id, r.type, r.url, r.skip) for r in manifest.collect()} == {("a", "paper", "https://doi.org/10.1000/xyz", True), ("b", "doc", "https://x.org", False)}
    assert readers.group_counts(manifest, {"g": 2}).count() == 0 and readers.group_counts(manifest, {"g": 3}).count() == 1
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://x/abs/1v2</id><title>A\n b</title><summary> s </summary></entry></feed>")
    assert [tuple(r) for r in readers.read_atom(spark, str(tmp_path / "f.xml")).collect()] == [("http://x/abs/1v2", "v2", "A b", "s")]
    pages = spark.createDataFrame([(" ", None, "c"), ("a", "b", None), (None, "", " ")], "x string, y string, z string")
    got = [(r.content, r.reasons) for r in readers.first_answer(pages, "x", "y", "z").collect()]
    assert got == [("c", ["x: blank", "y: blank"]), ("a", []), (None, ["x: blank", "y: blank", "z: blank"])]


def test_conform(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert readers.conform(df, "b string, a long, c double").columns == ["b", "a", "c"]
    with pytest.raises(ValueError):
        readers.conform(df, "a int")
    with pytest.raises(Exception, match="b is null"):
        readers.conform(df, "a int, b string", ("b",)).collect()


def test_logs_and_notes(spark, tmp_path):
    df = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run_id string, op string")
    readers.append_log(df, str(tmp_path / "log"), "run_id")
    readers.append_log(df, str(tmp_path / "log"), "run_id")
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    notes = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, body string")
    assert readers.write_notes(notes, str(tmp_path / "notes")) == 2
    with pytest.raises(ValueError):
        readers.write_notes(notes.union(notes), str(tmp_path / "notes"))


def test_notes_become_files(spark, tmp_path):
    src = spark.createDataFrame([("s1", "http://x/a>b", "T [x]", "paper", "v1", None), ("s2", "u", None, "doc", None, None)], "id string, url string, title string, type string, version string, retrieved_at string")
    idea = spark.createDataFrame([("i1", "An | idea", "when\nit", "", ["m"], None, "e", 0.12345), ("i2", "alone", None, None, [], None, None, None)], "id string, text string, applicability_conditions string, limitations string, failure_modes array<string>, effect_claimed string, effect_observed string, trust_score double")
    leaf = spark.createDataFrame([("l1", "s1", "i1", "one\ntwo [[i9]]", "c", "e", "p"), ("l2", "s2", "i1", None, None, None, None), ("l3", "s9", "i1", "lost", "c", "e", "p")], "id string, source_id string, idea_id string, text string, context string, effect string, locator string")
    found = vault.notes(src, idea, leaf)
    folder = str(tmp_path / "vault")
    assert vault.write_folder(found, folder) == 7
    assert vault.write_folder(found, folder) == 7
    files = {f: (tmp_path / "vault" / f).read_text() for f in os.listdir(folder) if f.endswith(".md")}
    assert set(files) == {"one-two-i9-l1.md", "l2.md", "an-idea-i1.md", "alone-i2.md", "t-x-s1.md", "s2.md", "README.md"}
    assert "> one\n> two \\[\\[i9\\]\\]" in files["one-two-i9-l1.md"] and "[[an-idea-i1]]" in files["one-two-i9-l1.md"] and "<http://x/a%3Eb>" in files["one-two-i9-l1.md"]
    assert "orphan: true" in files["alone-i2.md"] and "orphan" not in files["an-idea-i1.md"] and "## Leaves (2)" in files["an-idea-i1.md"]
    known = {f[:-3] for f in files}
    assert all(t in known for body in files.values() for t in re.findall(r"(?<!\\)\[\[([^\]]+)\]\]", body))
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "x").write_text("")
    with pytest.raises(ValueError):
        vault.write_folder(found, str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        vault.write_folder(found.unionByName(found), folder)


def test_job_moves():
    new, queued = ("new", 1, 0), ("queued", 1, 0)
    assert advance(new, "enqueue") == queued
    assert advance(queued, "claim") == ("running", 1, 1)
    assert advance(("running", 1, 1), "release") == queued
    assert advance(("running", 2, 1), "release") == ("staged", 2, 0)
    assert advance(("running", 1, 1), "stage") == ("staged", 2, 0)
    assert advance(("running", 1, 1), "fail") == ("queued", 1, 1)
    assert advance(("running", 2, 1), "fail") == ("staged", 2, 1)
    assert advance(("running", 1, ATTEMPTS), "fail") == ("failed", 1, ATTEMPTS)
    assert advance(("running", 1, 1), "fail", True) == ("failed", 1, 1)
    assert advance(("ok", 2, 1), "claim") == ("ok", 2, 1)


def _stream(spark, tmp_path, name, schema, batches, build, mode):
    folder = tmp_path / name
    folder.mkdir()
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.json(str(folder / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_job_stream_keeps_state_over_triggers(spark, tmp_path):
    schema = "job string, seq int, event string, permanent boolean, error string"
    batches = [[("a", 1, "enqueue", False, None), ("b", 1, "enqueue", False, None), ("a", 2, "claim", False, None)], [("a", 3, "fail", False, "net"), ("a", 4, "claim", False, None), ("b", 2, "claim", False, None), ("b", 3, "fail", True, "bad")]]
    out = _stream(spark, tmp_path, "jobs_out", schema, batches, job_stream, "update").collect()
    assert ("a", "running", 1, 2, "net") in [tuple(r) for r in out] and ("b", "failed", 1, 1, "bad") in [tuple(r) for r in out]


def test_batches_of_a_stream_are_published_once(spark, tmp_path):
    folder = tmp_path / "staged"
    folder.mkdir()
    for n in range(3):
        spark.createDataFrame([(n, f"t{n}")], "id int, text string").coalesce(1).write.json(str(folder / f"b{n}"))
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    read = lambda: spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))
    for checkpoint in ("a", "b"):  # the second run begins anew and must add nothing
        q = publish_stream(read(), store, "rows", str(tmp_path / checkpoint), lambda df: df.withColumn("n", F.length("text")))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(tuple(r) for r in store.read("rows").collect()) == [(0, "t0", 2), (1, "t1", 2), (2, "t2", 2)]
    slot = Slot()
    with slot.held("phase"), pytest.raises(RuntimeError, match="phase"), slot.held("other"):
        pass
    with slot.held("other"):
        assert slot.holder == "other"


def test_requests_are_answered_once(spark, tmp_path):
    cache, calls = f"file://{tmp_path}/cache", str(tmp_path / "calls")

    def fetch(key):
        with open(calls, "a") as f:
            f.write(key)
        if key == "x":
            raise OSError("gone")
        return key * 2

    wanted = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "key string")
    for _ in range(2):
        assert {(r.key, r.body, r.error) for r in readers.read_through(wanted, cache, fetch).collect()} == {("a", "aa", None), ("x", None, "OSError: gone")}
    assert sorted(open(calls).read()) == ["a", "x", "x"]


def test_manifests(spark):
    text = "# corpus\n- id: a\n  kind: paper  # note\n  url: 'it''s'\n- id: \"b \\\"q\\\"\"\n  url: http://x/#y\n"
    assert readers.parse_manifest(text) == [{"id": "a", "kind": "paper", "url": "it's"}, {"id": 'b "q"', "url": "http://x/#y"}]
    with pytest.raises(ValueError):
        readers.parse_manifest("- id: a\nnonsense")
    df = spark.createDataFrame([("b", None), ("a", "u")], "id string, url string")
    assert readers.manifest_lines(df) == ['{"id":"a","url":"u"}', '{"id":"b"}'] == readers.manifest_lines(df.repartition(3))


def test_whole_leaves(spark):
    df = spark.createDataFrame([("b", "i", "t", [1.0], 2), ("a", "i", "u", [2.0], 1)], "id string, idea_id string, text string, vec array<float>, seq int")
    assert [r.id for r in all_leaves(df).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="text is missing"):
        all_leaves(df.withColumn("text", F.lit(None).cast("string"))).collect()


def test_rate_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    batches = [[("c", t + timedelta(seconds=s)) for s in (0, 1)], [("c", t + timedelta(seconds=2)), ("c", t + timedelta(seconds=62))]]
    out = _stream(spark, tmp_path, "rate_out", "client string, ts timestamp", batches, lambda s: rate_stream(s, 2, 60), "append")
    assert sorted((r.ts.second + 60 * r.ts.minute, r.allowed) for r in out.collect()) == [(0, True), (1, True), (2, False), (62, True)]
