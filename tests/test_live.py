"""A graph that follows its sources: the stream of a tree's changes, bursts in any order of arrival, rows that go wrong."""

import datetime
import json
import os
import random

import pytest

from symbolweave.plans import parse
from symbolweave.plans.graph import CodeGraph
from symbolweave.schema import EDGES, NODES
from symbolweave.streaming import files, watch


def write(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_py", ".py").replace("_go", ".go")
        path.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            path.unlink()
        else:
            path.write_bytes(text if isinstance(text, bytes) else text.encode())


def told(spark, state, sink, number, fail=False):
    """Catch up with a snapshot; what the batches got so far, in the sink."""

    def keep(batch, k):
        if fail:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{sink}/batch={k}")

    if fail:
        with pytest.raises(Exception, match="killed"):
            files.catch_up(spark, state, keep, f"{state}/checkpoint", number, 4)
    else:
        files.catch_up(spark, state, keep, f"{state}/checkpoint", number, 4)
    if not os.path.exists(sink):
        return []
    return sorted((r.snapshot, r.op, r.path) for r in spark.read.schema(files.CHANGES).parquet(sink).collect())


def test_a_restart_tells_nothing_twice_and_leaves_nothing_out(spark, tmp_path):
    root, state, sink = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "sink")
    write(root, a_py="one", sub__b_py="two", node_modules__c_py="skipped", note="not a source")
    files.take_snapshot(spark, str(root), state, buckets=4)
    first = [(1, "created", "a.py"), (1, "created", "sub/b.py")]
    assert told(spark, state, sink, 1) == first
    assert told(spark, state, sink, 1) == first  # nothing new
    write(root, a_py="longer", sub__b_py=None, d_go="x")
    assert told(spark, state, sink, 1) == first  # no snapshot of it yet
    files.take_snapshot(spark, str(root), state, buckets=4)
    assert told(spark, state, sink, 2, fail=True) == first  # a batch that is killed ...
    write(root, a_py="longer still")
    files.take_snapshot(spark, str(root), state, buckets=4)
    second = [(2, "created", "d.go"), (2, "deleted", "sub/b.py"), (2, "modified", "a.py"), (3, "modified", "a.py")]
    assert told(spark, state, sink, 3) == first + second  # ... is told by the next run
    assert len(os.listdir(f"{state}/snapshots")) <= 2


def test_an_unfinished_snapshot_is_not_read(spark, tmp_path):
    root, state, sink = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "sink")
    write(root, a_py="one")
    files.take_snapshot(spark, str(root), state, buckets=4)
    (tmp_path / "state/snapshots/number=2").mkdir()
    assert told(spark, state, sink, 1) == [(1, "created", "a.py")]
    write(root, b_py="two")
    assert files.take_snapshot(spark, str(root), state, buckets=4) == 2
    assert told(spark, state, sink, 2) == [(1, "created", "a.py"), (2, "created", "b.py")]


def test_graph_follows_a_tree(spark, tmp_path):
    root, state = tmp_path / "tree", str(tmp_path / "state")
    write(root, a_py="def a():\n    b()\n", sub__b_py="def b(): pass\n", bad_py=b"\xff\xfe")
    graph = CodeGraph(spark, str(tmp_path / "graph"), buckets=2)
    names = lambda: sorted(r.name for r in graph.nodes.collect())
    assert graph.watch(str(root), state) == 3 and names() == ["a", "b"]
    assert [(os.path.basename(r.path), r.error.split(": ")[1]) for r in graph.bad_files(state).collect()] == [("bad.py", "not UTF-8")]
    assert graph.watch(str(root), state) == 0 and names() == ["a", "b"]
    write(root, a_py="def a2(): pass\n", sub__b_py=None, c_go="package c\nfunc C() {}\n", bad_py="def good(): pass\n")
    assert graph.watch(str(root), state) == 4 and names() == ["C", "a2", "good"]
    assert graph.bad_files(state).count() == 0 and [r.name for r in graph.search("a2").collect()] == ["a2"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bursts_in_any_order_of_arrival(spark, tmp_path, seed):
    """The stream's bursts are those of the batch, whatever order events come in within the watermark."""
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at, rows = 0, []
    for k in range(120):
        at += rng.choice([50, 200, 499, 501, 900, 3000])
        rows.append({"path": f"/{rng.choice('ab')}.py", "op": rng.choice(["created", "modified", "deleted"]),
                     "ts": (start + datetime.timedelta(milliseconds=at)).isoformat(), "text": str(k)})
    rows.append({"path": "/end.py", "op": "created", "ts": (start + datetime.timedelta(hours=2)).isoformat(), "text": ""})
    folder = tmp_path / "events"
    folder.mkdir()
    shuffled = sorted(range(len(rows) - 1), key=lambda k: k + rng.randrange(12))
    for part in range(4):
        chosen = [rows[k] for k in shuffled[part::4]] if part < 3 else [rows[k] for k in shuffled[3::4]] + rows[-1:]
        (folder / f"{part}.json").write_text("\n".join(map(json.dumps, chosen)))
    events = spark.read.schema(watch.EVENTS).json(str(folder)).filter("path != '/end.py'")
    stream = spark.readStream.schema(watch.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    name = f"bursts_{seed}"
    (watch.debounced_stream(stream, late="10 minutes").writeStream.format("memory").queryName(name).outputMode("append")
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    found = sorted((r.path, r.op, r.ts) for r in spark.table(name).collect())
    wanted = sorted((r.path, r.op, r.last_ts) for r in watch.debounced(events).collect())
    assert found == wanted and len(found) > 20


def test_watch_with_bursts_survives_a_restart(spark, tmp_path):
    log = watch.start_log(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), str(tmp_path / "log"))
    events = tmp_path / "events"
    events.mkdir()

    def send(name, rows):
        (events / name).write_text("\n".join(json.dumps(dict(zip(("path", "op", "ts", "text"), r))) for r in rows))
        stream = spark.readStream.schema(watch.EVENTS).json(str(events))
        watch.watch(stream, log, str(tmp_path / "checkpoint"), available_now=True, debounce_ms=500, late="1 second").awaitTermination()
        return sorted(r.name for r in watch.current_graph(spark, log)[0].collect())

    at = "2024-01-01T00:00:"
    assert send("1.json", [("/a.py", "created", at + "01.000Z", "def first(): pass"), ("/a.py", "modified", at + "01.300Z", "def second(): pass")]) == []
    # the burst is still open; its text and clearing wait in the state for another run
    assert send("2.json", [("/b.py", "created", at + "30.000Z", "def other(): pass")]) == ["second"]
    assert send("3.json", [("/a.py", "modified", at + "02.000Z", "def late(): pass"), ("/c.py", "created", at + "59.000Z", "")]) == ["other", "second"]


def test_bad_rows_stop_nothing(spark, tmp_path):
    log = watch.start_log(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), str(tmp_path / "log"))
    rows = [(f"/{k}.py", "created", f"def f{k}(): pass\n", False) for k in range(5)] + [("/none.py", "modified", None, True), ("/gone.py", "deleted", None, True)]
    changes = spark.createDataFrame(rows, "path string, op string, text string, cleared boolean")
    watch.apply_batch(log, changes, 0)
    bad = lambda: {r.path: (r.error, r.batch) for r in watch.bad_records(spark, log).collect()}
    names = lambda: sorted(r.name for r in watch.current_graph(spark, log)[0].collect())
    assert bad() == {"/none.py": ("no text", 0)} and names() == [f"f{k}" for k in range(5)]
    watch.retry(spark, log, 1, spark.createDataFrame([("/none.py", "def there(): pass\n")], "path string, text string"))
    assert bad() == {} and names() == [*[f"f{k}" for k in range(5)], "there"]


def test_a_scope_that_fails_is_told():
    import pyarrow as pa

    found = parse.nest.func(pa.array(["dm", "ll"]), pa.array([[], [1]], pa.list_(pa.int32()))).to_pylist()
    assert found[0]["error"] is None and found[0]["start"] == [0, 0]
    assert found[1]["start"] == [] and found[1]["error"].startswith("StopIteration")
