"""Growing files, hubs, the outbox and the capture service."""

import json
import os
import time

import pytest

from evidentia.sources import tail as tails
from evidentia.sources import transcripts
from evidentia.sources.hub import HubReader, jdbc_rows
from evidentia.streaming import flows
from evidentia.streaming.service import Service, Source


class Tail:
    """A stream over a folder whose batches are kept as lists."""

    def __init__(self, spark, folder, state, **options):
        self.spark, self.folder, self.state, self.options = spark, str(folder), str(state), options

    def take(self):
        got = []
        land = lambda batch, n: got.extend((r.path.rsplit("/", 1)[1], r.offset, r.value) for r in batch.collect())
        stream = tails.tail(self.spark, self.folder, **self.options)
        stream.writeStream.foreachBatch(land).option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination()
        return sorted(got)


def put(path, text, mode="ab"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_tail_reads_every_line_once(spark, tmp_path):
    logs, t = tmp_path / "logs", None
    t = Tail(spark, logs, tmp_path / "state")
    put(logs / "a.jsonl", "one\n")
    assert t.take() == [("a.jsonl", 0, "one")]
    put(logs / "a.jsonl", "two\nthr")  # a torn last line waits
    put(logs / "deep" / "b.jsonl", "été\n")
    put(logs / "c.txt", "not read\n")
    assert t.take() == [("a.jsonl", 4, "two"), ("b.jsonl", 0, "été")]
    assert t.take() == []
    put(logs / "a.jsonl", "ee\n\nfive\n")
    assert t.take() == [("a.jsonl", 8, "three"), ("a.jsonl", 14, ""), ("a.jsonl", 15, "five")]
    put(logs / "a.jsonl", "new\n", "wb")  # shrunk: another file
    assert t.take() == [("a.jsonl", 0, "new")]
    put(logs / "a.jsonl", "xyz\nmore\n", "wb")  # longer, but another file by its mark
    assert t.take() == [("a.jsonl", 0, "xyz"), ("a.jsonl", 4, "more")]
    put(logs / "a.jsonl", "xyw\nmore\n", "wb")  # as long, and another
    assert t.take() == [("a.jsonl", 0, "xyw"), ("a.jsonl", 4, "more")]
    (logs / "deep" / "b.jsonl").unlink()
    put(logs / "a.jsonl", b"\xff\xfe bad\nlast\n")
    assert t.take() == [("a.jsonl", 16, "last")]


def test_tail_splits_files_into_ranges(spark, tmp_path):
    import random

    rng, logs = random.Random(1), tmp_path / "logs"
    lines = ["x" * rng.choice([0, 1, 7, 300, 5000]) + str(i) for i in range(400)]
    put(logs / "a.jsonl", "".join(x + "\n" for x in lines) + "torn")
    for split in (1, 10, 64, 4097, 1 << 20):
        if split == 1:
            lines_here, folder = lines[:40], tmp_path / "small"
            put(folder / "a.jsonl", "".join(x[-9:] + "\n" for x in lines_here))
            want = [x[-9:] for x in lines_here]
        else:
            want, folder = lines, logs
        if split == 10:
            continue  # many thousand tasks; 64 and 1 stand for it
        if split == 64:
            want, folder = [x[-70:] for x in lines[:60]], tmp_path / "middle"
            put(folder / "a.jsonl", "".join(x + "\n" for x in want))
        got = tails.tail(spark, str(folder), stream=False, split_bytes=str(split)).orderBy("offset").collect()
        assert [r.value for r in got] == want
        assert [r.offset for r in got] == [sum(len(y) + 1 for y in want[:i]) for i in range(len(want))]


def test_lines_of_any_split_are_each_lines_once():
    import io

    data = b"a\n\nbc\n" + b"d" * 50 + b"\ne\n"
    want = [(0, b"a"), (2, b""), (3, b"bc"), (6, b"d" * 50), (57, b"e")]
    for split in range(1, len(data) + 2):
        got = [x for at in range(0, len(data), split) for x in tails.lines_of(io.BytesIO(data), tails.Range("", at, min(len(data), at + split), len(data), at == 0))]
        assert got == want
    assert tails.whole_lines(io.BytesIO(data + b"torn"), len(data) + 4) == len(data)
    long = b"x\n" + b"y" * (3 * tails.WINDOW)
    assert tails.whole_lines(io.BytesIO(long), len(long)) == 2 and tails.whole_lines(io.BytesIO(b"torn"), 4) == 0


def test_tail_baseline_starts_at_the_last_whole_line(spark, tmp_path):
    logs = tmp_path / "logs"
    put(logs / "a.jsonl", "old\nhalf")
    t = Tail(spark, logs, tmp_path / "state", start="end")
    assert t.take() == []
    put(logs / "a.jsonl", "-done\nnew\n")
    put(logs / "b.jsonl", "all of a later file\n")
    assert t.take() == [("a.jsonl", 4, "half-done"), ("a.jsonl", 14, "new"), ("b.jsonl", 0, "all of a later file")]


def test_tail_budget_ends_on_whole_lines_and_survives_restarts(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    put(logs / "a.jsonl", "".join(f"{i:09d}\n" for i in range(10)))
    put(logs / "b.jsonl", "z" * 100 + "\n" + "y\n")
    t = Tail(spark, logs, state, max_bytes="35", checkpoint=str(state))
    batches = []
    while part := t.take():
        batches.append(part)
        assert len(batches) < 20
    flat = [x for b in batches for x in b]
    assert len(flat) == len(set(flat)) == 12 and len(batches) > 3
    assert max(sum(len(v) + 1 for _, _, v in b) for b in batches) <= 35 + 101


def test_tail_deletes_read_files_that_are_idle(spark, tmp_path):
    logs = tmp_path / "logs"
    t = Tail(spark, logs, tmp_path / "state", delete_idle="3600")
    for name in ("done", "fresh", "torn"):
        put(logs / f"{name}.jsonl", f"{name}\n" + ("half" if name == "torn" else ""))
    old = time.time() - 7200
    for name in ("done", "torn"):
        os.utime(logs / f"{name}.jsonl", (old, old))
    assert len(t.take()) == 3
    put(logs / "fresh.jsonl", "next\n")  # commits of a batch are made when the next one is planned
    assert t.take() == [("fresh.jsonl", 6, "next")]
    assert sorted(p.name for p in logs.iterdir()) == ["fresh.jsonl", "torn.jsonl"]
    put(logs / "done.jsonl", "a later session\n")
    assert t.take() == [("done.jsonl", 0, "a later session")]


def test_a_file_that_grows_while_it_is_removed_stays(tmp_path):
    put(tmp_path / "a.jsonl", "one\n")
    files = tails.Files(str(tmp_path), "*.jsonl")
    name = next(iter(files.listed()))
    put(tmp_path / "a.jsonl", "two\n")
    assert not files.remove_if(name, 4) and (tmp_path / "a.jsonl").read_text() == "one\ntwo\n"
    assert files.remove_if(name, 8) and not list(tmp_path.iterdir())


def test_stream_of_transcripts_sees_appended_lines(spark, tmp_path):
    said = lambda i: json.dumps({"type": "user", "uuid": f"u{i}", "timestamp": "2024-05-01T10:00:00Z", "message": {"content": f"turn {i}"}}) + "\n"
    put(tmp_path / "in" / "s.jsonl", said(0))
    for want in (1, 3):
        stream = transcripts.to_turns(transcripts.format_b(transcripts.lines(spark, str(tmp_path / "in"), stream=True)), "b")
        flows.capture(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"turn {i}" for i in range(want)]
        put(tmp_path / "in" / "s.jsonl", said(1) + said(2))


def test_device_logs_as_a_stream(spark, tmp_path):
    line = lambda i: json.dumps({"kind": "turn", "device": "d", "written_at": str(i), "record": {"turn_id": f"t{i}"}}) + "\n"
    got = []
    for i in range(3):
        put(tmp_path / "log" / "d.jsonl", line(i) + "{torn\n")
        stream = transcripts.device_log(spark, str(tmp_path / "log"), stream=True, checkpoint=str(tmp_path / "state"))
        stream.writeStream.foreachBatch(lambda batch, n: got.extend(r.id for r in batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == ["t0", "t1", "t2"]


def test_hub_pages_repeat_and_lose_nothing(spark, tmp_path):
    held = spark.createDataFrame([(i, f"line {i}") for i in range(1, 26) if i % 5], "seq long, line string")
    reader = lambda hub="one": HubReader(spark, lambda after: held, hub, str(tmp_path), page_rows=6)
    assert reader().cursor() == 0 and reader().page() and reader().cursor() == 7
    # a run that stopped before its page was complete: part files, no mark of completeness
    half = f"{reader().path}/after={7:020d}"
    held.filter("seq BETWEEN 8 AND 9").write.parquet(half)
    os.remove(half + "/_SUCCESS")
    assert reader().cursor() == 7
    got = reader().drain().orderBy("seq").collect()
    assert [r.seq for r in got] == [i for i in range(1, 26) if i % 5]
    assert not reader().page() and reader("two").cursor() == 0
    assert HubReader(spark, lambda after: held.limit(0), "none", str(tmp_path)).drain().count() == 0


def test_hub_in_a_database(spark, tmp_path):
    # Derby comes with Spark
    url = f"jdbc:derby:{tmp_path}/hub;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(1, 11)], "seq long, line string")
    rows.write.format("jdbc").options(url=url, dbtable="sharing", createTableColumnTypes="line VARCHAR(100)", **options).save()
    reader = HubReader(spark, jdbc_rows(spark, url, "sharing", **options), "derby", str(tmp_path / "pages"), page_rows=4)
    assert [r.line for r in reader.drain().orderBy("seq").collect()] == [f"line {i}" for i in range(1, 11)]
    assert len(reader.pages()) == 3
    plan = jdbc_rows(spark, url, "sharing", **options)(5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(seq), *GreaterThan(seq,5)]" in plan.replace("SEQ", "seq") or "GreaterThan" in plan


def test_outbox_rows_that_arrive_while_sending_wait(spark, tmp_path):
    box, sent = str(tmp_path / "box"), str(tmp_path / "sent")
    add = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "id string, written_at string").write.mode("append").parquet(box)
    outbox = lambda: spark.read.schema("id string, written_at string").parquet(box)
    got = []

    def send(rows):
        add("late")
        got.append([r.id for r in rows.collect()])

    add("b", "a")
    assert flows.drain_outbox(outbox(), send, sent) == 2 and got == [["a", "b"]]
    assert flows.drain_outbox(outbox(), lambda rows: got.append([r.id for r in rows.collect()]), sent) == 1 and got[1] == ["late"]
    assert flows.drain_outbox(outbox(), send, sent) == 0

    def broken(rows):
        raise OSError("away")

    add("c")
    with pytest.raises(OSError):
        flows.drain_outbox(outbox(), broken, sent)
    assert flows.drain_outbox(outbox(), lambda rows: got.append([r.id for r in rows.collect()]), sent) == 1 and got[2] == ["c"]


def service_of(spark, tmp_path, broken):
    landed = {"good": [], "bad": []}

    def land(name):
        def keep(batch, n):
            rows = [r.value for r in batch.collect()]
            if name == "bad" and broken:
                raise RuntimeError("the source is broken")
            landed[name] += rows

        return keep

    sources = [Source(name, lambda name=name: tails.tail(spark, str(tmp_path / name)), land(name), every=0.2) for name in ("bad", "good")]
    return Service(spark, sources, "file://" + str(tmp_path / "service"), retry=0.2), landed


def test_one_broken_source_leaves_the_others(spark, tmp_path):
    broken = [True]
    service, landed = service_of(spark, tmp_path, broken)
    for name in ("good", "bad"):
        put(tmp_path / name / "x.jsonl", "1\n")
    found = service.run_once()
    assert found["status"] == "CAPTURE_ERRORS" and landed == {"good": ["1"], "bad": []}
    assert "broken" in found["sources"]["bad"]["error"] and found["sources"]["good"]["error"] is None and found["sources"]["good"]["rows"] == 1
    assert json.loads((tmp_path / "service" / "status.json").read_text()) == found
    broken.clear()
    put(tmp_path / "good" / "x.jsonl", "2\n")
    assert service.run_once()["status"] == "CAPTURE_OK" and landed == {"good": ["1", "2"], "bad": ["1"]}


def test_service_restarts_what_failed(spark, tmp_path):
    broken = [True]
    service, landed = service_of(spark, tmp_path, broken)

    def until(done):
        end = time.time() + 60
        while not done():
            assert time.time() < end, service.status()
            service.tend()
            time.sleep(0.1)

    for name in ("good", "bad"):
        put(tmp_path / name / "x.jsonl", "1\n")
    service.start()
    try:
        until(lambda: landed["good"] == ["1"] and service.status()["sources"]["bad"]["failures"] >= 2)
        put(tmp_path / "good" / "x.jsonl", "2\n")
        until(lambda: landed["good"] == ["1", "2"])
        broken.clear()
        until(lambda: landed["bad"] == ["1"] and service.status()["status"] == "CAPTURE_OK")
        assert service.status()["sources"]["good"]["failures"] == 0
    finally:
        service.stop()


def test_names_of_sources_differ(spark, tmp_path):
    one = Source("x", lambda: None, lambda batch, n: None)
    with pytest.raises(ValueError):
        Service(spark, [one, one], str(tmp_path))
