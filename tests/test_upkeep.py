"""The deletion journal, repaired deletions, skipped folders, chains that wait, groups in a window."""

import datetime

from pyspark.sql import functions as F

from evidentia.operators import forget_jobs, history, sharing
from evidentia.plans import typed
from evidentia.sources import transcripts


def test_deletions_are_tried_until_they_are_done(spark, tmp_path):
    now, told, broken = [1000.0], [], {"send", "scrub"}
    journal = forget_jobs.Journal(spark, "file://" + str(tmp_path / "jobs"), clock=lambda: now[0])
    ids = spark.createDataFrame([("turn", "a"), ("turn", "b"), ("turn", "a")], "kind string, id string")

    def send(destination, rows):
        if "send" in broken and destination == "hub":
            raise OSError("away")
        told.append((destination, sorted(r.id for r in rows.collect())))

    def scrub(destination, rows):
        if "scrub" in broken and destination == "hub":
            raise ValueError("held")
        return rows.count()

    job = journal.accept(ids, "hub")
    assert journal.accept(ids.orderBy(F.desc("id")), "hub") == job and len(journal.jobs()) == 1
    journal.accept(ids, "folder")
    assert journal.retry(send, scrub) == {"scrubbed": 2, "pending": 1} and told == [("folder", ["a", "b"])]
    entry = journal.jobs()[job]
    assert (entry["attempts"], entry["error"], entry["sent"], entry["due"]) == (1, "OSError", False, 1060.0)
    assert journal.retry(send, scrub, wait=True)["pending"] == 1 and journal.jobs()[job]["attempts"] == 1  # not due yet
    broken.discard("send")
    now[0] = 1061.0
    journal.retry(send, scrub, wait=True)
    assert journal.jobs()[job]["sent"] and journal.jobs()[job]["attempts"] == 2 and journal.jobs()[job]["due"] == 1061.0 + 120
    for _ in range(9):
        journal.retry(send, scrub)
    assert journal.jobs()[job]["due"] == 1061.0 + 3600 and told.count(("hub", ["a", "b"])) == 1
    again = forget_jobs.Journal(spark, "file://" + str(tmp_path / "jobs"))  # another process goes on
    broken.clear()
    assert again.retry(send, scrub, destination="elsewhere") == {"scrubbed": 0, "pending": 0}
    assert again.retry(send, scrub) == {"scrubbed": 2, "pending": 0} and told.count(("hub", ["a", "b"])) == 1


def test_scrubbed_lines_keep_what_tells_of_deletions(spark):
    lines = spark.createDataFrame([("turn", "a", 1), ("forget", "a", 2), ("turn", "b", 3)], "kind string, id string, n int")
    left, n = forget_jobs.scrub_lines(lines, spark.createDataFrame([("turn", "a")], "kind string, id string"))
    assert n == 1 and sorted(r.n for r in left.collect()) == [2, 3]


def test_false_deletions_leave_with_their_symbols(spark):
    rows = [(1, "p", "kept.py", "DELETED", 1), (2, "p", "made_again.py", "DELETED", 2), (3, "p", "made_again.py", "ADDED", 3), (4, "p", "gone.py", "DELETED", 4), (5, "q", "kept.py", "DELETED", 5)]
    changes = spark.createDataFrame(rows, "change_id long, project_id string, file_path string, change_kind string, revision long")
    present = spark.createDataFrame([("p", "kept.py"), ("p", "made_again.py")], "project_id string, file_path string")
    symbols = spark.createDataFrame([(1, "f"), (4, "g")], "change_id long, name string")
    left, names = history.repaired(changes, present, symbols)
    assert sorted(r.change_id for r in left.collect()) == [2, 3, 4, 5] and [r.name for r in names.collect()] == ["g"]


def test_documents_of_tools_and_hidden_folders_are_skipped(spark, tmp_path):
    for name in ("a.md", "deep/b.txt", "node_modules/c.md", "deep/.git/d.md", "dist/x/e.md", ".hidden.md", "distance/f.rst"):
        (tmp_path / ".home" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / ".home" / name).write_text("text")
    for root in (str(tmp_path / ".home"), "file://" + str(tmp_path / ".home") + "/"):
        got = {r.path.rsplit(".home/", 1)[1] for r in transcripts.documents(spark, root).collect()}
        assert got - {".hidden.md"} == {"a.md", "deep/b.txt", "distance/f.rst"}


def test_long_chains_wait_or_land(spark):
    rows = [(f"x{i}", f"x{i - 1}") for i in range(1, 9)] + [("x0", "missing")] + [(f"y{i}", f"y{i - 1}") for i in range(1, 5)] + [("y0", "known"), ("z", None)]
    landed, waiting = sharing.land_pending(spark.createDataFrame(rows, "id string, supersedes string"), spark.createDataFrame([("known",)], "id string"))
    assert sorted(r.id for r in waiting.collect()) == [f"x{i}" for i in range(9)]
    assert sorted(r.id for r in landed.collect()) == [f"y{i}" for i in range(5)] + ["z"]


def test_largest_group_in_a_window(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    items = spark.createDataFrame([("g", "a", 5.0, day(1)), ("g", "b", 3.0, day(5)), ("g", "b", 1.0, day(9))], "g string, label string, amount double, at timestamp_ntz")
    win = lambda **w: tuple(typed.largest_group(items, ["g"], "label", "amount", **w).first())
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    assert win() == ("g", "a", 5.0) and win(time="at", since=at(2)) == ("g", "b", 4.0) and win(time="at", since=at(2), until=at(9)) == ("g", "b", 3.0)
