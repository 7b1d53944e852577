"""Reading page by page: what a killed batch had done stays, and pages that fail, die or hang are set aside."""

import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ledgerloom.streaming import queue


def put(folder, name, texts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps({"text": t}) + "\n" for t in texts)


def pages_of(docs):
    """A line is a page."""
    return docs.select("sha", F.posexplode(F.split("text", "\n")).alias("page", "body")).withColumn("page", F.col("page") + 1)


def text(name, n):
    return "\n".join(f"{name} {i}" for i in range(1, n + 1))


def reader(log):
    """Notes each page that it is given, in a file of its own."""

    def read(body: str) -> str:
        with open(f"{log}/{body.replace(' ', '-')}-{time.time_ns()}-{os.getpid()}", "w"):
            pass
        if body == "poison 3":
            raise ValueError("no such page")
        if body == "poison 4":
            os._exit(9)
        if body == "poison 5":
            time.sleep(60)
        return body.upper()

    return read


def seen(log):
    return sorted(f.rsplit("-", 2)[0] for f in os.listdir(log))


@pytest.fixture
def places(tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), str(log)


def run(spark, places, **options):
    folder, out, check, log = places
    options = {"flush": 3, "seconds": 2.0} | options
    queue.run_pages(queue.file_stream(spark, folder), out, check, reader(log), pages_of, **options).awaitTermination()


def test_a_killed_batch_goes_on_behind_its_last_wave(spark, places, monkeypatch):
    folder, out, _, log = places
    put(folder, "a", [text("long", 7), text("short", 2), None])
    whole, calls = queue.read_wave, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed between pages")
        return whole(*args)

    monkeypatch.setattr(queue, "read_wave", killed)
    with pytest.raises(StreamingQueryException):
        run(spark, places)
    assert seen(log) == ["long-1", "long-2", "long-3", "short-1", "short-2"]
    state = {r.pages: (r.pages_done, r.status) for r in queue.states(spark, out).collect()}
    assert state == {7: (3, "processing"), 2: (2, "ready")}
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    monkeypatch.setattr(queue, "read_wave", whole)
    run(spark, places)
    assert seen(log) == [f"long-{i}" for i in (4, 5, 6, 7)]
    assert {(r.pages, r.pages_done, r.status) for r in queue.states(spark, out).collect()} == {(7, 7, "ready"), (2, 2, "ready")}
    assert sorted(r.text for r in queue.read_pages(spark, out).collect()) == sorted(text("LONG", 7).split("\n") + text("SHORT", 2).split("\n"))


def test_pages_that_fail_three_times_are_set_aside(spark, places):
    folder, out, _, log = places
    put(folder, "a", [text("poison", 6), text("fine", 4)])
    run(spark, places)
    letters = {r.page: (r.attempts, r.error) for r in queue.dead_letters(spark, out).collect()}
    assert letters == {3: (3, "ValueError: no such page"), 4: (3, "the reader died"), 5: (3, "no answer in 2 s")}
    assert [seen(log).count(f"poison-{i}") for i in range(1, 7)] == [1, 1, 3, 3, 3, 1]
    assert {(r.pages, r.pages_done, tuple(r.skipped), r.status) for r in queue.states(spark, out).collect()} == {(6, 3, (3, 4, 5), "ready"), (4, 4, (), "ready")}
    # the same contents and a new one: only that is read
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    put(folder, "b", [text("poison", 6), text("new", 1)])
    run(spark, places)
    assert seen(log) == ["new-1"]


def test_virtual_pages_and_nothing_to_read(spark, places):
    folder, out, check, log = places
    put(folder, "a", [None, "one page"])
    queue.run_pages(queue.file_stream(spark, folder), out, check, reader(log), seconds=2.0).awaitTermination()
    assert [r.text.strip() for r in queue.read_pages(spark, out).collect()] == ["ONE PAGE"]
    assert queue.dead_letters(spark, out).count() == 0
