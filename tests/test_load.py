"""Incremental loads against one load of everything."""

import os

import pytest
from pyspark.sql import functions as F

from borelog.streaming import load

FIRST = "document_id string, path string, sha256 string, text string"
REPORTS = {
    "a.txt": "Well: A-1\nDrilled ahead to 2000 m. Stuck pipe at 2100 m. Worked string free.\n",
    "b.txt": "Well: B-2\nLost circulation at 1500 m. Pumped LCM pill, losses cured.\n",
    "c.txt": "Well: A-1\nTook a kick at 2500 m. Circulated out the kick.\n",
}


def put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)


def tables(spark, store, steps):
    return {s.name: sorted(map(repr, store.read(s.name, s.schema).collect())) for s in [*steps]} | {"documents": sorted(map(repr, store.read("documents", FIRST).collect()))}



def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def loaded(spark, folder, store, steps, checkpoint, n=1000):
    q = load.run(spark, folder, store, steps, checkpoint, files_a_batch=n)
    q.awaitTermination(300)
    assert q.exception() is None


def test_two_loads_with_a_changed_file_give_the_tables_of_one(spark, tmp_path):
    steps, land = load.report_steps(), str(tmp_path / "landing")
    store = load.Store(spark, str(tmp_path / "store"), buckets=16)
    put(f"{land}/d1", REPORTS)
    loaded(spark, land, store, steps, str(tmp_path / "cp"))
    first = tables(spark, store, steps)
    hazards = {r["name"] for r in store.read("pages", steps[-1].schema).where("kind = 'problem'").collect()}
    assert {"stuck_pipe", "lost_circulation", "kick"} <= hazards
    kept = files(str(tmp_path / "store"))

    changed = {"b.txt": "Well: B-2\nStuck pipe at 1600 m. Sidetracked.\n", "d.txt": "Well: D-4\nLost circulation at 900 m.\n", "copy-of-a.txt": REPORTS["a.txt"]}
    put(f"{land}/d2", changed)
    loaded(spark, land, store, steps, str(tmp_path / "cp"))
    second = tables(spark, store, steps)
    assert second != first and len(second["documents"]) == 4  # a copy of a loaded text is not loaded
    now = files(str(tmp_path / "store"))
    for name in ("documents", "passages", "events"):
        same = [p for p in kept if f"/{name}/" in p and now.get(p) == kept[p]]
        assert same, name  # buckets without a changed document keep their files

    whole = load.Store(spark, str(tmp_path / "whole"), buckets=16)
    rows = [(n, t) for n, t in (REPORTS | {k: v for k, v in changed.items() if k != "copy-of-a.txt"}).items()]
    batch = spark.createDataFrame([(p, t) for p, t in rows], "path string, text string").select("path", F.current_timestamp().alias("landed"), F.sha2("text", 256).alias("sha256"), "text")
    load.take(whole, "documents", batch, steps)
    assert tables(spark, whole, steps) == second
    assert {r["name"] for r in whole.read("pages", steps[-1].schema).where("kind = 'well'").collect()} == {"A-1", "B-2", "D-4"}

    before = files(str(tmp_path / "store"))
    assert load.take(store, "documents", batch, steps) == {"documents": 0}  # played again
    assert files(str(tmp_path / "store")) == before


def test_batches_of_any_size_and_a_broken_batch(spark, tmp_path):
    steps, land = load.report_steps(), str(tmp_path / "landing")
    put(f"{land}/d1", REPORTS)
    one, each = (load.Store(spark, str(tmp_path / n), buckets=4) for n in ("one", "each"))
    loaded(spark, land, one, steps, str(tmp_path / "cp1"))
    loaded(spark, land, each, steps, str(tmp_path / "cp2"), n=1)
    assert tables(spark, one, steps) == tables(spark, each, steps)

    class Broken(load.Store):
        def replace(self, name, *rest):
            if name == "events":
                raise RuntimeError("lost")
            return super().replace(name, *rest)

    rows = spark.createDataFrame([("a.txt", "Well: A-1\nStuck pipe at 2222 m.\n")], "path string, text string").select("path", F.current_timestamp().alias("landed"), F.sha2("text", 256).alias("sha256"), "text")
    with pytest.raises(RuntimeError, match="lost"):
        load.take(Broken(spark, str(tmp_path / "one"), buckets=4), "documents", rows, steps)
    load.take(load.Store(spark, str(tmp_path / "one"), buckets=4), "documents", rows, steps)  # the same batch again
    load.take(each, "documents", rows, steps)
    assert tables(spark, one, steps) == tables(spark, each, steps)


def test_a_unit_that_loses_all_its_rows(spark, tmp_path):
    steps = load.report_steps()
    store = load.Store(spark, str(tmp_path / "store"), buckets=1)
    row = lambda t: spark.createDataFrame([("p", t)], "path string, text string").select("path", F.current_timestamp().alias("landed"), F.sha2("text", 256).alias("sha256"), "text")
    load.take(store, "documents", row("Well: A\nStuck pipe at 100 m."), steps)
    assert store.read("pages", steps[-1].schema).count() == 2
    load.take(store, "documents", row("Well: A\nNothing to tell."), steps)
    assert store.read("pages", steps[-1].schema).count() == 0 == store.read("events", steps[1].schema).count()
    assert store.read("documents", FIRST).count() == 1
