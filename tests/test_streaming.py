import datetime as dt
import time

from pyspark.sql import functions as F

from borelog.streaming import detector, live

COLS = "well_id long, t timestamp, torque double, spp double, hookload double, pit_vol double, flow_in double"


def rows(n=80, step_at=60):
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        wobble = (i * 7 % 5) / 10
        out.append((1, start + dt.timedelta(seconds=5 * i), 10 + wobble + (50 if i >= step_at else 0), 100 + wobble, 50 + wobble, 200 + wobble - (5 * (i - step_at) if i >= step_at else 0), 500.0))
    return out


def test_batch_finds_torque_and_losses(spark):
    found = detector.detect_batch(spark.createDataFrame(rows(), COLS)).orderBy("t").collect()
    assert any("torque" in r["channels"] for r in found) and any(r["signal"] == "possible_losses" for r in found)
    assert min(r["t"] for r in found if "torque" in r["channels"]) >= dt.datetime(2024, 1, 1) + dt.timedelta(seconds=300)


def test_no_circulation_no_evaluation(spark):
    still = [(*r[:6], 10.0) for r in rows()]
    assert detector.detect_batch(spark.createDataFrame(still, COLS)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    data = spark.createDataFrame(rows(), COLS)
    for k in range(4):  # four files in order of time: state is carried between batches
        part = data.where((F.unix_timestamp("t") - F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01")))).between(k * 100, k * 100 + 99))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = detector.detect(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    live = sorted((r["t"], tuple(r["channels"]), r["signal"]) for r in spark.table("found").where("not stale").collect())
    assert live == sorted((r["t"], tuple(r["channels"]), r["signal"]) for r in detector.detect_batch(data).collect())


def by_definition(rows, limits):
    """The detector sample by sample."""
    import statistics

    def z(held, v):
        if len(held) < limits.least:
            return None
        m = statistics.median(held)
        d = 1.4826 * statistics.median([abs(x - m) for x in held])
        return (v - m) / d if d > 1e-9 else None

    names = [*detector.CHANNELS]
    held, runs, last, low, high, out = {k: [] for k in [*names, "pit"]}, dict.fromkeys(names, 0), None, 0.0, 0.0, []
    for r in rows:
        pit, last, before = r["pit_vol"], r["pit_vol"] if r["pit_vol"] is not None else last, last
        if (r["flow_in"] or 0) < limits.min_flow:
            runs = dict.fromkeys(names, 0)
            continue
        told, signal = [], None
        for k in names:
            if r[k] is not None:
                score = z(held[k][-limits.held :], r[k])
                if score is not None:
                    runs[k] = runs[k] + 1 if abs(score) >= limits.far else 0
                    told += [k] * (runs[k] >= limits.persist)
                held[k].append(r[k])
        if pit is not None and before is not None:
            tail = held["pit"][-limits.held :]
            if len(tail) >= limits.least:
                score = z(tail, pit - before)
                score = (pit - before - statistics.median(tail)) / 1e-6 if score is None else score
                low, high = max(0, low - score - limits.slack), max(0, high + score - limits.slack)
                if low > limits.alarm:
                    low, signal = 0.0, "possible_losses"
                elif high > limits.alarm:
                    high, signal = 0.0, "possible_influx"
            held["pit"].append(pit - before)
        if told or signal:
            out.append((r["t"], (*told, *["pit_vol"] * bool(signal)), signal))
    return out


def test_detector_against_its_definition(spark):
    import random

    limits = detector.Limits(held=12, least=5, far=2.5, persist=2)
    for seed in range(40):
        rng = random.Random(seed)
        t = dt.datetime(2024, 1, 1)
        got = []
        for i in range(200):
            some = lambda v: None if rng.random() < 0.1 else v
            far = rng.choice([0, 0, 0, 30])
            got.append({"well_id": 1, "t": t + dt.timedelta(seconds=i), "torque": some(rng.gauss(10, 1) + far), "spp": some(rng.gauss(5, 1)), "hookload": some(7.0 if seed % 4 == 0 else rng.gauss(7, 1)),
                        "pit_vol": some(50.0 if seed % 5 == 0 and i < 90 else rng.gauss(50, 2)), "flow_in": some(0.0 if rng.random() < 0.1 else 500.0)})
        frame, state, found = detector.pd.DataFrame(got), None, []
        for a, z in ((0, 3), (3, 70), (70, 71), (71, 200)):
            out, state = detector.judge(frame.iloc[a:z], state, limits)
            found += [(r.t.to_pydatetime(), tuple(r.channels), r.signal) for r in out.itertuples()]
        assert found == by_definition(got, limits)


def test_look_ahead_and_cool_down(spark):
    layers = spark.createDataFrame([(1, "A", 100.0, 200.0, "kick", 0.5, "ok", 3), (1, "B", 200.0, 300.0, "kick", 0.1, "ok", 1), (1, "C", 900.0, 950.0, "kick", 0.9, "ok", 9)], "well_id long, formation string, top double, base double, hazard string, mean double, status string, n_with int")
    t = dt.datetime(2024, 1, 1)
    samples = spark.createDataFrame([(1, t + dt.timedelta(seconds=30 * i), 120.0 + i) for i in range(6)], "well_id long, t timestamp, md_m double")
    found = detector.look_ahead(samples, layers)
    assert {(r["formation"], r["level"]) for r in found.collect()} == {("A", "alert"), ("B", "notice")}
    kept = live.cool_down(found.where("formation = 'A'")).collect()
    assert sorted(r["t"] for r in kept) == [t, t + dt.timedelta(seconds=120)]


def test_only_moves_are_assessed_again(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=i), md) for i, md in enumerate([100.0, 100.5, 101.0, 101.5, None, 99.0])]
    found = detector.moved(spark.createDataFrame(rows, "well_id long, t timestamp, md_m double")).orderBy("t").collect()
    assert [r["md_m"] for r in found] == [100.0, 101.0, 99.0]


def stream_of(spark, data, cuts, folder):
    """``data`` as files cut at the given times, read one a batch."""
    for k, (a, z) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = data.where((F.lit(True) if a is None else F.col("t") >= F.lit(a)) & (F.lit(True) if z is None else F.col("t") < F.lit(z)))
        part.coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def live_rows(seed, n=160):
    import random

    rng, out = random.Random(seed), []
    for well in (1, 2):
        t, md = dt.datetime(2024, 1, 1), 100.0
        for i in range(n):
            t += dt.timedelta(seconds=rng.choice([4, 5, 6]) if well == 1 else 20)
            md += rng.choice([0, 0.2, 0.7, 1.5])
            burst = 40 if 90 <= i < 99 else 0
            out.append((well, t, None if rng.random() < 0.05 else md, 10 + rng.random() + burst, 100 + rng.random(), 50 + rng.random(), 200 + rng.random() - (6 * (i - 120) if i > 120 else 0), 500.0 if rng.random() < 0.9 else 0.0))
    return out


def drained(q, n):
    """Runs a query until it has read ``n`` rows, a minute and a half at most: state with a time to live goes on with empty batches."""
    read, end = {}, time.time() + 90
    while sum(read.values()) < n and q.isActive and time.time() < end:
        time.sleep(0.3)
        read.update({p["batchId"]: p["numInputRows"] for p in q.recentProgress})
    failed = q.exception()
    q.stop()
    assert failed is None and sum(read.values()) == n


LIVE = "well_id long, t timestamp, md_m double, torque double, spp double, hookload double, pit_vol double, flow_in double"
LAYERS = "well_id long, formation string, top double, base double, hazard string, mean double, status string, n_with long"


def test_live_alerts_do_not_depend_on_the_cuts(spark, tmp_path):
    data = spark.createDataFrame(live_rows(1), LIVE).cache()
    layers = spark.createDataFrame([(w, f, top, top + 60, h, m, "ok", n) for w in (1, 2) for f, top in (("A", 90.0), ("B", 150.0), ("C", 400.0)) for h, m, n in (("torque_spike", 0.2, 1), ("lost_circulation", 0.5, 3), ("kick", 0.1, 0))], LAYERS)
    limits = detector.Limits(least=20, far=3.0, persist=2)
    key = lambda r: (r["well_id"], r["t"], r["formation"], r["hazard"], r["level"])
    wanted = sorted(map(key, live.alerts_batch(data, layers, limits).collect()))
    assert {k[4] for k in wanted} == {"alert", "notice", "escalated"}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, seconds in (("one", []), ("some", [37, 300, 301, 650]), ("early", [9, 30])):
            cuts = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in seconds]
            found = live.alerts(stream_of(spark, data, cuts, str(tmp_path / name)), layers, limits)
            drained(found.writeStream.format("memory").queryName(f"live_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start(), 320)
            assert sorted(map(key, spark.table(f"live_{name}").collect())) == wanted, name
        short = live.alerts(stream_of(spark, data, [dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 6)], str(tmp_path / "ttl")), layers, limits, seconds=1e9, kept_ms=1)
        drained(short.writeStream.format("memory").queryName("live_ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "ttl-cp")).start(), 320)
        told = [key(r) for r in spark.table("live_ttl").collect()]
        once = {(k[0], *k[2:]) for k in told}
        assert len(told) > len(once)  # what was told is forgotten after its time to live, so the store stays small
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        data.unpersist()


def test_watch_by_its_definition():
    """Batches of any size give the same; the look-back comes from the first samples' rate; the state stays small."""
    import json
    import random

    limits = detector.Limits(least=20, far=3.0, persist=2)
    for seed in range(12):
        frame = detector.pd.DataFrame([r for r in live_rows(seed) if r[0] == 1 + seed % 2], columns=[c.split(" ")[0] for c in LIVE.split(", ")])
        whole, end = live.watch(frame, None, limits)
        assert end["held"] == (max(20, int(300 / ((frame["t"][19] - frame["t"][0]).total_seconds() / 19))))
        rng, state, parts, at = random.Random(seed), None, [], 0
        while at < len(frame):
            step = rng.choice([1, 2, 19, 20, 21, 60])
            out, state = live.watch(frame.iloc[at : at + step], state and json.loads(json.dumps(state)), limits)
            parts.append(out)
            at += step
        assert detector.pd.concat(parts, ignore_index=True).to_dict("records") == whole.to_dict("records")
        assert max(map(len, state["judged"][0])) <= state["held"] and not state["first"]
        last, wanted = None, []
        odd = {(t, md) for t, md, c, s in zip(whole["t"], whole["md_m"], whole["channels"], whole["signal"], strict=True) if c or s}
        for t, md in zip(frame["t"], frame["md_m"], strict=True):
            if md == md and (last is None or abs(md - last) >= 1.0 or (t, md) in odd):
                wanted.append((t, md))
                last = md
        assert list(zip(whole["t"], whole["md_m"], strict=True)) == wanted
