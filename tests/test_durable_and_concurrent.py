"""Steps that survive a stop, calls in flight, programs that hang."""

import time

import pytest
from pyspark.sql import functions as F

from mathgrade.operators import inference as INF
from mathgrade.streaming import checkpointed as CK


def _counting(calls, fail_at=None):
    """A model call per row, noted in a folder; ``work`` of a step fails after its calls if ``fail_at`` says so."""
    def factory():
        def fn(prompts, n):
            for p in prompts:
                with open(f"{calls}/{p}", "a") as f:
                    f.write("x")
            return [[f"answer {p}"] * n for p in prompts]
        return fn

    done = []

    def work(rows):
        out = INF.generate(rows, "id", "prompt", 1, factory)
        done.append(1)
        if fail_at is not None and len(done) > fail_at:
            raise RuntimeError("the driver stops")
        return out
    return work


def _prompts(spark, n):
    return spark.range(n).withColumn("prompt", F.col("id").cast("string"))


def _calls(folder):
    return {int(p.name): len(p.read_text()) for p in folder.iterdir()}


def test_a_model_is_called_once_a_row(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    out = CK.write_in_steps(_prompts(spark, 40), "id", str(tmp_path / "out"), 8, "r", _counting(calls))
    assert out.count() == 40 and out.select("step").distinct().count() == 5
    assert _calls(calls) == dict.fromkeys(range(40), 1)
    out = CK.write_in_steps(_prompts(spark, 43), "id", str(tmp_path / "out"), 8, "r", _counting(calls))
    assert sorted(r.id for r in out.collect()) == list(range(43)) and _calls(calls) == dict.fromkeys(range(43), 1)


def test_calls_inside_the_input_are_made_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    assert CK.write_in_steps(_counting(calls)(_prompts(spark, 40)), "id", str(tmp_path / "out"), 8, "r").count() == 40
    assert _calls(calls) == dict.fromkeys(range(40), 1)


def test_a_stopped_run_keeps_its_steps_and_resumes(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "out")
    calls.mkdir()
    with pytest.raises(RuntimeError, match="the driver stops"):
        CK.write_in_steps(_prompts(spark, 60), "id", path, 10, "r", _counting(calls, fail_at=3))
    kept = CK.committed(spark, path)
    assert sorted({r.step for r in kept.select("step").collect()}) == [0, 1, 2]
    before = kept.count()
    assert 0 < before < 60 and len(_calls(calls)) == before
    out = CK.write_in_steps(_prompts(spark, 60), "id", path, 10, "r", _counting(calls))
    assert sorted(r.id for r in out.collect()) == list(range(60)) and _calls(calls) == dict.fromkeys(range(60), 1)
    sizes = {r.step: r.rows for r in CK.manifest(spark, path).collect()}
    assert sum(sizes.values()) == 60 and len(sizes) == 6


def test_a_half_written_step_is_replaced(spark, tmp_path):
    """Rows of a step without a manifest entry don't count, and a replay replaces them."""
    path = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        CK.write_in_steps(_prompts(spark, 20), "id", path, 10, "r", _failing_second())
    spark.range(100, 103).withColumn("prompt", F.lit("stray")).write.parquet(f"{path}/run_id=r/step=1")
    assert CK.committed(spark, path).filter("id >= 100").count() == 0
    assert sorted(r.id for r in CK.write_in_steps(_prompts(spark, 20), "id", path, 10, "r").collect()) == list(range(20))


def _failing_second():
    seen = []

    def work(rows):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("stop")
        return rows
    return work


def test_empty_input(spark, tmp_path):
    path = str(tmp_path / "out")
    assert CK.write_in_steps(_prompts(spark, 0), "id", path, 10, "r").count() == 0
    assert CK.write_in_steps(_prompts(spark, 3), "id", path, 10, "r").count() == 3


def test_stream_stops_and_resumes(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    _prompts(spark, 30).repartition(6).write.parquet(src)
    schema = _prompts(spark, 1).schema
    seen = []

    def failing(batch):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("stop")
        return batch.withColumn("answer", F.upper("prompt"))
    with pytest.raises(Exception, match="stop"):
        CK.stream_new_results(spark, src, schema, failing, path, "s", files_per_step=2)
    assert sorted(r.step for r in CK.manifest(spark, path).collect()) == [0, 1]
    seen.extend([1] * 10)
    out = CK.stream_new_results(spark, src, schema, failing, path, "s", files_per_step=2)
    assert sorted(r.id for r in out.collect()) == list(range(30))
    _prompts(spark, 35).filter("id >= 30").coalesce(1).write.mode("append").parquet(src)
    out = CK.stream_new_results(spark, src, schema, failing, path, "s", files_per_step=2)
    assert sorted(r.id for r in out.collect()) == list(range(35)) and len(seen) == 13 + 1 + 1


def test_calls_in_flight_are_bounded_ordered_and_faster(spark):
    def factory():
        import threading
        lock, now, most = threading.Lock(), [0], [0]

        def fn(prompts, n):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.1)
            with lock:
                now[0] -= 1
            return [[f"{p} {most[0]}"] * n for p in prompts]
        return fn
    df = _prompts(spark, 40).coalesce(1)
    took, rows = {}, {}
    for in_flight in (1, 8):
        begin = time.time()
        rows[in_flight] = INF.generate(df, "id", "prompt", 1, factory, batch_size=1, in_flight=in_flight).collect()
        took[in_flight] = time.time() - begin
    assert [r.id for r in rows[8]] == list(range(40)) == [r.id for r in rows[1]]
    most = max(int(r.completion.split()[1]) for r in rows[8])
    assert 4 <= most <= 8 and max(int(r.completion.split()[1]) for r in rows[1]) == 1
    assert took[8] < took[1] - 2  # 40 calls of 0.1 s: 4 s one by one, about 0.5 s in flight


def test_back_pressure_of_calls():
    taken = []

    def calls():
        for i in range(20):
            taken.append(i)
            yield lambda i=i: i
    out = INF.in_order(calls(), 4)
    assert next(out) == 0 and len(taken) <= 5
    assert list(out) == list(range(1, 20))


def test_programs_that_hang_or_die(spark):
    def factory():
        import os

        def run(code, timeout):
            if code == "hang":
                time.sleep(60)
            if code == "die":
                os._exit(3)
            if code == "fail":
                raise ValueError("no")
            return code.upper()
        return run
    codes = ["a", "hang", "b", None, "die", "c", "fail", "d"]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code string").coalesce(1)
    begin = time.time()
    got = {r.id: (r.program_output, r.run_error) for r in INF.run_programs(df, "code", factory, timeout=1.0).collect()}
    assert time.time() - begin < 30
    assert [got[i][0] for i in range(8)] == ["A", None, "B", None, None, "C", None, "D"]
    assert got[1][1].startswith("TimeoutError") and got[4][1].startswith("RuntimeError") and got[6][1] == "ValueError: no" and got[3][1] is None


def _noted(folder, factory):
    """The stub, noting each prompt it is sent."""
    def build():
        import uuid
        inner = factory()

        def fn(prompts, n):
            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            return inner(prompts, n)
        return fn
    return build


def _prompts_sent(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_augmentation_goes_on_after_its_driver_is_lost(spark, tmp_path, monkeypatch):
    """Stopped in the solver's second step of level 2 and called again: no prompt is sent twice, and the result is that
    of an undisturbed run."""
    from mathgrade.plans import augment as AU
    from mathgrade.plans import stubs
    src = spark.createDataFrame([(i, f"text {'x' * i}") for i in range(12)], "item_id long, text string")
    commit, results = CK._commit, {}
    for name, stop_at in (("whole", None), ("stopped", 11)):
        ask, solve = tmp_path / f"{name}-ask", tmp_path / f"{name}-solve"
        ask.mkdir()
        solve.mkdir()
        run = lambda: AU.augment_chain(
            spark, src, "item_id", "text", levels=2, samples=3, augmenter_factory=_noted(ask, stubs.augmenter_factory),  # noqa: B023
            runner_factory=stubs.print_runner_factory, solver_factory=_noted(solve, stubs.solver_factory),  # noqa: B023
            novelty_samples=2, path=str(tmp_path / name), every_n=5)  # noqa: B023
        if stop_at is not None:
            seen = []

            def lost(*args):
                seen.append(1)
                if len(seen) > stop_at:  # noqa: B023
                    raise RuntimeError("driver lost")
                return commit(*args)
            monkeypatch.setattr(CK, "_commit", lost)
            with pytest.raises(RuntimeError, match="driver lost"):
                run()
            monkeypatch.setattr(CK, "_commit", commit)
            before = len(_prompts_sent(ask)), len(_prompts_sent(solve))
            assert before[0] > 12 and 0 < before[1]
        best, every = run()
        results[name] = sorted(map(tuple, best.collect())), every.count(), _prompts_sent(ask), _prompts_sent(solve)
    assert results["whole"] == results["stopped"]
    assert len(results["whole"][2]) == 24 and len(set(results["whole"][2])) == 24


def test_feedback_loop_goes_on(spark, tmp_path, monkeypatch):
    from mathgrade.plans import augment as AU
    from mathgrade.plans import stubs
    src = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "item_id long, text string")
    asked = tmp_path / "asked"
    asked.mkdir()
    run = lambda: AU.feedback_loop(src, "item_id", "text", 3, _noted(asked, stubs.tagged_augmenter_factory), stubs.print_runner_factory,
                                   stubs.solver_factory, path=str(tmp_path / "loop"))
    commit, seen = CK._commit, []

    def lost(*args):
        seen.append(1)
        if len(seen) > 3:
            raise RuntimeError("driver lost")
        return commit(*args)
    monkeypatch.setattr(CK, "_commit", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        run()
    monkeypatch.setattr(CK, "_commit", commit)
    rows = run().collect()
    assert len(rows) == 4 and all(len(r.messages) == 7 for r in rows)
    sent = _prompts_sent(asked)
    assert len(sent) == 12 == len(set(sent))
