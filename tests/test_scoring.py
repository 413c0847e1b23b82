"""Scoring that is taken up again: which prompts are called, and when."""

import os
import threading
import time

import pytest

from tidelog.operators import scoring

PROMPTS = "file string, chunk_id long, line_count long, prompt string"


@pytest.fixture
def calls(tmp_path):
    """A scorer that notes every call in a file, and what was called so far."""
    folder = str(tmp_path / "calls")
    os.mkdir(folder)

    def make(broken=()):
        def start():
            def score(prompt):
                with open(os.path.join(folder, f"{os.getpid()}-{threading.get_ident()}"), "a") as file:
                    file.write(prompt + "\n")
                if prompt in broken:
                    raise RuntimeError(f"no answer to {prompt}")
                return prompt.upper(), len(prompt)

            return score

        return start

    def seen():
        found = []
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            with open(path) as file:
                found += file.read().split()
            os.truncate(path, 0)
        return sorted(found)

    return make, seen


def prompts(spark, names):
    return spark.createDataFrame([("f", i, 1, name) for i, name in enumerate(names)], PROMPTS)


def test_only_what_has_no_answer_is_called(spark, tmp_path, calls):
    make, seen = calls
    path, names = str(tmp_path / "answers"), [f"p{i}" for i in range(30)]
    first = scoring.infer_resumable(prompts(spark, names[:20]), make(broken={"p3", "p7"}), path, wave_prompts=6, attempts=2, wait=0.0)
    rows = {r.chunk_id: (r.response, r.tokens_used, r.success, r.error) for r in first.collect()}
    assert rows[4] == ("P4", 2, True, None) and rows[3] == (None, 0, False, "no answer to p3") and len(rows) == 20
    assert seen() == sorted([*names[:20], "p3", "p7"])
    second = scoring.infer_resumable(prompts(spark, names), make(), path, wave_prompts=6, attempts=2, wait=0.0)
    assert {r.response for r in second.collect()} == {name.upper() for name in names}
    assert seen() == sorted(["p3", "p7", *names[20:]])
    assert scoring.infer_resumable(prompts(spark, names), make(), path).count() == 30 and seen() == []


def test_a_run_that_dies_keeps_the_waves_before(spark, tmp_path, calls):
    make, seen = calls
    path, names = str(tmp_path / "answers"), [f"p{i}" for i in range(40)]

    def deadly():
        inner = make()()

        def score(prompt):
            if prompt == "p11":
                raise SystemExit("the worker is gone")
            return inner(prompt)

        return score

    with pytest.raises(Exception):  # noqa: B017
        scoring.infer_resumable(prompts(spark, names), deadly, path, wave_prompts=4, attempts=1)
    seen()
    kept = {r.prompt_hash for r in scoring.read_answers(spark, path).collect()} if os.path.exists(path) else set()
    scoring.infer_resumable(prompts(spark, names), make(), path, wave_prompts=4)
    called = seen()
    assert len(called) == 40 - len(kept) and "p11" in called
    assert scoring.read_answers(spark, path).count() == 40


def test_equal_prompts_are_one_call(spark, tmp_path, calls):
    make, seen = calls
    found = scoring.infer_resumable(prompts(spark, ["same"] * 50 + ["other"]), make(), str(tmp_path / "answers"))
    assert found.count() == 51 and seen() == ["other", "same"]


def test_calls_in_flight_are_bounded(spark):
    def start():
        state = {"now": 0, "most": 0}
        lock = threading.Lock()

        def score(prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.02)
            with lock:
                state["now"] -= 1
            return str(state["most"]), 0

        return score

    frame = prompts(spark, [f"p{i}" for i in range(30)]).coalesce(1).withColumn("prompt_hash", scoring.prompt_hash())
    most = [int(r.response) for r in scoring.called(frame, start, in_flight=3).collect()]
    assert max(most) == 3


def test_a_client_that_cannot_be_made(spark, tmp_path):
    def start():
        raise OSError("no key")

    (row,) = scoring.infer_resumable(prompts(spark, ["a"]), start, str(tmp_path / "answers")).collect()
    assert not row.success and row.error == "scorer initialization failed: no key"
    assert scoring.infer_resumable(prompts(spark, ["a"]).limit(0), start, str(tmp_path / "none")).count() == 0
