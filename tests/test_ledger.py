"""Each distinct prompt is asked once: by failing tasks, second actions, other runs, and copies of a task."""

import sys
import threading
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomcorpus.ledger import Ledger, _Bucket, address, embedded_once, replies, with_replies
from loomcorpus.plans import evaluate
from loomcorpus.providers import HashEmbedder, extractive_answer, overlap_judge

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """A provider that notes every prompt it is asked, and fails hard at some while a file is there."""

    def __init__(self, folder, inner=str.upper, bad=None):
        self.log, self.trap, self.inner, self.bad = str(folder / "asked.log"), str(folder / "trap"), inner, bad

    def note(self, prompt):
        with open(self.log, "a") as f:
            f.write(prompt.replace("\n", " ")[:4000] + "\n")

    def __call__(self, prompt):
        import os

        if prompt == self.bad and os.path.exists(self.trap):
            os._exit(1)  # the worker dies
        self.note(prompt)
        return self.inner(prompt)

    def asked(self):
        try:
            with open(self.log) as f:
                return Counter(f.read().splitlines())
        except FileNotFoundError:
            return Counter()


def prompts(spark, n, copies=3):
    return spark.range(n * copies).select(F.concat(F.lit("prompt "), (F.col("id") % n).cast("string")).alias("prompt"))


def test_failing_task_and_second_action_ask_once(spark, tmp_path):
    call = Counting(tmp_path, bad="prompt 17")
    ledger = Ledger(str(tmp_path / "ledger"), buckets=3, lease=1.0, poll=0.1)
    ask = lambda: with_replies(prompts(spark, 40), call, ledger, "m", x=F.col("prompt")).collect()
    (tmp_path / "trap").touch()
    with pytest.raises(Exception):  # noqa: B017
        ask()
    before = call.asked()
    assert len(before) < 40 and not before["prompt 17"]
    (tmp_path / "trap").unlink()
    for _ in range(2):
        got = ask()
        assert len(got) == 120 and all(r["x_raw"] == r["prompt"].upper() and r["x_error"] is None for r in got)
    assert call.asked() == Counter({f"prompt {i}": 1 for i in range(40)})
    with_replies(prompts(spark, 41), call, ledger, "m", x=F.col("prompt")).collect()
    assert call.asked() == Counter({f"prompt {i}": 1 for i in range(41)})
    with_replies(prompts(spark, 1), call, ledger, "another model", x=F.col("prompt")).collect()
    assert call.asked()["prompt 0"] == 2


def test_errors_are_asked_again_and_nulls_never(spark, tmp_path):
    calls = Counting(tmp_path, inner=lambda p: 1 / 0 if p == "bad" else p)
    ledger = Ledger(f"file://{tmp_path}/ledger", buckets=2)
    df = spark.createDataFrame([(1, "bad"), (2, "fine"), (3, None)], "id int, prompt string")
    for n in (1, 2):
        got = {r["id"]: (r["a_raw"], r["a_error"], r["b_raw"]) for r in with_replies(df, calls, ledger, "m", a=F.col("prompt"), b=F.lit("same")).collect()}
        assert got[2] == ("fine", None, "same") and got[3] == (None, None, "same") and got[1][1].startswith("ZeroDivisionError")
        assert calls.asked()["bad"] == n and calls.asked()["same"] == 1


def test_torn_lines_and_dead_holders(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "ledger"), buckets=1, lease=0.5, poll=0.05)
    with _Bucket(ledger, 0) as b:
        b.note({"k": "v"})
    with open(tmp_path / "ledger/00000/torn.jsonl", "w") as f:
        f.write('["a", "b"]\n["half')
    dead = _Bucket(ledger, 0).__enter__()
    began = time.time()
    with _Bucket(ledger, 0) as b:
        assert b.noted() == {"k": "v", "a": "b"} and time.time() - began >= 0.4
    order, gate = [], threading.Event()
    longer = Ledger(ledger.path, 1, 30.0, 0.05)

    def hold(name):
        with _Bucket(longer, 0):
            order.append(f"{name} in")
            gate.set()
            time.sleep(0.3)
            order.append(f"{name} out")

    one = threading.Thread(target=hold, args=("first",))
    one.start()
    gate.wait()
    hold("second")
    one.join()
    assert order == ["first in", "first out", "second in", "second out"] and dead.holder


def test_evaluation_with_a_ledger(spark, tmp_path):
    questions = spark.createDataFrame([(str(i), "c", f"what is w{i % 3}?", ["a"], None, False, None) for i in range(6)], "id string, category string, question string, ground_truth_chunk_ids array<string>, reference_answer string, should_abstain boolean, notes string")
    texts = spark.createDataFrame([("a", "W0 is here. And w1."), ("b", "w2 stands there."), ("c", "w2 stands there.")], "chunk_id string, text string").withColumns({c: F.lit("x") for c in ("source_type", "source_name", "section_path", "original_path")})
    ledger = Ledger(str(tmp_path / "ledger"), buckets=2)
    for name in ("answers", "judge", "vectors"):
        (tmp_path / name).mkdir()
    answers, judge_, vectors = Counting(tmp_path / "answers", extractive_answer), Counting(tmp_path / "judge", overlap_judge), Counting(tmp_path / "vectors")

    def embedder(batch, input_type):
        for t in batch:
            vectors.note(t)
        return HashEmbedder()(batch, input_type)

    chunks = embedded_once(texts, embedder, ledger, "m")
    plain = evaluate.run(questions, chunks, 2, judge_call=overlap_judge)
    want = sorted(repr(r) for r in plain.collect())
    for _ in range(2):
        got = evaluate.run(questions, chunks, 2, embedder, answers, judge_, ledger=ledger)
        assert sorted(repr(r) for r in got.collect()) == want
    for c in (answers, judge_, vectors):
        assert c.asked() and set(c.asked().values()) == {1}, c.log
    assert len(answers.asked()) == 3 and len(vectors.asked()) == 5


def test_replies_in_batches(spark, tmp_path):
    sizes = tmp_path / "sizes"

    def send(texts):
        with open(sizes, "a") as f:
            f.write(f"{len(texts)}\n")
        return [t[::-1] for t in texts]

    rows = prompts(spark, 10, 1).select(address(F.col("prompt"), "m").alias("address"), "prompt")
    got = replies(rows, send, Ledger(str(tmp_path / "l"), buckets=1), most=8).collect()
    assert len(got) == 10 and all(r["error"] is None for r in got)
    assert sorted(map(int, sizes.read_text().split())) == [2, 4, 4]
