"""The reply chains of plain conversations."""

import os
import random

from pyspark.sql import functions as F

from docloom.llm import chat


def test_the_self_joins_climb_over_every_turn(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(1, t, "user", "a") for t in [None, *range(40)]] + [(c, rng.randrange(6), "assistant", "b") for c in [None, 2, 3, 4] for _ in range(9)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    want = {}
    for c, t in {r[:2] for r in rows}:
        before = [x for x in {r[1] for r in rows if r[0] == c} if t is not None and (x is None or x < t)]
        want[c, t] = max(before, key=lambda x: -1 if x is None else x) if before else "root"
    seen, real = [], chat.doubled

    def spy(now, work, keep=True):
        rows = now.collect()
        at = {r.id: r["at"] for r in rows}
        seen.append({(r.tree, r["at"]): "root" if r.up is None else at[r.up] for r in rows})
        known, rounds = real(now, work, keep)
        assert {(r.tree, r["at"]): r.depth for r in known.collect()} == {(c, t): 1 + sum((x is None, x or 0) != (t is None, t or 0) and (x is None or t is not None and x < t) for d, x in want if d == c) for c, t in want}
        return known, rounds

    monkeypatch.setattr(chat, "doubled", spy)
    got = chat.plain_conversations(conversations, f"file://{tmp_path}")
    assert {r.tree: r.n_turns for r in got.collect()} == {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    assert seen == [want]
    assert len(os.listdir(tmp_path / "rounds")) == 1 and not (tmp_path / "sorted").exists()  # a round's table goes with the next
    assert got.agg(F.sum("n_turns")).first()[0] == len(rows)
