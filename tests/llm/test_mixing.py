import random

import pytest

from quiverlake.llm import mixing

from . import cases


def schedule(weights, blocks):
    """Earliest deadline first, slot by slot."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    gone = dict.fromkeys(left, 0)
    while left:
        total = sum(weights[s] for s in left)
        done, t, ended = dict.fromkeys(left, 0), 0, False
        while not ended:
            ready = [(-(-(done[s] + 1) * total // weights[s]), s) for s in sorted(left) if done[s] * total // weights[s] <= t]
            s = min(ready)[1]
            out.append((s, gone[s]))
            gone[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
            ended = not left[s]
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [7, 1, 1, 1], [5, 3, 2, 2, 1]])
def test_period_stays_within_one_block_of_the_shares(spark, weights):
    order = mixing.pfair_period(spark, weights)
    total, done = sum(weights), [0] * len(weights)
    for t, i in enumerate(order, 1):
        done[i] += 1
        assert all(abs(d - w * t / total) < 1 for d, w in zip(done, weights))
    assert done == weights


def test_positions_follow_the_schedule(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "other", None])) for i in range(300)]
    weights = {"a": 3, "b": 2, "c": 1}
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block=7).orderBy("_mix_position").collect()
    assert sorted(x.doc_id for x in got) == list(range(300))
    names = {i: s if s in weights else "" for i, s in rows}
    blocks = {s: -(-sum(n == s for n in names.values()) // 7) for s in set(names.values())}
    want = schedule({**weights, "": 1}, blocks)
    seen = list(dict.fromkeys((x._mix_source, x._mix_block) for x in got))
    assert seen == want
    for s in set(names.values()):
        assert [x.doc_id for x in got if x._mix_source == s] == [i for i in sorted(names) if names[i] == s]


def test_wrong_weights():
    for bad in ({}, {"a": 0}, {"a": 0.5}, {"a": 1, "b": mixing.MAX_PERIOD}):
        with pytest.raises(ValueError):
            mixing.integer_weights(bad)


def test_awkward_rows(spark):
    got = mixing.mix_sources(cases.frame(spark), {"src1": 2, "src2": 1}, block=2).collect()
    assert len(got) == len(cases.awkward()) and len({r._mix_position for r in got}) == len(got)
    assert not mixing.mix_sources(cases.frame(spark, []), {"src1": 2}).collect()


def test_equal_keys_have_one_order_and_reserved_names_are_refused(spark):
    rows = [(1, "src0", f"text {i}") for i in range(200)]
    first = {r.text: r["_mix_position"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3), {"src0": 1}).collect()}
    again = {r.text: r["_mix_position"] for r in mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id bigint, source string, text string").repartition(7), {"src0": 1}).collect()}
    assert first == again and sorted(first.values()) == list(range(200))
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame([(1, "a", 2)], "doc_id bigint, source string, _m int"), {"a": 1})
