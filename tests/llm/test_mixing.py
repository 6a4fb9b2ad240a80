import hashlib
import random
import re

import duckdb
import pytest

from lonja.llm import mixing
from lonja.llm.queries import ORACLE_SQL


def mix_by_hand(rows):
    size = {}
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    target = {s: fixed.get(s, weight[s] * level) for s in order}
    taken = {}
    for s in order:
        full = int(target[s] // size[s]) if size[s] else 0
        budget = target[s] - full * size[s]
        groups = {}
        for i, o, n in docs:
            if o == s:
                h = int(hashlib.md5(str(i if i is not None else "null").encode()).hexdigest()[:15], 16)
                groups.setdefault(h, []).append((i, n))
        before = 0
        for h in sorted(groups):
            own = sum(n for _, n in groups[h])
            extra = budget > 0 and 2 * before + own <= 2 * budget
            for i, n in groups[h]:
                taken.setdefault((i, s), []).append((n, size[s], n * (full + extra)))
            before += own
    return target, taken


CASES = {
    "plain": lambda rng: [(i, "w " * rng.randint(0, 50), "en", f"s{rng.randrange(7)}") for i in range(300)],
    "hot": lambda rng: [(i, "w " * rng.randint(1, 9), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)],
    "capped": lambda rng: [(i, "w " * (200 if i < 3 else 1), "en", "big" if i < 3 else f"z{i % 4}") for i in range(40)],
    "nulls": lambda rng: [(i, None if i % 7 == 0 else "a b c", "en", None if i % 3 == 0 else "é" if i % 3 == 1 else "Z") for i in range(60)] + [(None, "x y", "en", "Z")] * 2,
    "repeats": lambda rng: [(i // 4, "a b c d", "en", f"s{i % 2}") for i in range(64)],
    "zero": lambda rng: [(i, " ", "en", f"s{i % 2}") for i in range(6)],
}


@pytest.mark.parametrize("case", CASES)
def test_mix_equals_brute_force(make_docs, scratch, case):
    rows = CASES[case](random.Random(9))
    target, taken = mix_by_hand(rows)
    found = mixing.plan_mix(make_docs(rows), scratch).collect()
    assert len(found) == len(rows)
    got = {}
    for r in found:
        assert r.target == pytest.approx(target[r.source], rel=1e-12)
        got.setdefault((r.doc_id, r.source), []).append((r.size, r.source_size, r.size * r.copies))
    key = {k: sorted(v) for k, v in got.items()}
    # A zero-sized document takes nothing whether it is chosen or not.
    assert key == {k: sorted(v) for k, v in taken.items()}


def test_refinement_down_to_equal_hashes(make_docs, scratch, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    rows = CASES["hot"](random.Random(1))
    taken = mix_by_hand(rows)[1]
    got = {(r.doc_id, r.source): [(r.size, r.source_size, r.size * r.copies)] for r in mixing.plan_mix(make_docs(rows), scratch).collect()}
    assert got == taken


def test_reruns_agree_for_any_partitioning(make_docs, scratch):
    rows = CASES["plain"](random.Random(2))
    assert sorted(mixing.mix(make_docs(rows, 1), scratch).collect()) == sorted(mixing.mix(make_docs(rows, 9), scratch).collect())


def test_rows_of_the_mix(make_docs, scratch):
    rows = CASES["capped"](random.Random(3))
    docs = make_docs(rows)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(docs, scratch).collect()}
    mixed = mixing.mixed_rows(docs, scratch)
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and count == {k: v for k, v in plan.items() if v}


def test_empty_table(make_docs, scratch):
    assert mixing.mix(make_docs([]), scratch).count() == 0


def test_sql_agrees(make_docs, scratch, tmp_path):
    rows = CASES["nulls"](random.Random(5))
    make_docs(rows).write.parquet(f"{tmp_path}/d")
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
        expected = sorted((repr(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in db.sql(ORACLE_SQL["op5_mixing"]).fetchall())
    found = sorted((repr(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(make_docs(rows), scratch).collect())
    assert found == expected
