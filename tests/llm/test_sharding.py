from collections import Counter

import pytest
import xxhash

from lonja.llm import sharding

SHARDS = [f"s{i}" for i in range(7)]


def fill_by_hand(names, slots):
    prefs = {n: [(xxhash.xxh64_intdigest(n.encode(), 1) % slots + j * (xxhash.xxh64_intdigest(n.encode(), 2) % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    table, nxt = {}, dict.fromkeys(names, 0)
    while True:
        for n in sorted(names):
            while prefs[n][nxt[n]] in table:
                nxt[n] += 1
            table[prefs[n][nxt[n]]] = n
            if len(table) == slots:
                return [table[i] for i in range(slots)]


def test_table_equals_the_definition_and_is_even():
    found = [SHARDS[i] for i in sharding.lookup_table(SHARDS, 211)]
    assert found == fill_by_hand(SHARDS, 211)
    shares = Counter(sharding.lookup_table(SHARDS))
    assert max(shares.values()) - min(shares.values()) <= 1


def test_order_of_shards_does_not_matter_and_removal_moves_little():
    one = [SHARDS[i] for i in sharding.lookup_table(SHARDS, 4099)]
    back = SHARDS[::-1]
    assert one == [back[i] for i in sharding.lookup_table(back, 4099)]
    fewer = SHARDS[:-1]
    after = [fewer[i] for i in sharding.lookup_table(fewer, 4099)]
    moved = sum(a != b for a, b in zip(one, after, strict=True) if a != "s6")
    assert moved < 0.1 * 4099


def test_placement(make_docs, corpus):
    docs = make_docs(corpus + [(None, "x"), (5, "again")])
    placed = sharding.place(docs, "doc_id", SHARDS, 211)
    table = sharding.lookup_table(SHARDS, 211)
    rows = placed.collect()
    assert placed.columns == [*docs.columns, "slot", "shard"] and len(rows) == len(corpus) + 2
    for r in rows:
        slot = (xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42) if r.doc_id is not None else 42)
        slot = (slot - (1 << 64) if slot >> 63 else slot) % 211
        assert (r.slot, r.shard) == (slot, SHARDS[table[slot]])
    assert sharding.place(make_docs([]), "doc_id", SHARDS, 211).count() == 0


def test_clashing_columns_come_back_renamed(spark):
    rows = spark.createDataFrame([(1, "mine", 5)], "doc_id long, shard string, slot int")
    placed = sharding.place(rows, "doc_id", SHARDS, 211)
    row = placed.first()
    assert placed.columns == ["doc_id", "shard_input", "slot_input", "slot", "shard"] and (row.shard_input, row.slot_input) == ("mine", 5) and row.shard in SHARDS
    assert sharding.place(rows, "shard", SHARDS, 211).first().shard_input == "mine"


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), ([str(i) for i in range(9)], 7)])
def test_bad_arguments(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_one_shard_and_small_tables():
    assert sharding.lookup_table(["only"], 2) == [0, 0]
    assert sorted(sharding.lookup_table(["a", "b"], 2)) == [0, 1]
