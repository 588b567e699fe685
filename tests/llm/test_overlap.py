"""Overlaps across splits against an all-pairs comparison on a small fixture."""

import random

from kinolith.llm import overlap as O

WORDS = "somebody with a lime scarf boots the ball under the glowing anvil while two patient bakers wave near an old mirror then nine".split()
EVAL, TRAIN = "eval_table string, item_id bigint, prompt string", "pair_id bigint, origin string, prompt string, item_id int"


def test_kinds_of_change_are_found(spark):
    base = "eight serene divers in a frosty canteen, then somebody with an orange raincoat drags a glowing windmill, while a soaked skater boots the ball; keep it tender"
    same = [
        base, base.upper(), "  " + base.replace(",", " -").replace(" ", "  "), base.replace("eight", "8"), base.replace("divers", "dívers"),
        base.replace("serene", "seerene").replace("windmill", "winmdill"), base.replace("somebody", "really somebody kindly"),
        "a soaked skater boots the ball, while eight serene divers in a frosty canteen; then somebody with an orange raincoat drags a glowing windmill, keep it tender",
        base.replace("orange", "mirror").replace("frosty", "anvil").replace("soaked", "bench"),
    ]
    other = [base[:60], "nine lopsided hikers, one nods", " ".join(base.split()[:13]) + " then nothing at all happens to anybody here today", None, " ", "???"]
    train = spark.createDataFrame([(100 + i, "o", p, 1) for i, p in enumerate(same + other)], TRAIN)
    held = spark.createDataFrame([("e", 1, base), ("e", 2, base), ("e", 3, None), ("e", 4, "")], EVAL)
    found = {(r.item_id, r.pair_id) for r in O.overlaps(held, train).collect()}
    assert found == {(i, 100 + k) for i in (1, 2) for k in range(len(same))}


def test_random_prompts_equal_all_pairs(spark):
    rng = random.Random(9)
    prompts = [[rng.choice(WORDS) for _ in range(rng.choice([1, 2, 4, 9, 30]))] for _ in range(60)]

    def changed(p):
        q = list(p)
        for _ in range(rng.randint(0, 1 + len(q) // 4)):
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [q[k], "zebra"]])
            if not q:
                return list(p)
        return q

    held = [("e", i, " ".join(p)) for i, p in enumerate(prompts)]
    train = [(1000 + i, None, " ".join(changed(rng.choice(prompts))), 0) for i in range(400)]
    found = {(r.item_id, r.pair_id) for r in O.overlaps(spark.createDataFrame(held, EVAL), spark.createDataFrame(train, TRAIN), 500, 4000).collect()}
    true = set()
    for _, i, p in held:
        for k, _, q, _ in train:
            a, b = O.words_of(p), O.words_of(q)
            if O.differing(a, b) * 5 <= max(len(a), len(b)):
                true.add((i, k))
    # short random prompts hold the same words in another order by chance; these the passages don't cover
    assert found <= true and len(found) >= 0.9 * len(true)
    assert {x for x in true if len(O.words_of(held[x[0]][2])) == 30} <= found


def test_empty_tables(spark):
    held, train = spark.createDataFrame([], EVAL), spark.createDataFrame([(1, "o", "a b c", 0)], TRAIN)
    assert O.overlaps(held, train).collect() == []
    assert O.overlaps(spark.createDataFrame([("e", 1, "a b c")], EVAL), train.where("pair_id < 0")).collect() == []
    assert O.overlap_report(O.overlaps(held, train), held).collect() == []


def test_common_passages_are_left_out_of_the_count(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)]
    common = ["somebody with a", "whoever wears the", "boots the ball"]
    held = [" ".join(common + [rng.choice(words) for _ in range(51)]) for _ in range(300)]
    shard = O.Shard(held)
    shard._rare(60 // O.DIFFER)
    # 20 passages, 6 of which a pair must keep; 3 of these are among the 17 rarest
    assert len(shard.rare) == 17 * len(held) and len(shard.owner) == 20 * len(held)
    texts = []
    for k, p in enumerate(held[:40]):
        q = p.split()
        for i in rng.sample(range(60), k % 16):
            q[i] = rng.choice(words)
        texts.append(" ".join(q))
    found = {(i, e) for i, e, _, _ in shard.scan(texts)}
    assert {(i, i) for i in range(40) if i % 16 <= 12} <= found
    assert all(O.differing(texts[i].split(), held[e].split()) * 5 <= 60 for i, e in found)
    train = spark.createDataFrame([(1000 + i, "o", t, 0) for i, t in enumerate(texts)], TRAIN)
    rows = [("e", e, p) for e, p in enumerate(held)] + [("e", 900, None), ("e", 901, "two words")]
    # one length fills several shards
    assert len(O._cuts(O._normalised(spark.createDataFrame(rows[:300], EVAL)), 30_000)) >= 3
    cut = O.overlaps(spark.createDataFrame(rows, EVAL), train, 60_000, 20_000)
    assert {(r.pair_id - 1000, r.item_id) for r in cut.collect()} == found
