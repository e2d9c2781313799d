import json
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from codonlake.llm import packing
from codonlake.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def test_every_token_merges_to_itself(bpe):
    """With that the ranked merges give the ids of the rule-by-rule merges for any word."""
    vocab = json.load(open(PATH))["model"]["vocab"]
    ranks = {i: k for k, i in enumerate(bpe.ids.tolist())}
    bad = 0
    for token, i in vocab.items():
        if token.startswith("<|") or i not in ranks:
            continue
        raw = bpe.ranked.decode_single_token_bytes(ranks[i])
        bad += bpe.ranked._core_bpe.encode_single_piece(raw) != [ranks[i]]
    assert not bad


def test_ids_against_the_library(bpe):
    rng = random.Random(2)
    letters = [chr(i) for i in range(0x250)] + list("  \n\t ​́ΣσΑς漢字😀'stremvdl<|>") + ["<|endoftext|>", "'s", "'LL", " the ", "<|startoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", None, "word " * 3000]
    want = [np.array(bpe.slow.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert bpe.encode(texts) == want
    bpe.KEEP = 10
    assert bpe.encode(texts) == want


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 50, 4096])
    counts = {}
    for _ in range(rng.randint(1, 400)):
        k = rng.randint(1, cap)
        counts[k] = counts.get(k, 0) + rng.randint(1, 4)
    runs, bins, bound = packing.plan_bins(counts, cap)
    used = {}
    for times, filling in runs:
        assert sum(k * v for k, v in filling.items()) <= cap
        for k, v in filling.items():
            used[k] = used.get(k, 0) + times * v
    assert used == counts and bins == sum(t for t, _ in runs) and bound <= bins <= bound * 1.25 + 1


def test_small_plans_are_optimal():
    def best(items, cap):
        bins = [[]]
        state = {(): 0}
        full = (1 << len(items)) - 1
        dp = {0: (1, 0)}
        for mask in range(full + 1):
            if mask not in dp:
                continue
            n, last = dp[mask]
            for i, x in enumerate(items):
                if not mask >> i & 1:
                    new = (n, last + x) if last + x <= cap else (n + 1, x)
                    if mask | 1 << i not in dp or new < dp[mask | 1 << i]:
                        dp[mask | 1 << i] = new
        assert bins and state is not None
        return dp[full][0]

    rng = random.Random(9)
    for case in range(190):
        cap = rng.randint(8, 30) if case < 40 else rng.choice([20, 100, 4096])
        items = [rng.randint(1 if case % 2 else max(1, cap // 5), cap if case % 3 else cap // 2) for _ in range(12 if case >= 40 else rng.randint(1, 10))]
        counts = {}
        for x in items:
            counts[x] = counts.get(x, 0) + 1
        runs, bins, bound = packing.plan_bins(counts, cap)
        assert bound <= bins == best(items, cap)


def test_fillings_are_the_undominated_ones_in_order_of_waste():
    rng = random.Random(2)
    for _ in range(60):
        room = rng.randint(5, 25)
        n = {}
        for _ in range(rng.randint(1, 7)):
            k = rng.randint(1, room)
            n[k] = n.get(k, 0) + 1
        got = list(packing.fillings(n, room, room, [0]))
        assert [w for w, _ in got] == sorted(w for w, _ in got) and len(set(f for _, f in got)) == len(got)
        assert all(w == room - sum(f) and all(f.count(k) <= n[k] for k in f) for w, f in got)
        items = [k for k, v in n.items() for _ in range(v)]
        every = {tuple(sorted(c, reverse=True)) for m in range(len(items) + 1) for c in itertools.combinations(items, m) if sum(c) <= room}
        lengths = sorted(n)
        assert {f for _, f in got} == {f for f in every if not packing.dominated(f, room - sum(f), lengths, n)}


def test_search_ends_after_its_steps():
    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        k = rng.randint(700, 2900)
        counts[k] = counts.get(k, 0) + 1
    greedy = sum(t for t, _ in packing.best_fit(counts, 4096))
    runs, bins, bound = packing.plan_bins(counts, 4096, work=300_000)
    assert bound <= bins <= greedy and sum(t * v for t, f in runs for v in f.values()) == 20_000


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (1, ""), (2, None), (None, "a b")], [(i, "word " * (i * 97 % 900)) for i in range(120)] + [(500, "long text " * 9000)] + [(600 + i, "copy of it") for i in range(200)]])
def test_pack(spark, bpe, rows):
    got = packing.pack(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string"), PATH).collect()
    want = {}
    for doc, text in rows:
        ids = bpe.encode([text])[0] + np.array([1], dtype="<u4").tobytes()
        for k in range(0, len(ids), 4 * 4096):
            key = doc, k // 16384, k // 4, len(ids[k : k + 16384]) // 4, zlib.crc32(ids[k : k + 16384])
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got:
        key = r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]
        have[key] = have.get(key, 0) + 1
    assert have == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    if rows:
        assert len(seqs) <= -(-sum(r["length"] for r in got) // 4096) + 1
