import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import EDGES, docs
from verisift.llm import packing, repair, token_output
from verisift.llm.common import fresh_path
from verisift.llm.tokens import TokenIds, default_tokenizer

TOK = TokenIds(default_tokenizer(), 2)
ids_of = lambda t: [*TOK.library.encode(t or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'slrevtmd.19aé 　日\0"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_ids_are_the_library_s(texts):
    assert [x.tolist() for x in TOK.encode(texts)] == [ids_of(t) for t in texts]


def test_ids_of_words_that_a_polynomial_confuses():
    one = "a"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    assert [x.tolist() for x in TOK.encode([one, two, f"{two} {one}"])] == [ids_of(one), ids_of(two), ids_of(f"{two} {one}")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=80), max_size=6))
def test_grammar_round_trip(lists):
    arrays = [np.array(x, np.uint32) for x in lists]
    shard = repair.Shard(repair.pack(list(range(len(arrays))), arrays))
    assert shard.all_ids().tolist() == [i for x in lists for i in x]
    for k, x in enumerate(lists):
        assert shard.document(k).tolist() == x
        a = len(x) // 3
        assert shard.span(k, a, a + 5).tolist() == x[a : a + 5]


def test_grammar_compresses_and_keeps_wide_ids():
    ids = np.array([70_000, 5, 9, 1] * 500, np.uint32)
    blob = repair.pack([None], [ids])
    shard = repair.Shard(blob)
    assert shard.doc_ids == [None] and (shard.document(0) == ids).all() and len(shard.symbols) < 500


def test_grammar_goes_on_until_no_rule_pays():
    rng = np.random.default_rng(6)
    one = rng.integers(0, 5000, 700).astype(np.uint32)
    shard = repair.Shard(repair.pack(list(range(60)), [one] * 60))
    assert len(shard.symbols) == 60 and (shard.document(59) == one).all()
    # A pair that occurs 40 times in a large shard gets a rule as it does in a small one.
    ids = rng.integers(0, 40_000, 700_000).astype(np.uint32)
    at = np.arange(40) * 1000
    ids[at], ids[at + 1] = 41_000, 41_001
    shard = repair.Shard(repair.pack([0], [ids]))
    assert [41_000, 41_001] in shard.rules.tolist() and (shard.all_ids() == ids).all()
    s, pair = shard.symbols[:-1].astype(np.uint64), shard.symbols[1:].astype(np.uint64)
    assert np.unique(s << np.uint64(32) | pair, return_counts=True)[1].max() <= repair.RULE // 2
    # Where 16 bits run out, rules go on with wide symbols.
    ids = np.tile(rng.permutation(65_000).astype(np.uint32), 12)
    shard = repair.Shard(repair.pack([0], [ids]))
    assert shard.wide == 4 and len(shard.symbols) <= 12 and (shard.all_ids() == ids).all()


@pytest.mark.parametrize("seed", range(6))
def test_rules_by_brute_force(seed):
    """Expansion lengths are those of the rules, and no rule is missing that would save more bytes than it takes."""
    r = random.Random(seed)
    lists = [[r.randrange(12) for _ in range(r.randint(1, 400))] for _ in range(20)]
    shard = repair.Shard(repair.pack(list(range(20)), [np.array(x, np.uint32) for x in lists]))

    def expand(x):
        return [x] if x < shard.first else [y for s in shard.rules[x - shard.first].tolist() for y in expand(s)]

    assert shard.length.tolist() == [len(expand(shard.first + i)) for i in range(len(shard.rules))]
    assert [i for s in shard.symbols.tolist() for i in expand(s)] == [i for x in lists for i in x]
    left = {}
    for a, b in zip(shard.sym_starts[:-1].tolist(), shard.sym_starts[1:].tolist(), strict=True):
        s, i = shard.symbols[a:b].tolist(), 0
        while i + 1 < len(s):
            left[s[i], s[i + 1]] = left.get((s[i], s[i + 1]), 0) + 1
            i += 2 if i + 2 < len(s) and s[i] == s[i + 1] == s[i + 2] else 1
    assert max(left.values(), default=0) <= repair.RULE // 2


def varied_shard(seed):
    """Documents of phrases of many lengths and counts, and of runs, so that many rounds are made at the lowest count."""
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 3000, int(rng.integers(2, 200))).astype(np.uint32) for _ in range(300)]
    lists = [np.concatenate([phrases[min(int(k), 300) - 1] for k in rng.zipf(1.2, 25)]) for _ in range(60)]
    return [np.repeat(x, rng.integers(1, 6, len(x))) if i % 20 == 0 else x for i, x in enumerate(lists)]


def test_rounds_at_one_count_look_at_changed_places_only(monkeypatch):
    """Rounds at the lowest count are most of all rounds; the positions that are counted stay below what the falling counts take."""
    docs, seen, rounds = varied_shard(1), 0, 0
    count, order = np.bincount, np.lexsort

    def bincount(x, *args, **more):
        nonlocal seen
        seen += len(x)
        return count(x, *args, **more)

    def lexsort(keys):
        nonlocal rounds
        rounds += 1
        return order(keys)

    monkeypatch.setattr(np, "bincount", bincount)
    monkeypatch.setattr(np, "lexsort", lexsort)
    repair.pack([None] * len(docs), docs)
    assert rounds >= 15 and seen < 8 * sum(map(len, docs))


@pytest.mark.parametrize("seed", range(4))
def test_rounds_on_changed_places_make_the_grammar_of_all_places(seed, monkeypatch):
    docs = varied_shard(seed)
    if seed == 3:
        docs = [x + np.uint32(65_000) for x in docs]  # wide symbols
    names = list(range(len(docs)))
    blob, some = repair.pack(names, docs), repair._pairs_to_replace
    monkeypatch.setattr(repair, "_pairs_to_replace", lambda s, ends, at, least, most: some(s, ends, np.arange(len(s) - 1), least, most))
    assert repair.pack(names, docs) == blob
    assert all((repair.Shard(blob).document(i) == x).all() for i, x in enumerate(docs))


def test_new_words_go_to_the_library_as_one_text():
    """Words that begin with a blank need no call each; and two words whose slots are both taken are told apart."""
    tok, single = TokenIds(default_tokenizer(), 2), []

    class Library:
        def encode_batch_fast(self, texts, is_pretokenized=False, **more):
            single.extend(texts[0] if is_pretokenized else [])
            return tok_library.encode_batch_fast(texts, is_pretokenized=is_pretokenized, **more)

    tok_library, tok.library = tok.library, Library()
    r = random.Random(5)
    text = "First" + "".join(" " + "".join(r.choices("abcdeéß日", k=r.randint(1, 9))) for _ in range(3000)) + " 12, \n!"
    assert tok.encode([text])[0].tolist() == ids_of(text)
    assert len(single) < 10
    tok.slots[1:] = 1  # all slots but the end's are taken by another entry
    for _ in range(2):
        assert tok.encode([text])[0].tolist() == ids_of(text)


def test_output_edges(spark):
    df = docs(spark, EDGES)
    path = fresh_path(spark, "test")
    token_output.write_token_shards(df, path, default_tokenizer(), 2, shard_ids=50)
    got = token_output.read_token_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    texts = {i: t for i, t, *_ in EDGES}
    at = 0
    for r in got:
        ids = ids_of(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = fresh_path(spark, "test")
    token_output.write_token_shards(df.limit(0), empty, default_tokenizer(), 2)
    assert token_output.read_token_digests(spark, empty).count() == 0


def optimum(items, size):
    best = [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= size and bins[k] not in bins[:k]:
                bins[k] += items[i]
                rec(i + 1, bins)
                bins[k] -= items[i]
        rec(i + 1, [*bins, items[i]])

    rec(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    size = r.choice([10, 20, 37])
    items = sorted((r.randint(1, size) for _ in range(r.randint(1, 9))), reverse=True)
    h = np.bincount(items, minlength=size + 1)
    fixed = packing.reduce_dominated(h)
    rest = sorted((s for s in range(size + 1) for _ in range(h[s])), reverse=True)
    assert sum(n for _, n in fixed) + (optimum(rest, size) if rest else 0) == optimum(items, size)
    plan = packing.plan(dict(zip(*np.unique(items, return_counts=True), strict=True)), size)
    assert sorted((s for p, n in plan for _ in range(n) for s in p), reverse=True) == items
    assert all(sum(p) <= size for p, _ in plan)


def test_three_short_pieces_beat_one():
    items = [87, 85, 10, 5, 4, 4, 4]
    h = np.bincount(items, minlength=101)
    fixed = packing.reduce_dominated(h)
    rest = sorted((s for s in range(101) for _ in range(h[s])), reverse=True)
    assert sum(n for _, n in fixed) + optimum(rest, 100) == optimum(items, 100) == 2


def test_packing_edges(spark):
    df = docs(spark, EDGES)
    got = packing.pack_documents(df, size=64).toPandas()
    texts = {i: t for i, t, *_ in EDGES}
    for i, t in texts.items():
        rows = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values(["piece", "sequence_id"])
        rows = rows.drop_duplicates("piece")
        ids = np.array(ids_of(t), "<u4")
        assert rows.length.sum() == len(ids) and (rows.length[1:] == 64).all()
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 64
    assert packing.pack_documents(df.limit(0)).count() == 0
