"""Deduplication, decontamination, mixing and the Jaccard join against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from marquee.llm import decontaminate, dedup, jaccard, mixing

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(20_000))


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(base, n):
    out = list(base)
    for _ in range(n):
        out[RNG.randrange(len(out))] = f"x{RNG.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    base, other = words(150), words(60)
    texts = [None, "", " \n", "a", "a b", "A b", "a b", LONG, LONG + " end"]
    texts += [" ".join(base)] * 40
    texts += [" ".join(edited(base, RNG.randrange(1, 7))) for _ in range(60)]
    texts += [" ".join(edited(other, RNG.randrange(0, 3))) for _ in range(20)]
    texts += [" ".join(words(RNG.randrange(1, 80))) for _ in range(60)]
    RNG.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_exact_dedup(documents, rows):
    got = {r.doc_id: r for r in dedup.exact_dedup(documents(rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))


def test_exact_dedup_of_repeated_and_unkeyed_rows(documents):
    found = dedup.exact_dedup(documents([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    assert Counter(r.kept for r in found) == {True: 2, False: 3}
    assert dedup.exact_dedup(documents([])).collect() == []


@pytest.mark.parametrize("limit", [1, 2, 64])
def test_a_small_bloom_filter_only_shuffles_more(documents, rows, monkeypatch, limit):
    monkeypatch.setattr(dedup, "MAX_WORDS", limit)
    test_exact_dedup(documents, rows)


def brute(rows, width, num, den):
    sets, first = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets[i] = grams
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    pairs = 0
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    pairs += sets[a] != sets[b]
                    one, two = sorted((find(a), find(b)))
                    root[two] = one
    del first
    return {i: (len(sets[i]), find(i)) for i in ids}, pairs


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("tree", [4_000, 16])
def test_jaccard_components(documents, rows, monkeypatch, width, num, tree):
    monkeypatch.setattr(jaccard, "TREE_SETS", tree)
    found = jaccard.jaccard_components(documents(rows), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, width, num, 100)[0]


def test_jaccard_join_loses_no_link(documents, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 16)
    join = jaccard.jaccard_join(documents(rows), 3, 90, 100)
    sizes = {r._set: r._size for r in join.classes.collect()}
    pairs = [(r.a, r.b) for r in join.links.collect()]
    assert len(pairs) == len(set(pairs))
    assert sum(sizes[a] * sizes[b] for a, b in pairs) == brute(rows, 3, 90, 100)[1]


def test_keep_one_keeps_the_least_key_once(documents):
    words = " ".join(f"w{i}" for i in range(40))
    docs = documents(
        [(4, words), (2, words), (2, words), (7, "other text of few words"), (9, ""), (9, ""), (None, words), (None, words)]
    )
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 2), (False, 7), (False, 9), (True, 0), (True, 0)
    ]


def test_jaccard_of_columns_with_private_names(documents):
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 7 * i], *["y"] * (i % 3), *base[7 * i + i % 3 :]])) for i in range(9)]
    rows += [(3, " ".join(base)), (20, None)]
    docs = documents(rows)
    clash = docs.selectExpr("*", *[f"'x' AS {c}" for c in ("_set", "_n", "_key", "_id", "_first", "_no", "_text", "label")])
    found = sorted(map(tuple, jaccard.jaccard_components(clash, 1, 80, 100).collect()))
    assert found == sorted(map(tuple, jaccard.jaccard_components(docs, 1, 80, 100).collect()))
    assert jaccard.keep_one(clash, 1, 80, 100).columns == clash.columns


def test_jaccard_edges(documents):
    assert jaccard.jaccard_components(documents([])).collect() == []
    rows = [(2, "a b"), (2, "a b"), (None, "a b"), (1, "A  B"), (4, ""), (5, None)]
    found = sorted(map(tuple, jaccard.jaccard_components(documents(rows)).collect()), key=str)
    assert found == sorted([(2, 1, 1), (2, 1, 1), (None, 1, None), (1, 1, 1), (4, 0, 4), (5, 0, 5)], key=str)
    kept = jaccard.keep_one(documents([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b"), (7, None)]))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 7, None]
    assert len(kept.columns) == 8


def test_contaminated(documents, spark):
    item = words(40)
    leak = words(30) + item[5:25] + words(30)
    substituted = list(item)
    for k in (3, 9, 16, 22, 30, 35):
        substituted[k] = "zzz"
    rows = [
        (1, " ".join(leak).upper()),
        (2, "-- " + ", ".join(substituted)),
        (3, " ".join(words(3_000))),
        (4, " ".join(item[:9] + words(9) + item[9:18])),
        (5, None),
        (6, ""),
        (None, " ".join(item)),
        (7, LONG + " " + " ".join(item[-13:])),
        (8, " ".join(["n1", "n2", "n3", "n4", "n5", "n6", "n7", "n8"])),
    ]
    items = [(1, " ".join(item)), (2, "short one"), (3, None), (None, "n1 n2 n3 n4 n5 n6 n7 n8")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (None, 1), (7, 1), (8, None)}
    one = next(r for r in found if r.doc_id == 1)
    assert (one.passage_words, one.agreeing, one.doc_word, one.item_word) == (13, 13, 30, 5)
    kept = decontaminate.decontaminate(documents(rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(documents([]), benchmark).collect() == []
    assert decontaminate.contaminated(documents(rows), benchmark.limit(0)).collect() == []


def test_short_items_with_every_permitted_substitution(documents, spark):
    """Items of every length below a passage, exact and with each set of substitutions, and one more."""
    items, rows, want = [], [], set()
    for n in range(1, decontaminate.PASSAGE):
        words = [f"item{n}word{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        spared = n - math.ceil(n * decontaminate.AGREE)
        for size in {0, spared, spared + 1}:
            for changed in combinations(range(n), size):
                text = ["before", "it", *["other" if j in changed else w for j, w in enumerate(words)], "after"]
                if size <= spared:
                    want.add((len(rows), n))
                rows.append((len(rows), " ".join(text)))
    items.append((99, "你好吗？"))
    want.add((len(rows), 99))
    rows.append((len(rows), "他说，你好吗！"))
    rows += [(len(rows), "item1word"), (len(rows) + 1, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for n in range(1, decontaminate.PASSAGE):
        spared = n - math.ceil(n * decontaminate.AGREE)
        for changed in combinations(range(n), spared):
            assert any(not set(changed) & set(mask) for mask in decontaminate.masks_of(n))


def test_masks_hit_every_passage_with_two_substitutions():
    for changed in combinations(range(decontaminate.PASSAGE), 2):
        assert any(
            all(at + o not in changed for o in mask)
            for mask in decontaminate.MASKS
            for at in range(decontaminate.PASSAGE - mask[-1])
        )


def expected_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(documents, rows):
    source = [["b", "a", None, "é", "Z"][min(4, RNG.randrange(9))] for _ in rows]
    mixed = mixing.mix(documents(rows, source))
    got = mixed.documents.collect()
    sizes = Counter()
    for (_, t), s in zip(rows, source, strict=True):
        sizes[s] += len((t or "").encode().split())
    target = expected_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(target[s]) for s in sizes)
    again = mixing.mix(documents(rows, source)).documents.collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    slots = mixed.schedule.orderBy("_position").collect()
    assert sum(r._words for r in slots) == sum(taken.values())
    # Low discrepancy: every beginning of the schedule has nearly its share of each source.
    share = Counter(r._no for r in slots)
    seen = Counter()
    for k, r in enumerate(slots[: len(slots) // 2], 1):
        seen[r._no] += 1
        assert abs(seen[r._no] - k * share[r._no] / len(slots)) < 40


def test_mixed_documents(documents, rows):
    docs = documents(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).documents.collect()}
    got = mixing.mixed_documents(docs).collect()
    count = Counter()
    for r in got:
        count[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(count)


@pytest.mark.parametrize("block", [7, 128])
def test_mixed_blocks(documents, rows, block):
    texts = [(i, t) for i, t in rows if len(t or "") < 9_000]
    source = [("hot", "hot", "hot", "b", None)[i * 7 % 5] for i, _ in texts]
    docs = documents(texts, source)
    mixed = mixing.mix(docs, block_words=block)
    spans = sorted((r.position, r.doc_id, r.first_word, r.words) for r in mixed.spans.collect())
    blocks = mixing.mixed_blocks(docs, block_words=block).collect()
    # Same spans, and a text that is made of their words, in the order of the schedule.
    assert spans == sorted((r.position, s.doc_id, s.first_word, s.words) for r in blocks for s in r.spans)
    assert [r.position for r in blocks] == sorted({r.position for r in blocks})
    split = {i: (t or "").encode().split() for i, t in texts}
    for r in blocks:
        wanted = [w for s in r.spans for w in split[s.doc_id][s.first_word : s.first_word + s.words]]
        assert r.text.encode().split() == wanted and len(wanted) == r.words <= block
    # The first pass of a source delivers every word of its documents, in one order.
    at = Counter()
    for r in sorted(blocks, key=lambda r: (str(r.source), r["pass"], r.block)):
        for s in r.spans:
            assert s.first_word == at[s.doc_id, r["pass"]]
            at[s.doc_id, r["pass"]] += s.words
    taken = Counter()
    for (i, _), n in at.items():
        taken[i] += n
    assert {r.doc_id: r.taken for r in mixed.documents.collect() if r.taken} == dict(taken)
    # Every beginning of the text holds nearly the share of each source.
    words, seen = Counter(), Counter()
    for r in blocks:
        words[r.source] += r.words
    total, so_far = sum(words.values()), 0
    for r in blocks:
        seen[r.source] += r.words
        so_far += r.words
        for s, n in words.items():
            assert abs(seen[s] - so_far * n / total) <= 12 * block
    assert mixing.mixed_blocks(documents([])).collect() == []
    assert mixing.mixed_blocks(documents([(1, None), (2, " ")])).collect() == []


def test_mix_edges(documents):
    assert mixing.mix(documents([])).documents.collect() == []
    assert mixing.mixed_documents(documents([])).collect() == []
    found = mixing.mix(documents([(1, None), (2, ""), (None, "a b"), (None, "a b")], [None] * 4)).documents.collect()
    assert sum(r.taken for r in found) == 6 and all(r.size == 0 or r.taken <= 4 for r in found)
    half = mixing.mix(documents([(1, "a b c")])).documents.first()  # a target of 4.5 words: half a word counts
    assert (half.target, half.taken) == (4.5, 5)
