"""Packing, periodic runs and repair of conversations, each against a plain computation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import pack, periodic, repair
from marquee.llm.queries import QUERIES, damaged, tokenizer_path, with_planted_repeats
from marquee.llm.word_ids import WordEncoder

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_encode_as_whole_texts(tokenizer):
    signs = [*"abcXYZ'' sdtmlvre019.,;:!?-_<|>\n\t\x0b\x0c\x1c\x85\xa0é ÉßſİŉŸǰJ", "̌", "̇"]
    signs += [*"Σσς中文٣²½ªⅣ…“”’—", "​", "Å", "<|endoftext|>", "<|startoftext|>", "'ll", "'ve", " ", " "]
    draw = random.Random(5)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "J̌", "aİ.", " lead", "trail "]
    encoder = WordEncoder(tokenizer_path())
    assert encoder.by_word
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = ["Two  words here.", None, "é\n"]
    ids, sizes = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain.encode(t or "", add_special_tokens=False).ids]
    assert sizes.tolist() == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_and_sequences(documents, tokenizer):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["alpha", "beta.", "é", "x1"]) for _ in range(draw.randint(0, 60)))) for i in range(80)]
    rows += [(7, rows[7][1]), (900, None), (901, ""), (None, "no key"), (902, "long " * 3000)]
    docs = documents(rows).repartition(5)
    stream = pack.placed(pack.tokenized(docs, tokenizer_path())).cache()
    room = 64
    pieces = pack.pieces(stream, room).collect()
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    whole = pack.sequences(stream, room).collect()
    ids = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in whole}
    assert sorted(ids) == list(range(len(ids)))
    assert all(r.n_tokens == len(ids[r.sequence_id]) for r in whole)
    total = sum(len(x) for found in want.values() for x in found)
    assert [len(ids[i]) for i in range(len(ids))] == [room] * (total // room) + [total % room] * (total % room > 0)
    tail = total % room
    assert {r.padded for r in whole if r.n_tokens < room} == ({tail if tail & (tail - 1) == 0 else room} if tail else set())
    filled = {}
    for p in pieces:
        part = ids[p.sequence_id][p.offset : p.offset + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and 0 < p.length <= room - p.offset
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in filled.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    for key, found in want.items():
        mine = sorted((p.start, p.sequence_id, p.offset, p.length, p.doc_tokens) for p in pieces if p.doc_id == key)
        assert {m[4] for m in mine} == {len(x) for x in found}
        if len(found) == 1:
            joined = np.concatenate([ids[s][o : o + n] for _, s, o, n, _ in mine])
            assert joined.tolist() == found[0] and mine[0][0] == 0
        else:
            assert sum(m[3] for m in mine) == sum(map(len, found))
    again = pack.pieces(pack.placed(pack.tokenized(docs, tokenizer_path())), room)
    assert sorted(map(str, again.collect())) == sorted(map(str, pieces))


def test_pack_empty_table(documents):
    stream = pack.placed(pack.tokenized(documents([]), tokenizer_path()))
    assert pack.pieces(stream).collect() == [] and pack.sequences(stream).collect() == []


def test_pack_query(spark, tokenizer):
    pieces = QUERIES["op13_pack_sequences"](spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {p.doc_id for p in pieces} == set(docs)
    for p in pieces[:300]:
        ids = [*tokenizer.encode(docs[p.doc_id] or "", add_special_tokens=False).ids, 2]
        part = np.array(ids[p.start : p.start + p.length], dtype="<u4")
        assert (len(part), p.doc_tokens) == (p.length, len(ids)) and zlib.crc32(part.tobytes()) == p.ids_crc32


def plain_runs(words, shortest=6, times=4):
    """All runs by trying every start and period."""
    out, n = [], len(words)
    for s in range(n):
        for q in range(1, (n - s) // times + 1):
            if s and words[s - 1] == words[s - 1 + q]:
                continue
            t = s
            while t + q < n and words[t] == words[t + q]:
                t += 1
            size = t - s + q
            smaller = any(all(words[i] == words[i + p] for i in range(s, s + size - p)) for p in range(1, q))
            if size >= max(shortest, times * q) and not smaller:
                out.append((s, size, q))
    return out


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeated_words(draw):
    words, k, size = [], draw.choice([1, 2, 3, 5]), draw.randint(0, 90)
    while len(words) < size:
        if draw.random() < 0.5:
            period = [draw.randint(0, k) for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16]))]
            words += (period * 9)[: len(period) * draw.randint(3, 6) + draw.randint(0, len(period))]
        else:
            words += [draw.randint(0, k) for _ in range(draw.randint(0, 9))]
    return words


@pytest.mark.parametrize("pairs", [7, 2_000_000])
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    draw, seen = random.Random(11), 0
    for _ in range(120):
        texts = [repeated_words(draw) for _ in range(draw.randint(1, 4))]
        codes = np.array([w for t in texts for w in t], dtype=np.int64)
        got = periodic.find_runs(codes, np.array([len(t) for t in texts]))
        want, base = [], 0
        for t in texts:
            want += [(s + base, n, q) for s, n, q in plain_runs(t)]
            base += len(t)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))
        seen += len(want)
    assert seen > 150


def test_runs_of_long_texts():
    for words, want in (
        (np.zeros(200_000, dtype=np.int64), [(0, 200_000, 1)]),
        (np.arange(200_000) % 30_000, [(0, 200_000, 30_000)]),
        (np.arange(200_000) % 70_000, []),
    ):
        assert [tuple(r) for r in periodic.find_runs(words, np.array([len(words)])).tolist()] == want


def test_runs_of_documents(documents):
    draw = random.Random(4)
    rows = [(i, " ".join(["w "]) + " ".join(f"w{w}" for w in repeated_words(draw))) for i in range(60)]
    rows += [(1, rows[1][1]), (100, None), (101, ""), (102, " \t\x0b\n"), (None, "a " * 6), (103, "\x0ba\x0ca\ta\ra a  a\n"), (104, "a a a a a")]
    got = periodic.periodic_runs(documents(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(plain_runs(w := WORD.findall(t or ""))), collapse(w, plain_runs(w)), len(w)) for i, t in rows)
    assert sorted((str(r.doc_id), str([tuple(x) for x in r.runs]), r.collapsed, r.n_words) for r in got) == want
    assert periodic.periodic_runs(documents([])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(documents([]), exponent=3)


def test_periodic_runs_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in with_planted_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            assert WORD.findall(texts[doc_id]) == words
            planted += 1
        if n > 400:
            continue  # the plain way is cubic
        runs = plain_runs(words)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 5


def cheapest(rows):
    """(cost, audit) by trying all edits, at most two insertions in a row."""
    found, limit = [], [10**9]

    def go(i, state, cost, audit, inserted):
        if cost > limit[0]:
            return
        if i == len(rows) and state in repair.ACCEPTING:
            found.append((cost, audit))
            limit[0] = cost
        follow = repair.NEXT[state]
        if inserted < 2:
            for r in "ua":
                if r in follow:
                    go(i, follow[r], cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", 0)
            if fault in (repair.SOUND, repair.CUT):
                extra = 3 if fault == repair.CUT else 0
                if role in follow:
                    go(i + 1, follow[role], cost + extra, audit + "K", 0)
                for r in "ua":
                    if r in follow:
                        go(i + 1, follow[r], cost + extra + 3, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def test_agenda_finds_the_least_derivation():
    draw = random.Random(8)
    for _ in range(300):
        rows = [(draw.choice("suuaax "), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randint(0, 7))]
        assert repair.lightest(rows) == cheapest(rows), rows
    long = repair.lightest([("u", 0)] * 5000)
    assert long[0] == 3 * 2500 and len(long[1]) == 5000


def plain_repair(rows):
    """The contract's columns for (turn, role, text) rows that are there."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = WORD.findall(text)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1][-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    cost, audit = cheapest(list(zip(initials, faults, strict=True)))
    out, state, at = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit != "D":
            if edit != "K":
                role = "assistant" if state == 2 else "user"
            state = repair.NEXT[state][role[0]]
            out.append(f"{role}:{text}")
    return (gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_odd_rows(spark):
    draw, rows = random.Random(6), []
    for c in [*range(60), None]:
        for _ in range(draw.randint(1, 6)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "cut", "", " \x0b", "Why? \n", "Yes.", None, "é"])
            rows.append((c, draw.choice([0, 1, 2, 3, 5, None]), role, text, 1, draw.random() < 0.9))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _key int, kept boolean")
    got = repair.repair(table, present=F.col("kept")).collect()
    want = {}
    for c, turn, role, text, _, kept in rows:
        want.setdefault(c, [])
        if kept:
            want[c].append((turn, " " if role is None else role, " " if text is None else text))
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == {c: plain_repair(found) for c, found in want.items()}
    assert len(got) == len(want)
    reviewed = repair.review(table, present=F.col("kept"))
    turns = repair.repaired_turns(table, reviewed, present=F.col("kept")).collect()
    by = {}
    for t in sorted(turns, key=lambda t: t.position):
        by.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for r in got:
        assert hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in by.get(r.conv_id, [])))
    assert repair.repair(table.limit(0), present=F.col("kept")).collect() == []


def test_repair_query(spark):
    rows, want = spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), {}
    for r in rows:
        case = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role = "user" if case == 4 else r.role
        text = "" if case == 1 else re.sub("[.!?]", "", r.text) if case == 2 else r.text
        want.setdefault(r.conv_id, []).extend([(r.turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1))
    got = QUERIES["op12_repair_conversations"](spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        if len(want[r.conv_id]) <= 6:
            assert tuple(r[f] for f in FIELDS) == plain_repair(want[r.conv_id]), r.conv_id


def test_damage_of_nulls(spark):
    rows = [(None, None, None, None), (1, None, "user", None), (None, 4, None, "a.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if case == 4 else role or " ", "" if case == 1 else text or " "
        text = re.sub("[.!?]", "", text) if case == 2 else text
        want += [(conv, turn, role, text, case != 0)] * (2 if case == 3 else 1)
    assert sorted(map(str, map(tuple, damaged(table).collect()))) == sorted(map(str, want))
