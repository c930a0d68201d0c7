"""Toxicity: a lexicon trie met with Levenshtein automata, and the context of each hit."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrays import joined_codes, parts, runs
from marquee.llm.labelled import held_out, labelled, sample
from marquee.session import durable

#: Terms known without labels; labelled texts add theirs.
SEED_TERMS = (
    "bastard", "clown", "dimwit", "disgusting", "dumbass", "filthy", "halfwit", "idiot", "imbecile",
    "jackass", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)
#: Ordinary words within one edit of a seed term.
ORDINARY = frozenset(
    "brash clone closer clowns crash crown crowns flown losers lower loner loosen looser loses lose "
    "apathetic bathetic boron crash cum dastard laser lover moser oser rash scrum slum stash sum swum "
    "maroon moor morons stupor thrash scam scums scud spumes closed poser posers verein vereine".split()
) - {"losers", "morons", "clowns"}
#: Words that announce a quotation or speak about words; words that address somebody.
MENTION = frozenset(
    "word words term terms called calling quote quoted quotes quoting said says saying wrote writes insult "
    "insults slur slurs phrase expression mot mots terme insulte wort begriff zitat schimpfwort palabra "
    "palabras término insulto cita".split()
)
ADDRESS = frozenset("you you're youre your yours u ur tu vous du dich ihr eres usted".split())
OPENING, CLOSING = "\"'“„‘«‹`", "\"'”“’»›`"
#: Characters on either side of a hit that belong to its context, and words for the cues.
WINDOW_CHARS, WINDOW_WORDS = 80, 6
#: What a quoted hit counts beside an abusive one.
QUOTED = 0.3
#: Prior probability that an abusive hit means a toxic text, by edit distance; its weight in
#: texts against a form's own count, and in forms against those of the same distance.
PRIOR, PRIOR_WEIGHT, PRIOR_FORMS = (0.95, 0.85, 0.75), 4.0, 20
#: A term is learnt from at least this many places in toxic texts, at least this share of the
#: number of such texts, and if at least this share of its places is in toxic texts.  Places
#: with the same neighbouring words count once, so copies of one text teach no more than it.
TERM_PLACES, TERM_SHARE, TERM_TOXIC = 5, 0.02, 0.9
#: At most so many learnt terms, the most frequent ones.
TERMS = 500
#: Labelled rows of each label from which terms are learnt, at most.
TRAINING_ROWS = 20_000

LETTERS = 26
OTHER = LETTERS + 1  # a character that is no letter a-z but stands inside a word
EITHER = LETTERS + 2  # 1 and !, written for i or l
DROP = LETTERS + 3
SYMBOLS = LETTERS + 3
TABLE = 0x2500
#: Digits and signs written for letters, and Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = dict(
    zip("03457@$аеорсхуіΑοεικ", "oeastasaeopcxyiaoeik", strict=True)
)


def edits_allowed(term: str) -> int:
    """No edit in terms of up to three letters, one up to eight, else two."""
    return 0 if len(term) <= 3 else 1 if len(term) <= 8 else 2


class Automaton(NamedTuple):
    """next[state, symbol]; found[state]: (term, distance) or None; state 0 is dead, 1 the start."""

    terms: list[str]
    next: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    longest: int


def build(terms: Iterable[str]) -> Automaton:
    """The product of a trie of the terms with the Levenshtein automata of its paths.

    A state of the product holds pairs of trie node and edits so far (insertions, deletions,
    substitutions, and swaps of neighbours); sets of them become the states of one table.
    Branches whose terms allow no further edit end there, so no term is visited by itself.
    """
    terms = sorted(set(terms))
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    allowed = [0]
    for number, term in enumerate(terms):
        node = 0
        allowed[0] = max(allowed[0], edits_allowed(term))
        for letter in term:
            symbol = ord(letter) - 96
            if symbol not in children[node]:
                children[node][symbol] = len(children)
                children.append({})
                allowed.append(0)
            node = children[node][symbol]
            allowed[node] = max(allowed[node], edits_allowed(term))
        ends[node] = number

    def close(states: set) -> frozenset:
        """Add what deletions reach; keep the fewest edits of each node."""
        best: dict = {}
        work = list(states)
        while work:
            node, edits, swap = work.pop()
            if edits > allowed[node] or best.get((node, swap), 9) <= edits:
                continue
            best[node, swap] = edits
            if not swap:
                work += [(child, edits + 1, 0) for child in children[node].values()]
        return frozenset((node, edits, swap) for (node, swap), edits in best.items())

    def step(states: frozenset, symbol: int) -> frozenset:
        out = set()
        letters = (ord("i") - 96, ord("l") - 96) if symbol == EITHER else (symbol,)
        for node, edits, swap in states:
            if swap:
                if swap in letters:
                    out.add((node, edits, 0))
                continue
            out.update((children[node][x], edits, 0) for x in letters if x in children[node])
            if edits < allowed[node]:
                out.add((node, edits + 1, 0))
                for letter, child in children[node].items():
                    out.add((child, edits + 1, 0))
                    out.update((children[child][x], edits + 1, letter) for x in letters if x in children[child])
        return close(out)

    start = close({(0, 0, 0)})
    numbers = {frozenset(): 0, start: 1}
    order = [frozenset(), start]
    rows = [[0] * SYMBOLS]
    at = 1
    while at < len(order):
        row = [0]
        for symbol in range(1, SYMBOLS):
            target = step(order[at], symbol)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
        at += 1
    found = []
    for states in order:
        hits = [
            (edits, ends[node])
            for node, edits, swap in states
            if not swap and node in ends and edits <= edits_allowed(terms[ends[node]])
        ]
        found.append(min(hits, default=(-1, -1)))
    longest = max((len(t) + edits_allowed(t) for t in terms), default=0)
    return Automaton(
        terms,
        np.array(rows, dtype=np.int32),
        np.array([f[1] for f in found], dtype=np.int32),
        np.array([f[0] for f in found], dtype=np.int8),
        longest,
    )


def _symbols() -> np.ndarray:
    """Symbol of each code point: letters without case and accents; 0 separates words."""
    table = np.zeros(TABLE + 1, dtype=np.uint8)
    for code in range(TABLE):
        char = chr(code)
        if char in LOOKALIKE:
            char = LOOKALIKE[char]
        elif category := unicodedata.category(char):
            if category in ("Mn", "Cf"):
                table[code] = DROP
                continue
            if category[0] != "L" and category != "Nd":
                continue
        base = unicodedata.normalize("NFKD", char)[0].lower()
        table[code] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    table[ord("*")] = OTHER
    table[ord("1")] = EITHER
    table[TABLE] = 0
    return table


def find(texts: list[str], automaton: Automaton, symbols: np.ndarray) -> Iterator[tuple[int, str, int, int, bool]]:
    """Hits of whole texts: (text, form, term, distance, quoted)."""
    for a, b in parts(texts):
        codes, bounds = joined_codes(texts[a:b])
        seen = symbols[np.minimum(codes, TABLE)]
        # Signs written for letters count only between letters, and a sign stands alone there.
        signs = np.isin(codes, [ord("*"), ord("$"), ord("@")])
        left, right = np.roll(codes, 1), np.roll(codes, -1)
        alone = (symbols[np.minimum(right, TABLE)] > 0) & (right != codes) & (left != codes) & ~np.roll(signs, -1)
        seen = np.where(signs & ~alone, 0, seen)
        place = np.flatnonzero(seen != DROP)
        seen, marks = seen[place], codes[place] == ord("!")
        begins, ends = runs(seen > 0)
        # Words are read with ! between them, and again with ! as a letter where one follows.
        marked = np.zeros(len(begins), dtype=bool)
        marks &= (np.roll(seen, -1) > 0) & ~np.roll(marks, -1) & ~np.roll(marks, 1)
        if marks.any():
            seen = np.where(marks, EITHER, seen)
            before = np.concatenate(([0], np.cumsum(marks)))
            more, ends_more = runs(seen > 0)
            other = before[ends_more] > before[more]
            begins = np.concatenate((begins, more[other]))
            ends = np.concatenate((ends, ends_more[other]))
            marked = np.concatenate((marked, np.ones(np.count_nonzero(other), dtype=bool)))
        lengths = ends - begins
        keep = lengths <= automaton.longest
        begins, lengths, marked = begins[keep], lengths[keep], marked[keep]
        state = np.ones(len(begins), dtype=np.int32)
        live = np.arange(len(begins))
        hits = []
        for depth in range(automaton.longest):
            live = live[lengths[live] > depth]
            state[live] = automaton.next[state[live], seen[begins[live] + depth]]
            live = live[state[live] > 0]
            done = live[lengths[live] == depth + 1]
            hits.append(done[automaton.term[state[done]] >= 0])
        found = np.sort(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
        # Of the two readings of a place the one with fewer edits counts, or that without !.
        for hit in found[marked[found]]:
            within = found[(begins[found] >= begins[hit]) & (begins[found] < begins[hit] + lengths[hit]) & ~marked[found]]
            near = automaton.distance[state[within]].min(initial=9) <= automaton.distance[state[hit]]
            found = np.setdiff1d(found, [hit] if near else within)
        for hit in found:
            first, last = place[begins[hit]], place[begins[hit] + lengths[hit] - 1] + 1
            text = int(np.searchsorted(bounds, first, side="right")) - 1
            offset = bounds[text]
            body = texts[a + text]
            form = body[first - offset : last - offset].lower()
            if form in ORDINARY:
                continue
            yield a + text, form, int(automaton.term[state[hit]]), int(automaton.distance[state[hit]]), is_quoted(
                body, int(first - offset), int(last - offset)
            )


def is_quoted(text: str, first: int, last: int) -> bool:
    """Whether the window around a hit speaks about the term rather than using it.

    Quotation marks on both sides within the sentence count 2, each word of speaking about
    words before the hit 1; against them counts each word that addresses somebody.
    """
    before, after = text[max(0, first - WINDOW_CHARS) : first], text[last : last + WINDOW_CHARS]
    before, after = re.split(r"[.!?\n]", before)[-1], re.split(r"[.!?\n]", after)[0]
    opens = re.search(rf"(?:^|[\s(])[{OPENING}][^{CLOSING}]*$", before)
    closes = re.search(rf"^[^{OPENING}]*?[{CLOSING}](?:\W|$)", after)
    words = [w.strip(",;:()") for w in before.lower().split()[-WINDOW_WORDS:]]
    near = words + [w.strip(",;:()") for w in after.lower().split()[:WINDOW_WORDS]]
    mention = 2 * bool(opens and closes) + sum(w in MENTION for w in words)
    return mention > sum(w in ADDRESS for w in near)


def learn_terms(docs: DataFrame, known: DataFrame, key: str, text: str) -> list[str]:
    """Terms that mark toxic texts in a bounded sample of the training rows."""
    chosen = sample(known.where("NOT _held_out"), "_label", TRAINING_ROWS).select("_id", "_label")
    chosen = durable(chosen)
    toxic = chosen.where("_label = 1").count()
    if not toxic:
        return []
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\s]+"), F.lit(0))
    # At most 2 * TRAINING_ROWS rows.
    taught = docs.join(F.broadcast(chosen), docs[key] == chosen["_id"]).select("_label", words.alias("_w"))
    zipped = F.arrays_zip(
        F.concat(F.array(F.lit("")), "_w").alias("before"),
        F.col("_w").alias("word"),
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("after"),
    )
    words = (
        taught.select("_label", F.explode(zipped).alias("_z"))
        .select(
            F.regexp_extract("_z.word", r"^\W*([a-z]{4,20})\W*$", 1).alias("_word"),
            F.xxhash64("_z.before", "_z.after").alias("_around"),
            "_label",
        )
        .where("_word != ''")
        .groupBy("_word", "_around")
        .agg(F.max("_label").alias("_label"))
        .groupBy("_word")
        .agg(F.sum("_label").alias("_toxic"), F.count("*").alias("_places"))
    )
    least = max(TERM_PLACES, math.ceil(TERM_SHARE * toxic))
    marking = words.where((F.col("_toxic") >= least) & (F.col("_toxic") >= TERM_TOXIC * F.col("_places")))
    rows = marking.orderBy(F.desc("_toxic"), "_word").limit(TERMS).collect()
    return [r["_word"] for r in rows]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """One row per document: key, held_out, score, predicted, hits, quoted_hits.

    The lexicon is SEED_TERMS and the terms that mark toxic texts among at most TRAINING_ROWS
    training rows of either label.  Every word of every whole text runs through the automaton
    of the lexicon; each hit, misspelt ones included, is judged by the window around it as
    abuse or as quotation.  How often a form of a term means a toxic text is counted over all
    training rows and smoothed towards its edit distance's.  The score joins the different
    abusive forms as independent reasons; quoted ones together count QUOTED of the strongest.

    Training rows are those whose crc32 of the key as text is no multiple of 5 (a null key
    counts as an empty text).  A text without hits, also a null or empty one, scores the share
    of toxic texts among such training rows.  Without labels the priors serve.  Labels of one key
    count once, the largest; repeated documents score alike.  Other columns are ignored.
    """
    known = durable(labelled(labels, key, label))
    terms = [*SEED_TERMS, *learn_terms(docs, known, key, text)]
    automaton, symbols = build(terms), _symbols()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["_text"]]
            per_text = defaultdict(list)
            for at, *hit in find(texts, automaton, symbols):
                per_text[at].append(hit)
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "_forms": [[h[0] for h in per_text[i]] for i in range(len(texts))],
                    "_distances": [[h[2] for h in per_text[i]] for i in range(len(texts))],
                    "_quoted": [[h[3] for h in per_text[i]] for i in range(len(texts))],
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    hits = durable(
        docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(
            search, f"_id {kind}, _forms array<string>, _distances array<int>, _quoted array<boolean>"
        )
    )
    # A row per training text and form that occurs in it as abuse.
    training = hits.join(known.where("NOT _held_out"), "_id")
    pairs = F.arrays_zip("_forms", "_distances", "_quoted")
    abuse = training.select(
        "_label", F.explode(F.array_distinct(F.filter(pairs, lambda h: ~h["_quoted"]))).alias("_hit")
    )
    counts = (
        abuse.groupBy("_hit._forms", "_hit._distances")
        .agg(F.sum("_label").alias("toxic"), F.count("*").alias("texts"))
        .where("texts >= 2")
        .collect()  # forms within two edits of at most TERMS + len(SEED_TERMS) terms
    )
    none = training.where(F.size("_forms") == 0).agg(F.sum("_label"), F.count("*")).first()
    base = ((none[0] or 0) + 0.02) / (none[1] + 2)
    by_distance = []
    for d, prior in enumerate(PRIOR):
        # Every form counts once: frequent forms speak for themselves, not for others.
        shares = [c["toxic"] / c["texts"] for c in counts if c["_distances"] == d]
        by_distance.append((sum(shares) + prior * PRIOR_FORMS) / (len(shares) + PRIOR_FORMS))
    chance = {
        c["_forms"]: (c["toxic"] + PRIOR_WEIGHT * by_distance[c["_distances"]]) / (c["texts"] + PRIOR_WEIGHT)
        for c in counts
    }

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, abusive, quotes = [], [], []
            for forms, distances, quoted in zip(batch["_forms"], batch["_distances"], batch["_quoted"], strict=True):
                clean, mention = 1.0 - base, 0.0
                n = sum(not q for q in quoted)
                for form, distance, in_quotes in set(zip(forms, distances, quoted, strict=True)):
                    p = chance.get(form, by_distance[distance])
                    if in_quotes:
                        mention = max(mention, p * QUOTED)
                    else:
                        clean *= 1.0 - min(p, 0.999)
                scores.append(1.0 - clean * (1.0 - mention))
                abusive.append(n)
                quotes.append(len(forms) - n)
            yield pd.DataFrame({key: batch["_id"], "score": scores, "hits": abusive, "quoted_hits": quotes})

    scored = hits.mapInPandas(score, f"`{key}` {kind}, score double, hits int, quoted_hits int")
    return scored.select(
        key,
        held_out(key).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits",
        "quoted_hits",
    )
