"""Vector codes, ranked search and passages against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import elkan, lexical, relz

DOCS = "doc_id long, text string, id string, item long, score string, key string, own int"
VECTORS = "vec_id long, embedding array<float>, label string, id int, x string, code int, error string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rows], DOCS)


# passages


def plain_passages(rows, width=13):
    """Per row: words and which of them a window that starts at a smaller place covers; null ids are least."""
    order = lambda i: (i is not None, i or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least: dict = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < order(i):
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


def got_passages(df, **settings):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in relz.remove_passages(df, **settings).collect())


def planted(seed, n=120):
    """Texts of few words with passages of others, cut at random, some repeated in their own text."""
    draw = random.Random(seed)
    passages = [[f"p{k}x{j}" for j in range(draw.randrange(8, 60))] for k in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randrange(5)):
            words += [f"w{draw.randrange(40)}" for _ in range(draw.randrange(20))]
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            words += p[a : a + draw.randrange(5, 60)] * draw.choice((1, 1, 2))
        rows.append((i, draw.choice((" ", "\n", " \t ")).join(words)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, relz.HOT), (2, relz.HOT), (3, 3), (4, 0)])
def test_passages_are_brute_force(spark, seed, hot):
    rows = planted(seed)
    assert got_passages(docs_of(spark, rows).repartition(5), hot=hot) == plain_passages(rows)


def test_passages_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (None, text), (None, "x " + text), (-7, text), (3, None), (4, ""), (6, " \n\t "), (7, "again " * 40), (8, "again " * 13), (9, "ü ß\x0b" * 20), (1, "word " * 12)]
    assert got_passages(docs_of(spark, rows)) == plain_passages(rows)
    assert got_passages(docs_of(spark, rows), hot=1) == plain_passages(rows)
    assert relz.remove_passages(docs_of(spark, [])).count() == 0


def test_long_texts_are_hashed_whole(monkeypatch):
    raw = ("some words of a text\tand a-very-long-word-" + "y" * 300 + "\nmore ").encode() * 5
    whole = relz.word_hashes([raw], relz.Powers())[0]
    for chunk in (7, 64, 1000):
        monkeypatch.setattr(relz, "CHUNK", chunk)
        assert np.array_equal(relz.hashed_words(raw, relz.Powers()), whole)


def test_factors_and_their_ends():
    """A window across two factors is found though neither factor holds it."""
    block = relz.Block(3)
    assert block.take(b"a b c d ", 1) == []
    assert block.take(b"d e f g ", 2) == []
    assert block.take(b"c d e ", 3) == []
    # a b c d, then d e f of another text; c d e stands across
    spans = block.take(b"a b c d e f z ", 4)
    assert (0, 4) in spans and (2, 5) in spans and relz._merged(spans) == [(0, 6)]
    assert block.take(b"a b c d e f z ", 5) == [(0, 7)]
    assert block.take(b"z a b c ", 1) == []


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else i, -s] += 1
    return out


def got_search(spark, docs, items, **settings):
    found = lexical.search(docs_of(spark, docs).repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), **settings)
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect())


@pytest.mark.parametrize(("block", "chunk"), [(lexical.BLOCK_BYTES, lexical.CHUNK), (40, 60)])
def test_search_is_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    draw = random.Random(7)
    word = lambda: draw.choice(("the", "The", "ÄÖ", "äö", "x1", "x-2", "É9", "rare")) if draw.random() < 0.5 else f"w{int(draw.expovariate(0.05))}"
    docs = [(i, " ".join(word() for _ in range(draw.randrange(60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[3][1]), (None, docs[3][1]), (400, None), (401, ""), (402, " .,; "), (403, "the " * 500)]
    items = [(i, " ".join(word() for _ in range(draw.randrange(12)))) for i in range(12)]
    items += [(50, docs[3][1]), (51, docs[3][1]), (51, docs[5][1]), (52, None), (53, "--"), (None, "the w1"), (54, "the the THE")]
    want = plain_search(docs, items)
    assert got_search(spark, docs, items, block_bytes=block) == want
    assert sum(want.values()) > 100


def test_search_of_empty_tables(spark):
    assert not got_search(spark, [], [(1, "a")]) and not got_search(spark, [(1, "a")], []) and not got_search(spark, [(1, None)], [(1, "a")])


def test_terms_of_equal_hash_are_told_apart():
    """A found term counts only if its bytes are those of the vocabulary's."""
    vocabulary = lexical.Vocabulary([b"one", b"two", b"seven"])
    raw = np.frombuffer(b"two oneseven seven one", np.uint8)
    starts, lengths, hashes = lexical.find_terms(raw, lexical.Powers())
    hit, number = vocabulary.look_up(raw, starts, lengths, hashes)
    assert hit.tolist() == [0, 2, 3] and number.tolist() == [1, 2, 0]
    forged = hashes.copy()
    forged[3] = hashes[0]  # as long as "two", and of its hash, but other bytes
    assert vocabulary.look_up(raw, starts, lengths, forged)[0].tolist() == [0, 2]


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """Lloyd by all distances, in Python's integers."""
    rows = sorted((i, [math.floor(256 * x) for x in v]) for i, v in rows)
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(v, p)[1] for p in range(parts)] for _, v in rows]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v), c in zip(rows, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, [nearest(v, p) for p in range(parts)]) for i, v in rows]
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found}, digest


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, "a", 2, "b") for i, v, g in rows], VECTORS)


@pytest.mark.parametrize(("seed", "grid"), [(1, 0), (2, 4), (3, 1)])
def test_codes_are_brute_force(spark, seed, grid):
    """Coarse grids make ties and equal entries."""
    draw = np.random.default_rng(seed)
    data = draw.normal(size=(300, 8))
    data = np.round(data * grid) / grid if grid else data
    data = data.astype(np.float32).tolist()
    rows = [(i * 3 - 50, v, str(i % 3) if i % 4 else None) for i, v in enumerate(data)]
    want, digest = plain_codes([(i, v) for i, v, _ in rows], 4, 16, 3)
    got = elkan.vector_codes(vectors_of(spark, rows).repartition(5), parts=4, entries=16, rounds=3).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    by_label: Counter = Counter()
    for i, _, g in rows:
        by_label[g] += want[i][1]
    label = {i: g for i, _, g in rows}
    assert all(r.label_error == by_label[label[r.vec_id]] for r in got)


def test_bounds_prune(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(10, 16)) * 5
    data = centres[draw.integers(0, 10, 2000)] + draw.normal(size=(2000, 16)) * 0.2
    df = vectors_of(spark, [(i, v, None) for i, v in enumerate(data.astype(np.float32).tolist())])
    _, _, looked = elkan.fit_codes(elkan.kept(df, "vec_id", "embedding", "label"), parts=4, entries=32, rounds=4)
    assert len(looked) == 4 and all(n < 0.6 * 2000 * 4 * 32 for n in looked) and looked[-1] < 0.35 * 2000 * 4 * 32


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(4, [1.0, -1.0, 0.5, 0.25], "a"), (2, [0.0, 0.0, 0.0, -0.001], None), (2, [3.0, 0.0, 0.0, 0.0], "a"), (None, [9.0, 9.0, 9.0, 9.0], None)]
    bad = [(1, None, "a"), (0, [1.0, None, 0.0, 0.0], "a"), (7, [nan, 0.0, 0.0, 0.0], None), (8, [0.0, -inf, 0.0, 0.0], "b")]
    rows = elkan.vector_codes(vectors_of(spark, good + bad + [(9, [1.0], "a"), (9, [], None)]), parts=2, entries=3, rounds=2).collect()
    assert Counter(r.vec_id for r in rows) == {4: 1, 2: 2, None: 1, 9: 2}
    assert all((r.code is None) == (r.error is None) == (r.vec_id == 9) for r in rows)
    # 4 and one of the rows of id 2 share a label with a row of another length
    of_a = [r for r in rows if r.vec_id == 4 or r.label_error == next(x.label_error for x in rows if x.vec_id == 4)]
    assert len(of_a) == 3 and sum(r.error or 0 for r in of_a) == of_a[0].label_error
    assert elkan.vector_codes(vectors_of(spark, []), parts=2).count() == 0 and elkan.vector_codes(vectors_of(spark, bad), parts=2).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        elkan.vector_codes(vectors_of(spark, [(1, [1.0, 2.0, 3.0], "a")]), parts=2)
