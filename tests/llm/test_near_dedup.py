"""The pipeline's near_dedup stage against all pairs' Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from textquarry.llm import alike


def plain_kept(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_pairs_of_similarity_over_08_are_found(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(150, 400))]
        rows.append(words)
        for changes in (1, 3, 6, 9):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "other"
            rows.append(copy)
    rows += [["few", "words"], ["few", "words"], ["few", "others"], []]
    rng.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept, expected = {r.doc_id for r in found.collect()}, set(plain_kept(rows))
    assert expected <= kept  # nothing goes that isn't alike
    assert len(rows) - len(kept) >= 0.95 * (len(rows) - len(expected))


def test_isolated_pairs_are_found_by_similarity(spark):
    """Pairs that no third text helps: the share of those at a similarity that lose one text."""
    rng = random.Random(11)
    rows, bins, pairs = [], {}, 400
    for name, words, changes in (("0.80 to 0.82", 190, 4), ("0.84 to 0.86", 185, 3), ("0.90", 195, 2)):
        for _ in range(pairs):
            text = [f"v{rng.randrange(10**6)}" for _ in range(words)]
            other = list(text)
            places = [20 + k * 35 for k in range(changes)]
            for at in places:
                other[at] = "other"
            same = words - 4 - 5 * changes
            assert 0.8 <= same / (words - 4 + 5 * changes) <= 0.905
            bins.setdefault(name, []).append(len(rows) + 1)
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all(i in kept for i, _ in rows[::2])
    found = {name: sum(i not in kept for i in ids) / pairs for name, ids in bins.items()}
    assert found["0.80 to 0.82"] >= 0.95 and found["0.84 to 0.86"] >= 0.98 and found["0.90"] >= 0.99, found


def test_size_of_fingerprints_follows_the_documents():
    sizes = [alike.size(n) for n in (0, 1000, 256_000, 10**8, 10**10, 10**15)]
    assert sizes == sorted(sizes) and sizes[2] == (32, 29)
    assert all(bits + alike.WORD_BITS <= 64 and tables <= alike.MOST_TABLES for bits, tables in sizes)
    words = [alike._code_word(t) for t in range(alike.MOST_TABLES)]
    assert min((a ^ b).bit_count() for a in words for b in words if a != b) > alike.MOST_BITS and max(words) < 1 << alike.WORD_BITS


def test_rows_that_differ_in_other_columns_alone(spark):
    rows = [(1, "a b c d e f", {"k": str(i)}, i) for i in range(40)] + [(2, "a b c d e f", {"k": "x"}, 0), (3, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>, odd int")
    runs = [sorted(r.asDict()["odd"] for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 2


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    rows = [(r.doc_id, r.text.replace(" ", "x").replace("\x1c", "x")) for r in docs.collect()]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in found.collect()) == plain_kept(rows)


def test_large_groups_lose_no_near_pair(spark, monkeypatch):
    """Four bits in one table put all texts in one group, whose pivot is alike to one other at most."""
    monkeypatch.setattr(alike, "size", lambda documents: (4, 1))
    monkeypatch.setattr(alike, "MEMBERS", 7, raising=False)
    rng, rows = random.Random(3), []
    for k in range(0, 60, 2):
        words = [f"u{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:-2], "others", "now"]))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == set(range(0, 60, 2))


def packed(codes, bits):
    return alike._packed(np.array(codes, alike.U64), bits).tobytes()


def test_codes_go_to_three_tasks_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(alike.simhash, "GROUP", 16)
    rng, copies = random.Random(2), []
    for n in (200, 1600):
        coded = spark.createDataFrame([(k, packed([rng.getrandbits(28) for _ in range(2)], 28)) for k in range(n)], "node long, codes binary")
        sent = coded.mapInArrow(alike._deal(28, 2, alike._upper_bits(n, 28)), "group bigint, sent binary").collect()
        copies.append(sum(len(r.sent) // 12 for r in sent) / n)
    assert copies == [2 * alike.BANDS] * 2  # of two tables


def test_codes_two_bits_apart_meet_wherever_these_are():
    bits, upper = 28, 7
    for a in range(bits):
        codes = [0, 1 << a, 1 << a | 1 << (a + 1 + a * 5 % (bits - 1)) % bits]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([packed([c], bits) for c in codes])], names=["node", "codes"])
        sent = pa.Table.from_batches(list(alike._deal(bits, 1, upper)(iter([batch]))))
        together = set()
        for group in set(sent.column("group").to_pylist()):
            found = alike._find(bits, upper)(sent.filter(pa.array([g == group for g in sent.column("group").to_pylist()])))
            rows = list(zip(found.column("node").to_pylist(), found.column("root").to_pylist(), strict=True))
            together |= {(x, y) for x, r in rows for y, q in rows if x < y and r == q}
        assert together == {(0, 1), (0, 2), (1, 2)}, a


def test_rows_of_a_near_group_that_is_apart_follow_its_members(spark):
    n = 600
    grouped = spark.createDataFrame([(k, 0, 0) for k in range(n)], "node long, code long, root long")
    assert alike.unmet(grouped, spark.createDataFrame([], "node long, root long")).count() == n


def test_pairs_near_by_chance_alone_cost_no_sets(spark):
    """In one table of ten the codes are equal, in all others as far apart as those of any two texts."""
    rng = random.Random(4)
    one = [rng.getrandbits(28) for _ in range(10)]
    other, close = [one[0], *(rng.getrandbits(28) for _ in range(9))], [one[0], *(c ^ 5 for c in one[1:])]
    coded = spark.createDataFrame([(k, packed(c, 28)) for k, c in enumerate((one, other, close))], "node long, codes binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert [tuple(r) for r in alike.likely(pairs, coded, 280).collect()] == [(0, 2)]


def test_small_alike_sets_are_likely_at_any_number_of_bits():
    """Four of five shingles: 0.19 of the bits differ."""
    for bits in (504, 928, 2470, 9744):
        assert 0.1875 * bits + 8 * (bits * 0.1875 * 0.8125) ** 0.5 < alike._most_apart(bits) < 0.5 * bits - 5 * (bits * 0.25) ** 0.5
