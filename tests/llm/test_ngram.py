"""The language model against a plain dictionary version."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import pytest
from rows import documents, odd_documents, words

from sparkloom.llm.ngram import score, score_documents, train

END = object()


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2 - 3 * y * n[2] / n[1])
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def model(texts):
    """(word, two words before) -> probability, by the formulas of interpolated modified Kneser-Ney; and the unigram counts."""
    unigrams, triples = Counter(), Counter()
    for t in texts:
        seq = [*words(t), END]
        unigrams.update(seq)
        triples.update(zip([END, END, *seq], [END, *seq], seq))
    pairs, left = Counter((b, c) for _, b, c in triples), Counter()
    left.update(c for _, c in pairs)
    after3, after2 = defaultdict(list), defaultdict(list)
    for (a, b, _), n in triples.items():
        after3[a, b].append(n)
    for (b, _), n in pairs.items():
        after2[b].append(n)
    d3, d2, d1 = (discounts(x.values()) for x in (triples, pairs, left))
    cut = lambda c, ds: ds[min(c, 3) - 1]
    v = len(unigrams)

    def level(n, follow, ds, lower):
        if not follow:
            return lower
        return ((n - cut(n, ds)) if n else 0) / sum(follow) + sum(cut(x, ds) for x in follow) / sum(follow) * lower

    def p(w, before):
        low = ((left[w] - cut(left[w], d1)) / len(pairs) if left[w] else 0.0) + sum(cut(c, d1) for c in left.values()) / len(pairs) / (v + 1) if pairs else 1.0
        two = level(pairs[before[1], w], after2.get(before[1]), d2, low)
        return level(triples[(*before, w)], after3.get(before), d3, two)

    return p, unigrams


def contexts(seq):
    return zip([END, END, *seq], [END, *seq])


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_scores_equal_plain_version(spark):
    rows = odd_documents()
    p, unigrams = model([r[1] for r in rows if not held(r[0])])
    n, v = sum(unigrams.values()), len(unigrams)
    got = defaultdict(list)
    for r in score_documents(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert any(held(r[0]) for r in rows)
    for row in rows:
        seq = [*words(row[1]), END]
        base = sum(math.log10((unigrams.get(w, 0) + 1) / (n + v + 1)) for w in seq)
        want = sum(math.log10(p(w, before)) for w, before in zip(seq, contexts(seq)))
        r = next(x for x in got[row[0]] if x.n_tokens == len(seq))
        assert r.held_out == held(row[0])
        assert (r.n_known, r.train_tokens) == (sum(w in unigrams for w in seq), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(want, rel=1e-5)


def test_probabilities_of_a_context_sum_to_one(spark):
    """Over all known words, the end, and the one place for unknown words."""
    texts = ["a b a c", "b a b", "c c a", "d", "a b", ""]
    rows = [(k, t, "", "s", 0, "", 0, 0, 0) for k, t in enumerate(texts)]
    p, unigrams = model(texts)
    for before in product([END, *"abcd", "never"], repeat=2):
        assert sum(p(w, before) for w in [*unigrams, "never"]) == pytest.approx(1)
    m = train(documents(spark, rows), shard_tokens=2)
    got = {r.text: r.score for r in score(documents(spark, [(9, t, "", "s", 0, "", 0, 0, 0) for t in ("a", "d x", "c b")]), m, "text").collect()}
    for text in ("a", "d x", "c b"):
        seq = [*text.split(), END]
        assert got[text] == pytest.approx(sum(math.log10(p(w, b)) for w, b in zip(seq, contexts(seq))), rel=1e-5)
    m.delete()


def test_many_slices_and_files_change_nothing(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.ngram.MOST_FILES", 4)
    rows = odd_documents()[:-2]
    docs = documents(spark, rows)
    few, many = train(docs), train(docs, shard_tokens=60)
    assert many.cut.files == 4 and many.cut.slices_a_file > 8
    first, second = (sorted((r.doc_id, r.n_known, r.score) for r in score(docs, m, "doc_id").collect()) for m in (few, many))
    assert [x[:2] for x in first] == [x[:2] for x in second]
    assert [x[2] for x in first] == pytest.approx([x[2] for x in second], rel=1e-12)
    assert sum(f.stat().st_size > 0 for f in Path(many.folder).iterdir()) < 80
    few.delete()
    many.delete()


def test_better_than_the_base_on_held_out_driver_documents(spark, sf_dir):
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").collect()
    assert out
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_no_training_text_and_empty_table(spark):
    assert score_documents(documents(spark, [])).collect() == []
    out_id = next(k for k in range(100) if held(k))
    (r,) = score_documents(documents(spark, [(out_id, "a b", "", "s", 0, "", 0, 0, 0)])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
