"""The manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from rows import DOCS, documents, odd_documents

from sparkloom.llm.merkle import manifest, verify_manifest


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(leaves: list[str], arity: int = 3) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[k : k + arity]) for k in range(0, len(below), arity)])
    return levels


def siblings(levels: list[list[str]], place: int, arity: int = 3) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        first = place - place % arity
        out.append((level[first:place], level[place + 1 : first + arity]))
        place //= arity
    return out


def expected(rows: list[tuple], arity: int = 3) -> Counter:
    groups: dict = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        groups.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), (source, lang, n_chars, text)))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    trees = {s: tree([m[1] for m in groups[s]], arity) for s in keys}
    crown = tree([trees[s][-1][0] for s in keys], arity)
    out: Counter = Counter()
    for k, s in enumerate(keys):
        for place, (doc_id, own, (source, lang, n_chars, text)) in enumerate(groups[s]):
            way = siblings(trees[s], place, arity) + siblings(crown, k, arity)
            h = own
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                h = leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
            for before, after in way:
                h = digest(*before, h, *after)
            root = crown[-1][0]
            out[doc_id, own, trees[s][-1][0], root, digest(*("".join(b + a) for b, a in way)), h, h == root] += 1
    return out


def test_odd_documents_equal_a_plain_tree(spark):
    rows = odd_documents() + [(None, "no\nid", None, "hot", None, "c", 1, 2, 3), (None, None, None, None, None, None, 1, 2, 3), (2, "line\nbreak\n", "xx", "Ärger", 3, "c", 1, 2, 3), (4, "line\nbreak", "xx", "", 3, "c", 1, 2, 3)]
    got = Counter(map(tuple, verify_manifest(documents(spark, rows)).collect()))
    assert got == expected(rows)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("count", [1, 4, 10])
def test_runs_of_every_length(spark, count):
    rows = [(k, f"t{k}\n", "l", "s", 1, "c", 1, 2, 3) for k in range(count)]
    assert Counter(map(tuple, verify_manifest(documents(spark, rows)).collect())) == expected(rows)


def test_many_sources_of_one_document(spark):
    rows = [(k, f"t{k}", "l", f"s{k}", 1, "c", 1, 2, 3) for k in range(40)]
    assert Counter(map(tuple, verify_manifest(documents(spark, rows)).collect())) == expected(rows)


def test_repeated_rows_keep_their_places(spark):
    """One row a hundred times: a third of all leaves are equal, and each has a proof of its own."""
    rows = [(7, "same\n", "l", "s", 1, "c", 1, 2, 3)] * 100 + [(k, f"t{k}", "l", "s", 1, "c", 1, 2, 3) for k in range(200)]
    assert Counter(map(tuple, verify_manifest(documents(spark, rows)).collect())) == expected(rows)


def test_empty_table(spark):
    out = verify_manifest(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.collect() == []


def test_proofs_fold_to_the_root_with_another_arity(spark):
    rows = odd_documents()
    out = manifest(documents(spark, rows), arity=5)
    for r in out.collect():
        h = r.leaf
        for step in r.steps:
            h = digest(step.before.hex(), h, step.after.hex())
        assert h == r.root
        assert r.other_leaf is None
