"""Small tables with the odd cases that every operator must bear, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, size long, _copies int, slice int"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(n: int, links) -> list[int]:
    """For each of n items the least item that links reach."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def odd_documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Documents with null and empty texts, exact and near copies, one very long text, repeated rows, null sources and odd spaces."""
    rng = random.Random(seed)
    vocabulary = ["wort%d" % k for k in range(400)] + ["Ärger", "naïve", "日本", "emoji😀", "a,b", "X.", "tab"]
    texts: list[str | None] = [None, "", "   \t\n", "one", "One TWO three", "a b c d", "a b c d e", "A b C d E", "🙂" * 7, "x y z", "x y"]
    for _ in range(n):
        texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([6, 30, 80, 200]))))
    for k in range(12, 30):
        w = (texts[k] or "x").split(" ")
        w[rng.randrange(len(w))] = "CHANGED"
        texts.append("  ".join(w) if k % 2 else " ".join(w))
    texts += [texts[15], texts[15], texts[20], " ".join(rng.choices(vocabulary, k=30_000))]
    rows = []
    for k, t in enumerate(texts):
        source = None if k % 11 == 3 else ("hot" if k % 3 else f"s{k % 5}")
        rows.append((1000 - 7 * k, t, "xx", source, len(t or ""), "c", 1, 2, 3))
    rows.append(rows[14])  # one row twice
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, DOCS)
