"""Small documents with everything that goes wrong, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASHING = ("row_key", "key", "id", "turn", "fp", "class", "shingle", "slot", "removed_lines", "words_left", "n_removed",
            "toxicity", "probabilities", "language", "personal", "hash", "size", "shard", "component_id", "Row_Key")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def odd_documents() -> list[tuple]:
    same = prose(1, 60)
    words = same.split()
    near = " ".join(["changed", *words[1:]])
    shared = prose(2, 55)
    texts = [same, same, near, None, "", "   \t\n ", "one", "two words", prose(3, 3000), shared + "\n" + prose(4, 30),
             prose(5, 30) + "\n" + shared, prose(6, 20) + "\n\n" + prose(6, 20), "É é ÀB 漢字 😀 " + prose(7, 12), same.upper(),
             "x" * 50_000, "1" * 5_000 + "@" * 300, "a\rb\x0bc\x0cd", "\n\n\n"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, same, None, None, None), (None, None, None, None, None)]


def documents(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        for name in CLASHING:
            if name.lower() not in {c.lower() for c in df.columns}:
                df = df.selectExpr("*", f"'kept' as `{name}`")
    return df


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def fingerprint(text: str | None) -> int:
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked) -> list[int]:
    """The smallest index reachable from each of n, by links between all pairs for which ``linked(i, j)``."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(line: str) -> frozenset:
    w = words(line)
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def deduplicated(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """Texts by id without the lines that an earlier line matches; ids are distinct and come in order."""
    seen, out = [], {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            s = shingle_set(line)
            if not s:
                kept.append(line)
                continue
            if not any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen):
                kept.append(line)
            seen.append(s)
        out[i] = "\n".join(kept)
    return out
