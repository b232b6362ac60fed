"""A small corpus with every awkward case, and brute-force versions of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h string, fp string, row int, line int, t int, n int, bytes string, word string, w string, score double, raw string, `a.b` string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in "ka lo mi ru te so va".split() for b in "n r s l d ndo ria".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(11)
    base = ["\n".join(sentence(rng, rng.randint(12, 40)).capitalize() + "." for _ in range(rng.randint(1, 5))) for _ in range(14)]
    out: list[str | None] = [None, "", "  \t\n ", "a", "12 34 !?", "one two", *base]
    out += [base[0], base[0], base[1].replace(" ", "  "), base[2].upper()]
    for b in base[3:8]:
        words = b.split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    passage = sentence(rng, 30)
    out += [f"{sentence(rng, 9)} {passage} {sentence(rng, 8)}" for _ in range(5)]
    out.append("<|endoftext|> inside <|endoftext|>text")
    out.append("Ελληνικά κείμενο, 漢字かな交じり文 и русский текст")
    out.append("naïve café é́ x " * 3)
    out.append("ab" * 200)
    out.append(" ".join(sentence(rng, 2000) for _ in range(12)))
    return out


def documents(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts())]
    rows.append((rows[6][0], rows[6][1]))  # a repeated row
    rows.append((None, texts()[7]))
    extra = ("x",) * 3 + (1, 2, 3, 4) + ("b", "w", "w2", 0.5, "r", "dot")
    full = [(i, t, "aa" if i is None or i % 2 else "bb", "s", len(t or ""), *extra) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))


def removed_bytes(rows, length: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for at in range(len(b) - length + 1):
            if i is not None:
                w = b[at : at + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if i is not None and first[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def order(rows) -> list:
    return sorted(rows, key=repr)
