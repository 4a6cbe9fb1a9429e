"""Small documents with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, part int, key string, label int"


def documents() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[40] = "changed"
    texts = {
        1: base, 2: " ".join(near), 3: base, 4: None, 5: "", 6: "   \n\t ", 7: "word", 8: "word", 9: "Word", 10: LONG,
        11: "é中文🙂 ñandú " * 30, 12: "Mail a.b.77@mail6.example.com or +1 (427) 555-5262, Mr. John Smith.", 13: "a.b.77@mail6.example.com again, 10.0.0.7 and 4785380592391139",
        14: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Г. Госпожа Анна Ким', 15: "Released under the MIT License. MIT license",
        16: "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", 17: "a" * 5_000, 18: "x  y \n z", 19: " ".join(word() for _ in range(4)),
    }
    rows = [(i, t, "en", "src0", len(t) if t else None, 0.5, 7, 1, "k", 0) for i, t in texts.items()]
    rows.append((20, "no language here", None, None, None, None, None, None, None, None))
    rows.append((None, base, "de", "src1", 5, 0.5, 7, 1, "k", 0))
    rows.append((1, base, "en", "src0", len(base), 0.5, 7, 1, "k", 0))  # a repeated row
    return rows
